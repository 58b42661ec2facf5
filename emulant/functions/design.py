"""Model designs as lists of products, usable from Spark and from numpy.

A term is a product of factors. A factor is a column, a ``Level`` (1 when the
column equals a value) or a ``Power``. The empty product is the intercept. The
same design yields Spark column expressions, which is how single fits and
predictions run, and numpy columns, which is how the replicate kernel builds its
matrix from a handful of raw columns instead of shipping every product.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """1 where ``column`` equals ``value``, else 0."""

    column: str
    value: object

    @property
    def label(self) -> str:
        return f"{self.column}={self.value}"

    def spark(self) -> Column:
        return (F.col(self.column) == F.lit(self.value)).cast("double")

    def numpy(self, data: Mapping[str, np.ndarray]) -> np.ndarray:
        values = np.asarray(data[self.column])
        out = (values == self.value).astype(np.float64)
        if values.dtype.kind == "f":
            out[np.isnan(values)] = np.nan  # a missing level leaves the row out, as in Spark
        return out


@dataclass(frozen=True)
class Power:
    """``column`` raised to a whole exponent."""

    column: str
    exponent: int = 1

    @property
    def label(self) -> str:
        return self.column if self.exponent == 1 else f"{self.column}^{self.exponent}"

    def spark(self) -> Column:
        col = F.col(self.column).cast("double")
        return reduce(lambda a, b: a * b, [col] * self.exponent)

    def numpy(self, data: Mapping[str, np.ndarray]) -> np.ndarray:
        return np.asarray(data[self.column], dtype=np.float64) ** self.exponent


@dataclass(frozen=True)
class Term:
    """Named product of factors; no factor at all is the intercept."""

    name: str
    factors: tuple[Level | Power, ...] = ()

    def spark(self) -> Column:
        return reduce(lambda a, b: a * b, [f.spark() for f in self.factors], F.lit(1.0))

    def numpy(self, data: Mapping[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n)
        for factor in self.factors:
            out = out * factor.numpy(data)
        return out


def _factor(item) -> Level | Power:
    return Power(item) if isinstance(item, str) else item


@dataclass(frozen=True)
class Design:
    """Ordered terms of a model."""

    terms: tuple[Term, ...]

    @staticmethod
    def of(*items, intercept: bool = True) -> Design:
        """Build from column names, factors, tuples of factors, or ready terms."""
        terms: list[Term] = [Term("(Intercept)")] if intercept else []
        for item in items:
            if isinstance(item, Term):
                terms.append(item)
                continue
            factors = tuple(_factor(i) for i in (item if isinstance(item, tuple) else (item,)))
            terms.append(Term(":".join(f.label for f in factors), factors))
        return Design(tuple(terms))

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    @property
    def columns(self) -> list[str]:
        """Raw columns the design reads, in first-use order."""
        seen: dict[str, None] = {}
        for term in self.terms:
            for factor in term.factors:
                seen.setdefault(factor.column)
        return list(seen)

    def __len__(self) -> int:
        return len(self.terms)

    def without(self, names: Iterable[str]) -> Design:
        drop = set(names)
        return Design(tuple(t for t in self.terms if t.name not in drop))

    def levels(self, column: str) -> list:
        """Values of ``column`` that terms compare with."""
        found = {f.value: None for t in self.terms for f in t.factors if isinstance(f, Level) and f.column == column}
        return list(found)

    def coded(self, codes: Mapping[str, list]) -> Design:
        """The same design over columns whose values were replaced by list positions."""

        def swap(f):
            if isinstance(f, Level) and f.column in codes:
                return Level(f.column, codes[f.column].index(f.value))
            return f

        return Design(tuple(Term(t.name, tuple(swap(f) for f in t.factors)) for t in self.terms))

    def vector(self) -> Column:
        """All terms of a row as ``array<double>``."""
        return F.array(*[t.spark() for t in self.terms])

    def matrix(self, data: Mapping[str, np.ndarray], n: int) -> np.ndarray:
        return np.stack([t.numpy(data, n) for t in self.terms], axis=1)


def visit_terms(
    visits: int,
    covariates: Iterable[str] = (),
    treatment: str = "assigned_treatment",
    time: str = "followup_time",
) -> Design:
    """Outcome design with one dummy per later visit and its interactions.

    Covariates, treatment, visit dummies, then dummy x treatment and dummy x
    covariate, in that order.
    """
    covariates = list(covariates)
    levels = [Level(time, k) for k in range(1, visits)]
    items: list = [*covariates, treatment]
    items += [Term(f"t_{lv.value}", (lv,)) for lv in levels]
    items += [Term(f"t_{lv.value}A", (lv, Power(treatment))) for lv in levels]
    for name in covariates:
        items += [Term(f"t_{lv.value}{name}", (lv, Power(name))) for lv in levels]
    return Design.of(*items)


def linear_time_terms(
    covariates: Iterable[str] = (),
    treatment: str = "assigned_treatment",
    time: str = "followup_time",
    interactions: bool = True,
) -> Design:
    """Outcome design with linear and squared follow-up time.

    With ``interactions`` the products of time with treatment and with each
    covariate are added.
    """
    covariates = list(covariates)
    items: list = [*covariates, treatment, time, Power(time, 2)]
    if interactions:
        items.append(Term("tA", (Power(time), Power(treatment))))
        items += [Term(f"t{name}", (Power(time), Power(name))) for name in covariates]
    return Design.of(*items)


def cell_terms(*columns_levels: tuple[str, Iterable]) -> Design:
    """Saturated design with one 0/1 term per combination of levels, no intercept."""
    combos: list[tuple[Level, ...]] = [()]
    for column, levels in columns_levels:
        combos = [c + (Level(column, v),) for c in combos for v in levels]
    return Design.of(*combos, intercept=False)
