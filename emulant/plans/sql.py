"""SQL fragments shared by the checks, as WITH-clauses to be joined."""

from emulant.functions.counter import normal_sql, uniform_sql
from emulant.functions.design import Design, Level
from emulant.functions.tree import LEAF

HISTORY = """
g AS (SELECT c_custkey AS id, c_acctbal, c_mktsegment, t::INTEGER AS t FROM customer, range(0, 6) r(t)),
o AS (SELECT o_custkey AS id, (year(o_orderdate) - 1995)::INTEGER AS t,
        max(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS tr,
        max(CASE WHEN o_totalprice >= 450000 THEN 1 ELSE 0 END) AS ev, sum(o_totalprice) AS spend
      FROM orders GROUP BY 1, 2),
j AS (SELECT g.id, g.t, coalesce(tr,0) AS A, coalesce(ev,0) AS ev, coalesce(spend,0) AS spend,
        c_acctbal, c_mktsegment FROM g LEFT JOIN o USING (id, t)),
h AS (SELECT *, coalesce(lag(A) OVER p, 0) AS Ap, coalesce(lag(A, 2) OVER p, 0) AS App,
        coalesce(sum(A) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS CAp,
        coalesce(max(ev) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Yp,
        ln(1 + coalesce(lag(spend) OVER p, 0)) AS X2
      FROM j WINDOW p AS (PARTITION BY id ORDER BY t)),
hist AS (SELECT *, greatest(ev, Yp) AS Y, CASE WHEN CAp = 0 AND Yp = 0 THEN 1 ELSE 0 END AS eligible,
        c_acctbal / 1000 AS X4 FROM h)"""

PANEL6 = HISTORY + """,
panel AS (SELECT * FROM hist WHERE Yp = 0)"""

PANEL = HISTORY + """,
panel AS (SELECT * FROM hist WHERE Yp = 0 AND t <= 4)"""

CENSORED = HISTORY + """,
flagged AS (SELECT *, CASE WHEN id % 7 = 0 AND t = (id // 7) % 4 THEN 1 ELSE 0 END AS C
  FROM hist WHERE Yp = 0 AND t <= 4),
marked AS (SELECT *, coalesce(max(C) OVER (PARTITION BY id ORDER BY t
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM flagged),
panel AS (SELECT * FROM marked WHERE dropped = 0)"""

TRIALS = """,
itt AS (SELECT p.id, s.t AS trial_period, p.t - s.t AS followup_time, s.A AS assigned_treatment,
    p.Y AS outcome, p.A AS treatment, s.X2, s.X4, s.c_mktsegment, p.t AS now,
    max(abs(p.A - s.A)) OVER (PARTITION BY p.id, s.t ORDER BY p.t) AS switched
  FROM panel p JOIN panel s ON p.id = s.id AND s.t <= p.t AND s.eligible = 1),
pp AS (SELECT * FROM itt WHERE switched = 0)"""

# Saturated models: fitted probabilities are group means.
WEIGHTS = """,
wm AS (SELECT *, avg(A) OVER (PARTITION BY Ap, c_mktsegment) AS pd, avg(A) OVER (PARTITION BY Ap) AS pn FROM panel),
wv AS (SELECT *, CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END AS wt FROM wm),
cw AS (SELECT *, product(wt) OVER (PARTITION BY id ORDER BY t) AS cum_weight FROM wv)"""

WEIGHTED = TRIALS + WEIGHTS + """,
wpp AS (SELECT pp.*, a.cum_weight / b.cum_weight AS weight FROM pp
  JOIN cw a ON a.id = pp.id AND a.t = pp.now JOIN cw b ON b.id = pp.id AND b.t = pp.trial_period)"""

CELLS = """,
cell AS (SELECT assigned_treatment, followup_time, sum(weight * outcome) / sum(weight) AS p,
    sum(weight) AS sw FROM wpp GROUP BY 1, 2),
surv AS (SELECT assigned_treatment, followup_time,
    product(1 - p) OVER (PARTITION BY assigned_treatment ORDER BY followup_time) AS s FROM cell),
curve AS (SELECT a.followup_time, a.s AS survival_treatment, b.s AS survival_control,
    a.s - b.s AS survival_difference, a.s / b.s AS survival_ratio, b.s - a.s AS mrd
  FROM surv a JOIN surv b USING (followup_time) WHERE a.assigned_treatment = 1 AND b.assigned_treatment = 0)"""


TREE_LEVELS = 6  # levels of the splitting tree that the SQL can walk: up to 256 * 2**6 persons


def draws(replicates: int, seed: int, source: str = "pp") -> str:
    """Person numbers, draws by the splitting tree, and counts (zeros included)."""
    out = f""",
ids AS (SELECT DISTINCT id FROM {source}),
ix AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 4096, id) - 1 AS idx
  FROM ids),
total AS (SELECT count(*) AS n, greatest(0, ceil(log2(greatest(count(*), 1) / {LEAF})))::INTEGER AS levels FROM ids),
nd0 AS (SELECT r.rep::INTEGER AS rep, 0::BIGINT AS j, n AS m, n, levels FROM total, range(0, {replicates}) r(rep))"""
    for k in range(TREE_LEVELS):
        u = uniform_sql(seed, ["rep", f"{1 << k} + j", "0"])
        out += f""",
sp{k} AS (SELECT rep, j, m, n, levels, (n * (2 * j + 1) // {2 << k} - n * j // {1 << k}) / (n * (j + 1) // {1 << k} - n * j // {1 << k}) AS p,
    {u} AS u FROM nd{k} WHERE levels > {k}),
cd{k} AS (SELECT rep, j, u, m, n, levels, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)))
    OVER (PARTITION BY rep, j ORDER BY k) AS reached FROM (SELECT *, unnest(range(m + 1)) AS k FROM sp{k})),
lf{k} AS (SELECT rep, j, any_value(m) AS m, any_value(n) AS n, any_value(levels) AS levels,
    least(count(*) FILTER (reached < u), any_value(m)) AS l FROM cd{k} GROUP BY 1, 2),
nd{k + 1} AS (SELECT rep, 2 * j AS j, l AS m, n, levels FROM lf{k} UNION ALL SELECT rep, 2 * j + 1, m - l, n, levels FROM lf{k}
  UNION ALL SELECT * FROM nd{k} WHERE levels <= {k})"""
    u = uniform_sql(seed, ["rep", "(1 << levels) + j", "1 + d"])
    return out + f""",
dr AS (SELECT rep, lo + least(floor({u} * (hi - lo))::BIGINT, hi - lo - 1) AS idx
  FROM (SELECT rep, j, levels, n * j // (1 << levels) AS lo, n * (j + 1) // (1 << levels) AS hi, unnest(range(m)) AS d FROM nd{TREE_LEVELS})),
drawn AS (SELECT rep, id, count(*) AS n FROM dr JOIN ix USING (idx) GROUP BY 1, 2),
counts AS (SELECT r.rep::INTEGER AS rep, i.id, coalesce(d.n, 0) AS n FROM ids i CROSS JOIN range(0, {replicates}) r(rep)
  LEFT JOIN drawn d ON d.rep = r.rep AND d.id = i.id)"""


def leave_one_out(source: str = "pp") -> str:
    """One replicate per person: everybody counts once but the person left out."""
    return f""",
ids AS (SELECT DISTINCT id FROM {source}),
ix AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 4096, id) - 1 AS idx
  FROM ids),
counts AS (SELECT k.idx::INTEGER AS rep, i.id, CASE WHEN i.idx = k.idx THEN 0 ELSE 1 END AS n FROM ix k CROSS JOIN ix i)"""


REFIT_WEIGHTS = """,
rm AS (SELECT p.*, c.rep, c.n,
    sum(c.n * A) OVER (PARTITION BY rep, Ap, c_mktsegment) / nullif(sum(c.n) OVER (PARTITION BY rep, Ap, c_mktsegment), 0) AS pd,
    sum(c.n * A) OVER (PARTITION BY rep, Ap) / nullif(sum(c.n) OVER (PARTITION BY rep, Ap), 0) AS pn
  FROM panel p JOIN counts c USING (id)),
rv AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END AS wt FROM rm),
rc AS (SELECT *, product(wt) OVER (PARTITION BY rep, id ORDER BY t) AS cum_weight FROM rv)"""

# One Newton step from the group means: logit(p) + score / information, per cell.
STEP_WEIGHTS = """,
f0 AS (SELECT *, avg(A) OVER (PARTITION BY Ap, c_mktsegment) AS pd, avg(A) OVER (PARTITION BY Ap) AS pn FROM panel),
f1 AS (SELECT f0.*, c.rep, c.n FROM f0 JOIN counts c USING (id)),
f2 AS (SELECT *, ln(pd / (1 - pd)) + sum(n * (A - pd)) OVER sd / sum(pd * (1 - pd)) OVER sd AS bd,
    ln(pn / (1 - pn)) + sum(n * (A - pn)) OVER sn / sum(pn * (1 - pn)) OVER sn AS bn FROM f1
  WINDOW sd AS (PARTITION BY rep, Ap, c_mktsegment), sn AS (PARTITION BY rep, Ap)),
rv AS (SELECT * EXCLUDE (pd, pn), 1 / (1 + exp(-bd)) AS pd, 1 / (1 + exp(-bn)) AS pn FROM f2),
rw AS (SELECT *, CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END AS wt FROM rv),
rc AS (SELECT *, product(wt) OVER (PARTITION BY rep, id ORDER BY t) AS cum_weight FROM rw)"""

# The same with drop-out models by stratum.
REFIT_WEIGHTS_DROPOUT = """,
rm AS (SELECT p.*, k.rep, k.n,
    sum(k.n * p.A) OVER d / nullif(sum(k.n) OVER d, 0) AS pd, sum(k.n * p.A) OVER a / nullif(sum(k.n) OVER a, 0) AS pn,
    sum(k.n * (1 - p.C)) OVER d / nullif(sum(k.n) OVER d, 0) AS cd, sum(k.n * (1 - p.C)) OVER a / nullif(sum(k.n) OVER a, 0) AS cn
  FROM panel p JOIN counts k USING (id) WINDOW d AS (PARTITION BY k.rep, p.Ap, p.c_mktsegment), a AS (PARTITION BY k.rep, p.Ap)),
rv AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN A = 1 THEN pn / pd * cn / cd ELSE (1 - pn) / (1 - pd) * cn / cd END AS wt FROM rm),
rc AS (SELECT *, product(wt) OVER (PARTITION BY rep, id ORDER BY t) AS cum_weight FROM rv)"""

WEIGHTED_DROPOUT = TRIALS + """,
wm AS (SELECT *, avg(A) OVER d AS pd, avg(A) OVER a AS pn, avg(1 - C) OVER d AS cd, avg(1 - C) OVER a AS cn FROM panel
  WINDOW d AS (PARTITION BY Ap, c_mktsegment), a AS (PARTITION BY Ap)),
wv AS (SELECT *, CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END * cn / cd AS wt FROM wm),
cw AS (SELECT *, product(wt) OVER (PARTITION BY id ORDER BY t) AS cum_weight FROM wv),
wpp AS (SELECT pp.*, a.cum_weight / b.cum_weight AS weight FROM pp
  JOIN cw a ON a.id = pp.id AND a.t = pp.now JOIN cw b ON b.id = pp.id AND b.t = pp.trial_period)"""

STEP_WEIGHTS_DROPOUT = """,
f1 AS (SELECT w.* EXCLUDE (wt), k.rep, k.n FROM wv w JOIN counts k USING (id)),
f2 AS (SELECT *, ln(pd / (1 - pd)) + sum(n * (A - pd)) OVER sd / sum(pd * (1 - pd)) OVER sd AS bd,
    ln(pn / (1 - pn)) + sum(n * (A - pn)) OVER sn / sum(pn * (1 - pn)) OVER sn AS bn,
    ln(cd / (1 - cd)) + sum(n * (1 - C - cd)) OVER sd / sum(cd * (1 - cd)) OVER sd AS bcd,
    ln(cn / (1 - cn)) + sum(n * (1 - C - cn)) OVER sn / sum(cn * (1 - cn)) OVER sn AS bcn FROM f1
  WINDOW sd AS (PARTITION BY rep, Ap, c_mktsegment), sn AS (PARTITION BY rep, Ap)),
rv AS (SELECT * EXCLUDE (pd, pn, cd, cn), 1 / (1 + exp(-bd)) AS pd, 1 / (1 + exp(-bn)) AS pn, 1 / (1 + exp(-bcd)) AS cd, 1 / (1 + exp(-bcn)) AS cn FROM f2),
rw AS (SELECT *, CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END * cn / cd AS wt FROM rv),
rc AS (SELECT *, product(wt) OVER (PARTITION BY rep, id ORDER BY t) AS cum_weight FROM rw)"""

REPLICATE_ROWS = """,
rr AS (SELECT a.rep, a.n, pp.*, CASE WHEN a.n = 0 THEN 0 ELSE a.n * a.cum_weight / b.cum_weight END AS w
  FROM pp JOIN rc a ON a.id = pp.id AND a.t = pp.now
  JOIN rc b ON b.id = pp.id AND b.t = pp.trial_period AND b.rep = a.rep)"""

REFIT_CELLS = """,
rp AS (SELECT rep, assigned_treatment, followup_time,
    CASE WHEN sum(w) > 0 THEN sum(w * outcome) / sum(w) ELSE 0.5 END AS p FROM rr GROUP BY 1, 2, 3)"""

STEP_CELLS = """,
rb AS (SELECT rr.rep, assigned_treatment, followup_time, any_value(ln(cell.p / (1 - cell.p)))
    + sum(rr.w * (rr.outcome - cell.p)) / any_value(cell.sw * cell.p * (1 - cell.p)) AS b
  FROM rr JOIN cell USING (assigned_treatment, followup_time) GROUP BY 1, 2, 3),
rp AS (SELECT *, 1 / (1 + exp(-b)) AS p FROM rb)"""

REPLICATE_CURVES = """,
share AS (SELECT rep, sum(n) / count(*) AS s FROM rr WHERE trial_period = 0 AND followup_time = 0 GROUP BY 1),
rs AS (SELECT rep, assigned_treatment, followup_time, product(1 - p) OVER
    (PARTITION BY rep, assigned_treatment ORDER BY followup_time) AS s FROM rp),
reps AS (SELECT a.rep, a.followup_time, a.s * share.s AS survival_treatment, b.s * share.s AS survival_control,
    (a.s - b.s) * share.s AS survival_difference, a.s / b.s AS survival_ratio, (b.s - a.s) * share.s AS mrd
  FROM rs a JOIN rs b USING (rep, followup_time) JOIN share USING (rep)
  WHERE a.assigned_treatment = 1 AND b.assigned_treatment = 0)"""

EVENT_HISTORY = """
b AS (SELECT user_id AS id, least(floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 5), 5)::INTEGER AS t,
    CASE WHEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END AS A,
    max(CASE WHEN event_type = 'error' AND value >= 120 THEN 1 ELSE 0 END) AS ev, sum(value) AS spend
  FROM events GROUP BY 1, 2),
u AS (SELECT DISTINCT user_id AS id FROM events),
j AS (SELECT u.id, r.t::INTEGER AS t, coalesce(b.A, 0) AS A, coalesce(b.ev, 0) AS ev, coalesce(b.spend, 0) AS spend
  FROM u CROSS JOIN range(0, 6) r(t) LEFT JOIN b ON b.id = u.id AND b.t = r.t),
h AS (SELECT *, coalesce(lag(A) OVER p, 0) AS Ap,
    coalesce(sum(A) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS CAp,
    coalesce(max(ev) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Yp,
    ln(1 + coalesce(lag(spend) OVER p, 0)) AS X2,
    ln(1 + first_value(spend) OVER p) AS X4
  FROM j WINDOW p AS (PARTITION BY id ORDER BY t)),
seen AS (SELECT *, greatest(ev, Yp) AS Y, CASE WHEN CAp = 0 AND Yp = 0 THEN 1 ELSE 0 END AS eligible,
    CASE WHEN t = 0 THEN 'first' ELSE 'later' END AS c_mktsegment FROM h WHERE Yp = 0)"""

EVENT_PANEL = EVENT_HISTORY + """,
panel AS (SELECT * FROM seen WHERE t <= 2)"""

EVENT_PANEL5 = EVENT_HISTORY + """,
panel AS (SELECT * FROM seen WHERE t <= 4)"""

ESTIMATES = """
li AS (SELECT l_orderkey, l_linenumber - 1 AS v, avg(l_discount) AS d, avg(l_tax) AS x, avg(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2),
est AS (SELECT (['low','med','high'])[((l_orderkey // 27) % 3 + 1)::INTEGER] AS outcome,
    (l_orderkey % 27 + 1)::INTEGER AS scenario, l_orderkey * 2 + CASE WHEN v >= 5 THEN 1 ELSE 0 END AS iter,
    (v % 5)::INTEGER AS visit, exp(-x) - exp(-d) AS est, exp(-x) AS surv0, exp(-d) AS surv1,
    0.02 * exp(q / 50) AS half FROM li)"""

RESULTS = ESTIMATES + """,
meth AS (SELECT * FROM (VALUES (0,'bootstrap'),(1,'lef_outcome'),(2,'lef_both'),(3,'sandwich'),
    (4,'jackknife_mvn'),(5,'jackknife_wald')) m(m, method)),
ci AS (SELECT outcome, scenario, iter, visit, method, est,
    CASE WHEN ((iter // 2) + m) % 11 <> 0 THEN est - 0.9 * (half * (1 + 0.1 * m)) END AS lb,
    CASE WHEN ((iter // 2) + m) % 11 <> 0 THEN est + 1.1 * (half * (1 + 0.1 * m)) END AS ub
  FROM est CROSS JOIN meth)"""

TRUTH = """,
setting AS (SELECT outcome, (scenario - 1) % 9 AS setting, visit, round(avg(est), 6) AS mrd,
    round(avg(surv0), 6) AS surv0, round(avg(surv1), 6) AS surv1 FROM est GROUP BY 1, 2, 3),
truth AS (SELECT outcome, (setting + 1 + 9 * i)::INTEGER AS scenario, visit, mrd, surv0, surv1
  FROM setting CROSS JOIN range(0, 3) s(i))"""

GRID = """,
grid AS (SELECT (1 + 9 * i + 3 * j + k)::INTEGER AS scenario, ([200, 1000, 5000])[i + 1] AS size,
    ([0.1, 0.5, 0.9])[j + 1]::DOUBLE AS conf, ([-1, 0, 1])[k + 1] AS treat
  FROM range(0, 3) a(i), range(0, 3) b(j), range(0, 3) c(k))"""


# ---- regression in SQL ----------------------------------------------------------------


def design_list(design: Design) -> str:
    """The terms of a design as a list of doubles."""

    def factor(f) -> str:
        if isinstance(f, Level):
            value = f"'{f.value}'" if isinstance(f.value, str) else str(f.value)
            return f"(CASE WHEN {f.column} = {value} THEN 1.0 ELSE 0.0 END)"
        return "(" + " * ".join([f'"{f.column}"'] * f.exponent) + ")"

    return "[" + ", ".join(" * ".join(["1.0", *map(factor, t.factors)]) for t in design.terms) + "]::DOUBLE[]"


def eliminated(matrix: str, p: int, whole: bool = True, tol: float = 1e-7) -> str:
    """A matrix (list of rows) after Gauss-Jordan elimination of its first ``p`` columns; with ``whole`` false
    only below the diagonal. Columns whose pivot is next to 0 are left out: their row becomes zeros."""
    k = "k[1][1]::BIGINT"
    good = f"m[{k}][{k}] > {tol}"
    below = f"list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}])"
    own = f"CASE WHEN {good} THEN list_transform(r, lambda v: v / m[{k}][{k}]) ELSE list_transform(r, lambda v: 0.0::DOUBLE) END" if whole else "r"
    steps = ", ".join(f"[[{i + 1}.0]]" for i in range(p))
    return (
        f"list_reduce(list_concat([{matrix}], [{steps}]::DOUBLE[][][]), lambda m, k: list_transform(m, lambda r, i: "
        f"CASE WHEN i = {k} THEN {own} WHEN {good} AND {'true' if whole else f'i > {k}'} THEN {below} ELSE r END))"
    )


def logit(name: str, rows: str, p: int, passes: int = 12) -> str:
    """Weighted logistic regressions by Newton's method: ``name`` has (g, b, cov) for each group of ``rows`` (g, x, y, w).

    ``b`` is a list, 0 for aliased terms; ``cov`` the inverse information, a list of rows.
    """
    out = f""",
{name}_r AS MATERIALIZED (SELECT g, x, y::DOUBLE AS y, w::DOUBLE AS w FROM ({rows}) WHERE w > 0),
{name}_0 AS MATERIALIZED (SELECT g, list_transform(range({p}), lambda i: 0.0::DOUBLE) AS b FROM {name}_r GROUP BY 1)"""

    def sums(k: int, tail: str) -> str:
        return f""",
{name}_e{k} AS (SELECT r.g, x, w, y, 1 / (1 + exp(-list_dot_product(x, b))) AS q FROM {name}_r r JOIN {name}_{k} USING (g)),
{name}_s{k} AS (SELECT g, i, sum(w * (y - q) * x[i + 1]) AS s FROM {name}_e{k}, range({p}) t(i) GROUP BY 1, 2),
{name}_i{k} AS (SELECT g, i, j, sum(w * q * (1 - q) * x[i + 1] * x[j + 1]) AS v FROM {name}_e{k}, range({p}) t(i), range({p}) u(j) GROUP BY 1, 2, 3),
{name}_l{k} AS (SELECT g, i, list(v ORDER BY j) AS l FROM {name}_i{k} GROUP BY 1, 2),
{name}_m{k} AS (SELECT l.g, list(list_concat(l.l, {tail}) ORDER BY l.i) AS m FROM {name}_l{k} l JOIN {name}_s{k} s ON l.g = s.g AND l.i = s.i GROUP BY 1),
{name}_x{k} AS MATERIALIZED (SELECT g, {eliminated('m', p)} AS m FROM {name}_m{k})"""

    for k in range(passes):
        out += sums(k, "[s.s]") + f""",
{name}_{k + 1} AS MATERIALIZED (SELECT g, list_transform(b, lambda v, i: v + m[i][{p + 1}]) AS b FROM {name}_{k} JOIN {name}_x{k} USING (g))"""
    unit = f"list_transform(range({p}), lambda c: CASE WHEN c = l.i THEN 1.0 ELSE 0.0 END::DOUBLE)"
    return out + sums(passes, unit) + f""",
{name} AS MATERIALIZED (SELECT g, b, list_transform(m, lambda r: r[{p + 1}:]) AS cov FROM {name}_{passes} JOIN {name}_x{passes} USING (g))"""


def weighted_by(design: Design, censor: Design | None = None) -> str:
    """``WEIGHTED`` with switch models (and drop-out models, by stratum) that have no closed form."""
    out = TRIALS + logit("swd", f"SELECT Ap AS g, {design_list(design)} AS x, A AS y, 1.0 AS w FROM panel", len(design))
    drop, ratio = "", ""
    if censor is not None:
        out += logit("cnd", f"SELECT Ap AS g, {design_list(censor)} AS x, 1 - C AS y, 1.0 AS w FROM panel", len(censor))
        drop = f", 1 / (1 + exp(-list_dot_product({design_list(censor)}, cnd.b))) AS cd, avg(1 - C) OVER (PARTITION BY Ap) AS cn"
        ratio = " * cn / cd"
    joined = " JOIN cnd ON cnd.g = Ap" if censor is not None else ""
    return out + f""",
wm AS (SELECT panel.*, 1 / (1 + exp(-list_dot_product({design_list(design)}, swd.b))) AS pd, avg(A) OVER (PARTITION BY Ap) AS pn{drop}
  FROM panel JOIN swd ON swd.g = Ap{joined}),
wv AS (SELECT *, CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END{ratio} AS wt FROM wm),
cw AS (SELECT *, product(wt) OVER (PARTITION BY id ORDER BY t) AS cum_weight FROM wv),
wpp AS (SELECT pp.*, a.cum_weight / b.cum_weight AS weight FROM pp
  JOIN cw a ON a.id = pp.id AND a.t = pp.now JOIN cw b ON b.id = pp.id AND b.t = pp.trial_period)"""


def outcome_by(design: Design) -> str:
    """The weighted outcome model ``oc``."""
    return logit("oc", f"SELECT 0 AS g, {design_list(design)} AS x, outcome AS y, weight AS w FROM wpp", len(design))


def curves_by(design: Design, visits: int, coefs: str = "SELECT 0 AS rep, b FROM oc") -> str:
    """``marks``: curves of each row (rep, b) of ``coefs``, standardised over the first trial."""
    return f""",
bs AS (SELECT id, X2, X4, c_mktsegment FROM pp WHERE trial_period = 0 AND followup_time = 0),
cx AS MATERIALIZED (SELECT id, assigned_treatment, followup_time, {design_list(design)} AS x FROM bs, range(2) a(assigned_treatment), range({visits}) k(followup_time)),
ch AS (SELECT rep, id, assigned_treatment, followup_time, 1 - 1 / (1 + exp(-list_dot_product(x, b))) AS s FROM cx, ({coefs})),
cs AS (SELECT *, product(s) OVER (PARTITION BY rep, id, assigned_treatment ORDER BY followup_time) AS alive FROM ch),
mn AS (SELECT rep, assigned_treatment, followup_time, avg(alive) AS s FROM cs GROUP BY 1, 2, 3),
marks AS (SELECT a.rep, a.followup_time::INTEGER AS followup_time, a.s AS survival_treatment, b.s AS survival_control, a.s - b.s AS survival_difference,
    a.s / b.s AS survival_ratio, b.s - a.s AS mrd FROM mn a JOIN mn b USING (rep, followup_time)
  WHERE a.assigned_treatment = 1 AND b.assigned_treatment = 0)"""


def robust_by(design: Design) -> str:
    """``rv``: robust covariance of ``oc`` (i, j, v), scores added up by person."""
    p = len(design)
    return f""",
rs1 AS (SELECT id, i, sum(weight * (outcome - 1 / (1 + exp(-list_dot_product(x, b)))) * x[i + 1]) AS s
  FROM (SELECT id, weight, outcome, {design_list(design)} AS x FROM wpp), oc, range({p}) t(i) GROUP BY 1, 2),
rmeat AS (SELECT a.i, b.i AS j, sum(a.s * b.s) AS m FROM rs1 a JOIN rs1 b USING (id) GROUP BY 1, 2),
rn AS (SELECT count(DISTINCT id) AS n FROM wpp),
rleft AS (SELECT c.i, m.j, sum(cov[c.i + 1][m.i + 1] * m.m) AS v FROM oc, range({p}) c(i), rmeat m GROUP BY 1, 2),
rv AS MATERIALIZED (SELECT l.i, c.j, sum(l.v * cov[l.j + 1][c.j + 1]) * any_value(n / (n - 1)) AS v FROM oc, rleft l, range({p}) c(j), rn GROUP BY 1, 2)"""


def normal_by(p: int, draws: int, seed: int, covariance: str, mean: str) -> str:
    """``drawn_b``: (rep, b) of normal draws; ``covariance`` has (i, j, v) and ``mean`` (i, m), both from 0."""
    return f""",
nl AS (SELECT i, list(v ORDER BY j) AS l, max(CASE WHEN i = j THEN v END) AS top FROM ({covariance}) GROUP BY 1),
nm AS MATERIALIZED (SELECT {eliminated('list(l ORDER BY i)', p, whole=False, tol=1e-14)} AS m FROM nl),
nz AS MATERIALIZED (SELECT d, j, {normal_sql(seed, 'd', 'j')} AS z FROM range({draws}) a(d), range({p}) b(j)),
nb AS (SELECT d, t.i, any_value(t.m) + sum(CASE WHEN j <= t.i AND nm.m[j + 1][j + 1] > 1e-14 THEN nm.m[j + 1][t.i + 1] / sqrt(nm.m[j + 1][j + 1]) * z ELSE 0 END) AS v
  FROM nz, nm, ({mean}) t GROUP BY 1, 2),
drawn_b AS MATERIALIZED (SELECT d::INTEGER AS rep, list(v ORDER BY i) AS b FROM nb GROUP BY 1)"""
