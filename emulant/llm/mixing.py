"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same number of copies on average, target / size of
the source. Its whole part is taken at once; the rest is a fractional probability of one
copy more. Two fractions meet, and an amount of words moves from one to the other, up or
down at random so that no average changes, until one of them is a whole number. The sum
of words stays as it is in every meeting, so a source misses its target by less than the
one document left at the end, which is its smallest of those that met last.

Meetings happen in groups of about ``GROUP`` documents by hash; what is left of each
group goes on to the next level, where ``GROUP`` groups meet, until one is left for each
source: a reduction tree of log(n) levels, whatever the size of a source. All draws are
hashes of the document, so reruns agree.

Documents with the same id, source and size are one unit of several rows; the copies of
the unit are dealt over its rows. Null ids are ids of their own, null sources come last,
null and empty texts have size 0, are taken 0 times and count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulant.llm.quality import WORD
from emulant.session import written

GROUP = 48
WEIGHTS = (5, 2, 1)
EPS = 1e-9


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``share`` of all words is dealt by weight; a target stops at ``most`` times its
    source, and the excess is dealt again. That is one common level: sources whose
    limit per weight lies lowest are full, the others share what is left by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # Along the limits, the first source that isn't full sets the level for all after it.
    level = ranked.withColumn("_level", left / weight_left)
    level = level.withColumn("_open", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    common = F.first("_open", ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), common * F.col("_w")).otherwise(F.col("_cap"))
    return level.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """Number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


UNIT = "struct<key:string,size:bigint,p:double>"
DONE = "array<struct<key:string,size:bigint,up:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _meet(a: Column, b: Column, seed: int) -> Column:
    """struct(done, rest) of two units with fractions: one becomes whole, the other goes on."""

    def move(x: Column) -> Column:
        up = _uniform(F.lit(seed), a["key"], a["size"], b["key"], b["size"]) * (x["give"] + x["take"]) < x["take"]
        return F.when(up, x["give"]).otherwise(-x["take"])

    def settled(x: Column) -> Column:
        return F.struct(
            F.struct(
                F.when(x["whole"], a["key"]).otherwise(b["key"]).alias("key"),
                F.when(x["whole"], a["size"]).otherwise(b["size"]).alias("size"),
                F.round(F.when(x["whole"], x["pa"]).otherwise(x["pb"])).cast("int").alias("up"),
            ).alias("done"),
            F.struct(
                F.when(x["whole"], b["key"]).otherwise(a["key"]).alias("key"),
                F.when(x["whole"], b["size"]).otherwise(a["size"]).alias("size"),
                F.when(x["whole"], x["pb"]).otherwise(x["pa"]).alias("p"),
            ).alias("rest"),
        )

    def nearer(x: Column) -> Column:
        """The one nearer to a whole number is done; rounding errors cannot keep both open."""
        return F.struct(
            x["pa"].alias("pa"), x["pb"].alias("pb"), (F.least(x["pa"], 1 - x["pa"]) <= F.least(x["pb"], 1 - x["pb"])).alias("whole")
        )

    amounts = F.struct(
        F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("give"),  # words a can gain from b
        F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"]).alias("take"),
    )
    moved = _let(amounts, move)
    after = _let(moved, lambda m: F.struct((a["p"] + m / a["size"]).alias("pa"), (b["p"] - m / b["size"]).alias("pb")))
    return _let(_let(after, nearer), settled)


def _level(units: DataFrame, seed: int) -> DataFrame:
    """One level: (source, bucket, done, rest) from (source, bucket, key, size, p)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("size"), F.col("key"), F.col("p"))), asc=False)
    groups = units.groupBy("source", "bucket").agg(ordered.alias("units"))
    unit = lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["p"].alias("p"))
    start = F.struct(F.array().cast(DONE).alias("done"), unit(F.element_at("units", 1)).cast(UNIT).alias("rest"))

    def step(acc, x):
        return _let(
            _meet(acc["rest"], unit(x), seed),
            lambda met: F.struct(
                F.concat(acc["done"], F.array(met["done"])).cast(DONE).alias("done"), met["rest"].cast(UNIT).alias("rest")
            ),
        )

    run = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, step)
    return groups.select("source", "bucket", run.alias("run")).select("source", "bucket", "run.done", "run.rest")


def pivotal_round(units: DataFrame, seed: int = 1) -> DataFrame:
    """(source, key, size, up 0/1) from (source, key, size, p) with 0 < p < 1.

    Each level is written to the shared folder, where its lineage ends.
    """
    sources = units.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    largest = sources.agg(F.max("_n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.ceil(F.col("_n") / GROUP))
    same = F.expr("_s <=> source")
    now = units.join(sources.withColumnRenamed("source", "_s"), same).withColumn("bucket", bucket).drop("_s", "_n")
    out, groups, level = [], -(-largest // GROUP), 0
    while True:
        met = written(_level(now, seed + level), f"mixing-{level}")
        out.append(met.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.size", "d.up"))
        now = met.select("source", F.floor(F.col("bucket") / GROUP).alias("bucket"), "rest.key", "rest.size", "rest.p")
        if groups <= 1:
            break
        groups, level = -(-groups // GROUP), level + 1
    last = now.select(
        "source", "key", "size", (_uniform(F.lit(seed), F.lit("last"), F.col("key"), F.col("size")) < F.col("p")).cast("int").alias("up")
    )
    for done in out:
        last = last.unionByName(done)
    return last


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """``docs`` with the struct column ``mix``: size, source_size, target, copies, taken.

    Needs doc_id, text and source. ``copies`` is how often the row enters the mix.
    """
    key, size, src = "_mix_key", "_mix_size", "_mix_source"
    keyed = (
        docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        .withColumn(size, text_size(F.col("text")))
        .withColumn(src, F.col("source"))
    )
    units = written(
        keyed.groupBy(F.col(src).alias("source"), F.col(key).alias("key"), F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("rows")),
        "mixing-units",
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most), "mixing-targets")
    named = targets.withColumnRenamed("source", "_s")
    wanted = units.join(named, F.expr("_s <=> source")).drop("_s")
    mass = F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A fraction that is whole but for rounding errors needs no draw.
    wanted = wanted.withColumn("base", F.floor(mass + EPS)).withColumn("p", F.greatest(mass - F.col("base"), F.lit(0.0)))
    rounded = pivotal_round(wanted.filter(F.col("p") > EPS).select("source", "key", "size", "p"), seed)
    rounded = rounded.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("size").alias("_z"), "up")
    decided = wanted.join(rounded, F.expr("_s <=> source AND _k = key AND _z = size"), "left").select(
        F.col("source").alias("_s"),
        F.col("key").alias("_k"),
        F.col("size").alias("_z"),
        F.col("rows").alias("_rows"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        (F.col("base") + F.coalesce("up", F.lit(0))).alias("_copies"),
    )
    joined = keyed.join(decided, F.expr(f"_s <=> {src} AND _k = {key} AND _z = {size}"))
    nth = F.row_number().over(Window.partitionBy(key, size, src).orderBy(F.xxhash64("text")))
    each = F.floor(F.col("_copies") / F.col("_rows"))
    copies = F.when(F.col("_rows") == 1, F.col("_copies")).otherwise(
        each + (nth <= F.col("_copies") - each * F.col("_rows")).cast("long")
    )
    mix = F.struct(
        F.col(size).alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col(size)).alias("taken"),
    )
    return joined.withColumn("mix", mix).select(*docs.columns, "mix")
