"""URL filter: association rules over URL tokens, mined by FP-growth from labels.

A page is bad if its label says low quality or toxic. The tokens of its URL (parts of the
host, of the path, and names of the query's fields, each marked by its place) and, for bad
pages, the item ``label=bad`` are one transaction. FP-growth finds frequent sets; the
rules {tokens} -> bad are pruned by support, confidence and lift, and a rule goes if a
subset of its tokens is at least as sure. Rules are looked up by an inverted index: each
is filed under its rarest token, and fits if all its tokens are in the URL.

Site rules (host, path) come before the mined ones. A null URL, or one without ``://``,
has empty host and path, no tokens, and is allowed. Repeated page ids are judged row by
row. Without labelled pages there are no mined rules and everything is allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest site rule that fits, else null.

    ``rules`` is a short list of (verdict, host, path). A rule fits its host and all
    subdomains if the path starts with its own.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` parts of the host, ``p:`` of the path (numbers as ``#``), ``q:`` field names."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    host = mark("h:", F.split(host_of(url), r"[.\-:@]"))
    path = mark("p:", F.split(F.regexp_replace(F.lower(path_of(url)), r"[0-9]+", "#"), r"[/._\-]"))
    fields = mark("q:", F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    return F.array_distinct(F.concat(host, path, fields))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5
) -> DataFrame:
    """(rule_id, tokens, index_token, confidence, lift) from (tokens, bad).

    ``min_support`` is the least share of labelled pages that hold the tokens and are bad.
    Sets of tokens have a bounded number: each holds at least that share of the pages.
    """
    spark = labelled.sparkSession
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets
    bad = F.lit(BAD)
    with_bad = sets.filter(F.array_contains("items", bad) & (F.size("items") > 1)).select(
        F.array_sort(F.array_except("items", F.array(bad))).alias("tokens"), F.col("freq").alias("bad_freq")
    )
    alone = sets.filter(~F.array_contains("items", bad)).select(F.array_sort("items").alias("tokens"), "freq")
    base = labelled.agg(F.avg(F.col("bad").cast("double")).alias("share"))
    rules = (
        with_bad.join(alone, "tokens")
        .crossJoin(F.broadcast(base))  # one row
        .withColumn("confidence", F.col("bad_freq") / F.col("freq"))
        .withColumn("lift", F.col("confidence") / F.col("share"))
        .filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
        .withColumn("rule_id", F.xxhash64("tokens"))
    )
    # A rule goes if leaving out one of its tokens leaves one that is as sure.
    subsets = rules.select(
        "rule_id", "confidence", F.explode(F.transform("tokens", lambda x: F.array_except("tokens", F.array(x)))).alias("tokens")
    )
    sure = rules.select("tokens", F.col("confidence").alias("_general"))
    weaker = subsets.join(sure, "tokens").filter(F.col("_general") >= F.col("confidence")).select("rule_id").distinct()
    kept = rules.join(weaker, "rule_id", "left_anti")
    frequency = alone.filter(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("freq").alias("_f"))
    first = (
        kept.select("rule_id", F.explode("tokens").alias("token"))
        .join(frequency, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("_f", "token")).getField("token").alias("index_token"))
    )
    out = kept.join(first, "rule_id").select("rule_id", "tokens", "index_token", "confidence", "lift")
    return spark.createDataFrame([], out.schema).unionByName(out)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id, confidence): the surest mined rule of each (key, tokens) that one fits."""
    hits = (
        urls.select("key", "tokens", F.explode("tokens").alias("index_token"))
        .join(rules.select("index_token", "rule_id", F.col("tokens").alias("_need"), "confidence"), "index_token")
        .filter(F.size(F.array_except("_need", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "rule_id"))
    return hits.groupBy("key").agg(best.alias("_b")).select("key", "_b.rule_id", "_b.confidence")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **mining) -> DataFrame:
    """``pages`` with the struct column ``judged``: host, path, rule, verdict, mined_rule, confidence.

    ``labels`` is (page_id, bad). Pages with the same URL share one look-up.
    """
    url = F.col("url")
    known = labels.select(F.col("page_id").alias("_page"), "bad").filter("bad IS NOT NULL")
    labelled = pages.join(known, pages["page_id"] == F.col("_page")).select(url_tokens(url).alias("tokens"), "bad")
    mined = mine_rules(labelled, **mining)
    urls = pages.select(F.xxhash64(url_tokens(url)).alias("key"), url_tokens(url).alias("tokens")).filter(F.size("tokens") > 0)
    matched = match_rules(urls.dropDuplicates(["key"]), mined)
    host, path = host_of(url), path_of(url)
    out = pages.withColumn("_site", site_rule(host, path, rules)).withColumn("_tokens_key", F.xxhash64(url_tokens(url)))
    out = out.join(matched.select(F.col("key").alias("_k"), "rule_id", "confidence"), F.expr("_tokens_key = _k"), "left")
    judged = F.struct(
        host.alias("host"),
        path.alias("path"),
        F.col("_site.rule").alias("rule"),
        F.coalesce("_site.verdict", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("rule_id").alias("mined_rule"),
        F.col("confidence").alias("confidence"),
    )
    return out.withColumn("judged", judged).select(*pages.columns, "judged")
