"""Profiles, digests, percentiles, agreement and mining of URLs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.functions.text import text

# Path names and file endings that are no employer's board.
NOT_A_BOARD = "robots.txt sitemap.xml favicon.ico index.html 404.html embed api static assets".split()
FILE_ENDINGS = "txt xml json md html htm ico css js php yml yaml csv pdf png jpg svg map gz zip".split()


def filled(name: str, kind: str) -> Column:
    """Whether a value says anything: not NULL, not blank text; empty lists say nothing."""
    c = F.col(name)
    if kind.startswith("array"):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (F.trim(c.cast("string")) != "") if kind == "string" else c.isNotNull()


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, rows, rate): one pass for all columns; an empty table has rate NULL."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(filled(c, kinds[c])).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns]))
    return one.select(pairs.alias("p"), F.col("__n").alias("rows")).select("p.*", "rows").withColumn("rate", F.try_divide(F.col("filled"), F.col("rows")))


def completeness(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a + b, [F.when(filled(c, kinds[c]), 1).otherwise(0) for c in columns])


def indexed_percentiles(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """n, p10 = asc[n // 10], p50 = asc[n // 2], p95 = asc[int(0.95 n)], rank95 = the nearest rank of a descending list,
    round95 = asc[min(n - 1, round_half_even(0.95 (n - 1)))] per group.

    Values are counted first; a group's values are cut into buckets at approximate quantiles and numbered bucket by
    bucket, so the picks are exact and no group, however large, is sorted in one task. NULL values don't count.
    """
    g = list(group)
    key = g or ["__all"]
    rows = df.where(F.col(value).isNotNull()) if g else df.where(F.col(value).isNotNull()).withColumn("__all", F.lit(0))
    cuts = rows.groupBy(*key).agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000).alias("__cuts"), F.count("*").alias("n"))
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("c")).join(cuts, key).withColumn("__b", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    sums = counts.groupBy(*key, "__b").agg(F.sum("c").alias("s"))
    base = sums.select(*key, "__b", (F.sum("s").over(Window.partitionBy(*key).orderBy("__b")) - F.col("s")).alias("__base"))
    run = Window.partitionBy(*key, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.join(base, [*key, "__b"]).withColumn("hi", F.col("__base") + F.sum("c").over(run))
    at = {
        "p10": F.floor(F.col("n") / 10), "p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)),
        "rank95": F.col("n") - 1 - F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), "round95": F.least(F.col("n") - 1, F.bround(0.95 * (F.col("n") - 1)).cast("bigint")),
    }
    pick = lambda i: F.max(F.when((F.col("hi") > i) & (F.col("hi") - F.col("c") <= i), F.col(value)))
    return c.groupBy(*key).agg(F.max("n").alias("n"), *[pick(i).alias(k) for k, i in at.items()]).drop("__all")


def top_terms(df: DataFrame, terms: Column, n: int) -> DataFrame:
    """(term, n, distinct_terms): the n most frequent terms, ties by term, with the number of distinct ones."""
    counts = df.select(F.explode(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(n).crossJoin(counts.agg(F.count("*").alias("distinct_terms")))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two raters; NULL kappa where chance agreement is full."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    ma, mb = pairs.groupBy(F.col("a").alias("l")).agg(F.sum("c").alias("x")), pairs.groupBy(F.col("b").alias("l")).agg(F.sum("c").alias("y"))
    chance = ma.join(mb, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    pe, po = F.col("xy") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return total.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of two sets: both empty 1, one empty 0."""
    p, g = F.array_distinct(F.coalesce(pred, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    tp = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(tp == 0, 0.0).otherwise(2.0 * tp / (F.size(p) + F.size(g)))


def slug_junk(slug: Column) -> Column:
    """Why a slug is no board, or NULL."""
    s = text(slug)
    return (
        F.when((F.length(s) < 2) | (F.length(s) > 60), "length")
        .when(s.rlike(r"%[0-9A-Fa-f]{2}|[{} ]"), "template-or-encoded")
        .when(F.lower(s).isin(*NOT_A_BOARD), "not-a-board-path")
        .when(F.contains(s, F.lit(".")) & F.lower(F.substring_index(s, ".", -1)).isin(*FILE_ENDINGS), "file-extension")
    )


def mine_boards(df: DataFrame, url: str) -> DataFrame:
    """(host, slug, url, junk): one URL, the smallest, for every host and first path segment."""
    host, path = F.lower(F.parse_url(F.col(url), F.lit("HOST"))), F.coalesce(F.parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    slug = F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1))
    return df.where(F.col(url).isNotNull()).groupBy(host.alias("host"), slug.alias("slug")).agg(F.min(url).alias("url")).where("host IS NOT NULL").withColumn("junk", slug_junk(F.col("slug")))


def asked_for(counts: DataFrame, key: str, asked: Sequence[str]) -> DataFrame:
    """(key, n, failed) of every key that was asked for: one that gave nothing failed."""
    want = counts.sparkSession.createDataFrame([(k,) for k in asked], f"`{key}` string")
    return want.join(counts.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("failed"))


def interleave(df: DataFrame, group: str, order: Sequence[str], budget: int) -> DataFrame:
    """Round robin over groups: the first of each, then the second of each, up to a budget."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= budget).orderBy("turn", group, *order).limit(budget)


def concentration(df: DataFrame, group: str) -> DataFrame:
    """(groups, rows, top_share) of non-blank groups."""
    counts = df.where(F.trim(text(F.col(group))) != "").groupBy(group).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("groups"), F.sum("c").alias("rows"), (F.max("c") / F.sum("c")).alias("top_share"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket: str = "day", width: float = 1_000) -> DataFrame:
    """left with the latest `value` of `right` at or before each row's time, of values at one time the largest; NULL values of
    `right` don't count.

    A key's rows are cut into buckets of time (of `width`, where times are numbers): the running window sees one bucket of a key, and what earlier buckets end
    with comes from one row a bucket, so that a key with a third of all rows isn't one task's.
    """
    kind = dict(right.dtypes)[value]
    slot = F.date_trunc(bucket, F.col(at)) if dict(left.dtypes)[at] in ("timestamp", "timestamp_ntz", "date") else F.floor(F.col(at) / width)
    rows = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(kind))
    add = right.where(F.col(value).isNotNull()).select(key, at, F.col(value).alias("__v"))
    for c in left.columns:
        if c not in (key, at):
            add = add.withColumn(c, F.lit(None).cast(dict(left.dtypes)[c]))
    both = rows.unionByName(add.withColumn("__side", F.lit(0))).withColumn("__b", slot)
    ends = both.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__bb")).agg(F.max_by("__v", F.when(F.col("__side") == 0, F.struct(at, "__v"))).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__bb").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__k", "__bb", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    w = Window.partitionBy(key, "__b").orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("__now", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    met = run.join(ends, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__bb")), "left")
    return met.withColumn(value, F.coalesce("__now", "__carried")).select(*left.columns, value)


def shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share): counts with their share of all rows. The total is one row, joined to the counts."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__t")))).select(group, "n", (F.col("n") / F.col("__t")).alias("share"))


def staleness(at: Column, now: Column, days: int = 45) -> Column:
    """fresh, stale or unknown (NULL) by age in days."""
    return F.when(at.isNull(), "unknown").when(F.datediff(now, at) > days, "stale").otherwise("fresh")


def coalesced(requests: DataFrame, key: Column, at: str, seconds: int) -> DataFrame:
    """(key, window, n): requests of one key within a window of seconds are one fetch, n of them served by it."""
    slot = F.floor(F.unix_seconds(F.col(at)) / seconds)
    return requests.groupBy(key.alias("key"), slot.alias("window")).agg(F.count("*").alias("n"))


def bar(value: Column, width: int = 20) -> Column:
    """A bar of blocks for a share between 0 and 1, rounded half to even."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(0), F.least(F.lit(width), F.bround(value * width).cast("int"))))
