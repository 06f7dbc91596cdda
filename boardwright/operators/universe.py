"""The universe of mined boards: what of it is new, whose it is, and what becomes of names that were looked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwright.functions.surface import by_priority
from boardwright.functions.text import norm_key, text
from boardwright.operators.analytics import slug_junk


class NotQueried(ValueError):
    """The universe says of itself that a provider wasn't mined."""


def of_provider(boards: DataFrame, provider: str, counts: Mapping[str, int] | None = None) -> DataFrame:
    """The boards of one provider with a slug. `counts` are what the universe says it mined: a provider that it leaves out
    raises; without counts nothing is known against it."""
    if counts is not None and provider not in counts:
        raise NotQueried(f"{provider}: not mined ({', '.join(sorted(counts)) or 'nothing'} were)")
    return boards.where((F.col("ats") == provider) & (text(F.col("slug")) != "")).select("ats", "slug", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("host", "site") if c in boards.columns])


def _board(df: DataFrame) -> list[Column]:
    site = F.lower(text(F.col("site"))) if "site" in df.columns else F.lit("")
    return [F.col("ats").alias("__a"), F.lower(text(F.col("slug"))).alias("__s"), site.alias("__t")]


def unknown_boards(mined: DataFrame, known: Sequence[DataFrame]) -> DataFrame:
    """Mined boards that none of the known tables has, letter case aside, each once (the smallest spelling); rows without a
    provider or a slug are no boards."""
    mined = mined.where(F.col("ats").isNotNull() & (text(F.col("slug")) != ""))
    seen = None
    for k in known:
        part = k.select(*_board(k)).distinct()
        seen = part if seen is None else seen.union(part).distinct()
    one = mined.groupBy(*_board(mined)).agg(F.min(F.struct(*mined.columns)).alias("b"))
    return (one.join(seen, ["__a", "__s", "__t"], "left_anti") if seen is not None else one).select("b.*")


def name_variants(name: Column, first_word: bool = False) -> Column:
    """Slugs that a name suggests: its words joined, and joined by hyphens; with first_word also that alone."""
    key = norm_key(name)
    made = [F.replace(key, F.lit(" "), F.lit("")), F.replace(key, F.lit(" "), F.lit("-"))] + ([F.split(key, " ")[0]] if first_word else [])
    return F.array_distinct(F.filter(F.array(*made), lambda s: s != ""))


def match_names(names: DataFrame, name: str, boards: DataFrame, first_word: bool = False) -> DataFrame:
    """(name, ats, slug): the boards whose slug is a variant of a name, the smallest per name and provider."""
    v = names.select(F.col(name).alias("name"), F.explode(name_variants(F.col(name), first_word)).alias("__s")).distinct()
    b = boards.where(text(F.col("slug")) != "").select("ats", "slug", F.lower("slug").alias("__s"))
    return v.join(b, "__s").groupBy("name", "ats").agg(F.min("slug").alias("slug"))


def still_open(names: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Names that weren't found."""
    return names.select(name).distinct().join(found.select(name), name, "left_anti")


def resolve(names: DataFrame, found: DataFrame, outcomes: DataFrame, covered: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, state, ats, slug) of a batch of names after probes.

    found (name, ats, slug) resolves, but where the name's own listings name boards (evidence: name, ats, slug) and this one
    isn't among them: contradicted. Of the others, refused probes (outcomes: name, outcome) make it dead, a slug that a
    known board holds (covered: name) covered, an answer that never came (throttled, error) deferred, anything else
    unresolved. One row a name; of several found boards the smallest.
    """
    n = names.select("name").distinct()
    f = found.groupBy("name").agg(F.min(F.struct("ats", "slug")).alias("f"))
    o = outcomes.groupBy("name").agg(F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome").isin("throttled", "error")).alias("lost"))
    c = covered.select("name", F.lit(True).alias("held")).distinct()
    e = evidence.groupBy("name").agg(F.collect_set(F.concat_ws("/", "ats", F.lower("slug"))).alias("own"))
    j = n.join(f, "name", "left").join(o, "name", "left").join(c, "name", "left").join(e, "name", "left")
    has, mine = F.col("f").isNotNull(), F.concat_ws("/", F.col("f.ats"), F.lower("f.slug"))
    against = has & F.col("own").isNotNull() & ~F.array_contains("own", mine)
    state = by_priority([(against, "contradicted"), (has, "resolved"), (F.col("refused") > 0, "dead"), (F.col("held"), "covered"), (F.col("lost") > 0, "deferred")], "unresolved")
    kept = F.when(state == "resolved", F.col("f"))
    return j.select("name", state.alias("state"), kept["ats"].alias("ats"), kept["slug"].alias("slug"))


def record_as(state: Column) -> Column:
    """What the ledger writes for a state: a contradicted name is unresolved, a deferred one leaves no trace (NULL)."""
    return F.when(state == "contradicted", "unresolved").when(state != "deferred", state)


def display_name() -> Column:
    """How a discovered board is shown: its name, else its slug; tenants with several sites by slug and site."""
    return F.when((F.col("ats") == "workday") & (text(F.col("site")) != ""), F.concat_ws("/", "slug", "site")).otherwise(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("slug")))


def merged_crawls(crawls: Sequence[DataFrame]) -> DataFrame:
    """(ats, slug) of all crawls: each board once, the first spelling by crawl, without slugs that are no board, in order."""
    every = None
    for i, df in enumerate(crawls):
        part = df.select(F.lit(i).alias("__i"), "ats", "slug")
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("ats", F.lower("slug")).orderBy("__i", "slug")
    kept = every.where(F.col("ats").isNotNull() & slug_junk(F.col("slug")).isNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return kept.select("ats", "slug").orderBy("ats", F.lower("slug"), "slug")
