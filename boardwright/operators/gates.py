"""Digests and gates: one row per check, with whether it passes and the figures it rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.surface import by_priority
from boardwright.functions.text import text
from boardwright.session import collect_bounded

WEAK_TOP = 55


def demand(searches: DataFrame) -> DataFrame:
    """Logged searches without those of probes."""
    return searches.where(~F.coalesce(F.col("probe"), F.lit(False)))


def rung_histogram(searches: DataFrame, top: str = "top") -> DataFrame:
    """(rung, n, share): the title rungs of the first results; searches without results don't count."""
    first = searches.select(F.try_element_at(top, F.lit(1)).alias("t")).where("t IS NOT NULL").groupBy(F.col("t.tier").alias("rung")).agg(F.count("*").alias("n"))
    return first.crossJoin(F.broadcast(first.agg(F.sum("n").alias("__t")))).select("rung", "n", (F.col("n") / F.col("__t")).alias("share"))


def search_failures(searches: DataFrame, weak: int = WEAK_TOP) -> DataFrame:
    """One row: searches, and how many and what share came back empty, with a weak best match, or degraded."""
    tests = {"empty": F.col("delivered") == 0, "weak": (F.col("delivered") > 0) & (F.coalesce("score_max", F.lit(0)) < weak), "degraded": text(F.col("degraded")) != ""}
    one = searches.agg(F.count("*").alias("searches"), *[F.count_if(c).alias(k) for k, c in tests.items()])
    return one.select("*", *[F.try_divide(k, "searches").alias(f"{k}_share") for k in tests])


def completion(interviews: DataFrame, model: str, turns: str) -> DataFrame:
    """(model, interviews, completion_rate, mean_turns): turns are NULL where an interview wasn't completed."""
    return interviews.groupBy(model).agg(F.count("*").alias("interviews"), (F.count(turns) / F.count("*")).alias("completion_rate"), F.avg(turns).alias("mean_turns"))


def locality(df: DataFrame, location: str, near: str, source: str, share: float = 0.5, sources: int = 3) -> DataFrame:
    """(ok, rows, local_share, sources): whether enough rows are near and come from enough sources; no rows don't pass."""
    one = df.agg(F.count("*").alias("rows"), F.avg(F.coalesce(F.col(location).rlike(near), F.lit(False)).cast("double")).alias("local_share"), F.count_distinct(F.nullif(F.col(source), F.lit(""))).alias("sources"))
    return one.select(F.coalesce((F.col("local_share") >= share) & (F.col("sources") >= sources), F.lit(False)).alias("ok"), "rows", "local_share", "sources")


def pool_ratio(pool: DataFrame, servable: DataFrame, ratio: float = 0.7, least: int = 500) -> DataFrame:
    """(ok, pool, servable): whether the pool holds at least `least` rows and `ratio` of what could be served."""
    one = pool.agg(F.count("*").alias("pool")).crossJoin(servable.agg(F.count("*").alias("servable")))
    return one.select(((F.col("pool") >= least) & (F.col("pool") >= ratio * F.col("servable"))).alias("ok"), "pool", "servable")


def filled_share(df: DataFrame, column: str, more_than: float = 0.5) -> DataFrame:
    one = df.agg(F.avg((text(F.col(column)) != "").cast("double")).alias("share"))
    return one.select(F.coalesce(F.col("share") > more_than, F.lit(False)).alias("ok"), "share")


def top_score(scored: DataFrame, points: str = "points") -> DataFrame:
    return scored.agg(F.coalesce(F.max(points), F.lit(0)).alias("top"))


def freshness(imported: Column, written: Column, hours: int = 24) -> Column:
    """Whether a snapshot was imported no more than `hours` before it was last written; never imported is not fresh."""
    return F.coalesce((F.unix_seconds(written) - F.unix_seconds(imported)) / 3600 <= hours, F.lit(False))


def universe_state(boards: DataFrame, generated_at: Column, now: Column, provider: str = "greenhouse", least: int = 500, days: int = 45) -> DataFrame:
    """(state, boards, of_provider, age_days): bad with too few boards of the provider or no date, stale beyond `days`, else ok."""
    one = boards.agg(F.count("*").alias("boards"), F.count_if(F.col("ats") == provider).alias("of_provider")).withColumn("age_days", F.floor((F.unix_seconds(now) - F.unix_seconds(generated_at)) / 86400))
    state = by_priority([(F.col("of_provider") < least, "bad"), (F.col("age_days").isNull() | (F.col("age_days") < 0), "bad"), (F.col("age_days") > days, "stale")], "ok")
    return one.select(state.alias("state"), "boards", "of_provider", "age_days")


def grew(before: DataFrame, after: DataFrame, least: int = 3) -> DataFrame:
    """(ok, grew): whether a log has at least `least` more lines than before."""
    one = before.agg(F.count("*").alias("b")).crossJoin(after.agg(F.count("*").alias("a")))
    return one.select((F.col("a") - F.col("b") >= least).alias("ok"), (F.col("a") - F.col("b")).alias("grew"))


def retire(backups: DataFrame, at: str, keep: int) -> DataFrame:
    """The backups beyond the `keep` newest ones: a top-k of what stays, then all the others."""
    newest = backups.orderBy(F.desc(at), *[c for c in backups.columns if c != at]).limit(keep)
    return backups.exceptAll(newest)


def funnel(before: DataFrame, after: DataFrame, checked: DataFrame, requeued: DataFrame, name: str, seconds: float, backlog: int) -> DataFrame:
    """One row of a trial run: how many names were checked, what became resolved, the minutes a pass over the backlog would
    take, and how many names that were answered stand in the queue again (a working negative cache has none)."""
    resolved = lambda df, alias: df.agg(F.count_if(F.lower("status") == "resolved").alias(alias))
    again = checked.select(name).distinct().join(requeued.select(name), name, "left_semi").agg(F.count("*").alias("requeued"))
    one = resolved(before, "before").crossJoin(resolved(after, "after")).crossJoin(checked.select(name).distinct().agg(F.count("*").alias("checked"))).crossJoin(again)
    minutes = F.round(F.lit(seconds) / F.greatest("checked", F.lit(1)) * backlog / 60, 3)
    return one.select("checked", "before", "after", F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("gained"), minutes.alias("pass_minutes"), "requeued", (F.col("requeued") == 0).alias("cache_works"))


def notice_kind(degraded: Column, pool: Column, count: Column) -> Column:
    """What a board has to say of itself: why it is degraded, else that the pool is still filling, else that it is thin."""
    d = text(degraded)
    return by_priority([(d.isin("live_search_limit", "monthly_source_limit", "fetch_error"), "degraded"), ((pool > 0) & (pool < 200) & (count < 3), "filling"), (count < 3, "thin")], "")


def notice(notes: Column, kind: Column) -> Column:
    """The corrections of a search before whatever else its board says."""
    return F.concat(F.when(F.size(notes) > 0, F.concat(F.lit("Note: "), F.array_join(notes, "; "), F.lit(". "))).otherwise(""), kind)


def applied_order(df: DataFrame, at: str = "applied_at") -> DataFrame:
    return df.orderBy(F.col(at).desc_nulls_last(), "url")


def without_criterion(search: dict, field: str, value: str | None = None) -> dict:
    """A search without one of its criteria: a value of a list, or a whole field."""
    rest = dict(search)
    if value is None or not isinstance(rest.get(field), (list, tuple)):
        rest.pop(field, None)
    else:
        rest[field] = [v for v in rest[field] if v != value]
    return rest


def merged_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value): the store's notes on itself with new values over old ones."""
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new.groupBy("key").agg(F.max("value").alias("value")))


def meta_value(meta: DataFrame, key: str) -> str | None:
    rows = collect_bounded(meta.where(F.col("key") == key).select("value").distinct(), 1, f"values of {key}")
    return rows[0][0] if rows else None


def score_profiles(df: DataFrame, profiles: Sequence[tuple[str, dict]], most: int = 10_000) -> DataFrame:
    """(url, profile_id, points) of many searches over one pool, rows of 0 points left out.

    Every distinct wanted title and term of all profiles is looked at once a row; a profile then adds up the figures of its
    own, so a listing's text is read once however many profiles there are. Up to `most` profiles, a broadcast literal.
    """
    from boardwright.functions.text import term_hits
    from boardwright.operators import board

    if len(profiles) > most:
        raise ValueError(f"more than {most} profiles; score them in parts")
    qs = [(p, board.Query.of(d)) for p, d in profiles]
    titles = sorted({t for _, q in qs for t in (*q.titles, *q.related)})
    boosts = sorted({b for _, q in qs for b in q.boosts})
    penalties = sorted({p for _, q in qs for p in q.penalties})
    at = {k: {v: i for i, v in enumerate(vs)} for k, vs in (("t", titles), ("b", boosts), ("p", penalties))}
    base = board.with_title_keys(df).select("url", "__k0", "__k1", "__w0", "__w1", "__s0", "__s1", F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("body")))).alias("__blob"), F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("company")))).alias("__head"), F.lower(text(F.col("company"))).alias("__company"), F.lower(text(F.col("body"))).alias("__body"))
    none = F.array().cast("array<int>")
    tier = lambda t: F.greatest(*[board.title_tier(t, F.col(f"__k{i}"), F.col(f"__w{i}"), F.col(f"__s{i}")) for i in (0, 1)])
    boost = lambda b: F.element_at(F.array(*[F.lit(x) for x in (0, *board.BOOSTS)]), F.least(term_hits(b, F.col("__blob")), F.lit(len(board.BOOSTS))).cast("int") + 1)
    read = base.select(
        "url", F.array(*map(tier, titles)).alias("t") if titles else none.alias("t"), F.array(*map(boost, boosts)).alias("b") if boosts else none.alias("b"),
        F.array(*[board._penalty(p, F.col("__head"), F.col("__company"), F.col("__body")) for p in penalties]).alias("p") if penalties else none.alias("p"),
    )
    rows = [(p, [at["t"][t] for t in q.titles], [at["t"][t] for t in q.related], [at["b"][b] for b in q.boosts], [at["p"][x] for x in q.penalties]) for p, q in qs]
    literal = df.sparkSession.createDataFrame(rows, "profile_id string, wanted array<int>, near array<int>, adds array<int>, takes array<int>")
    pick = lambda values, places: F.transform(places, lambda i: F.get(values, i))
    total = lambda values, places: F.aggregate(pick(values, places), F.lit(0), lambda s, x: s + x)
    best = F.coalesce(F.array_max(pick("t", "wanted")), F.lit(0))
    rung = F.when(best > 0, best).when(F.coalesce(F.array_max(pick("t", "near")), F.lit(0)) > 0, board.RELATED).otherwise(0)
    points = rung + total("b", "adds") - total("p", "takes")
    return read.crossJoin(F.broadcast(literal)).select("url", "profile_id", points.alias("points")).where("points <> 0")


def pairs_within(df: DataFrame, group: str, item: str, most: int = 1_000) -> DataFrame:
    """(group, a, b), a < b: the pairs of items that stand in one group, such as the models that met one persona. For short
    lists by nature: a group of more than `most` items raises."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    checked = sets.withColumn("s", F.when(F.size("s") <= most, F.col("s")).otherwise(F.raise_error(F.lit(f"pairs_within: a group of more than {most} items"))))
    return checked.select(group, F.posexplode("s").alias("i", "a"), "s").select(group, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
