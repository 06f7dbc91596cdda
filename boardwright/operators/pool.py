"""The pool of listings: normalisation, admission, upsert, freshness and eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import text
from boardwright.operators.order import numbered

BODY_CAP = 8000


def latest(df: DataFrame, key: str, version: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The last written row of every key: only `columns` travel, and copies shrink before the shuffle. Blank keys drop.

    Rows that tie in `version` are told apart by a hash over all columns, so the choice doesn't depend on row order.
    """
    cols = [c for c in (columns or df.columns) if c != key]
    rank = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(version)], F.xxhash64(*cols).alias("h")) if cols else None
    rows = df.where(F.trim(text(F.col(key))) != "")
    if not cols:
        return rows.select(key).distinct()
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("s")).select(key, "s.*")


def upsert(stored: DataFrame, batch: DataFrame, key: str, first: str, last: str, now: Column) -> DataFrame:
    """Stored rows merged with a batch: new keys come with both clocks at `now`; known ones keep `first`, take the rest
    from the batch and refresh `last`. Within the batch the row with the highest `seq` counts. One full outer join."""
    cols = [c for c in stored.columns if c not in (key, first, last)]
    new = latest(batch, key, ["seq"], [key, *cols, "seq"]).select(F.col(key).alias("__k"), F.struct(*cols).alias("__n"))
    old = stored.select(key, first, last, F.struct(*cols).alias("__o"))
    j = old.join(new, old[key] == new["__k"], "full_outer")
    s = F.coalesce("__n", "__o")
    return j.select(F.coalesce(key, "__k").alias(key), *[s[c].alias(c) for c in cols], F.coalesce(first, now).alias(first), F.when(F.col("__k").isNotNull(), now).otherwise(F.col(last)).alias(last))


def reject_reason(us_only: bool = True, direct_only: bool = True, carried: Sequence[str] = ("adzuna.com",)) -> Column:
    """Why intake drops a row: blank url, then not servable in the US, then not direct to an employer; NULL if it passes."""
    cur, country = F.upper(F.trim(text(F.col("salary_currency")))), F.upper(F.trim(text(F.col("country"))))
    areas = F.col("remote_areas")
    servable = (
        F.when((cur != "") & (cur != "USD"), False)
        .when(~country.isin("", "US"), False)
        .when(F.size(areas) > 0, F.exists(areas, lambda a: (F.upper(a) == "US") | F.startswith(F.upper(a), F.lit("US-"))))
        .otherwise(True)
    )
    host = F.lower(text(F.parse_url(F.col("url"), F.lit("HOST"))))
    direct = F.coalesce(F.col("direct_apply"), F.lit(False))
    for a in carried:
        direct = direct | (host == a) | F.endswith(host, F.lit("." + a))
    reason = F.when(F.trim(text(F.col("url"))) == "", "blank url")
    if us_only:
        reason = reason.when(~servable, "not servable")
    return reason.when(~direct, "not direct") if direct_only else reason


def posted_day(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def survivors(jobs: DataFrame, now: Column, polled: Sequence[str], polled_days: int = 3, other_days: int = 14, posted_days: int = 60, cap: int = 120_000) -> DataFrame:
    """Rows that eviction keeps: seen recently (polled sources sooner), not posted too long ago (unreadable dates stay),
    and of the rest the `cap` last seen ones. The cap is a top-k of keys alone, so neither is the whole pool sorted nor do
    whole rows meet in one task."""
    days = F.when(F.col("source").isin(*polled), polled_days).otherwise(other_days) if polled else F.lit(other_days)
    day = posted_day(F.col("posted"))
    kept = jobs.where((F.col("last_seen") >= now - F.make_dt_interval(days)) & (day.isNull() | (day >= F.date_sub(now.cast("date"), posted_days))))
    return kept.join(kept.select("url", "last_seen").orderBy(F.desc("last_seen"), "url").limit(cap).select("url"), "url", "left_semi")


def fresh_keys(fetches: DataFrame, key: str, at: str, now: Column, hours: int = 24) -> DataFrame:
    return fetches.groupBy(key).agg(F.max(at).alias("fetched_at")).withColumn("fresh", F.col("fetched_at") > now - F.make_dt_interval(hours=F.lit(hours)))


def shed(requests: DataFrame, at: str, order: Sequence[str], ceiling: int, zone: str = "America/New_York", spent: Column | None = None) -> DataFrame:
    """Requests with their number in the zone's calendar day, whether the day's ceiling sheds them, and the reason to serve
    them from the store: the ceiling, else `spent`, a source's monthly quota that is used up.

    All requests are numbered by a range sort and a day counts on from its first number, so a busy day isn't one task's.
    """
    day = F.to_date(F.from_utc_timestamp(F.col(at), zone))
    rows = numbered(requests.withColumn("day", day), ["day", at, *order], "__i", 1)
    first = rows.groupBy(F.col("day").alias("__day")).agg(F.min("__i").alias("__first"))
    nth = (F.col("__i") - F.col("__first") + 1).cast("int")
    return rows.join(first, F.col("day").eqNullSafe(F.col("__day"))).withColumn("nth", nth).withColumn("shed", F.col("nth") > ceiling).withColumn("reason", F.when(F.col("shed"), "live_search_limit").when(F.lit(False) if spent is None else spent, "monthly_source_limit")).drop("__i", "__first", "__day")


def sync_plan(pool: DataFrame, vectors: DataFrame, key: str, content_id: str) -> DataFrame:
    """(key, action): new, changed or gone, of a full outer join of content ids; unchanged keys are left out."""
    a, b = pool.select(F.col(key).alias("__a"), F.col(content_id).alias("__x")), vectors.select(F.col(key).alias("__b"), F.col(content_id).alias("__y"))
    act = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "gone").when(F.col("__x") != F.col("__y"), "changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), act.alias("action")).where("action IS NOT NULL")
