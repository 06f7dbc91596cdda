"""Queries of upkeep: quarantine, negative windows, least recent listings, shares, staleness, coalesced requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.operators import analytics as A
from boardwright.operators import ledger
from boardwright.plans.listings import LATEST, POLLED, jobs
from boardwright.session import table

NOW = "2026-07-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def ledger_quarantine(spark, sf):
    """Resolved rows without roles are suspect."""
    co = table(spark, sf, "companies")
    bad = co.where("status = 'resolved' AND roles = 0").select("name_key", F.concat(F.lit("no roles: "), F.repeat("name", F.lit(9))).alias("reason"))
    return ledger.quarantine(co, bad, _now()).select("name_key", "status", "matched_variant", F.unix_micros("checked_at").alias("checked_us"))


def negative_window(spark, sf):
    return ledger.recently_probed(table(spark, sf, "companies"), "t", _now(), 60)


def least_recent(spark, sf):
    return ledger.least_recent(jobs(spark, sf, ["url", "source", "last_seen"]), list(POLLED), 50).select("url")


def source_shares(spark, sf):
    got = A.shares(jobs(spark, sf, ["url", "source"]), "source")
    return got.select("source", "n", F.round("share", 6).alias("share"), F.length(A.bar(F.col("share"))).alias("bar"))


def ledger_staleness(spark, sf):
    return table(spark, sf, "companies").groupBy("ats", A.staleness(F.col("checked_at"), _now()).alias("state")).agg(F.count("*").alias("n"))


def coalesced_requests(spark, sf):
    df = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    got = A.coalesced(df, F.col("event_type"), "ts", 3600)
    return got.groupBy("key").agg(F.count("*").alias("fetches"), F.sum("n").alias("requests"))


QUERIES = {f.__name__: f for f in (ledger_quarantine, negative_window, least_recent, source_shares, ledger_staleness, coalesced_requests)}
W = f"WITH pool AS {LATEST}"
_BAD = "(status = 'resolved' AND roles = 0)"
ORACLES = {
    "ledger_quarantine": f"SELECT name_key, CASE WHEN {_BAD} THEN 'quarantined' ELSE status END AS status, CASE WHEN {_BAD} THEN substr('no roles: ' || repeat(name, 9), 1, 120) ELSE matched_variant END AS matched_variant, epoch_us(CASE WHEN {_BAD} THEN TIMESTAMPTZ '{NOW}+00' ELSE checked_at END) AS checked_us FROM companies",
    "negative_window": f"SELECT name_key FROM companies WHERE starts_with(name_key, 't') AND coalesce(checked_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') > TIMESTAMPTZ '{NOW}+00' - INTERVAL 60 DAY",
    "least_recent": f"{W} SELECT url FROM pool WHERE source NOT IN {POLLED} ORDER BY last_seen, url LIMIT 50",
    "source_shares": f"{W}, c AS (SELECT source, count(*) AS n FROM pool GROUP BY source) SELECT source, n, round(n / (SELECT sum(n) FROM c), 6) AS share, CAST(round_even(20 * n / (SELECT sum(n) FROM c), 0) AS INTEGER) AS bar FROM c",
    "ledger_staleness": f"SELECT ats, CASE WHEN checked_at IS NULL THEN 'unknown' WHEN date_diff('day', CAST(timezone('UTC', checked_at) AS DATE), DATE '2026-07-01') > 45 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM companies GROUP BY ALL",
    "coalesced_requests": "WITH s AS (SELECT event_type AS key, floor(epoch(ts) / 3600) AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT key, count(*) AS fetches, CAST(sum(n) AS BIGINT) AS requests FROM s GROUP BY key",
}
