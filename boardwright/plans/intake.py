"""Queries of intake: the listings read as raw rows, sources, order-preserving lookups, liveness and scores of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.functions import vocab as V
from boardwright.operators import intake as I
from boardwright.plans.listings import _CLEAN, _KFIG, _LOOK, LATEST, jobs, key_sql
from boardwright.session import table

NOW = "2026-07-01 00:00:00"


def normalised_listings(spark, sf):
    df = jobs(spark, sf).withColumnRenamed("remote", "remote_type").withColumnRenamed("body", "text")
    got = I.normalise(df, F.to_timestamp(F.lit(NOW)))
    return got.select("url", "title", "remote", "remote_basis", "category", "seniority", "state", "salary_band", "source", F.size("tags").alias("n_tags"), F.length("body").alias("body_length"), F.unix_micros("fetched_at").alias("first_us"))


def source_report(spark, sf):
    df = jobs(spark, sf, ["url", "source"])
    parts = {s: df.where(F.col("source") == s).select("url") for s in ("rolewire", "werkpfad", "nosuchfeed")}
    return I.union_sources(parts)[1]


def search_places(spark, sf):
    return jobs(spark, sf, ["url", "location"]).groupBy((I.search_place(F.col("location")) == "").alias("no_place")).agg(F.count("*").alias("n"))


def search_keys(spark, sf):
    df = jobs(spark, sf, ["url", "title", "title_root", "location"])
    return df.select(I.search_key(F.filter(F.array("title", "title_root"), lambda t: t.isNotNull()), F.col("location")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def liveness_probe(spark, sf):
    df = jobs(spark, sf, ["url", "last_seen"])
    code = F.element_at(F.array(*map(F.lit, (200, 404, 500, 301))), (F.length("url") % 4 + 1).cast("int"))
    probes = df.where(F.length("url") % 3 == 0).select("url", code.alias("http_status"))
    return I.liveness(df, probes, F.to_timestamp(F.lit(NOW))).select("url", F.unix_micros("last_seen").alias("last_us"))


def extraction_scores(spark, sf):
    """Root titles and places as if extracted from listings, against the listings' own fields, per source."""
    df = table(spark, sf, "jobs").select("source", F.split("title", " ").alias("gold_words"), F.split("title_root", " ").alias("pred_words"), F.col("location").alias("gold_place"), F.col("city").alias("pred_place"), (F.coalesce("title_root", F.lit("")) != "").alias("responded"))
    got = I.model_report(I.field_scores(df, ["words"], ["place"]), "source", ["words", "place"])
    return got.select("source", "cases", *[F.round(c, 6).alias(c) for c in ("reliability", "quality", "words", "place")])


QUERIES = {f.__name__: f for f in (normalised_listings, source_report, search_places, search_keys, liveness_probe, extraction_scores)}

W = f"WITH pool AS {LATEST}"
_BAND = f"""coalesce(CASE WHEN salary_min > 0 AND upper(trim(coalesce(salary_currency, ''))) IN ('', 'USD') THEN CASE WHEN lower(trim(coalesce(salary_period, ''))) = '' THEN CASE WHEN salary_min >= 15000 THEN salary_min END ELSE salary_min * CASE lower(trim(salary_period)) WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'hour' THEN 2080 WHEN 'day' THEN 260 END END END,
 CASE WHEN len(k) > 0 THEN list_min(list_concat(k, list_transform(p, lambda v: CASE WHEN v < 1000 THEN v * 1000 ELSE v END))) ELSE list_min(p) END)"""
_DERIVED = "(regexp_matches(lower(coalesce(title, '')), '\\bremote\\b') OR regexp_matches(lower(coalesce(location, '')), '\\b(remote|anywhere)\\b') OR (regexp_matches(lower(coalesce(body, '')), '\\b(fully remote|100% remote|remote position|remote role|work from home|remote opportunity)\\b') AND NOT regexp_matches(lower(coalesce(body, '')), '\\bnot (a |an )?(fully )?remote\\b')))"
_NOPLACE = "'', 'remote', 'remote only', 'remote-only', 'remote us', 'remote (us)', 'anywhere', 'anywhere in the us', 'anywhere in the united states', 'any', 'everywhere', 'virtual', 'wfh', 'work from home', 'home based', 'home-based', 'telecommute', 'nationwide', 'national', 'us', 'usa', 'u.s.', 'u.s.a.', 'united states', 'no preference', 'none', 'n/a', 'flexible', 'open'"
_F1 = "CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(p, g)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END"
ORACLES = {
    "normalised_listings": f"""{W}, a AS (SELECT *, list_transform(regexp_extract_all(coalesce(salary, ''), '{_KFIG}', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE) * 1000) AS k, list_transform(regexp_extract_all(regexp_replace(coalesce(salary, ''), '{_KFIG}', ' ', 'g'), '[\\d,]{{3,}}'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)) AS p FROM pool), b AS (SELECT *, {_BAND} AS f FROM a)
SELECT url, coalesce(title, '') AS title, CASE WHEN remote IN ('remote', 'hybrid', 'onsite') THEN remote WHEN {_DERIVED} THEN 'remote' END AS remote, CASE WHEN remote IN ('remote', 'hybrid', 'onsite') THEN coalesce(nullif(remote_basis, ''), 'stated') WHEN {_DERIVED} THEN 'derived' END AS remote_basis, {_LOOK(V.CATEGORIES, _CLEAN.format('category'))} AS category, {_LOOK(V.SENIORITY, _CLEAN.format('seniority'))} AS seniority, {_LOOK(V.STATES, key_sql('state'))} AS state,
CASE WHEN f IS NULL THEN '' WHEN f < 50000 THEN 'under-50k' WHEN f < 80000 THEN '50-80k' WHEN f < 120000 THEN '80-120k' WHEN f < 180000 THEN '120-180k' ELSE '180k-plus' END AS salary_band, coalesce(source, '') AS source, CAST(len(tags) AS INTEGER) AS n_tags, CAST(length(substr(coalesce(body, ''), 1, 8000)) AS INTEGER) AS body_length, epoch_us(TIMESTAMPTZ '{NOW}+00') AS first_us FROM b""",
    "source_report": f"{W} SELECT s AS source, count(url) AS n, CASE WHEN count(url) = 0 THEN 'empty' ELSE '' END AS why FROM (VALUES ('rolewire'), ('werkpfad'), ('nosuchfeed')) AS v(s) LEFT JOIN pool ON source = s GROUP BY s",
    "search_places": f"{W} SELECT lower(trim(coalesce(location, ''))) IN ({_NOPLACE}) OR trim(coalesce(location, '')) = '' AS no_place, count(*) AS n FROM pool GROUP BY 1",
    "search_keys": f"{W} SELECT array_to_string(list_sort(list_filter([lower(title), lower(title_root)], lambda x: x IS NOT NULL)), ',') || '|' || lower(coalesce(location, '')) AS key, count(*) AS n FROM pool GROUP BY 1 HAVING count(*) > 1",
    "liveness_probe": f"{W}, s AS (SELECT *, CASE WHEN length(url) % 3 = 0 THEN [200, 404, 500, 301][1 + length(url) % 4] END AS code FROM pool) SELECT url, CASE WHEN code BETWEEN 200 AND 399 THEN epoch_us(TIMESTAMPTZ '{NOW}+00') ELSE epoch_us(last_seen) END AS last_us FROM s WHERE code IS NULL OR code NOT IN (404, 410)",
    "extraction_scores": f"""WITH a AS (SELECT source, coalesce(title_root, '') <> '' AS r, title IS NOT NULL AS gw, location IS NOT NULL AS gp, list_distinct(coalesce(string_split(title_root, ' '), [])) AS p, list_distinct(coalesce(string_split(title, ' '), [])) AS g, {key_sql('city')} = {key_sql('location')} AS same, city IS NULL AS nc FROM jobs),
b AS (SELECT source, r, CASE WHEN r AND gw THEN {_F1} END AS w, CASE WHEN r AND gp THEN CASE WHEN nc THEN 0.0::DOUBLE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS pl FROM a), c AS (SELECT *, CASE WHEN w IS NOT NULL AND pl IS NOT NULL THEN (w + pl) / 2 ELSE coalesce(w, pl) END AS o FROM b)
SELECT source, count(*) AS cases, round(avg(r::INT), 6) AS reliability, round(avg(o), 6) AS quality, round(avg(w), 6) AS words, round(avg(pl), 6) AS place FROM c GROUP BY source""",
}
