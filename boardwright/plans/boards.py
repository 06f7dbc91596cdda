"""End-to-end boards through the engine's surface, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boardwright.api import INDEXED, Engine, stored_index
from boardwright.operators import board, dense, order
from boardwright.plans.listings import AS_OF, LATEST, hits_sql, jobs, key_sql, tier_sql
from boardwright.plans.retrieval import _D
from boardwright.session import ensure_checkpoint_dir, table
from boardwright.sources import files
from boardwright.streaming.imports import import_snapshots

DOC = {"titles": ["Engineer", "Accountant"], "boosts": ["kubernetes", "sql"], "rank_down": ["phlebotomy"], "limit": 100}


def _engine(spark, sf, **kw):
    """Over the index that stands in the shared folder for this state of the table; the first search writes it."""
    index = stored_index(spark, jobs(spark, sf, ["url", *INDEXED]), f"{sf}/jobs.parquet", ensure_checkpoint_dir(spark), stemmed=False)
    return Engine(jobs(spark, sf), as_of=F.to_date(F.lit(AS_OF)), stemmed=False, index=index, **kw)


def board_delivered(spark, sf):
    return _engine(spark, sf).score(DOC).jobs.select("url", "points")


def board_facets(spark, sf):
    return _engine(spark, sf).score(DOC).facets


def board_candidates(spark, sf):
    """Lexical and dense arms of one search, fused. The n-th listing by url has vector n; every vector with an id divisible
    by 50 is a query vector."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    at = order.numbered(jobs(spark, sf, ["url"]), ["url"], "vec_id")
    engine = _engine(spark, sf, vectors=at.join(vectors, "vec_id").select("url", "embedding"))
    probes = dense.probes_from(vectors, "vec_id", 50).select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    return engine.candidates({"titles": DOC["titles"], "remote_only": True}, probes, 50).select("url", F.round("rrf", 9).alias("rrf"))


def search_loose(spark, sf):
    return _engine(spark, sf).search(["Accountant"], remote_only=True, salary_floor=60_000).select("url")


def pool_stats(spark, sf):
    return _engine(spark, sf).stats().select("pool", "newest_posted", F.unix_micros("last_seen").alias("last_us"), "companies")


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def partition_subset(spark, sf):
    root = _folder(spark)
    jobs(spark, sf, ["url", "source"]).write.partitionBy("source").parquet(root)
    return files.read_partitions(spark, root, "source", ["rolewire", "werkpfad"]).groupBy("source").agg(F.count("*").alias("n"))


def csv_roundtrip(spark, sf):
    root = _folder(spark)
    files.write_csv(table(spark, sf, "companies").select("name_key", "status", "roles"), root)
    back = spark.read.schema("name_key string, status string, roles bigint").option("header", True).csv(root)
    return back.groupBy("status").agg(F.count("*").alias("n"), F.sum("roles").alias("roles"))


def log_lines(spark, sf):
    """A log line per employer with its first 60 urls, of which as many stay as fit into 600 bytes."""
    root = _folder(spark)
    rows = jobs(spark, sf, ["url", "company"]).where("company IS NOT NULL")
    tops = board.cap_per_group(rows, F.col("company"), ["url"], 60).groupBy("company").agg(F.array_sort(F.collect_list("url")).alias("top"))
    files.append_log(tops, root, most_bytes=600)
    return files.read_lines(spark, root, "company string, top array<string>").where("_corrupt_record IS NULL").select("company", F.size("top").alias("kept"))


def stream_import(spark, sf):
    """Listings as two deliveries of JSON lines, imported as a stream into a stored pool."""
    root = _folder(spark)
    raw = jobs(spark, sf, ["url", "title", "company", "country", "salary_currency", "remote_areas", "direct_apply"])
    raw.where(F.length("url") % 2 == 0).write.json(f"{root}/in/first")
    raw.write.json(f"{root}/in/second")
    import_snapshots(spark, f"{root}/in/*", f"{root}/store", f"{root}/state", "2026-07-01 00:00:00")
    return spark.read.parquet(f"{root}/store").select("url", "title")


QUERIES = {f.__name__: f for f in (board_delivered, board_facets, board_candidates, search_loose, pool_stats, partition_subset, csv_roundtrip, log_lines, stream_import)}

_RANKED = _D + """, q(w) AS (VALUES ('engineer'), ('accountant')), f AS (SELECT url, w, len, len(list_filter(t, lambda x: x = w)) AS tf FROM d, q), n AS (SELECT w, count(*) AS n FROM f WHERE tf > 0 GROUP BY w),
i AS (SELECT w, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, mean FROM n, av), sc AS (SELECT url, sum(idf * (8.0 * tf) * 2.2 / (8.0 * tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN i USING (w) WHERE tf > 0 {0} GROUP BY url),
rk AS (SELECT url, row_number() OVER (ORDER BY round(score, 9) DESC, url) AS rank FROM sc)"""
_BOOST = " + ".join(f"[0, 8, 14, 18, 20][1 + least({hits_sql(b, 'bl')}, 4)]" for b in DOC["boosts"])
_BOARD = f"""{_RANKED.replace('{0}', '')}, g AS (SELECT pool.*, rank, {key_sql('company')} AS ck, {key_sql('title')} AS k1 FROM rk JOIN pool USING (url)),
dd AS (SELECT CASE WHEN ck = '' AND k1 = '' THEN 'url:' || url ELSE ck || '|' || k1 END AS gk, min(rank) OVER (PARTITION BY CASE WHEN ck = '' AND k1 = '' THEN 'url:' || url ELSE ck || '|' || k1 END) AS slot, row_number() OVER (PARTITION BY CASE WHEN ck = '' AND k1 = '' THEN 'url:' || url ELSE ck || '|' || k1 END ORDER BY length(coalesce(body, '')) DESC, rank) AS rn, * FROM g),
e AS (SELECT *, {key_sql('title_root')} AS k2, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS bl, lower(coalesce(title, '') || ' ' || coalesce(company, '')) AS he, lower(coalesce(body, '')) AS bo FROM dd WHERE rn = 1),
p AS (SELECT *, greatest({', '.join(tier_sql(t, k) for t in ('engineer', 'accountant') for k in ('k1', 'k2'))}) + {_BOOST} - (CASE WHEN {hits_sql('phlebotomy', 'he')} > 0 THEN 30 WHEN {hits_sql('phlebotomy', 'bo')} > 0 THEN 15 ELSE 0 END) AS points FROM e),
top AS (SELECT * FROM p ORDER BY points DESC, slot, url LIMIT 100)"""
W = f"WITH pool AS {LATEST}"
_PAY = "(CASE WHEN salary_min > 0 AND upper(trim(coalesce(salary_currency, ''))) IN ('', 'USD') THEN CASE WHEN lower(trim(coalesce(salary_period, ''))) = '' THEN CASE WHEN salary_min >= 15000 THEN salary_min END ELSE salary_min * CASE lower(trim(salary_period)) WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'hour' THEN 2080 WHEN 'day' THEN 260 END END END)"
_SERVABLE = "upper(trim(coalesce(salary_currency, ''))) IN ('', 'USD') AND upper(trim(coalesce(country, ''))) IN ('', 'US') AND (remote_areas IS NULL OR len(remote_areas) = 0 OR len(list_filter(remote_areas, lambda a: upper(a) = 'US' OR starts_with(upper(a), 'US-'))) > 0)"
ORACLES = {
    "board_delivered": f"{_BOARD} SELECT url, CAST(points AS INTEGER) AS points FROM top",
    "board_facets": f"{_BOARD} SELECT facet, value, count(*) AS n FROM ({' UNION ALL '.join(f'''SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM top''' for f in ('category', 'employment_type', 'remote', 'seniority', 'salary_band', 'state'))} UNION ALL SELECT 'apply_via', CASE WHEN direct_apply THEN 'employer' WHEN NOT direct_apply THEN 'aggregator' ELSE '' END FROM top) WHERE value <> '' GROUP BY ALL",
    "board_candidates": f"""{_RANKED.replace('{0}', '')}, g AS (SELECT pool.*, rank, {key_sql('company')} AS ck, {key_sql('title')} AS k1 FROM rk JOIN pool USING (url) WHERE remote = 'remote'),
gk AS (SELECT *, CASE WHEN ck = '' AND k1 = '' THEN 'url:' || url ELSE ck || '|' || k1 END AS gk FROM g),
dd AS (SELECT url, min(rank) OVER (PARTITION BY gk) AS slot, row_number() OVER (PARTITION BY gk ORDER BY length(coalesce(body, '')) DESC, rank) AS rn FROM gk),
lex AS (SELECT url, row_number() OVER (ORDER BY slot, url) - 1 AS rank0 FROM dd WHERE rn = 1),
num AS (SELECT url, remote, row_number() OVER (ORDER BY url) - 1 AS vec_id FROM pool), vec AS (SELECT url, vec_id AS id, embedding::DOUBLE[] AS e FROM num JOIN embeddings USING (vec_id) WHERE remote = 'remote'),
pr AS (SELECT vec_id AS probe, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
sim AS (SELECT probe, url, id, row_number() OVER (PARTITION BY probe ORDER BY round(list_cosine_similarity(e, q), 9) DESC, id) - 1 AS rank0 FROM vec, pr),
den0 AS (SELECT url, id, sum(1.0::DOUBLE / (60 + rank0)) AS rrf FROM sim WHERE rank0 < 200 GROUP BY url, id), den1 AS (SELECT * FROM den0 ORDER BY round(rrf, 12) DESC, id LIMIT 200),
den AS (SELECT url, row_number() OVER (ORDER BY round(rrf, 12) DESC, url) - 1 AS rank0 FROM den1),
b AS (SELECT url, sum(1.0::DOUBLE / (60 + rank0)) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY url),
c AS (SELECT url, rrf, row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(company)), ''), url) ORDER BY round(rrf, 12) DESC, url) AS rn FROM b JOIN pool USING (url))
SELECT url, round(rrf, 9) AS rrf FROM c WHERE rn <= 3 ORDER BY round(rrf, 12) DESC, url LIMIT 50""",
    "search_loose": f"{_RANKED.replace('{0}', '''AND w = 'accountant' ''')} SELECT url FROM rk JOIN pool USING (url) WHERE coalesce(remote, '') NOT IN ('onsite', 'hybrid') AND coalesce({_PAY}, 60000) >= 60000 ORDER BY rank LIMIT 40",
    "pool_stats": f"{W} SELECT count(*) AS pool, max(posted) AS newest_posted, epoch_us(max(last_seen)) AS last_us, count(DISTINCT company) AS companies FROM pool",
    "partition_subset": f"{W} SELECT source, count(*) AS n FROM pool WHERE source IN ('rolewire', 'werkpfad') GROUP BY source",
    "csv_roundtrip": "SELECT status, count(*) AS n, CAST(sum(roles) AS BIGINT) AS roles FROM companies GROUP BY status",
    "log_lines": f"""{W}, r AS (SELECT company, url, row_number() OVER (PARTITION BY company ORDER BY url) AS n FROM pool WHERE company IS NOT NULL),
s AS (SELECT company, n, sum(strlen(url) + 3) OVER (PARTITION BY company ORDER BY n) AS bytes FROM r WHERE n <= 60)
SELECT company, CAST(count(*) FILTER (strlen('{{"company":' || to_json(company) || ',"top":[') + bytes - 1 + 2 < 600) AS INTEGER) AS kept FROM s GROUP BY company""",
    "stream_import": f"{W} SELECT url, coalesce(title, '') AS title FROM pool WHERE {_SERVABLE}",
}
