"""Queries of lexical and dense retrieval and rank fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.operators import dense, lexical, order, pool
from boardwright.plans.listings import _HTML, LATEST, jobs
from boardwright.session import table

WORDS = ["Engineer", "Accountant", "Registered Nurse"]
#: Every vector whose id is divisible by this is a search.
EVERY = 50


def _documents(spark, sf):
    return jobs(spark, sf, ["url", "title", "location", "body"])


def bm25_titles(spark, sf):
    df = _documents(spark, sf)
    got = lexical.bm25(lexical.postings(df, "url", "title"), lexical.doc_stats(df, "url", ["title", "location", "body"]), lexical.query_clauses(["Engineer", "Accountant"]))
    return got.select(F.col("doc").alias("url"), F.round("score", 6).alias("score"))


def bm25_stemmed(spark, sf):
    df = _documents(spark, sf)
    got = lexical.bm25(lexical.postings(df, "url", "title", stemmed=True), lexical.doc_stats(df, "url", ["title", "location", "body"]), lexical.query_clauses(WORDS, stemmed=True))
    return got.select(F.col("doc").alias("url"), F.round("score", 6).alias("score"))


def near_matches(spark, sf):
    hit = lexical.matches(lexical.postings(_documents(spark, sf), "url", "title"), lexical.query_clauses(["Senior Manager", "Software Engineer"]))
    return hit.select(F.col("doc").alias("url"), "clause").distinct()


def match_count(spark, sf):
    hit = lexical.matches(lexical.postings(_documents(spark, sf), "url", "title"), lexical.query_clauses(["Engineer", "Accountant", "Nurse"]))
    return hit.agg(F.countDistinct("doc").alias("n"))


def index_reconcile(spark, sf):
    df = _documents(spark, sf)
    return lexical.postings(df, "url", "title").agg(F.countDistinct("doc").alias("indexed")).crossJoin(df.agg(F.count_if(F.col("title").rlike(r"[\p{L}\p{N}]")).alias("stored")))


def index_upkeep(spark, sf):
    """(term, titles) of an index kept up: built over the listings of 2025, then told of all rows seen since."""
    df = table(spark, sf, "jobs").select("url", "title", "location", "body", "last_seen", "fetched_at")
    at = F.to_timestamp(F.lit("2026-01-01"))
    old = pool.latest(df.where(F.col("last_seen") < at), "url", ["last_seen", "fetched_at"])
    new = pool.latest(df.where(F.col("last_seen") >= at), "url", ["last_seen", "fetched_at"])
    cols = ["title", "location", "body"]
    index, totals = lexical.build_index(old, "url", "title", cols)
    index, totals = lexical.update_index(index, totals, old.join(new.select("url"), "url", "left_semi"), new, "url", "title", cols)
    terms = index.groupBy("term").agg(F.count("*").alias("titles"), F.sum("length").cast("bigint").alias("lengths"))
    return terms.unionByName(totals.select(F.lit("*").alias("term"), F.col("docs").alias("titles"), F.col("tokens").cast("bigint").alias("lengths")))


def _near(spark, sf, depth=dense.PROBE_DEPTH):
    v = table(spark, sf, "embeddings")
    return dense.top_per_probe(v, "vec_id", "embedding", dense.probes_from(v, "vec_id", EVERY), "vec_id", "embedding", depth)


def knn_per_probe(spark, sf):
    return _near(spark, sf).select("probe", "id", F.round("sim", 5).alias("sim"), F.col("rank0").cast("int").alias("rank0"))


def rrf_probes(spark, sf):
    got = dense.fuse(_near(spark, sf), "id")
    return got.orderBy(F.desc(F.round("rrf", 12)), "id").limit(40).select("id", F.round("rrf", 9).alias("rrf"))


def hybrid_rrf(spark, sf):
    """BM25 over the texts of documents and a dense arm over the vectors of the same numbers, at most three of a board."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "board")
    hits = lexical.bm25(lexical.postings(docs, "doc_id", "text"), lexical.doc_stats(docs, "doc_id", ["text"]), lexical.query_clauses(["Team"]))
    lex = order.numbered(hits.select(F.col("doc").alias("id"), "score"), [F.desc(F.round("score", 9)), "id"], "rank0")
    fused = dense.fuse(_near(spark, sf), "id").orderBy(F.desc(F.round("rrf", 12)), "id").limit(max(4 * 60, dense.PROBE_DEPTH))
    den = order.numbered(fused, [F.desc(F.round("rrf", 12)), "id"], "rank0")
    boards = docs.select(F.col("doc_id").alias("id"), F.lower(F.trim("board")).alias("b"))
    return dense.hybrid(lex, den, "id", F.col("b"), 60, groups=boards).select("id", F.round("rrf", 9).alias("rrf"))


SUMMARY = ["title", "title_root", "title_qualifiers", "company", "team", "category", "location", "tags", "body"]


def content_ids(spark, sf):
    return jobs(spark, sf, ["url", *SUMMARY]).select("url", dense.content_id(F.col("url"), dense.summary_text(*SUMMARY)).alias("content_id"))


def vector_sync(spark, sf):
    """Stored ids are those of listings seen before 2026 with their first title; the pool has moved on since."""
    df = jobs(spark, sf, ["url", *SUMMARY, "last_seen"])
    cid = dense.content_id(F.col("url"), dense.summary_text(*SUMMARY))
    now = df.where(F.col("last_seen") >= F.to_timestamp(F.lit("2025-10-01"))).select("url", cid.alias("cid"))
    old = df.where(F.col("last_seen") < F.to_timestamp(F.lit("2026-03-01"))).select("url", F.when(F.length("url") % 7 == 0, F.lit("stale")).otherwise(cid).alias("cid"))
    return pool.sync_plan(now, old, "url", "cid").groupBy("action").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (bm25_titles, bm25_stemmed, near_matches, match_count, index_reconcile, index_upkeep, knn_per_probe, rrf_probes, hybrid_rrf, content_ids, vector_sync)}

_TOK = "regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_D = f"WITH pool AS {LATEST}, d AS (SELECT url, {_TOK.format('title')} AS t, len({_TOK.format('title')}) + len({_TOK.format('location')}) + len({_TOK.format('body')}) AS len FROM pool), av AS (SELECT count(*) AS docs, avg(len) AS mean FROM d)"
_BM = """, q(w) AS (VALUES ('engineer'), ('accountant')), f AS (SELECT url, w, len, len(list_filter(t, lambda x: x = w)) AS tf FROM d, q), n AS (SELECT w, count(*) AS n FROM f WHERE tf > 0 GROUP BY w),
i AS (SELECT w, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, mean FROM n, av)
SELECT url, round(sum(idf * (8.0 * tf) * 2.2 / (8.0 * tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN i USING (w) WHERE tf > 0 GROUP BY url"""


def _near_sql(a: str, b: str, i: int) -> str:
    return f"SELECT url, {i} AS clause FROM d, unnest(range(1, len(t) + 1)) AS u(x), unnest(range(1, len(t) + 1)) AS v(y) WHERE t[x] = '{a}' AND t[y] = '{b}' AND abs(x - y) <= 4"


_V = f"""WITH p AS (SELECT vec_id AS probe, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT probe, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM embeddings, p),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, id) - 1 AS rank0 FROM s), k AS (SELECT * FROM r WHERE rank0 < 200), fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank0)) AS rrf FROM k GROUP BY id)"""
_SUM = """concat_ws(chr(10), concat_ws(' · ', CASE WHEN trim(title) <> '' THEN title END, CASE WHEN lower(title_root) <> lower(title) AND trim(title_root) <> '' THEN title_root END, CASE WHEN len(title_qualifiers) > 0 THEN array_to_string(title_qualifiers[1:4], ', ') END),
 concat_ws(' · ', CASE WHEN trim(company) <> '' THEN 'Company: ' || company END, CASE WHEN trim(team) <> '' THEN 'Team: ' || team END, CASE WHEN trim(category) <> '' THEN 'Field: ' || category END, CASE WHEN trim(location) <> '' THEN 'Location: ' || location END),
 CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags[1:8], ', ') END, substr({html}, 1, 1800))""".format(html=_HTML)
ORACLES = {
    "bm25_titles": _D + _BM,
    # the words of English titles that have the stems of engineer, accountant, registered and nurse
    "bm25_stemmed": f"""{_D}, st AS (SELECT url, len, list_transform(t, lambda x: CASE WHEN x IN ('engineer', 'engineers', 'engineering', 'engineered', 'engine', 'engines') THEN 'engin' WHEN x IN ('accountant', 'accountants') THEN 'account' WHEN x IN ('account', 'accounts', 'accounting', 'accounted') THEN 'account' WHEN x IN ('register', 'registered', 'registering', 'registers') THEN 'regist' WHEN x IN ('nurse', 'nurses', 'nursing', 'nursed') THEN 'nurs' ELSE x END) AS t FROM d),
df AS (SELECT w, count(*) AS n FROM st, (VALUES ('engin'), ('account'), ('regist'), ('nurs')) AS v(w) WHERE list_contains(t, w) GROUP BY w),
i AS (SELECT w, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, mean FROM df, av),
one AS (SELECT url, len, w, len(list_filter(t, lambda x: x = w)) AS tf FROM st, (VALUES ('engin'), ('account')) AS v(w)),
two AS (SELECT url, len, x, y FROM st, unnest(range(1, len(t) + 1)) AS u(x), unnest(range(1, len(t) + 1)) AS v(y) WHERE t[x] = 'regist' AND t[y] = 'nurs' AND abs(x - y) <= 4),
f AS (SELECT url, len, w, tf FROM one WHERE tf > 0 UNION ALL SELECT url, len, 'regist', count(DISTINCT x) FROM two GROUP BY url, len UNION ALL SELECT url, len, 'nurs', count(DISTINCT y) FROM two GROUP BY url, len)
SELECT url, round(sum(idf * (8.0 * tf) * 2.2 / (8.0 * tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN i USING (w) GROUP BY url""",
    "near_matches": f"{_D} SELECT DISTINCT url, CAST(clause AS INTEGER) AS clause FROM ({_near_sql('senior', 'manager', 0)} UNION ALL {_near_sql('software', 'engineer', 1)})",
    "match_count": f"{_D} SELECT count(*) AS n FROM d WHERE list_has_any(t, ['engineer', 'accountant', 'nurse'])",
    "index_reconcile": f"{_D} SELECT count(*) FILTER (len(t) > 0) AS indexed, (SELECT count(*) FROM pool WHERE regexp_matches(title, '[\\p{{L}}\\p{{N}}]')) AS stored FROM d",
    "index_upkeep": f"{_D} SELECT term, count(*) AS titles, CAST(sum(len) AS BIGINT) AS lengths FROM (SELECT DISTINCT url, len, unnest(t) AS term FROM d) GROUP BY term UNION ALL SELECT '*', count(*), CAST(sum(len) AS BIGINT) FROM d",
    "knn_per_probe": f"{_V} SELECT probe, id, round(sim, 5) AS sim, CAST(rank0 AS INTEGER) AS rank0 FROM k",
    "rrf_probes": f"{_V} SELECT id, round(rrf, 9) AS rrf FROM fused ORDER BY round(rrf, 12) DESC, id LIMIT 40",
    "hybrid_rrf": f"""{_V}, h AS (SELECT doc_id, board, {_TOK.format('text')} AS t FROM documents), m AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM h),
f AS (SELECT doc_id, len(t) AS len, len(list_filter(t, lambda x: x = 'team')) AS tf FROM h), n AS (SELECT count(*) AS n FROM f WHERE tf > 0),
g AS (SELECT doc_id, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * (8.0 * tf) * 2.2 / (8.0 * tf + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM f, n, m WHERE tf > 0),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM g),
e AS (SELECT id, row_number() OVER (ORDER BY round(rrf, 12) DESC, id) - 1 AS rank0 FROM fused ORDER BY rank0 LIMIT 240), b AS (SELECT id, sum(1.0::DOUBLE / (60 + rank0)) AS rrf FROM (SELECT * FROM l UNION ALL SELECT * FROM e) GROUP BY id),
c AS (SELECT b.*, row_number() OVER (PARTITION BY coalesce(lower(trim(board)), 'id:' || id) ORDER BY round(rrf, 12) DESC, id) AS rn FROM b LEFT JOIN documents ON doc_id = id) SELECT id, round(rrf, 9) AS rrf FROM c WHERE rn <= 3 ORDER BY round(rrf, 12) DESC, id LIMIT 60""",
    "content_ids": f"WITH pool AS {LATEST} SELECT url, sha1(encode(url) || '\\x00'::BLOB || encode({_SUM})) AS content_id FROM pool",
    "vector_sync": f"""WITH pool AS {LATEST}, p AS (SELECT *, sha1(encode(url) || '\\x00'::BLOB || encode({_SUM})) AS cid FROM pool), a AS (SELECT url, cid FROM p WHERE last_seen >= TIMESTAMPTZ '2025-10-01 00:00:00+00'), b AS (SELECT url, CASE WHEN length(url) % 7 = 0 THEN 'stale' ELSE cid END AS cid FROM p WHERE last_seen < TIMESTAMPTZ '2026-03-01 00:00:00+00')
SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.url IS NULL THEN 'new' WHEN a.url IS NULL THEN 'gone' WHEN a.cid <> b.cid THEN 'changed' END AS action FROM a FULL OUTER JOIN b ON a.url = b.url) WHERE action IS NOT NULL GROUP BY action""",
}
