"""Queries of the problems on training data, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.llm import canon, leakage, mixing, names, neardup, ranking, spam
from boardwright.session import table


def p1_found(spark, sf):
    return canon.canonical_fields(table(spark, sf, "jobs"), table(spark, sf, "canon_titles"), table(spark, sf, "canon_places"))


def p1_misses(spark, sf):
    return canon.misses(table(spark, sf, "jobs"), table(spark, sf, "canon_titles"), table(spark, sf, "canon_places"))


def p4_found(spark, sf):
    pairs = neardup.relisted_jobs(table(spark, sf, "jobs")).key_pairs()
    return pairs.select(F.col("key_a").alias("url_a"), F.col("key_b").alias("url_b"))


def p4_listing_classes(spark, sf):
    """One row per url: its class, and to how many listings of another text it is linked."""
    got = neardup.classes(neardup.relisted_jobs(table(spark, sf, "jobs")))
    return got.select(F.col("key").alias("url"), "class_id", "links")


def p4_document_classes(spark, sf):
    got = neardup.classes(neardup.near_duplicates(table(spark, sf, "documents"), "doc_id", ["text"]))
    return got.select(F.col("key").alias("doc_id"), "class_id", "links")


def p6_found(spark, sf):
    """The tie and order-effect model on the verdicts that count here: without ties, each half in both orders."""
    got = ranking.strengths(table(spark, sf, "verdicts"), table(spark, sf, "entrants"), ties=False, ridge=1e-9, balanced=True)
    return got.select("slug", "rank_no")


def p6_strengths(spark, sf):
    return ranking.strengths(table(spark, sf, "verdicts"), table(spark, sf, "entrants"))


def p6_intervals(spark, sf):
    return ranking.intervals(table(spark, sf, "verdicts"), table(spark, sf, "entrants"))


def p7_found(spark, sf):
    return names.linked_names(table(spark, sf, "companies"), table(spark, sf, "jobs"))


def p7_employers(spark, sf):
    """One row per ledger row: its employer's smallest name_key, and how many ledger rows that employer has."""
    return names.ledger_classes(table(spark, sf, "companies"), table(spark, sf, "jobs"))


def p8_found(spark, sf):
    return leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id")


def p8_longest_matches(spark, sf):
    return leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_clean_counts(spark, sf):
    return leakage.without_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).groupBy("lang").agg(F.count("*").alias("n"))


def p9_mix_plan(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).plan


def p9_mix_shares(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).shares


def p10_found(spark, sf):
    return spam.spam_pages(table(spark, sf, "documents"))


def p10_scores(spark, sf):
    return spam.score_pages(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_misses, p4_found, p4_listing_classes, p4_document_classes, p6_found, p6_strengths, p6_intervals, p7_found, p7_employers, p8_found, p8_longest_matches, p8_clean_counts, p9_mix_plan, p9_mix_shares, p10_found, p10_scores)
}

_PLAIN = "lower(strip_accents(nfc_normalize(text)))"
for _from, _to in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("\u00ad", ""), ("\u200b", "")):
    _PLAIN = f"replace({_PLAIN}, '{_from}', '{_to}')"
_P8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+9], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 9)) AS t(i)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS g FROM b, unnest(generate_series(1, len(w) - 9)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g))"""
def _near_sql(source: str, key: str, text: str, size: int, threshold: float, select: str) -> str:
    """Similar texts by brute force: t (id, key, w), p (a, b) of different texts, both ways."""
    return f"""WITH RECURSIVE k AS (SELECT DISTINCT {key} AS key, {text} AS txt FROM {source} WHERE {key} IS NOT NULL),
t AS (SELECT txt, dense_rank() OVER (ORDER BY txt) AS id, key, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') AS w FROM k),
u AS (SELECT DISTINCT id, w FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT id, hash(array_to_string(w[i:i+{size - 1}], ' ')) AS g FROM u, unnest(generate_series(1, greatest(1, len(w) - {size - 1}))) AS x(i)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= {threshold} * (x.n + y.n - c)),
r AS (SELECT id AS a, id AS b FROM u UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
{select}"""


_LISTING = "concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''), coalesce(body, ''))"
_CLASSES = """SELECT t.key AS {key}, min(o.key) AS class_id, (SELECT count(*) FROM p WHERE p.a = t.id) AS links
FROM t JOIN r ON r.a = t.id JOIN t o ON o.id = r.b GROUP BY t.key, t.id"""
_PAIRS = """SELECT DISTINCT least(x.key, y.key) AS url_a, greatest(x.key, y.key) AS url_b FROM (SELECT a, b FROM p UNION SELECT id, id FROM u) AS q JOIN t x ON x.id = q.a JOIN t y ON y.id = q.b WHERE x.key <> y.key"""
_SLUG = "nullif(regexp_replace(lower(trim({})), '\\s*:free$', ''), '')"
# minorise-maximise steps of the model in which a beats b with strength a over the sum of both
_P6 = f"""WITH RECURSIVE e AS (SELECT slug, {_SLUG.format("slug")} AS k, row_number() OVER (ORDER BY {_SLUG.format("slug")}) AS i FROM entrants),
v AS (SELECT verdict_id, {_SLUG.format("a")} AS a, {_SLUG.format("b")} AS b, {_SLUG.format("winner")} AS w FROM verdicts WHERE verdict_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY a, b, CASE WHEN w = a THEN 1 WHEN w = b THEN 2 ELSE 3 END) AS nth FROM v WHERE a <> b AND (w = a OR w = b OR w IS NULL OR w IN ('tie', 'draw'))),
c AS (SELECT x.i AS i, y.i AS j, count(*) AS n FROM o JOIN e x ON x.k = w JOIN e y ON y.k = CASE WHEN w = a THEN b ELSE a END WHERE nth = 1 AND w IN (a, b) GROUP BY ALL),
g AS (SELECT x.i, y.i AS j, coalesce(p.n, 0) AS won, coalesce(p.n, 0) + coalesce(q.n, 0) AS met FROM e x CROSS JOIN e y LEFT JOIN c p ON p.i = x.i AND p.j = y.i LEFT JOIN c q ON q.i = y.i AND q.j = x.i),
m AS (SELECT list(won ORDER BY i) AS won, list(met ORDER BY i) AS met FROM (SELECT i, sum(won)::DOUBLE AS won, list(met::DOUBLE ORDER BY j) AS met FROM g GROUP BY i)),
s AS (SELECT 0 AS step, list_transform(won, lambda x: 1.0::DOUBLE) AS p FROM m
  UNION ALL SELECT step + 1, list_transform(q, lambda x: x / list_sum(q)) FROM (SELECT step, list_transform(range(1, len(won) + 1), lambda i: won[i] / list_sum(list_transform(range(1, len(won) + 1), lambda j: met[i][j] / (p[i] + p[j])))) AS q FROM s, m WHERE step < 3000))
SELECT slug, CAST(row_number() OVER (ORDER BY p[i] DESC, slug) AS INTEGER) AS rank_no FROM e, (SELECT p FROM s ORDER BY step DESC LIMIT 1)"""
ORACLES = {
    "p6_found": _P6,
    "p4_found": _near_sql("jobs", "url", _LISTING, 3, 0.5, _PAIRS),
    "p4_listing_classes": _near_sql("jobs", "url", _LISTING, 3, 0.5, _CLASSES.format(key="url")),
    "p4_document_classes": _near_sql("documents", "doc_id", "coalesce(text, '')", 5, 0.8, _CLASSES.format(key="doc_id")),
    # runs of ten-word sequences that follow each other in both texts, on one diagonal
    "p8_longest_matches": f"""{_P8.split("dg AS", 1)[0]}dg AS (SELECT doc_id, i, array_to_string(w[i:i+9], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 9)) AS t(i)),
bg AS (SELECT item_id, i AS j, array_to_string(w[i:i+9], ' ') AS g FROM b, unnest(generate_series(1, len(w) - 9)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, item_id, i, j FROM dg JOIN bg USING (g)),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS k FROM hit),
run AS (SELECT doc_id, item_id, count(*) + 9 AS n, min(i) - 1 AS place FROM isle GROUP BY doc_id, item_id, i - j, k)
SELECT doc_id, item_id, max(n) AS match_words, arg_min(place, -n * 1000000000 + place) AS word_position FROM run GROUP BY doc_id, item_id""",
    "p8_found": f"{_P8} SELECT doc_id, item_id FROM hit",
    "p8_clean_counts": f"{_P8} SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) GROUP BY lang",
}
