import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardwright.operators import dense, lexical

ROWS = [
    ("a1", "Senior Accountant", "x", "ledger work " * 40), ("a2", "Accountant", "y", "ledger work " * 4), ("a3", "Accountants, Engineering", None, "one"), ("b1", "Software Engineer", "z", "code"), ("b2", "Engineer for Software", None, None), ("b3", "Data engineering of very many different softwares", "q", "w"),
    ("c1", "Nurse", "x", "care " * 9), ("c2", "Registered Nurse", "x", "care"), ("c3", "Chef", "x", "cook"), ("c4", "Welder", "x", "weld"), ("c5", "Baker", "x", "bread"), ("c6", None, "x", "nothing"), ("c7", "Café Manager", "x", ""),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "url string, title string, location string, body string")


def _fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, location, body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, title, location, body) VALUES (?,?,?,?)", [(i, *r[1:]) for i, r in enumerate(ROWS)])
    return {ROWS[i][0]: -s for i, s in con.execute("SELECT rowid, bm25(f, 8.0, 2.0, 1.0) FROM f WHERE f MATCH ?", (query,))}


@pytest.mark.parametrize("titles,query", [(["accountant"], "title: NEAR(\"accountant\", 3)"), (["software engineer"], "title: NEAR(\"software\" \"engineer\", 3)"), (["nurse"], "title: NEAR(\"nurse\", 3)")])
def test_bm25_agrees_with_a_full_text_engine(spark, corpus, titles, query):
    index, stats = lexical.postings(corpus, "url", "title", stemmed=True), lexical.doc_stats(corpus, "url", ["title", "location", "body"])
    got = {r.doc: r.score for r in lexical.bm25(index, stats, lexical.query_clauses(titles, stemmed=True)).collect()}
    want = _fts(query)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_no_query_no_rows(spark, corpus):
    index, stats = lexical.postings(corpus, "url", "title"), lexical.doc_stats(corpus, "url", ["title"])
    assert lexical.query_clauses(["***", ""]) == []
    assert lexical.bm25(index, stats, []).count() == 0


def test_a_title_of_six_words_is_not_near_itself():
    assert all(lexical.near_positions([[0], [1], [2], [3], [4]]))
    assert not all(lexical.near_positions([[0], [1], [2], [3], [4], [5]]))
    assert all(lexical.near_positions([[4], [0]])) and not all(lexical.near_positions([[0], [5]]))


def test_accents_fold(spark, corpus):
    index = lexical.postings(corpus, "url", "title")
    assert [r.doc for r in index.where("term = 'cafe'").collect()] == ["c7"]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [])], "id bigint, e array<float>")
    got = dense.top_per_probe(df.repartition(5), "id", "e", df.where("id IN (3, 11)"), "id", "e", 20).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for p in (3, 11):
        sims = u @ u[p]
        want = sorted(range(300), key=lambda i: (-round(float(sims[i]), 9), i))[:20]
        assert [r.id for r in sorted((r for r in got if r.probe == p), key=lambda r: r.rank0)] == want
    assert dense.top_per_probe(df, "id", "e", df.where("id = 900"), "id", "e").count() == 0


def test_fusion_and_cap(spark):
    lex = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, rank0 int")
    den = spark.createDataFrame([("c", 0), ("d", 1)], "id string, rank0 int")
    got = dense.hybrid(lex, den, "id", None, 3).collect()
    assert [r.id for r in got] == ["c", "a", "b"] and got[0].rrf == pytest.approx(1 / 62 + 1 / 60)
    one = dense.hybrid(lex, den, "id", F.lit("g"), 10, per_group=2).collect()
    assert len(one) == 2
    assert [r.id for r in dense.hybrid(lex, den.limit(0), "id", None, 3).collect()] == ["a", "b", "c"]
