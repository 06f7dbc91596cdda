import pytest

from boardwright.operators import intake as I
from boardwright.operators import lexical as L
from boardwright.sources import files as S


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.publish_table(spark.range(3), path)
    assert S.current_table(spark, path).count() == 3
    S.publish_table(S.current_table(spark, path).where("id < 2"), path)
    assert S.current_table(spark, path).count() == 2


def test_meta_is_read_again_when_the_file_changes(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"meta": {"n": 1}, "jobs": []}')
    assert S.cached_meta(spark, str(p), "n int") == {"n": 1} == S.cached_meta(spark, str(p), "n int")
    p.write_text('{"meta": {"n": 22}, "jobs": []}')
    assert S.cached_meta(spark, str(p), "n int") == {"n": 22}


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("2026-01-01", ["a"]), ("2026-02-01", ["b"])], "ts string, top array<string>")
    S.append_log(df, path)
    (tmp_path / "log" / "more.txt").write_text("{broken\n\n")
    good, bad = S.recent_lines(spark, path, "ts string, top array<string>", "ts", "2026-01-15")
    assert [r.ts for r in good.collect()] == ["2026-02-01"] and bad.first().unreadable == 1
    assert not S.rotate_log(spark, path) and S.rotate_log(spark, path, most_bytes=1) and not (tmp_path / "log").exists() and (tmp_path / "log.1").exists()
    S.append_log(df, path, rotate_bytes=1)
    assert not S.rotate_log(spark, str(tmp_path / "none"))


def test_cases_and_file_lists(spark, tmp_path):
    for k in "cab":
        (tmp_path / f"{k}.json").write_text(f'{{"id": "{k}",\n "x": 1}}')
    read = lambda **kw: [r.id for r in S.read_cases(spark, f"{tmp_path}/*.json", "id string, x int", **kw).collect()]
    assert read() == ["a", "b", "c"] and read(limit=2) == ["a", "b"] and read(ids=["c", "zz"]) == ["c"]
    with pytest.raises(S.SnapshotError):
        S.read_files(spark, [])


def test_sources_that_fail(spark):
    rows, report = I.union_sources({"a": spark.createDataFrame([("u",)], "url string"), "b": RuntimeError("Your account has run out of searches."), "c": ValueError("API key missing"), "d": OSError("x")})
    assert rows.count() == 1 and {(r.source, r.n, r.why) for r in report.collect()} == {("a", 1, ""), ("b", 0, "quota"), ("c", 0, "no_key"), ("d", 0, "error:OSError")}
    with pytest.raises(ValueError, match="every source"):
        I.union_sources({"a": OSError("x")})


def test_phrases(spark):
    assert L.query_clauses(["AI/ML Engineer", "C++", " !! ", 'the "cat"*']) == [[("ai", "ml"), "engineer"], ["c"], ["the", "cat"]]
    titles = ["AI/ML Engineer", "ai ml a b c engineer", "ai ml a b c d engineer", "ml engineer ai", "engineer x ai ml", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    index = L.postings(df, "id", "title")
    # a phrase of two tokens may begin five places before the last word
    assert {r.doc for r in L.matches(index, L.query_clauses(["AI/ML Engineer"])).collect()} == {0, 1, 4}
    scores = {r.doc: r.score for r in L.bm25(index, L.doc_stats(df, "id", ["title"]), L.query_clauses(["AI/ML Engineer"])).collect()}
    assert set(scores) == {0, 1, 4} and scores[0] > scores[1]


def test_index_upkeep_equals_a_rebuild(spark):
    cols = "id int, title string, body string"
    old = spark.createDataFrame([(1, "Data Engineer", "x y"), (2, "Nurse", None), (3, None, "z"), (4, "Cook", "")], cols)
    new = spark.createDataFrame([(1, "Data Scientist", "x"), (2, "Nurse", None), (3, None, "z"), (5, "New cook", "a b c")], cols)
    changed, gone, came = old.where("id = 1"), old.where("id = 4"), new.where("id IN (1, 5)")
    index, totals = L.build_index(old, "id", "title", ["title", "body"])
    index, totals = L.update_index(index, totals, changed.union(gone), came, "id", "title", ["title", "body"])
    want, whole = L.build_index(new, "id", "title", ["title", "body"])
    rows = lambda d: {(r.term, r.doc, tuple(r.positions), r.length) for r in d.collect()}
    assert rows(index) == rows(want) and tuple(totals.first()) == tuple(whole.first())
