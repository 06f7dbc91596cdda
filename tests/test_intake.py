import json

import pytest
from pyspark.sql import functions as F

from boardwright.operators import intake as I
from boardwright.operators import pool
from boardwright.schema import JOBS, RAW, check
from boardwright.streaming.imports import import_snapshots

def now():
    return F.to_timestamp(F.lit("2026-01-09"))


def _raw(spark, *rows):
    return spark.read.schema(RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_schema_has_forty_columns_in_order():
    assert len(JOBS) == 40 and JOBS.names[:5] == ["url", "title", "title_root", "title_level", "title_qualifiers"] and JOBS.names[-2:] == ["fetched_at", "last_seen"]
    with pytest.raises(ValueError):
        check(RAW)


def test_nulls_that_mean_something(spark):
    r = I.normalise(_raw(spark, {"url": "u"}, {"url": "v", "remote_areas": [], "tags": [" "], "direct_apply": False, "sources": ["s1", "s2"], "category": "IT Jobs", "text": "x" * 9000, "salary": "$255k – $290k", "title": "Remote Clerk", "seniority": "boss", "seniority_basis": "stated"}), now()).orderBy("url").collect()
    assert (r[0].title, r[0].body, r[0].remote, r[0].remote_areas, r[0].tags, r[0].direct_apply, r[0].salary_band, r[0].source) == ("", "", None, None, None, None, "", "")
    assert (r[1].remote, r[1].remote_basis, r[1].remote_areas, r[1].tags, r[1].direct_apply, r[1].category, len(r[1].body), r[1].salary_band, r[1].source, r[1].seniority, r[1].seniority_basis) == ("remote", "derived", [], None, False, "Software Engineering", 8000, "180k-plus", "s1", None, None)


def test_normalise_of_few_columns_and_no_rows(spark):
    assert I.normalise(spark.createDataFrame([("u",)], "url string"), now()).schema.names == JOBS.names
    assert I.normalise(_raw(spark), now()).count() == 0


def test_admission(spark):
    rows = [("", None, None, None, True), ("https://www.adzuna.com/1", None, None, None, False), ("https://badzuna.com/1", None, None, None, None), ("u1", "EUR", None, None, True), ("u2", None, "GB", None, True), ("u3", None, "us", ["GB"], True), ("u4", None, None, ["CA", "US-TX"], True), ("u5", "usd", "", [], True)]
    df = spark.createDataFrame(rows, "url string, salary_currency string, country string, remote_areas array<string>, direct_apply boolean")
    got = {r.url: r.why for r in df.select("url", pool.reject_reason().alias("why")).collect()}
    assert got == {"": "blank url", "https://www.adzuna.com/1": None, "https://badzuna.com/1": "not direct", "u1": "not servable", "u2": "not servable", "u3": "not servable", "u4": None, "u5": None}


def test_sources_and_fallback(spark):
    a, b = spark.createDataFrame([("x", 1)], "url string, n int"), spark.createDataFrame([], "url string")
    rows, report = I.union_sources({"a": a, "b": b})
    assert rows.count() == 1 and {tuple(r) for r in report.collect()} == {("a", 1, ""), ("b", 0, "empty")}
    assert I.with_fallback(b, lambda: a).count() == 1


def test_rows_in_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert [r.url for r in I.rows_in_order(df, "url", ["c", "zz", "a"]).collect()] == ["c", "a"]


def test_messages_and_verdicts(spark):
    m = spark.createDataFrame([(1, "user", "hi"), (1, "system", "x"), (1, "user", " "), (1, "assistant", "y" * 5000), (1, None, "z")], "c int, role string, content string")
    got = I.sanitize_messages(m).collect()
    assert [(r.role, len(r.content)) for r in got] == [("user", 2), ("assistant", 4000)] and not I.over_turn_cap(m, "c").first().over
    v = spark.createDataFrame([('say {"winner": "A"}', '{"winner": "B"}'), ('{"winner": "A"}', '{"winner": "A"}'), (None, "junk")], "x string, y string")
    assert [r[0] for r in v.select(I.judged(F.col("x"), F.col("y"), F.lit("m1"), F.lit("m2"))).collect()] == ["m1", None, None]


def test_snapshots_are_imported_once(spark, tmp_path):
    folder, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "one.json").write_text('{"url": "a", "title": "old", "country": "US"}\n{"url": "b", "country": "GB"}\n{"url": ""}\n')
    import_snapshots(spark, str(folder), store, state, "2026-01-01")
    (folder / "two.json").write_text('{"url": "a", "title": "new"}\n{"url": "c"}\n')
    import_snapshots(spark, str(folder), store, state, "2026-01-05")
    import_snapshots(spark, str(folder), store, state, "2026-01-09")
    got = {r.url: (r.title, r.fetched_at.day, r.last_seen.day) for r in spark.read.parquet(store).collect()}
    assert got == {"a": ("new", 1, 5), "c": ("", 5, 5)}
