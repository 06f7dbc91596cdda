import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwright.operators import analytics as A
from boardwright.operators import ledger, pool
from boardwright.sources import files

D = lambda d: dt.datetime(2026, 1, d)


def test_upsert_keeps_the_first_clock(spark):
    stored = spark.createDataFrame([("a", "old", D(1), D(1)), ("b", "b", D(1), D(1))], "url string, title string, fetched_at timestamp, last_seen timestamp")
    batch = spark.createDataFrame([("a", "new", 1), ("a", "newer", 2), ("c", None, 1), ("", "x", 1), (None, "x", 1)], "url string, title string, seq int")
    got = {r.url: (r.title, r.fetched_at.day, r.last_seen.day) for r in pool.upsert(stored, batch, "url", "fetched_at", "last_seen", F.to_timestamp(F.lit("2026-01-09"))).collect()}
    assert got == {"a": ("newer", 1, 9), "b": ("b", 1, 1), "c": (None, 9, 9)}


def test_eviction(spark):
    rows = [("p1", "polled", "2025-12-31", D(20)), ("p2", "polled", "", D(15)), ("o1", "other", "garbage", D(10)), ("o2", "other", None, D(1)), ("o3", "other", "2025-01-01", D(20)), ("o4", None, None, D(19))]
    df = spark.createDataFrame(rows, "url string, source string, posted string, last_seen timestamp")
    now = F.to_timestamp(F.lit("2026-01-21"))
    assert {r.url for r in pool.survivors(df, now, ["polled"]).collect()} == {"p1", "o1", "o4"}
    assert [r.url for r in pool.survivors(df, now, ["polled"], cap=1).collect()] == ["p1"]


def test_percentiles_of_ties_and_one_value(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 2.0)] * 5 + [("b", 7.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in A.indexed_percentiles(df, "v", ["g"]).collect()}
    assert got["a"].p50 == 2.0 and got["a"].p10 == 1.0 and got["a"].p95 == 2.0 and got["b"].p50 == 7.0 and "c" not in got


def test_fill_rates(spark):
    df = spark.createDataFrame([("", [], None), (" ", ["x"], 1), ("a", None, 2)], "s string, l array<string>, n int")
    assert {r.column: r.filled for r in A.fill_rates(df, ["s", "l", "n"]).collect()} == {"s": 1, "l": 1, "n": 2}
    assert A.fill_rates(df.limit(0), ["s"]).first().rate is None


def test_kappa(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")], "a string, b string")
    r = A.kappa(df, "a", "b").first()
    assert r.n == 50 and r.agreement == pytest.approx(0.7) and r.kappa == pytest.approx(0.4)
    assert A.kappa(df.where("a = 'y' AND b = 'y'"), "a", "b").first().kappa is None


def test_f1(spark):
    got = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"]), (None, None)], "p array<string>, g array<string>").select(A.set_f1(F.col("p"), F.col("g")).alias("f")).collect()
    assert [r.f for r in got] == [1.0, 0.0, 0.5, 1.0]


def test_junk_slugs(spark):
    cases = {"checkout.com": None, "robots.txt": "not-a-board-path", "zub.txt": "file-extension", "a": "length", "acme%20co": "template-or-encoded", "": "length"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.j for r in df.select("s", A.slug_junk(F.col("s")).alias("j")).collect()} == cases


def test_ledger_never_downgrades(spark):
    led = spark.createDataFrame([("a", "resolved", 1, D(1)), ("b", "unresolved", 2, D(1))], "name_key string, status string, attempts bigint, checked_at timestamp")
    out = spark.createDataFrame([("a", "refused", D(2)), ("b", "verified", D(2)), ("b", "throttled", D(3)), ("c", "missing", D(2))], "name_key string, outcome string, at timestamp")
    got = {r.name_key: (r.status, r.attempts) for r in ledger.record(led, out).collect()}
    assert got == {"a": ("resolved", 2), "b": ("resolved", 3), "c": ("unresolved", 1)}


def test_company_keys(spark):
    got = [r[0] for r in spark.createDataFrame([("Westhab Inc.",), ("Westhab, Inc",), ("CELSIUS",), (None,), ("eClinical Solutions LLC",)], "c string").select(ledger.company_key(F.col("c"))).collect()]
    assert got == ["westhab", "westhab", "celsius", "", "eclinical solutions"]


def test_asof(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 5, "z")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 9, 90)], "k int, t int, v int")
    assert {(r.n, r.v) for r in A.asof_join(left, right, "k", "t", "v").collect()} == {("x", 50), ("y", None), ("z", None)}


ROW = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])


def test_snapshots(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    doc = {"meta": {"count": 2}, "jobs": [{"url": "a", "title": "t", "more": 1}, {"url": "b"}]}
    for k, d in enumerate((doc, dict(reversed(doc.items())))):
        assert {tuple(r) for r in files.read_snapshot(spark, put(f"s{k}.json", json.dumps(d, indent=k or None)), ROW).collect()} == {("a", "t"), ("b", None)}
    assert files.read_snapshot(spark, put("e.json", '{"jobs": []}'), ROW).count() == 0
    assert files.read_meta(spark, put("m.json", json.dumps(doc)), "count int").first()[0] == 2
    for bad in (json.dumps(doc)[:-9], '{"meta": {}}', '{"jobs": "x"}', '{"jobs": {"a": 1}}'):
        with pytest.raises(files.SnapshotError):
            files.read_snapshot(spark, put("bad.json", bad), ROW)


def test_log_lines_fit_and_bad_lines_count(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x" * 50] * 9), (2, []), (3, ["y" * 500])], "id int, top array<string>")
    files.append_log(df, str(tmp_path / "log"), most_bytes=200)
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(lines) == 3 and all(len(x.encode()) < 200 for x in lines)
    (tmp_path / "bad").write_text('{"id": 1}\nnot json\n\n{"id": 2}\n')
    got = files.read_lines(spark, str(tmp_path / "bad"), "id int").cache()
    assert got.where("_corrupt_record IS NOT NULL").count() == 1 and got.where("id IS NOT NULL").count() == 2


def test_table_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(5), path)
    files.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_carry_forward(spark):
    new = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.StringType())])
    assert files.carry_forward(spark.createDataFrame([(1, "x")], "a int, b string"), new).collect() == [(1, None)]


def test_lists_in_documents(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"meta": {"n": 2}, "companies": [{"name": "A", "ats": "x"}, null, {"name": "B"}]}')
    (tmp_path / "bad.json").write_text('{"companies": {"name": "A"}}')
    assert [tuple(r) for r in files.read_list(spark, str(tmp_path / "w.json"), "companies", "name string, ats string").collect()] == [("A", "x"), ("B", None)]
    for name in ("bad.json", "none.json"):
        with pytest.raises(Exception):
            files.read_list(spark, str(tmp_path / name), "companies", "name string").collect()


def test_quarantine_and_shares(spark):
    led = spark.createDataFrame([("a", "resolved", "full", D(1)), ("b", "dead", None, D(1))], "name_key string, status string, matched_variant string, checked_at timestamp")
    bad = spark.createDataFrame([("a", "r" * 500), ("a", "z"), ("zz", "x")], "name_key string, reason string")
    got = {r.name_key: r for r in ledger.quarantine(led, bad, F.to_timestamp(F.lit("2026-02-01"))).collect()}
    assert (got["a"].status, len(got["a"].matched_variant), got["b"].status) == ("quarantined", 120, "dead")
    assert {r.s: r.share for r in A.shares(spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "s string"), "s").collect()} == {"x": 0.5, "y": 0.25, None: 0.25}
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-1.0,), (2.0,)], "v double").select(F.length(A.bar(F.col("v")))).collect()] == [10, 0, 20]
