import pytest
from pyspark.sql import functions as F

from boardwright.api import Engine, clamp, least_points
from boardwright.api import engine as open_engine
from boardwright.operators import intake
from boardwright.operators.order import numbered


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("u1", "Software Engineer", "A", "sql", "remote"), ("u2", "software engineer", "a", "sql sql and more", None), ("u3", "Data Engineer", "B", "", "onsite"), ("u4", "Nurse", "C", "care", None), ("u5", "Engineering Lead", "D", None, "remote"), ("u6", "Clerk", "E", "x", None), ("u7", "Cook", "F", "x", None)]
    raw = spark.createDataFrame(rows, "url string, title string, company string, text string, remote_type string").withColumn("direct_apply", F.lit(True))
    jobs = intake.normalise(raw, F.to_timestamp(F.lit("2026-01-01")))
    vectors = spark.createDataFrame([("u4", [1.0, 0.0]), ("u3", [0.8, 0.6]), ("u1", [0.0, 1.0])], "url string, embedding array<double>")
    return Engine(jobs, vectors, F.to_date(F.lit("2026-01-02")))


def test_board(spark, engine):
    b = engine.score({"titles": "Software Engineer, Engineer", "boosts": "sql", "limit": 10})
    got = {r.url: r for r in b.jobs.collect()}
    assert set(got) == {"u2", "u3", "u5"}
    assert got["u2"].points == 114 and got["u2"].why == "title, sql ×2" and sum(p.delta for p in got["u2"].parts) == 114
    assert all(r.n >= 1 for r in b.facets.collect())
    assert engine.score({"titles": ""}).jobs.count() == 0
    assert [r.url for r in engine.score({"titles": "Software Engineer", "min_score": "strong"}).jobs.collect()] == ["u2"]


def test_candidates(spark, engine):
    probes = spark.createDataFrame([(1, [1.0, 0.0])], "probe_id bigint, probe array<double>")
    got = [r.url for r in engine.candidates({"titles": "Engineer"}, probes, k=10).collect()]
    assert got[0] == "u3" and "u4" in got
    assert [r.url for r in engine.candidates({"titles": "Nurse"}, None).collect()] == ["u4"]
    remote = [r.url for r in engine.candidates({"titles": "Engineer", "remote_only": True}, probes).collect()]
    assert "u4" not in remote and "u3" not in remote


def test_lookups(spark, engine):
    rows, missing, rest = engine.read(["u4", "zz", "u1", "u4"], most=3)
    assert [r.url for r in rows.collect()] == ["u4", "u1"] and missing == ["zz"] and rest == []
    assert engine.recommend(["u9", "u2"]) == (["u2"], ["u9"])
    assert engine.candidate_count(["nurse"]) == 1 and engine.candidate_count(["***"]) == 0
    assert engine.stats().first().pool == 7
    assert {r.url for r in engine.search(["engineer"], remote_only=True).collect()} & {"u3"} == set()


def test_saved_index(spark, engine, tmp_path):
    engine.save_index(str(tmp_path))
    engine.jobs.write.parquet(str(tmp_path / "jobs"))
    other = open_engine(spark, str(tmp_path / "jobs"), index_path=str(tmp_path))
    assert other.candidate_count(["engineer"]) == engine.candidate_count(["engineer"]) > 0
    assert {r.url for r in other.retrieve(["nurse"]).collect()} == {"u4"}


def test_small_parts():
    assert [least_points(x) for x in ("plenty", "Strong ", 7, None, True, "x")] == [5, 20, 7, 12, 12, 12]
    assert [clamp(x, 50, 200) for x in (0, 999, None, "a", True)] == [1, 200, 50, 50, 50]


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = numbered(df, ["k", "id"], "at").collect()
    assert [r.id for r in sorted(got, key=lambda r: r["at"])] == [r.id for r in df.orderBy("k", "id").collect()] and sorted(r["at"] for r in got) == list(range(1000))
    assert numbered(df.limit(0), ["k"], "at").count() == 0


def test_settings_of_a_search():
    from boardwright.api import settings

    doc, notes = settings({"titles": ["AI/ML Engineer"], "exclude": ["ai ml engineer", "sales"], "boosts": "sql", "location": " Remote-only ", "max_age_days": True})
    assert doc["remote_only"] is True and doc["location"] == "remote" and doc["max_age_days"] is None and "ai ml engineer" in notes[0] and "sales" not in notes[0]
    assert doc["older_weights"] == {"ai/ml engineer": 3, "sql": 5}
    assert settings({"location": "anywhere"})[0]["remote_only"] is False and settings({"location": "remote", "remote_only": False})[0]["remote_only"] is False
    assert settings({"location": "Austin", "max_age_days": 30.5}) == ({"location": "Austin", "max_age_days": 30, "remote_only": False, "older_weights": {}}, [])


def test_a_search_without_penalties_of_its_own(spark):
    from boardwright.api import Engine

    rows = [("u1", "Cook", None, "Acme staffing agency", "", None), ("u2", "Cook", None, "Client Co", "", None), ("u3", "Cook", None, "Plain", "", None)]
    jobs = spark.createDataFrame(rows, "url string, title string, title_root string, company string, body string, location string").withColumn("remote", F.lit(None).cast("string")).withColumn("posted", F.lit(None).cast("string"))
    board = Engine(jobs).score({"titles": ["cook"]}, degraded="fetch_error")
    assert {r.url: r.points for r in board.jobs.collect()}["u3"] == 100 and {r.url for r in board.jobs.where("points < 100").collect()} == {"u1", "u2"}
    assert board.meta() == {"count": 3, "pool": 3, "notes": [], "degraded": "fetch_error"}
    own = Engine(jobs).score({"titles": ["cook"], "rank_down": ["plain"]})
    assert {r.url: r.points for r in own.jobs.collect()} == {"u1": 100, "u2": 70, "u3": 70}
