import json

from boardwright.__main__ import main
from boardwright.operators import analytics as A
from boardwright.operators import pool
from boardwright.sources import files


def _out(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, sf, tmp_path, capsys):
    jobs, companies = f"{sf}/jobs.parquet", f"{sf}/companies.parquet"
    run = lambda *a: (main(list(map(str, a)), spark), _out(capsys))[1]
    run("index", jobs, tmp_path / "index")
    found = run("search", jobs, "--titles", "engineer", "--index", tmp_path / "index", "--limit", "5", "--now", "2026-07-01")
    assert 0 < len(found) <= 6 and found[-1]["count"] == len(found) - 1 and all("points" in r for r in found[:-1])
    kept = run("evict", jobs, tmp_path / "kept", "--now", "2026-07-01 00:00:00")[0]
    assert 0 <= kept["kept"] <= kept["before"]
    assert sum(r["count"] for r in run("resolve", companies, jobs, "--stats")) == spark.read.parquet(companies).count()
    assert len(run("resolve", companies, jobs, "--due", "3", "--now", "2026-07-01 00:00:00")) <= 3
    assert run("discover", companies, companies, "--budget", "5") == []
    (tmp_path / "urls.txt").write_text("https://a.example/acme/1\nhttps://a.example/robots.txt\n\n")
    assert {r["reason"]: r["count"] for r in run("mine", tmp_path / "urls.txt", tmp_path / "mined")}["kept"] == 1
    assert [r["action"] for r in run("vectors", jobs, "none", tmp_path / "ids")] == ["new"]
    assert run("vectors", jobs, tmp_path / "ids", tmp_path / "ids", "--dry-run") == []
    run("rebuild", jobs, tmp_path / "rebuilt")
    assert files.current_table(spark, str(tmp_path / "rebuilt")).count() == spark.read.parquet(jobs).count()
    (tmp_path / "log.jsonl").write_text('{"ts":"2026-01-01","titles":["a"],"delivered":0,"top":[]}\n{bad\n{"ts":"2026-01-02","titles":["b"],"delivered":2,"score_max":100,"probe":true,"top":[{"tier":100}]}\n')
    got = run("review", tmp_path / "log.jsonl")
    assert got[0]["unreadable"] == 1 and got[1]["empty"] == 1
    assert run("dry-run", companies, companies, companies, "--seconds", "60", "--backlog", "100")[0]["gained"] == 0


def test_hot_days_and_keys(spark):
    df = spark.createDataFrame([(i, f"2026-01-0{1 + i % 2} 12:00:{i % 50:02}") for i in range(100)] + [(100, None)], "id int, t string").selectExpr("id", "timestamp(t) AS t")
    got = {r.id: (r.nth, r.shed, r.reason) for r in pool.shed(df, "t", ["id"], 20, "UTC").collect()}
    assert sorted(n for i, (n, _, _) in got.items() if i < 100 and i % 2 == 0) == list(range(1, 51)) and got[100] == (1, False, None)
    assert sum(s for _, s, _ in got.values()) == 60 and {r for _, _, r in got.values()} == {None, "live_search_limit"}
    left = spark.createDataFrame([("k", i, f"2026-01-{1 + i // 5:02} 0{i % 5}:30:00") for i in range(50)] + [("k", 99, None), ("z", 98, "2026-01-01 00:00:00")], "k string, n int, t string").selectExpr("k", "n", "timestamp(t) AS t")
    right = spark.createDataFrame([("k", "2026-01-02 01:30:00", 5), ("k", "2026-01-02 01:30:00", 7), ("k", "2026-01-07 00:00:00", 9), ("k", "2026-01-08 00:00:00", None)], "k string, t string, v int").selectExpr("k", "timestamp(t) AS t", "v")
    got = {r.n: r.v for r in A.asof_join(left, right, "k", "t", "v").collect()}
    assert got == {i: None if i < 6 else 7 if i < 30 else 9 for i in range(50)} | {99: None, 98: None}
