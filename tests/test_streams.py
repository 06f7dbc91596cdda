import random

from boardwright.plans import operations as O


def _unordered(spark, folder, files=20, rows=60):
    """A folder of more files than two triggers read, each with rows of the whole time."""
    rng = random.Random(7)
    all_rows = [(k, rng.randrange(86_400 * 20), rng.randrange(5), rng.choice(["view", "click"]), 1.0) for k in range(files * rows)]
    for i in range(files):
        df = spark.createDataFrame(all_rows[i::files], "event_id bigint, s bigint, user_id bigint, event_type string, value double")
        df.selectExpr("event_id", "timestamp_seconds(1700000000 + s) AS ts", "user_id", "event_type", "value", "'{}' AS props").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return all_rows


def test_streams_of_many_unordered_files_lose_nothing(spark, tmp_path):
    rows = _unordered(spark, tmp_path)
    sessions = 0
    for user in range(5):
        at = sorted(r[1] for r in rows if r[2] == user)
        sessions += sum(1 for i, s in enumerate(at) if not i or s - at[i - 1] >= 1800)
    got = O.stream_sessions(spark, str(tmp_path)).collect()
    assert sum(r.events for r in got) == len(rows)
    assert sum(r.sessions for r in got) == sessions
    assert {r.event_type: r.n for r in O.stream_dedup(spark, str(tmp_path)).collect()} == {t: sum(r[3] == t for r in rows) for t in ("view", "click")}
