import __spark_entry__ as e


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["url", "points", "why"] and df.count() > 0


def test_sql_is_only_for_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streams(spark, sf):
    q = e.queries()
    assert q["stream_dedup"](spark, sf).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()
    assert q["stream_heartbeats"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
