import datetime as dt

from boardwright.operators import snapshots as S

SCHEMA = "snapshot_no int, url string, title string, company string, location string, salary string, last_seen timestamp, loaded_at timestamp, row_hash string"
T = lambda d: dt.datetime(2026, 1, d)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_added_removed_changed_with_gaps_and_repeats(spark):
    data = [
        (1, "a", "x", "c", "l", None, T(1), T(1), "clash"), (1, "b", "x", "c", "l", "9", T(1), T(1), None), (1, " c ", "x", "c", "l", "9", T(1), T(1), None),
        (4, "a", " x ", "c", "l", "", T(2), T(9), None), (4, "b", "y", "c", "l", "9", T(2), T(2), None), (4, "b", "x", "c", "l", "9", T(1), T(3), None), (4, "d", "x", "c", "l", "9", None, None, None), (4, "", "x", "c", "l", "9", T(2), T(2), None), (4, None, "x", "c", "l", "9", T(2), T(2), None), (None, "z", "x", "c", "l", "9", T(2), T(2), None),
    ]
    got = rows(S.job_changes(spark.createDataFrame(data, SCHEMA)))
    assert got == {(4, "b", "changed"), (4, "c", "removed"), (4, "d", "added")}


def test_ties_do_not_depend_on_order(spark):
    data = [(1, "a", "x", "c", "l", "1", T(1), T(1), None), (2, "a", "x", "c", "l", "1", T(1), T(1), None), (2, "a", "y", "c", "l", "1", T(1), T(1), None)]
    one = rows(S.job_changes(spark.createDataFrame(data, SCHEMA)))
    assert one == rows(S.job_changes(spark.createDataFrame(data[::-1], SCHEMA)))


def test_status_letter_case_and_empty_table(spark):
    schema = "snapshot_no int, name_key string, status string, checked_at timestamp, loaded_at timestamp"
    data = [(1, "k", "Dead", T(1), T(1)), (2, "k ", " dead", T(1), T(1)), (3, "k", None, T(1), T(1)), (5, "k", "", T(1), T(1))]
    assert rows(S.company_changes(spark.createDataFrame(data, schema))) == {(3, "k", "changed")}
    assert rows(S.company_changes(spark.createDataFrame([], schema))) == set()
