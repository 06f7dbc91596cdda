import pytest
from pyspark.sql import functions as F

from boardwright.functions import surface as U
from boardwright.operators import gates as G
from boardwright.operators import stores as S
from boardwright.operators import universe as V
from boardwright.schema import JOBS


def _one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_locations(spark):
    tokens = lambda x: _one(spark, U.location_tokens(F.col("x")), x=x)
    assert tokens("Türkiye, Remote") == " turkiye remote " and tokens(None) == tokens("") == "  " and tokens("São Paulo " * 500).count("sao") == 12
    segments = lambda x: list(_one(spark, U.comma_segments(F.col("x")), x=x))
    assert segments("Austin, TX / Zürich - Remote; a-b") == ["austin", "tx", "zurich", "remote", "a b"] and segments(None) == []


def test_shown_values(spark):
    pay = lambda s: _one(spark, U.shown_salary(F.col("x")), x=s)
    assert pay("$40,000–$40,000") == "$40,000" and pay("$190–250k") == "$190–250k" and pay(None) == ""
    tags = F.array(F.lit("sql"), F.lit("remote"))
    place = lambda s, t=tags: _one(spark, U.shown_location(F.col("x"), t), x=s)
    assert place("Austin, Travis County") == "Austin" and place("") == place(None) == "—" and place("REMOTE (US) Do you want to help scientists in their daily work") == "Remote"
    assert place("one two three four five six seven eight nine", F.lit(None).cast("array<string>")) == "—" and len(place("x" * 90)) == 58
    least = lambda m, s: _one(spark, U.least_pay(F.col("m").cast("double"), F.col("s")), m=m, s=s)
    assert least(5.0, "x") == 5 and least(0.0, "$200-260K") == 200_000 and least(0.0, "$255k – $290k") == 255_000 and least(0.0, "$120,000-$150,000") == 120_000 and least(0.0, None) is None and least(0.0, "$150,000 - 200K") == 150_000
    assert [_one(spark, U.fit_band(F.col("p")), p=p) for p in (120, 80, 30, -5)] == ["strong", "good", "fair", "fair"]
    assert _one(spark, U.bar_width(F.col("p"), F.lit(100)), p=1) == 3 and _one(spark, U.bar_width(F.col("p"), F.lit(0)), p=1) == 0
    assert [_one(spark, U.backoff_seconds(F.col("n")), n=n) for n in range(4)] == [2, 4, 8, 8]


def test_settings(spark):
    back = U.unpacked_settings(U.packed_settings(F.struct(F.lit("Käse, “x”").alias("a"), F.lit(3).alias("b"))), "a string, b int")
    assert _one(spark, back, x=1) == ("Käse, “x”", 3)
    assert _one(spark, U.unpacked_settings(F.col("x"), "a string"), x="#q=%%%") is None and _one(spark, U.unpacked_settings(F.col("x"), "a string"), x=None) is None
    assert _one(spark, U.known_settings(F.create_map(F.lit("titles"), F.lit("a"), F.lit("odd"), F.lit("b"))), x=1) == {"titles": "a"}
    assert [_one(spark, U.valid_settings(F.col("x")), x=x) for x in ('{"titles":[]}', '{"titles":3}', None, "", '{"min_score":12}', '{"remote_only":1}')] == [True, False, False, False, True, False]


def test_scores_of_extracted_values(spark):
    s = lambda f, p, g: _one(spark, U.scalar_score(f, F.col("p"), F.col("g")), p=p, g=g)
    assert s("location", "Austin, Texas", "austin tx") == 1 and s("location", None, "") == 1 and s("location", "Austin", "Boston") == 0
    assert s("remote_only", None, False) == 0 and s("remote_only", False, False) == 1 and s("max_age_days", "30", 30) == 1 and s("max_age_days", "x", 30) == 0 and s("min_score", "Strong ", "strong") == 1
    items = F.array(F.lit("staffing agency"), F.lit("ai"), F.lit("rust"), F.lit("??"))
    assert list(_one(spark, U.unsupported_items(items, F.col("t")), t="No Agencies. I said mail, and Ai!")) == ["rust", "??"]
    assert _one(spark, U.title_rung(F.array(F.struct(F.lit("sql ×1").alias("label"), F.lit(8).alias("delta")))), x=1) == 0


def test_lists(spark):
    assert list(_one(spark, U.string_list(F.col("x")), x='["a","b"]')) == ["a", "b"] and list(_one(spark, U.string_list(F.col("x")), x="a")) == []
    assert list(_one(spark, U.sorted_set(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"))), x=1)) == ["a", "b"]
    assert list(_one(spark, U.some_errors(F.array(*map(F.lit, "abcdefg")), 2), x=1)) == ["a", "b", "… and 5 more"]


def test_universe(spark):
    boards = spark.createDataFrame([("gh", "Acme", None, ""), ("gh", "acme", None, ""), ("gh", "", None, ""), ("wd", "ten", "Ext", "h"), ("wd", "ten", "Int", "h")], "ats string, slug string, site string, host string")
    assert V.of_provider(boards, "gh", {"gh": 2}).count() == 2 and V.of_provider(boards, "zz").count() == 0
    with pytest.raises(V.NotQueried):
        V.of_provider(boards, "zz", {"gh": 2})
    known = spark.createDataFrame([("wd", "TEN", "ext")], "ats string, slug string, site string")
    assert {(r.ats, r.slug, r.site) for r in V.unknown_boards(boards.where("slug <> ''"), [known, known.limit(0)]).collect()} == {("gh", "Acme", None), ("wd", "ten", "Int")}
    names = spark.createDataFrame([("Acme",), ("Ten Ants Inc",), (None,), (" ",)], "n string")
    assert {tuple(r) for r in V.match_names(names, "n", boards, first_word=True).collect()} == {("Acme", "gh", "Acme"), ("Ten Ants Inc", "wd", "ten")}
    assert {tuple(r) for r in V.merged_crawls([boards.select("ats", "slug"), boards.select("ats", F.upper("slug").alias("slug"))]).collect()} == {("gh", "Acme"), ("wd", "ten")}


def test_resolution(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = df([(x,) for x in "abcdefg"] + [("a",)], "name string")
    found = df([("a", "gh", "A"), ("b", "gh", "b"), ("a", "zz", "z")], "name string, ats string, slug string")
    outcomes = df([("a", "refused"), ("c", "refused"), ("c", "error"), ("d", "throttled"), ("e", "error"), ("f", "missing")], "name string, outcome string")
    covered = df([("c",), ("d",), ("a",)], "name string")
    own = df([("a", "gh", "a"), ("b", "gh", "other")], "name string, ats string, slug string")
    got = {r.name: (r.state, r.slug) for r in V.resolve(names, found, outcomes, covered, own).collect()}
    assert got == {"a": ("resolved", "A"), "b": ("contradicted", None), "c": ("dead", None), "d": ("covered", None), "e": ("deferred", None), "f": ("unresolved", None), "g": ("unresolved", None)}
    assert [_one(spark, V.record_as(F.col("s")), s=s) for s in ("contradicted", "deferred", "dead")] == ["unresolved", None, "dead"]


def test_gates(spark):
    df = spark.createDataFrame([("Austin, TX", "a", "x"), ("Dallas", "b", ""), ("Rome", "c", None), (None, None, "y")], "location string, source string, title_root string")
    assert G.locality(df, "location", "Austin|Dallas", "source").first()[:4] == (True, 4, 0.5, 3) and not G.locality(df.limit(0), "location", "x", "source").first().ok
    assert not G.filled_share(df, "title_root").first().ok and not G.filled_share(df.limit(0), "title_root").first().ok
    assert G.pool_ratio(df, df, least=4).first().ok and not G.pool_ratio(df.limit(2), df, least=1).first().ok and G.grew(df.limit(1), df).first().ok
    at = lambda s: F.to_timestamp(F.lit(s))
    assert _one(spark, G.freshness(at("2026-01-01 00:00:00"), at("2026-01-02 00:00:00")), x=1) and not _one(spark, G.freshness(at(None), at("2026-01-02 00:00:00")), x=1)
    boards = spark.createDataFrame([("greenhouse",)] * 3, "ats string")
    state = lambda when, least=2: G.universe_state(boards, at(when), at("2026-03-01"), least=least).first().state
    assert (state("2026-02-20"), state("2026-01-01"), state(None), state("2026-02-20", 9)) == ("ok", "stale", "bad", "bad")
    b = spark.createDataFrame([(i, i) for i in range(5)], "name int, at int")
    assert {r.name for r in G.retire(b, "at", 2).collect()} == {0, 1, 2} and G.retire(b, "at", 9).count() == 0
    assert G.without_criterion({"titles": ["a", "b"], "x": 1}, "titles", "a") == {"titles": ["b"], "x": 1} and G.without_criterion({"x": 1}, "x") == {}
    kinds = [_one(spark, G.notice_kind(F.col("d"), F.col("p"), F.col("n")), d=d, p=p, n=n) for d, p, n in ((None, 50, 1), ("", 5000, 1), ("fetch_error", 5, 1), ("", 5000, 9))]
    assert kinds == ["filling", "thin", "degraded", ""]


def test_pairs_within_groups(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "c"), ("p", "a"), ("q", "a"), ("q", None)], "g string, m string")
    assert {tuple(r) for r in G.pairs_within(df, "g", "m").collect()} == {("p", "a", "b"), ("p", "a", "c"), ("p", "b", "c")}
    with pytest.raises(Exception, match="more than 2"):
        G.pairs_within(df, "g", "m", most=2).collect()


def test_profiles_agree_with_the_scoreboard(spark):
    from boardwright.operators import board

    rows = [("1", "Senior Data Engineer", "Data Engineer", "Acme staffing agency", "sql and sql and kubernetes"), ("2", "Accountant", None, None, None), ("3", "", "", "", "")]
    df = spark.createDataFrame(rows, "url string, title string, title_root string, company string, body string")
    docs = [("a", {"titles": ["Data Engineer"], "boosts": ["sql", "kubernetes"], "rank_down": ["agency"]}), ("b", {"titles": [], "related_titles": ["Accountant"], "boosts": ["sql"]})]
    got = {(r.url, r.profile_id): r.points for r in G.score_profiles(df, docs).collect()}
    want = {(r.url, p): r.points for p, d in docs for r in board.scoreboard(df, board.Query.of(d)).collect() if r.points}
    assert got == want and len(want) == 3


def test_stores(spark):
    v = spark.createDataFrame([("u1", "old"), ("u2", "b"), ("u3", "c")], "url string, cid string")
    meta = spark.createDataFrame([("model", "m1")], "key string, value string")
    assert S.vectors_of(v, meta, "m1").count() == 3 and S.vectors_of(v.limit(0), meta.limit(0), "m2").count() == 0
    for bad in (meta, meta.limit(0)):
        with pytest.raises(S.Mixed):
            S.vectors_of(v, bad, "m2")
    assert S.available(v) and not S.available(None) and not S.available(v.limit(0))
    plan = spark.createDataFrame([("u1", "changed"), ("u3", "gone"), ("u4", "new"), ("u5", "new")], "url string, action string")
    fresh = spark.createDataFrame([("u1", "a2"), ("u4", "d"), ("u5", "e")], "url string, cid string")
    rows = lambda **k: {tuple(r) for r in S.apply_sync(v, plan, fresh, "url", **k).collect()}
    assert rows() == {("u1", "a2"), ("u2", "b"), ("u4", "d"), ("u5", "e")} and rows(limit=2) == rows() - {("u5", "e")} and rows(dry_run=True) == {tuple(r) for r in v.collect()}
    S.check_schema(JOBS, JOBS, 3, "3")
    for stored, said in ((JOBS.fields[1:], "1"), (JOBS.fields, "4")):
        with pytest.raises(S.Mixed):
            S.check_schema(type(JOBS)(list(stored)), JOBS, 3, said)
