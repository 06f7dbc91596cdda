"""Queries of the ledger, freshness, quotas, mining, digests, agreement, set operations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.functions import text as X
from boardwright.operators import analytics as A
from boardwright.operators import intake as I
from boardwright.operators import ledger, pool
from boardwright.plans.listings import LATEST, jobs, key_sql
from boardwright.session import table
from boardwright.sources import files
from boardwright.streaming import events as S

NOW = "2026-07-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def _counts(spark, sf):
    return jobs(spark, sf, ["url", "company"]).where(F.trim(X.text(F.col("company"))) != "").groupBy("company").agg(F.count("*").alias("n"))


def company_counts(spark, sf):
    return _counts(spark, sf)


def resolution_stats(spark, sf):
    return table(spark, sf, "companies").groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.coalesce("roles", F.lit(0))).alias("roles"))


def distinct_employers(spark, sf):
    return jobs(spark, sf, ["url", "company"]).agg(F.countDistinct(ledger.company_key(F.col("company"))).alias("n"), F.countDistinct("company").alias("spellings"))


def ledger_due(spark, sf):
    return ledger.due(table(spark, sf, "companies"), _counts(spark, sf), _now()).orderBy(F.desc("n"), "name_key").limit(100).select("name_key", "n")


def ledger_record(spark, sf):
    """Probe outcomes stand in the snapshots' states: every row of a delivery is one probe."""
    s = F.lower(F.trim("status"))
    o = F.when(s == "resolved", "verified").when(s == "dead", "refused").when(s == "unresolved", "missing").otherwise("throttled")
    outcomes = table(spark, sf, "company_snapshots").select(F.trim("name_key").alias("name_key"), o.alias("outcome"), F.col("checked_at").alias("at"))
    return ledger.record(table(spark, sf, "companies"), outcomes).select("name_key", "status", F.col("attempts").cast("bigint").alias("attempts"), F.unix_micros("checked_at").alias("checked_us"))


def outcome_pivot(spark, sf):
    df = table(spark, sf, "company_snapshots").withColumn("s", F.lower(F.trim("status")))
    kinds = ["resolved", "unresolved", "dead", "covered", "quarantined"]
    return df.groupBy("snapshot_no").agg(*[F.count_if(F.col("s") == k).alias(k) for k in kinds])


def board_evidence(spark, sf):
    return ledger.evidence(jobs(spark, sf, ["url", "company"])).select("company", F.array_join(F.transform("boards", lambda b: F.concat(b["ats"], F.lit(":"), b["slug"])), ",").alias("boards"))


def audit_agreement(spark, sf):
    return ledger.audit(table(spark, sf, "companies"), ledger.evidence(jobs(spark, sf, ["url", "company"]))).groupBy("agrees").agg(F.count("*").alias("n"))


def board_keys(spark, sf):
    df = table(spark, sf, "companies").where("ats IS NOT NULL").select(ledger.board_key(F.col("ats"), F.col("slug"), F.col("site")).alias("key"))
    return df.select("key", ledger.parse_board_key(F.col("key")).alias("p")).select("key", "p.ats", "p.slug", "p.site")


def richest_ledger(spark, sf):
    return table(spark, sf, "companies").orderBy(F.coalesce("roles", F.lit(0)).desc(), "name_key").limit(30).select("name_key", "roles")


def discover_interleave(spark, sf):
    df = table(spark, sf, "companies").where("ats IS NOT NULL")
    return A.interleave(df, "ats", ["name_key"], 60).select("ats", "name_key", "turn")


def mined_boards(spark, sf):
    return A.mine_boards(jobs(spark, sf, ["url"]), "url").select("host", "slug", "url", "junk")


def mined_rejects(spark, sf):
    slugs = F.array(*[F.lit(s) for s in ("a", "robots.txt", "checkout.com", "zubiad.txt", "embed", "acme%20co", "{your_company}", "x" * 61)])
    df = table(spark, sf, "companies").select(F.explode(F.concat(slugs, F.array(F.coalesce("slug", F.lit(""))))).alias("slug"))
    return df.groupBy(F.coalesce(A.slug_junk(F.col("slug")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def first_per_board(spark, sf):
    df = table(spark, sf, "companies").where("slug IS NOT NULL")
    return ledger.first_seen(df, [F.col("ats"), F.lower("slug")], ["name_key"]).select("ats", "slug", "name_key")


def ttl_fresh(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return pool.fresh_keys(df, "user_id", "ts", F.to_timestamp(F.lit("2024-01-31"))).select("user_id", "fresh")


def daily_shed(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    got = pool.shed(df, "ts", ["event_id"], 300)
    return got.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if("shed").alias("shed"))


def percentiles(spark, sf):
    got = A.indexed_percentiles(table(spark, sf, "events").where("value > 0"), "value", ["event_type"])
    return got.select("event_type", "n", "p10", "p50", "p95", "rank95", "round95")


def medians(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"), F.max("value").alias("most"))


def top_title_words(spark, sf):
    df = jobs(spark, sf, ["url", "title"])
    return A.top_terms(df, F.array_distinct(F.split(X.norm_key(F.col("title")), " ")), 25)


def failure_shares(spark, sf):
    df = table(spark, sf, "events")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("value") < 5) / F.count("*"), 6).alias("weak"), F.round(F.count_if(F.col("value").isNull() | (F.col("value") == 0)) / F.count("*"), 6).alias("empty"))


def worst_searches(spark, sf):
    return table(spark, sf, "events").orderBy("value", "event_id").limit(25).select("event_id", "value")


def props_json(spark, sf):
    df = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return df.groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))


def judge_kappa(spark, sf):
    """Two raters: how a listing's remote state is written and what its title says."""
    df = jobs(spark, sf, ["url", "title", "remote"])
    a = F.when(F.col("remote") == "remote", "remote").when(F.col("remote").isNotNull(), "other").otherwise("unsaid")
    b = F.when(F.lower("title").rlike(r"\bremote\b"), "remote").otherwise("other")
    got = A.kappa(df.select(a.alias("a"), b.alias("b")), "a", "b")
    return got.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def _slug(c):
    key = F.regexp_replace(F.lower(F.trim(c)), r"\s*:free$", "")
    return F.when(key != "", key)


def _decided(spark, sf):
    """(a, b, w): the verdicts with a winner, each verdict_id once, of copies that differ the smallest."""
    v = table(spark, sf, "verdicts").where("verdict_id IS NOT NULL").select("verdict_id", _slug("a").alias("a"), _slug("b").alias("b"), _slug("winner").alias("w")).where("a <> b")
    o = F.when(F.col("w") == F.col("a"), 1).when(F.col("w") == F.col("b"), 2).when(F.col("w").isNull() | F.col("w").isin("tie", "draw"), 3)
    once = v.withColumn("o", o).where("o IS NOT NULL").groupBy("verdict_id").agg(F.min(F.struct("a", "b", "o", "w")).alias("s")).select("s.*")
    return once.where("o < 3").select("a", "b", "w")


def pairwise_wins(spark, sf):
    v = _decided(spark, sf)
    sides = v.select(F.explode(F.array(F.struct(F.col("w").alias("slug"), F.lit(1).alias("win")), F.struct(F.when(F.col("w") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("slug"), F.lit(0).alias("win")))).alias("s")).select("s.*")
    return sides.groupBy("slug").agg(F.sum("win").alias("wins"), F.count("*").alias("played"), F.round(F.sum("win") / F.count("*"), 6).alias("win_rate"))


def both_orders(spark, sf):
    """Pairs judged in both orders, and the entrant that leads in both, if one does."""
    c = _decided(spark, sf).groupBy("a", "b").agg(F.count_if(F.col("w") == F.col("a")).alias("first"), F.count("*").alias("n"))
    d = c.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") - F.col("first")).alias("first2"), F.col("n").alias("n2"))
    j = c.where("a < b").join(d, ["a", "b"])
    # the letter that leads in each order, as a judge would say it; the second order has the sides swapped
    said = lambda won, n, yes, no: F.when(F.col(won) * 2 > F.col(n), f'{{"winner": "{yes}"}}').when(F.col(won) * 2 < F.col(n), f'{{"winner": "{no}"}}')
    return j.select("a", "b", I.judged(said("first", "n", "A", "B"), said("first2", "n2", "B", "A"), F.col("a"), F.col("b")).alias("leader"))


def set_f1(spark, sf):
    df = jobs(spark, sf, ["url", "title", "title_root"])
    w = lambda c: F.filter(F.split(X.norm_key(F.col(c)), " "), lambda x: x != "")
    return df.select("url", F.round(A.set_f1(w("title_root"), w("title")), 6).alias("f1"))


def hallucination(spark, sf):
    """Share of a root title's words whose first four letters the title doesn't have."""
    df = jobs(spark, sf, ["url", "title", "title_root"]).where("trim(title_root) <> ''")
    t = F.lower(X.text(F.col("title")))
    ws = F.filter(F.split(X.norm_key(F.col("title_root")), " "), lambda x: x != "")
    missing = F.size(F.filter(ws, lambda x: F.instr(t, F.left(x, F.lit(4))) == 0))
    return df.select(F.size(ws).alias("k"), missing.alias("m")).agg(F.sum("k").alias("words"), F.sum("m").alias("unsupported"))


def concentration_gate(spark, sf):
    got = A.concentration(jobs(spark, sf, ["url", "company"]), "company")
    return got.select(F.col("groups").alias("employers"), "rows", F.round("top_share", 6).alias("top_share"))


def health_gate(spark, sf):
    df = jobs(spark, sf, ["url", "title_root", "source", "location"])
    return df.agg(F.count("*").alias("pool"), F.round(F.avg(F.when(F.trim(X.text(F.col("title_root"))) != "", 1.0).otherwise(0.0)), 6).alias("root_fill"), F.countDistinct("source").alias("sources"), F.round(F.avg(F.when(F.col("location").contains("US"), 1.0).otherwise(0.0)), 6).alias("local_share"))


def carry_forward(spark, sf):
    """Suppliers carried into the columns of customers and put beside them: what suppliers don't have is NULL."""
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(files.carry_forward(b, a.schema)).groupBy(F.col("segment").isNull().alias("carried")).agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def set_operations(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("both", c.intersect(s)), ("customers only", c.subtract(s)), ("either", c.union(s).distinct())]
    out = None
    for name, d in parts:
        got = d.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = got if out is None else out.unionByName(got)
    return out


def revenue_cube(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def asof_last_view(spark, sf):
    e = table(spark, sf, "events")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return A.asof_join(left, right, "user_id", "ts", "seen").select("event_id", "seen")


def stream_tumbling(spark, sf):
    got = S.drain(S.tumbling(_stream(spark, sf)), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sliding(spark, sf):
    return S.drain(S.sliding(_stream(spark, sf)), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_sessions(spark, sf):
    got = S.drain(S.sessions(_stream(spark, sf)), "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def stream_dedup(spark, sf):
    e = _stream(spark, sf)
    twice = e.unionByName(e.withColumn("value", F.col("value") + 1))
    return S.drain(S.deduplicated(twice.select("event_id", "ts", "event_type"), ["event_id"]), "append").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_heartbeats(spark, sf):
    got = S.drain(S.heartbeats(_stream(spark, sf)), "update", ["user_id"])
    return got.select("user_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n")


def _stream(spark, sf):
    return S.stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    f.__name__: f
    for f in (
        company_counts, resolution_stats, distinct_employers, ledger_due, ledger_record, outcome_pivot, board_evidence, audit_agreement, board_keys, richest_ledger, discover_interleave, mined_boards, mined_rejects, first_per_board, ttl_fresh, daily_shed, percentiles, medians, top_title_words,
        failure_shares, worst_searches, props_json, judge_kappa, pairwise_wins, both_orders, set_f1, hallucination, concentration_gate, health_gate, carry_forward, set_operations, revenue_cube, pricing_summary, asof_last_view, stream_tumbling, stream_sliding, stream_sessions, stream_dedup, stream_heartbeats,
    )
}

W = f"WITH pool AS {LATEST}"
_CKEY = f"regexp_replace({key_sql('company')}, '( (inc|llc|ltd|plc|gmbh|co|corp|corporation|company|limited))+$', '')"
_HOST, _PATH = "lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1))", "regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1)"
_EV = f"{W}, ev AS (SELECT DISTINCT company, split_part({_HOST}, '.', 1) AS ats, {_PATH} AS slug FROM pool WHERE trim(coalesce(company, '')) <> '')"
_ST = "lower(trim(status))"
_JUNK = r"""CASE WHEN length(slug) < 2 OR length(slug) > 60 THEN 'length' WHEN regexp_matches(slug, '%[0-9A-Fa-f]{2}|[{} ]') THEN 'template-or-encoded' WHEN lower(slug) IN ('robots.txt','sitemap.xml','favicon.ico','index.html','404.html','embed','api','static','assets') THEN 'not-a-board-path'
 WHEN contains(slug, '.') AND lower(list_last(string_split(slug, '.'))) IN ('txt','xml','json','md','html','htm','ico','css','js','php','yml','yaml','csv','pdf','png','jpg','svg','map','gz','zip') THEN 'file-extension' END"""
_SLUG = "nullif(regexp_replace(lower(trim({})), '\\s*:free$', ''), '')"
_VER = f"""v AS (SELECT verdict_id, {_SLUG.format('a')} AS a, {_SLUG.format('b')} AS b, {_SLUG.format('winner')} AS w FROM verdicts WHERE verdict_id IS NOT NULL),
k AS (SELECT *, CASE WHEN w = a THEN 1 WHEN w = b THEN 2 WHEN w IS NULL OR w IN ('tie', 'draw') THEN 3 END AS o FROM v WHERE a <> b), u AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY a, b, o, w) AS nth FROM k WHERE o IS NOT NULL) WHERE nth = 1 AND o < 3)"""
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
ORACLES = {
    "company_counts": f"{W} SELECT company, count(*) AS n FROM pool WHERE trim(coalesce(company, '')) <> '' GROUP BY company",
    "resolution_stats": f"SELECT {_ST} AS status, count(*) AS n, CAST(sum(coalesce(roles, 0)) AS BIGINT) AS roles FROM companies GROUP BY 1",
    "distinct_employers": f"{W} SELECT count(DISTINCT {_CKEY}) AS n, count(DISTINCT company) AS spellings FROM pool",
    "ledger_due": f"{W}, c AS (SELECT {_CKEY} AS name_key, count(*) AS n FROM pool WHERE trim(coalesce(company, '')) <> '' GROUP BY 1) SELECT name_key, n FROM c LEFT JOIN companies USING (name_key) WHERE name_key <> '' AND (status IS NULL OR (lower(status) = 'unresolved' AND coalesce(checked_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') < TIMESTAMPTZ '{NOW}+00' - INTERVAL 90 DAY)) ORDER BY n DESC, name_key LIMIT 100",
    "ledger_record": f"""WITH o AS (SELECT trim(name_key) AS name_key, CASE {_ST} WHEN 'resolved' THEN 'resolved' WHEN 'dead' THEN 'dead' WHEN 'unresolved' THEN 'unresolved' END AS ns, checked_at AS pt FROM company_snapshots), s AS (SELECT name_key, arg_max(ns, row(pt, ns)) AS ns, max(pt) AS pt, count(*) AS tries FROM o WHERE ns IS NOT NULL GROUP BY name_key)
SELECT coalesce(c.name_key, s.name_key) AS name_key, CASE WHEN ns IS NULL THEN lower(status) WHEN lower(status) = 'resolved' AND ns <> 'resolved' THEN lower(status) ELSE ns END AS status, CAST(coalesce(attempts, 0) + coalesce(tries, 0) AS BIGINT) AS attempts, epoch_us(coalesce(pt, checked_at)) AS checked_us FROM companies c FULL OUTER JOIN s ON c.name_key = s.name_key""",
    "outcome_pivot": "SELECT snapshot_no, " + ", ".join(f"count(*) FILTER ({_ST} = '{k}') AS {k}" for k in ("resolved", "unresolved", "dead", "covered", "quarantined")) + " FROM company_snapshots GROUP BY snapshot_no",
    "board_evidence": f"{_EV} SELECT company, array_to_string(list(ats || ':' || slug ORDER BY ats, slug), ',') AS boards FROM ev GROUP BY company",
    "audit_agreement": f"{_EV} SELECT agrees, count(*) AS n FROM (SELECT name_key, coalesce(bool_or(ev.ats = c.ats AND ev.slug = c.slug), false) AS agrees FROM companies c JOIN ev ON c.name = ev.company WHERE {_ST} = 'resolved' GROUP BY name_key) GROUP BY agrees",
    "board_keys": "SELECT 'board:' || ats || ':' || slug || CASE WHEN site IS NULL THEN '' ELSE '/' || site END AS key, ats, slug, site FROM companies WHERE ats IS NOT NULL",
    "richest_ledger": "SELECT name_key, roles FROM companies ORDER BY coalesce(roles, 0) DESC, name_key LIMIT 30",
    "discover_interleave": "SELECT ats, name_key, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY ats ORDER BY name_key) AS turn FROM companies WHERE ats IS NOT NULL) ORDER BY turn, ats, name_key LIMIT 60",
    "mined_boards": f"{W}, m AS (SELECT {_HOST} AS host, {_PATH} AS slug, min(url) AS url FROM pool GROUP BY 1, 2) SELECT host, slug, url, {_JUNK} AS junk FROM m",
    "mined_rejects": f"WITH s AS (SELECT unnest(['a', 'robots.txt', 'checkout.com', 'zubiad.txt', 'embed', 'acme%20co', '{{your_company}}', '{'x' * 61}', coalesce(slug, '')]) AS slug FROM companies) SELECT coalesce({_JUNK}, 'kept') AS reason, count(*) AS n FROM s GROUP BY 1",
    "first_per_board": "SELECT ats, slug, name_key FROM (SELECT *, row_number() OVER (PARTITION BY ats, lower(slug) ORDER BY name_key) AS r FROM companies WHERE slug IS NOT NULL) WHERE r = 1",
    "ttl_fresh": "SELECT user_id, max(ts) > TIMESTAMP '2024-01-30 00:00:00' AS fresh FROM events GROUP BY user_id",
    "daily_shed": "SELECT strftime(day, '%Y-%m-%d') AS day, n, greatest(0, n - 300) AS shed FROM (SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)",
    "percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value > 0 GROUP BY 1) SELECT event_type, n, v[1 + n // 10] AS p10, v[1 + n // 2] AS p50, v[1 + least(n - 1, CAST(floor(n * 0.95) AS BIGINT))] AS p95, v[n - least(n - 1, CAST(floor(n * 0.95) AS BIGINT))] AS rank95, v[1 + least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT))] AS round95 FROM l",
    "medians": "SELECT event_type, round(median(value), 6) AS median, max(value) AS most FROM events GROUP BY 1",
    "top_title_words": f"{W}, t AS (SELECT unnest(list_distinct(string_split({key_sql('title')}, ' '))) AS term FROM pool), c AS (SELECT term, count(*) AS n FROM t WHERE term <> '' GROUP BY term) SELECT term, n, (SELECT count(*) FROM c) AS distinct_terms FROM c ORDER BY n DESC, term LIMIT 25",
    "failure_shares": "SELECT event_type, count(*) AS n, round(count(*) FILTER (value < 5) / count(*), 6) AS weak, round(count(*) FILTER (value IS NULL OR value = 0) / count(*), 6) AS empty FROM events GROUP BY 1",
    "worst_searches": "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25",
    "props_json": "WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT k % 10 AS bucket, count(*) AS n, min(k) AS least, max(k) AS most FROM k GROUP BY 1",
    "judge_kappa": f"{W}, r AS (SELECT CASE WHEN remote = 'remote' THEN 'remote' WHEN remote IS NOT NULL THEN 'other' ELSE 'unsaid' END AS a, CASE WHEN regexp_matches(lower(coalesce(title, '')), '\\bremote\\b') THEN 'remote' ELSE 'other' END AS b FROM pool), s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg((a = 'remote')::INT) * avg((b = 'remote')::INT) + avg((a = 'other')::INT) * avg((b = 'other')::INT) AS pe FROM r) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s",
    "pairwise_wins": f"WITH {_VER}, s AS (SELECT w AS slug, 1 AS win FROM u UNION ALL SELECT CASE WHEN w = a THEN b ELSE a END, 0 FROM u) SELECT slug, CAST(sum(win) AS BIGINT) AS wins, count(*) AS played, round(sum(win) / count(*), 6) AS win_rate FROM s GROUP BY slug",
    "both_orders": f"WITH {_VER}, c AS (SELECT a, b, count(*) FILTER (w = a) AS f, count(*) AS n FROM u GROUP BY a, b) SELECT x.a AS a, x.b AS b, CASE WHEN x.f * 2 > x.n AND (y.n - y.f) * 2 > y.n THEN x.a WHEN x.f * 2 < x.n AND (y.n - y.f) * 2 < y.n THEN x.b END AS leader FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "set_f1": f"{W}, w AS (SELECT url, {_WORDS.format(key_sql('title_root'))} AS p, {_WORDS.format(key_sql('title'))} AS g FROM pool) SELECT url, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(p, g)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END, 6) AS f1 FROM w",
    "hallucination": f"{W}, w AS (SELECT lower(coalesce(title, '')) AS t, list_filter(string_split({key_sql('title_root')}, ' '), lambda x: x <> '') AS ws FROM pool WHERE trim(title_root) <> '') SELECT CAST(sum(len(ws)) AS BIGINT) AS words, CAST(sum(len(list_filter(ws, lambda x: NOT contains(t, left(x, 4))))) AS BIGINT) AS unsupported FROM w",
    "concentration_gate": f"{W}, c AS (SELECT company, count(*) AS c FROM pool WHERE trim(coalesce(company, '')) <> '' GROUP BY company) SELECT count(*) AS employers, CAST(sum(c) AS BIGINT) AS rows, round(max(c) / sum(c), 6) AS top_share FROM c",
    "health_gate": f"{W} SELECT count(*) AS pool, round(avg(CASE WHEN trim(coalesce(title_root, '')) <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS root_fill, count(DISTINCT source) AS sources, round(avg(CASE WHEN contains(location, 'US') THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS local_share FROM pool",
    "carry_forward": "SELECT segment IS NULL AS carried, count(*) AS n, min(name) AS first_name FROM (SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier) GROUP BY 1",
    "set_operations": "SELECT 'both' AS part, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "revenue_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "asof_last_view": "SELECT p.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events) SELECT user_id, CAST(sum(opens) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_heartbeats": "SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY user_id",
}
