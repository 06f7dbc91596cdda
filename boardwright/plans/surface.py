"""Queries of the surface, the universe of boards, digests and gates, and stores kept in step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boardwright.functions import surface as U
from boardwright.functions import text as X
from boardwright.operators import analytics, board, dense, gates, intake, pool, stores, universe
from boardwright.plans.listings import _SCORED, AS_OF, LATEST, POLLED, QUERY, _board, hits_sql, jobs, key_sql, tier_sql
from boardwright.plans.operations import _SLUG, _slug
from boardwright.session import ensure_checkpoint_dir, table
from boardwright.sources import files

NOW = f"{AS_OF} 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def location_words(spark, sf):
    df = jobs(spark, sf, ["url", "location"]).select("location").distinct()
    return df.select("location", U.location_tokens(F.col("location")).alias("tokens"), F.array_join(U.comma_segments(F.col("location")), "|").alias("segments"))


def shown_fields(spark, sf):
    df = jobs(spark, sf, ["url", "salary", "salary_min", "location", "remote"])
    tags = F.array_compact(F.array("remote"))
    return df.select("url", U.shown_salary(F.col("salary")).alias("salary"), U.shown_location(F.col("location"), tags).alias("place"), U.least_pay(F.col("salary_min"), F.col("salary")).alias("least"))


def fit_bands(spark, sf):
    df = _board(spark, sf).select("points")
    return df.crossJoin(F.broadcast(gates.top_score(df))).groupBy(U.fit_band(F.col("points")).alias("band"), F.floor(U.bar_width(F.col("points"), F.col("top"))).cast("int").alias("width")).agg(F.count("*").alias("n"))


def settings_fragments(spark, sf):
    df = jobs(spark, sf, ["url", "title", "location"]).select("url", F.struct(X.text(F.col("title")).alias("title"), X.text(F.col("location")).alias("location")).alias("s"))
    df = df.withColumn("fragment", U.packed_settings(F.col("s")))
    back = U.unpacked_settings(F.col("fragment"), "title string, location string")
    return df.select("url", F.md5("fragment").alias("digest"), back["title"].alias("title"), back["location"].alias("location"))


_DOCS = ('{"titles":["a"],"remote_only":true}', '{"titles":"a, b","min_score":12}', '{"titles":["a"],"max_age_days":true}', '{"titles":["a"],"odd":1}', "{}", "[1]", "nothing", '{"location":5}', '{"max_age_days":30.5,"min_score":"strong"}', '{"remote_only":"yes"}')


def settings_checked(spark, sf):
    docs = F.explode(F.array(*map(F.lit, _DOCS)))
    return table(spark, sf, "entrants").select("slug", docs.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).select("doc", "n", U.valid_settings(F.col("doc")).alias("valid"))


def scalar_scores(spark, sf):
    df = jobs(spark, sf, ["url", "location", "city", "state", "salary_min", "remote"])
    said = F.concat_ws(", ", "city", "state")
    return df.select("url", U.scalar_score("location", said, F.col("location")).alias("place"), U.scalar_score("remote_only", F.col("remote") == "remote", F.lit(True)).alias("remote"), U.scalar_score("max_age_days", F.col("salary_min"), F.lit(50000)).alias("number"))


def unsupported_tags(spark, sf):
    df = jobs(spark, sf, ["url", "tags", "body"]).where("size(tags) > 0")
    return df.select("url", F.array_join(U.unsupported_items(F.col("tags"), F.col("body")), "|").alias("unsupported"))


def _log(spark, sf):
    """A search log: an employer's listings as the results of a search."""
    scored = _board(spark, sf).where("company IS NOT NULL").select("company", "url", "points", U.title_rung(F.col("parts")).alias("tier"))
    tops = board.cap_per_group(scored, F.col("company"), [F.desc("points"), F.col("url")], 3).groupBy("company").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("order"), "url", "tier"))).alias("top"))
    counts = scored.groupBy("company").agg(F.count_if(F.col("points") > 0).alias("delivered"), F.max("points").alias("score_max"))
    n = F.length("company")
    return counts.join(tops, "company").select("company", "delivered", "score_max", "top", (n % 5 == 0).alias("probe"), F.when(n % 7 == 0, "fetch_error").alias("degraded"))


def shown_board(spark, sf):
    """What of the scored pool a reader sees who has applied to every listing of the first delivery."""
    scored = board.scoreboard(board.eligible(jobs(spark, sf, ["url", "title", "title_root", "company", "body", "remote", "posted", "salary_min", "category"]), QUERY, F.to_date(F.lit(AS_OF))), QUERY)
    seen = table(spark, sf, "job_snapshots").where("snapshot_no = 1").select("url")
    return board.shown_rows(scored, seen, 14, floor=40_000, chosen={"category": ["Sales", "Design", "Software Engineering"]}).select("url", "points")


def asked_providers(spark, sf):
    return analytics.asked_for(_boards(spark, sf), "ats", ["leafboard", "workvane", "nosuchboard"])


def search_rungs(spark, sf):
    return gates.rung_histogram(gates.demand(_log(spark, sf))).select("rung", "n", F.round("share", 6).alias("share"))


def first_results(spark, sf):
    """The first result of every search of the log."""
    first = F.try_element_at("top", F.lit(1))
    return _log(spark, sf).select("company", first["url"].alias("url"), first["tier"].alias("tier")).where("url IS NOT NULL")


def search_failures(spark, sf):
    got = gates.search_failures(gates.demand(_log(spark, sf)))
    return got.select("searches", "empty", "weak", "degraded", *[F.round(f"{c}_share", 6).alias(f"{c}_share") for c in ("empty", "weak", "degraded")])


def board_notices(spark, sf):
    log = _log(spark, sf)
    notes = F.when(F.length("company") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    kind = gates.notice_kind(F.col("degraded"), F.lit(150), F.col("delivered"))
    return log.groupBy(gates.notice(notes, kind).alias("notice")).agg(F.count("*").alias("n"))


def completion_rates(spark, sf):
    v = table(spark, sf, "verdicts").select(_slug("a").alias("model"), F.when(_slug("winner") == _slug("a"), F.col("verdict_id") % 9 + 1).alias("turns")).where("model IS NOT NULL")
    return gates.completion(v, "model", "turns").select("model", "interviews", F.round("completion_rate", 6).alias("completion_rate"), F.round("mean_turns", 6).alias("mean_turns"))


def release_gates(spark, sf):
    """Locality, size, fill and spread of the pool, each with its figure."""
    df = jobs(spark, sf, ["url", "location", "source", "title_root"])
    servable = table(spark, sf, "jobs").where(pool.reject_reason().isNull()).select("url")
    rows = [
        gates.locality(df, "location", r"(?i)texas|austin|dallas|houston|\bTX\b", "source").select(F.lit("locality").alias("gate"), "ok", F.round("local_share", 6).alias("figure")),
        gates.pool_ratio(df, servable).select(F.lit("pool").alias("gate"), "ok", F.round(F.col("pool") / F.col("servable"), 6).alias("figure")),
        gates.filled_share(df, "title_root").select(F.lit("root").alias("gate"), "ok", F.round("share", 6).alias("figure")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def upkeep_gates(spark, sf):
    boards = table(spark, sf, "companies").where("slug IS NOT NULL").select("ats", "slug")
    u = gates.universe_state(boards, F.to_timestamp(F.lit("2026-05-01")), _now(), "smartroster", 10).select(F.col("state").alias("what"), F.col("of_provider").alias("figure"), "age_days")
    log = table(spark, sf, "events").select("event_id")
    g = gates.grew(log.where("event_id % 10 < 9"), log, 3).select(F.when(F.col("ok"), "grew").otherwise("stuck").alias("what"), F.col("grew").alias("figure"), F.lit(None).cast("bigint").alias("age_days"))
    fresh = table(spark, sf, "job_snapshots").groupBy("snapshot_no").agg(F.max("loaded_at").alias("loaded"), F.max("last_seen").alias("seen")).groupBy(gates.freshness(F.col("seen"), F.col("loaded")).alias("ok")).agg(F.count("*").alias("figure"))
    return u.unionByName(g).unionByName(fresh.select(F.when(F.col("ok"), "fresh").otherwise("behind").alias("what"), "figure", F.lit(None).cast("bigint").alias("age_days")))


def retired_backups(spark, sf):
    b = table(spark, sf, "job_snapshots").groupBy("snapshot_no").agg(F.max("loaded_at").alias("at"))
    return gates.retire(b, "at", 3).select("snapshot_no")


def trial_funnel(spark, sf):
    c = table(spark, sf, "companies").select("name_key", "status", "attempts")
    before = c.withColumn("status", F.when(F.col("attempts") > 1, F.col("status")))
    open_ = c.where("lower(status) = 'unresolved'").select("name_key")
    got = gates.funnel(before, c, c.where("attempts > 1").select("name_key"), open_, "name_key", 120.0, 3068)
    return got


def tag_groups(spark, sf):
    df = jobs(spark, sf, ["url", "tags", "remote", "seniority", "salary_band"])
    tag = F.explode(F.array_compact(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("remote", "seniority", "salary_band"))))
    return df.select(tag.alias("tag")).groupBy(U.tag_group(F.col("tag")).alias("facet"), F.when(U.tag_group(F.col("tag")).isNotNull(), F.col("tag")).alias("tag")).agg(F.count("*").alias("n"))


def meta_merge(spark, sf):
    f = table(spark, sf, "feeds")
    new = f.where(F.length("source") % 2 == 0).select(F.col("source").alias("key"), F.col("currency").alias("value")).unionByName(f.select(F.concat(F.lit("extra "), "source").alias("key"), F.col("date_order").alias("value")))
    return gates.merged_meta(f.select(F.col("source").alias("key"), F.col("tz_name").alias("value")), new)


PROFILES = [
    ("engineer", {"titles": ["Software Engineer", "Data Engineer"], "related_titles": ["Web Developer"], "boosts": ["kubernetes", "sql"], "rank_down": ["agency"]}),
    ("office", {"titles": ["Accountant"], "related_titles": ["Bookkeeper"], "boosts": ["compliance report"], "rank_down": ["night shift", "client"]}),
    ("care", {"titles": ["Registered Nurse"], "boosts": ["sql"], "rank_down": []}),
]


def profile_points(spark, sf):
    return gates.score_profiles(jobs(spark, sf, ["url", "title", "title_root", "company", "body"]), PROFILES)


def persona_pairs(spark, sf):
    v = table(spark, sf, "verdicts").select("persona_id", _slug("a").alias("m")).where("m IS NOT NULL AND persona_id IS NOT NULL")
    return gates.pairs_within(v, "persona_id", "m").groupBy("a", "b").agg(F.count("*").alias("personas"))


def _boards(spark, sf):
    return table(spark, sf, "companies").where("slug IS NOT NULL").select("ats", "slug", "host", "site", "name", "status")


def provider_boards(spark, sf):
    return universe.of_provider(_boards(spark, sf), "workvane", {"workvane": 16}).groupBy("ats", "slug", "site").agg(F.count("*").alias("n"))


def unknown_boards(spark, sf):
    b = _boards(spark, sf)
    mined = b.select("ats", F.when(F.length("slug") % 2 == 0, F.upper("slug")).otherwise(F.col("slug")).alias("slug"), "site")
    return universe.unknown_boards(mined, [b.where("lower(status) = 'resolved'"), b.where("lower(status) = 'dead'")]).select("ats", F.lower("slug").alias("slug"), F.coalesce("site", F.lit("")).alias("site"))


def matched_names(spark, sf):
    """Typed employers, and slugs with their hyphens as blanks, against the boards."""
    typed = jobs(spark, sf, ["url", "company"]).select("company")
    names = typed.union(_boards(spark, sf).select(F.replace("slug", F.lit("-"), F.lit(" ")))).distinct()
    return universe.match_names(names, "company", _boards(spark, sf), first_word=True)


def names_still_open(spark, sf):
    names = jobs(spark, sf, ["url", "company"]).where("trim(company) <> ''").select(F.col("company").alias("name"))
    return universe.still_open(names, table(spark, sf, "companies").select("name"), "name")


def resolved_batch(spark, sf):
    c = table(spark, sf, "companies").select(F.col("name_key").alias("name"), "ats", "slug", F.lower("status").alias("status"), "attempts")
    n = F.length("name")
    found = c.where("status = 'resolved' AND slug IS NOT NULL").select("name", "ats", "slug")
    outcomes = c.where("status <> 'resolved'").select("name", F.when(n % 4 == 0, "refused").when(n % 4 == 1, "throttled").otherwise("missing").alias("outcome"))
    covered = c.where("status = 'covered'").select("name")
    own = found.where(n % 3 == 0).select("name", "ats", F.when(n % 2 == 0, F.upper("slug")).otherwise(F.lit("another")).alias("slug"))
    got = universe.resolve(c.select("name"), found, outcomes, covered, own)
    return got.select("name", "state", "slug", universe.record_as(F.col("state")).alias("recorded"))


def crawled_boards(spark, sf):
    b = _boards(spark, sf).select("ats", "slug")
    odd = table(spark, sf, "companies").select(F.lit("leafboard").alias("ats"), F.concat(F.lit("x"), F.coalesce("slug", F.lit("%20")), F.lit(".txt")).alias("slug"))
    return universe.merged_crawls([b.where(F.length("slug") % 2 == 0), b.withColumn("slug", F.upper("slug")), odd])


def board_names(spark, sf):
    return _boards(spark, sf).withColumn("ats", F.when(F.col("ats") == "workvane", "workday").otherwise(F.col("ats"))).select("slug", universe.display_name().alias("shown")).distinct()


def verify_then_evict(spark, sf):
    df = jobs(spark, sf, ["url", "source", "posted", "last_seen"])
    code = F.element_at(F.array(*map(F.lit, (200, 404, 500, 301))), (F.length("url") % 4 + 1).cast("int"))
    probes = df.where(F.length("url") % 3 == 0).select("url", code.alias("http_status"))
    got = stores.upkeep(df, probes, _now(), list(POLLED), polled_days=30, other_days=120, posted_days=200, cap=1_000_000)
    return got.select("url", F.unix_micros("last_seen").alias("last_us"))


def vectors_applied(spark, sf):
    """Content ids of the stored vectors after a sync of at most 400 keys."""
    cols = ["title", "title_root", "title_qualifiers", "company", "team", "category", "location", "tags", "body"]
    df = jobs(spark, sf, ["url", *cols, "last_seen"]).withColumn("cid", dense.content_id(F.col("url"), dense.summary_text(*cols)))
    now = df.where(F.col("last_seen") >= F.to_timestamp(F.lit("2025-10-01"))).select("url", "cid")
    old = df.where(F.col("last_seen") < F.to_timestamp(F.lit("2026-03-01"))).select("url", F.when(F.length("url") % 7 == 0, F.lit("stale")).otherwise(F.col("cid")).alias("cid"))
    return stores.apply_sync(old, pool.sync_plan(now, old, "url", "cid"), now, "url", limit=400).select("url", (F.col("cid") == "stale").alias("stale"))


def seen_sets(spark, sf):
    """Applied, dismissed and delivered urls as one set, with how many sets name each."""
    s = table(spark, sf, "job_snapshots").where("trim(coalesce(url, '')) <> ''")
    parts = [s.where("snapshot_no % 2 = 0"), s.where("snapshot_no % 3 = 0"), jobs(spark, sf, ["url", "source"]).where(F.col("source").isin(*POLLED))]
    rows = None
    for i, p in enumerate(parts):
        one = p.select("url", F.lit(i).alias("i")).distinct()
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("url").agg(F.count("*").alias("sets"))


def snapshot_report(spark, sf):
    errors = table(spark, sf, "feeds").select("source", F.concat(F.lit("no answer in "), "tz_name").alias("error"))
    got = intake.snapshot_meta(table(spark, sf, "jobs"), pool.reject_reason().isNull(), errors)
    return got.select("n", "servable", F.array_join("sources", ",").alias("sources"), F.array_join("errors", " | ").alias("errors"))


def log_since(spark, sf):
    """Lines of a log written from events since a day, and how many lines couldn't be read."""
    root = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(F.to_json(F.struct("event_id", "ts")))
    e.select(line.alias("value")).write.text(root)
    good, bad = files.recent_lines(spark, root, "event_id bigint, ts string", "ts", "2024-01-15")
    return good.agg(F.count("*").alias("lines"), F.min("event_id").alias("first")).crossJoin(bad)


def file_list(spark, sf):
    df = files.read_files(spark, [f"{sf}/{t}.parquet" for t in ("region", "nation")[1:]])
    return df.groupBy("n_regionkey").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        location_words, shown_fields, fit_bands, settings_fragments, settings_checked, scalar_scores, unsupported_tags, shown_board, asked_providers, search_rungs, first_results, search_failures, board_notices, completion_rates, release_gates, upkeep_gates, retired_backups, trial_funnel, tag_groups, meta_merge, profile_points, persona_pairs, provider_boards,
        unknown_boards, matched_names, names_still_open, resolved_batch, crawled_boards, board_names, verify_then_evict, vectors_applied, seen_sets, snapshot_report, log_since, file_list,
    )
}

W = f"WITH pool AS {LATEST}"
_HEAD = "strip_accents(substr(coalesce(location, ''), 1, 120))"
_KEYED = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_LOGGED = f"""{_SCORED}, sc AS (SELECT company, t.url, points, coalesce(list_filter(parts, lambda p: p.label IN ('title', 'related title'))[1].delta, 0) AS tier FROM t JOIN pool USING (url) WHERE company IS NOT NULL),
top1 AS (SELECT company, arg_min(tier, (-points, url)) AS tier FROM sc GROUP BY company),
log AS (SELECT company, count(*) FILTER (points > 0) AS delivered, max(points) AS score_max, any_value(top1.tier) AS tier, length(company) % 5 = 0 AS probe, length(company) % 7 = 0 AS degraded FROM sc JOIN top1 USING (company) GROUP BY company)"""
_STATE_CODES = "alabama:al alaska:ak arizona:az arkansas:ar california:ca colorado:co connecticut:ct delaware:de florida:fl georgia:ga hawaii:hi idaho:id illinois:il indiana:in iowa:ia kansas:ks kentucky:ky louisiana:la maine:me maryland:md massachusetts:ma michigan:mi minnesota:mn mississippi:ms missouri:mo montana:mt nebraska:ne nevada:nv ohio:oh oklahoma:ok oregon:or pennsylvania:pa tennessee:tn texas:tx utah:ut vermont:vt virginia:va washington:wa wisconsin:wi wyoming:wy mass:ma"
_CODES = "MAP {" + ", ".join("'{}': '{}'".format(*p.split(":")) for p in _STATE_CODES.split()) + "}"
_PLACE = lambda c: f"list_transform(string_split_regex(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]+', ' ', 'g')), '\\s+'), lambda w: coalesce({_CODES}[w], w))"
_SERV = """CASE WHEN trim(coalesce(url, '')) = '' THEN false WHEN upper(trim(coalesce(salary_currency, ''))) NOT IN ('', 'USD') THEN false WHEN upper(trim(coalesce(country, ''))) NOT IN ('', 'US') THEN false
 WHEN len(remote_areas) > 0 AND len(list_filter(remote_areas, lambda a: upper(a) = 'US' OR starts_with(upper(a), 'US-'))) = 0 THEN false ELSE coalesce(direct_apply, false) OR regexp_matches(lower(url), '^[a-z]+://([^/]*\\.)?adzuna\\.com(/|$)') END"""
_KEY = r"([\d,]+(?:\.\d+)?)\s*[kK]\b"


def _profile_sql(name, d):
    q = board.Query.of(d)
    best = "greatest(" + ", ".join(tier_sql(t, k) for t in q.titles for k in ("k1", "k2")) + ")"
    near = "greatest(0, " + ", ".join([tier_sql(t, k) for t in q.related for k in ("k1", "k2")] or ["0"]) + ")"
    add = " + ".join(["0", *(f"[0, 8, 14, 18, 20][1 + least({hits_sql(b, 'bl')}, 4)]" for b in q.boosts)])
    agency = "\\b(staffing|recruiting|recruitment|employment|temp|talent)[\\s-]+agenc(y|ies)\\b"
    take = {"agency": f"CASE WHEN regexp_matches(he, '{agency}') THEN 30 WHEN regexp_matches(bo, '{agency}') THEN 15 ELSE 0 END", "client": f"CASE WHEN {hits_sql('client', 'co')} > 0 THEN 30 ELSE 0 END"}
    less = " + ".join(["0", *(take.get(p, f"CASE WHEN {hits_sql(p, 'he')} > 0 THEN 30 WHEN {hits_sql(p, 'bo')} > 0 THEN 15 ELSE 0 END") for p in q.penalties)])
    return f"SELECT url, '{name}' AS profile_id, CAST(CASE WHEN {best} > 0 THEN {best} WHEN {near} > 0 THEN 30 ELSE 0 END + {add} - ({less}) AS INTEGER) AS points FROM a"


ORACLES = {
    "location_words": f"{W}, l AS (SELECT DISTINCT location FROM pool) SELECT location, ' ' || {_KEYED.format(_HEAD)} || ' ' AS tokens, array_to_string(list_filter(list_transform(string_split_regex({_HEAD}, '[,;/|]|\\s+-\\s+'), lambda p: {_KEYED.format('p')}), lambda p: p <> ''), '|') AS segments FROM l",
    "shown_fields": f"""{W}, a AS (SELECT *, trim(coalesce(salary, '')) AS s, trim(string_split_regex(coalesce(location, ''), '[.;|\\n]')[1]) AS first FROM pool),
b AS (SELECT *, coalesce(nullif(trim(regexp_replace(first, ',\\s*[^,]*\\bcounty\\s*$', '', 'i')), ''), first) AS place, try_cast(replace(regexp_extract(coalesce(salary, ''), '{_KEY}', 1), ',', '') AS DOUBLE) * 1000 AS k,
 try_cast(replace(regexp_extract(regexp_extract(coalesce(salary, ''), '(?s)^(.*?){_KEY}', 1), '(?s)([\\d,]+)[^\\d,]*$', 1), ',', '') AS DOUBLE) AS lead, try_cast(replace(regexp_extract(coalesce(salary, ''), '\\d[\\d,]*'), ',', '') AS DOUBLE) AS plain FROM a),
c AS (SELECT *, CASE WHEN k IS NOT NULL THEN least(k, CASE WHEN lead < 1000 THEN lead * 1000 ELSE lead END) ELSE plain END AS f FROM b)
SELECT url, CASE WHEN trim(regexp_extract(s, '(?s)^(.+?)\\s*[-–—]\\s*(.+)$', 1)) <> '' AND trim(regexp_extract(s, '(?s)^(.+?)\\s*[-–—]\\s*(.+)$', 1)) = trim(regexp_extract(s, '(?s)^(.+?)\\s*[-–—]\\s*(.+)$', 2)) THEN trim(regexp_extract(s, '(?s)^(.+?)\\s*[-–—]\\s*(.+)$', 1)) ELSE s END AS salary,
CASE WHEN first = '' THEN '—' WHEN len(string_split_regex(place, '\\s+')) > 8 THEN CASE remote WHEN 'remote' THEN 'Remote' WHEN 'hybrid' THEN 'Hybrid' WHEN 'onsite' THEN 'On-site' ELSE '—' END WHEN length(place) > 60 THEN substr(place, 1, 57) || '…' ELSE place END AS place,
CASE WHEN salary_min > 0 THEN salary_min WHEN f > 0 THEN f END AS least FROM c""",
    "fit_bands": f"{_SCORED}, m AS (SELECT max(points) AS top FROM t) SELECT CASE WHEN points >= 100 THEN 'strong' WHEN points >= 80 THEN 'good' ELSE 'fair' END AS band, CAST(floor(CASE WHEN top > 0 THEN greatest(3.0::DOUBLE, least(100.0::DOUBLE, points / top * 100)) ELSE 0 END) AS INTEGER) AS width, count(*) AS n FROM t, m GROUP BY ALL",
    "settings_fragments": f"""{W} SELECT url, md5('#q=' || base64(encode('{{"title":' || to_json(coalesce(title, '')) || ',"location":' || to_json(coalesce(location, '')) || '}}'))) AS digest, coalesce(title, '') AS title, coalesce(location, '') AS location FROM pool""",
    "settings_checked": "SELECT doc, (SELECT count(*) FROM entrants) AS n, doc IN ('{\"titles\":[\"a\"],\"remote_only\":true}', '{\"titles\":\"a, b\",\"min_score\":12}', '{\"max_age_days\":30.5,\"min_score\":\"strong\"}') AS valid FROM (VALUES " + ", ".join(f"('{d}')" for d in _DOCS) + ") AS v(doc)",
    "scalar_scores": f"{W} SELECT url, CASE WHEN {_PLACE('concat_ws(chr(44) || chr(32), city, state)')} = {_PLACE('location')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS place, CASE WHEN remote = 'remote' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS remote, CASE WHEN trunc(salary_min) = 50000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS number FROM pool",
    "unsupported_tags": f"""{W}, a AS (SELECT url, tags, regexp_replace(lower(coalesce(body, '')), '[^a-z0-9 ]+', ' ', 'g') AS c FROM pool WHERE len(tags) > 0)
SELECT url, array_to_string(list_filter(tags, lambda x: len(list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda w: w <> '' AND CASE WHEN length(w) < 3 THEN contains(' ' || c || ' ', ' ' || w || ' ') ELSE contains(c, left(w, 4)) END)) = 0), '|') AS unsupported FROM a""",
    "shown_board": f"""{_SCORED} SELECT t.url AS url, points FROM t JOIN pool USING (url) WHERE points >= 14 AND t.url NOT IN (SELECT url FROM job_snapshots WHERE snapshot_no = 1 AND url IS NOT NULL) AND (salary_min IS NULL OR salary_min <= 0 OR salary_min >= 40000) AND (coalesce(category, '') = '' OR category IN ('Sales', 'Design', 'Software Engineering'))
AND NOT regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(company, '')), '\\b(staffing|recruiting|recruitment|employment|temp|talent)[\\s-]+agenc(y|ies)\\b|\\brecruiting[\\s-]+(agency|agencies|firm|company)\\b|\\b(third[\\s-]party|external|agency)[\\s-]+recruiting\\b|\\b(agency|third[\\s-]party|external|contract)[\\s-]+recruiter\\b|\\bstaffing[\\s-]+(agency|agencies|firm|company|solutions|services|partner)\\b')""",
    "asked_providers": "SELECT v.ats AS ats, count(c.slug) AS n, count(c.slug) = 0 AS failed FROM (VALUES ('leafboard'), ('workvane'), ('nosuchboard')) AS v(ats) LEFT JOIN companies c ON c.ats = v.ats AND c.slug IS NOT NULL GROUP BY v.ats",
    "search_rungs": f"{_LOGGED}, d AS (SELECT tier AS rung, count(*) AS n FROM log WHERE NOT probe GROUP BY tier) SELECT rung, n, round(n / sum(n) OVER (), 6) AS share FROM d",
    "first_results": f"{_LOGGED}, head AS (SELECT company, arg_min(url, (-points, url)) AS url FROM sc GROUP BY company) SELECT head.company AS company, head.url AS url, tier FROM head JOIN top1 USING (company)",
    "search_failures": f"{_LOGGED}, d AS (SELECT count(*) AS searches, count(*) FILTER (delivered = 0) AS empty, count(*) FILTER (delivered > 0 AND score_max < 55) AS weak, count(*) FILTER (degraded) AS degraded FROM log WHERE NOT probe) SELECT *, round(empty / searches, 6) AS empty_share, round(weak / searches, 6) AS weak_share, round(degraded / searches, 6) AS degraded_share FROM d",
    "board_notices": f"{_LOGGED} SELECT CASE WHEN length(company) % 4 = 0 THEN 'Note: a; b. ' ELSE '' END || CASE WHEN degraded THEN 'degraded' WHEN delivered < 3 THEN 'filling' ELSE '' END AS notice, count(*) AS n FROM log GROUP BY 1",
    "completion_rates": f"WITH v AS (SELECT {_SLUG.format('a')} AS model, CASE WHEN {_SLUG.format('winner')} = {_SLUG.format('a')} THEN verdict_id % 9 + 1 END AS turns FROM verdicts) SELECT model, count(*) AS interviews, round(count(turns) / count(*), 6) AS completion_rate, round(avg(turns), 6) AS mean_turns FROM v WHERE model IS NOT NULL GROUP BY model",
    "release_gates": f"""{W}, a AS (SELECT avg(CASE WHEN regexp_matches(coalesce(location, ''), '(?i)texas|austin|dallas|houston|\\bTX\\b') THEN 1.0::DOUBLE ELSE 0.0 END) AS near, count(DISTINCT nullif(source, '')) AS sources, count(*) AS pool, avg(CASE WHEN coalesce(title_root, '') <> '' THEN 1.0::DOUBLE ELSE 0.0 END) AS root FROM pool), b AS (SELECT count(*) FILTER ({_SERV}) AS servable FROM jobs)
SELECT 'locality' AS gate, near >= 0.5 AND sources >= 3 AS ok, round(near, 6) AS figure FROM a UNION ALL SELECT 'pool', pool >= 500 AND pool >= 0.7 * servable, round(pool / servable, 6) FROM a, b UNION ALL SELECT 'root', root > 0.5, round(root, 6) FROM a""",
    "upkeep_gates": f"""WITH s AS (SELECT snapshot_no, max(loaded_at) AS l, max(last_seen) AS s FROM job_snapshots GROUP BY 1), f AS (SELECT coalesce((epoch(l)::BIGINT - epoch(s)::BIGINT) / 3600 <= 24, false) AS ok, count(*) AS n FROM (SELECT epoch_us(l) // 1000000 AS le, epoch_us(s) // 1000000 AS se, * FROM s) GROUP BY 1)
SELECT CASE WHEN count(*) FILTER (ats = 'smartroster') < 10 THEN 'bad' ELSE 'stale' END AS what, count(*) FILTER (ats = 'smartroster') AS figure, 61 AS age_days FROM companies WHERE slug IS NOT NULL
UNION ALL SELECT CASE WHEN count(*) FILTER (event_id % 10 = 9) >= 3 THEN 'grew' ELSE 'stuck' END, count(*) FILTER (event_id % 10 = 9), NULL FROM events UNION ALL SELECT CASE WHEN ok THEN 'fresh' ELSE 'behind' END, n, NULL FROM f""",
    "retired_backups": "SELECT snapshot_no FROM (SELECT snapshot_no, max(loaded_at) AS t FROM job_snapshots GROUP BY 1) ORDER BY t DESC OFFSET 3",
    "trial_funnel": "SELECT count(DISTINCT name_key) FILTER (attempts > 1) AS checked, count(*) FILTER (attempts > 1 AND lower(status) = 'resolved') AS before, count(*) FILTER (lower(status) = 'resolved') AS after, count(*) FILTER (attempts <= 1 AND lower(status) = 'resolved') + count(*) FILTER (attempts IS NULL AND lower(status) = 'resolved') AS gained, round(120.0::DOUBLE / greatest(count(DISTINCT name_key) FILTER (attempts > 1), 1) * 3068 / 60, 3) AS pass_minutes, count(*) FILTER (attempts > 1 AND lower(status) = 'unresolved') AS requeued, count(*) FILTER (attempts > 1 AND lower(status) = 'unresolved') = 0 AS cache_works FROM companies",
    "tag_groups": f"{W}, x AS (SELECT unnest(list_filter(list_concat(coalesce(tags, []), [remote, seniority, salary_band]), lambda t: t IS NOT NULL)) AS tag FROM pool), g AS (SELECT tag, CASE WHEN tag IN ('remote', 'hybrid', 'onsite') THEN 'remote' WHEN tag IN ('entry', 'mid', 'senior', 'executive') THEN 'seniority' WHEN tag IN ('under-50k', '50-80k', '80-120k', '120-180k', '180k-plus') THEN 'salary_band' END AS facet FROM x) SELECT facet, CASE WHEN facet IS NOT NULL THEN tag END AS tag, count(*) AS n FROM g GROUP BY 1, 2",
    "meta_merge": "SELECT source AS key, CASE WHEN length(source) % 2 = 0 THEN currency ELSE tz_name END AS value FROM feeds UNION ALL SELECT 'extra ' || source, date_order FROM feeds",
    "profile_points": f"{W}, a AS (SELECT url, {key_sql('title')} AS k1, {key_sql('title_root')} AS k2, lower(coalesce(title, '') || ' ' || coalesce(company, '')) AS he, lower(coalesce(company, '')) AS co, lower(coalesce(body, '')) AS bo, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS bl FROM pool) SELECT * FROM ({' UNION ALL '.join(_profile_sql(n, d) for n, d in PROFILES)}) WHERE points <> 0",
    "persona_pairs": f"WITH v AS (SELECT DISTINCT persona_id, {_SLUG.format('a')} AS m FROM verdicts WHERE persona_id IS NOT NULL) SELECT x.m AS a, y.m AS b, count(*) AS personas FROM v x JOIN v y ON x.persona_id = y.persona_id AND x.m < y.m GROUP BY 1, 2",
    "provider_boards": "SELECT ats, slug, nullif(site, '') AS site, count(*) AS n FROM companies WHERE ats = 'workvane' AND coalesce(slug, '') <> '' GROUP BY ALL",
    "unknown_boards": "WITH b AS (SELECT ats, lower(slug) AS slug, lower(coalesce(site, '')) AS k, coalesce(site, '') AS site, lower(status) AS st FROM companies WHERE slug IS NOT NULL) SELECT ats, slug, min(site) AS site FROM b WHERE (ats, slug, k) NOT IN (SELECT (ats, slug, k) FROM b WHERE st IN ('resolved', 'dead')) GROUP BY ats, slug, k",
    "matched_names": f"{W}, n AS (SELECT DISTINCT company, {key_sql('company')} AS k FROM (SELECT company FROM pool UNION ALL SELECT replace(slug, '-', ' ') FROM companies WHERE slug IS NOT NULL)), v AS (SELECT DISTINCT company AS name, unnest([replace(k, ' ', ''), replace(k, ' ', '-'), string_split(k, ' ')[1]]) AS s FROM n WHERE k <> '') SELECT v.name AS name, c.ats AS ats, min(c.slug) AS slug FROM v JOIN companies c ON lower(c.slug) = s WHERE coalesce(c.slug, '') <> '' GROUP BY v.name, c.ats",
    "names_still_open": f"{W} SELECT DISTINCT company AS name FROM pool WHERE trim(company) <> '' AND company NOT IN (SELECT name FROM companies WHERE name IS NOT NULL)",
    "resolved_batch": """WITH c AS (SELECT *, name_key AS n, lower(status) AS st, length(name_key) AS l FROM companies),
s AS (SELECT n, slug, CASE WHEN st = 'resolved' AND slug IS NOT NULL THEN CASE WHEN l % 3 = 0 AND l % 2 <> 0 AND lower(slug) <> 'another' THEN 'contradicted' ELSE 'resolved' END WHEN st <> 'resolved' AND l % 4 = 0 THEN 'dead' WHEN st = 'covered' THEN 'covered' WHEN st <> 'resolved' AND l % 4 = 1 THEN 'deferred' ELSE 'unresolved' END AS state FROM c)
SELECT n AS name, state, CASE WHEN state = 'resolved' THEN slug END AS slug, CASE WHEN state = 'contradicted' THEN 'unresolved' WHEN state <> 'deferred' THEN state END AS recorded FROM s""",
    "crawled_boards": "WITH b AS (SELECT ats, slug FROM companies WHERE slug IS NOT NULL), x AS (SELECT 0 AS i, ats, slug FROM b WHERE length(slug) % 2 = 0 UNION ALL SELECT 1, ats, upper(slug) FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY ats, lower(slug) ORDER BY i, slug) AS n FROM x WHERE ats IS NOT NULL AND length(slug) BETWEEN 2 AND 60) SELECT ats, slug FROM r WHERE n = 1",
    "board_names": "SELECT DISTINCT slug, CASE WHEN ats = 'workvane' AND coalesce(site, '') <> '' THEN slug || '/' || site ELSE coalesce(nullif(name, ''), slug) END AS shown FROM companies WHERE slug IS NOT NULL",
    "verify_then_evict": f"{W}, s AS (SELECT *, CASE WHEN length(url) % 3 = 0 THEN [200, 404, 500, 301][1 + length(url) % 4] END AS code FROM pool), v AS (SELECT url, source, CASE WHEN code BETWEEN 200 AND 399 THEN TIMESTAMPTZ '{NOW}+00' ELSE last_seen END AS seen, try_cast(CASE WHEN regexp_matches(substr(posted, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN substr(posted, 1, 10) END AS DATE) AS day FROM s WHERE code IS NULL OR code NOT IN (404, 410)) SELECT url, epoch_us(seen) AS last_us FROM v WHERE seen >= TIMESTAMPTZ '{NOW}+00' - CASE WHEN source IN {POLLED} THEN INTERVAL 30 DAY ELSE INTERVAL 120 DAY END AND (day IS NULL OR day >= DATE '{AS_OF}' - 200)",
    "vectors_applied": f"{W}, n AS (SELECT url FROM pool WHERE last_seen >= TIMESTAMPTZ '2025-10-01 00:00:00+00'), o AS (SELECT url, length(url) % 7 = 0 AS stale FROM pool WHERE last_seen < TIMESTAMPTZ '2026-03-01 00:00:00+00'), todo AS (SELECT url FROM n LEFT JOIN o USING (url) WHERE stale IS NULL OR stale ORDER BY url LIMIT 400) SELECT url, stale FROM o WHERE url IN (SELECT url FROM n) AND url NOT IN (SELECT url FROM todo) UNION ALL SELECT url, false FROM todo",
    "seen_sets": f"{W} SELECT url, count(*) AS sets FROM (SELECT DISTINCT url, 0 AS i FROM job_snapshots WHERE trim(coalesce(url, '')) <> '' AND snapshot_no % 2 = 0 UNION ALL SELECT DISTINCT url, 1 FROM job_snapshots WHERE trim(coalesce(url, '')) <> '' AND snapshot_no % 3 = 0 UNION ALL SELECT url, 2 FROM pool WHERE source IN {POLLED}) GROUP BY url",
    "snapshot_report": f"WITH e AS (SELECT source || ': no answer in ' || tz_name AS e FROM feeds) SELECT count(*) AS n, count(*) FILTER ({_SERV}) AS servable, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, (SELECT array_to_string(list_sort(list(e))[1:5], ' | ') || ' | … and ' || (count(*) - 5) || ' more' FROM e) AS errors FROM jobs",
    "log_since": "SELECT count(*) FILTER (event_id % 10 <> 3 AND ts >= TIMESTAMP '2024-01-15') AS lines, min(event_id) FILTER (event_id % 10 <> 3 AND ts >= TIMESTAMP '2024-01-15') AS first, count(*) FILTER (event_id % 10 = 3) AS unreadable FROM events",
    "file_list": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
}
