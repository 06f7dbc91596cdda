"""Queries on the pool of listings: text, vocabularies, scoring, filters, facets, intake and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.functions import text as X
from boardwright.functions import vocab as V
from boardwright.operators import analytics, board, intake, order, pool
from boardwright.session import table

QUERY = board.Query.of(
    {
        "titles": "Software Engineer, Data Engineer, Senior Accountant", "related_titles": ["Web Developer", "Bookkeeper"], "boosts": ["kubernetes", "sql", "build pipeline", "compliance report"],
        "exclude": ["weekends"], "rank_down": ["night shift", "agency", "our client", "client", "phlebotomy"],
    }
)
AS_OF = "2026-07-01"
NOW = f"{AS_OF} 00:00:00"
POLLED = ("rolewire", "jobdrift", "werkpfad")
CHOSEN = {"category": ["Sales", "Design", "Education"], "remote": ["remote", "hybrid"]}


def jobs(spark, sf, columns=None):
    df = table(spark, sf, "jobs")
    return pool.latest(df, "url", ["last_seen", "fetched_at"], columns)


def _board(spark, sf):
    df = jobs(spark, sf, ["url", "title", "title_root", "company", "body", "remote", "posted", "category", "seniority", "source", "employment_type"])
    kept = board.eligible(df, QUERY, F.to_date(F.lit(AS_OF)))
    return board.scoreboard(kept, QUERY)


def score_board(spark, sf):
    return _board(spark, sf).orderBy(F.desc("points"), "url").limit(QUERY.limit).select("url", "points", "why")


def score_parts(spark, sf):
    return _board(spark, sf).select("url", F.posexplode("parts").alias("at", "p")).select("url", "at", "p.label", "p.delta")


def score_reconcile(spark, sf):
    """Rows whose parts don't sum to their points: none."""
    return _board(spark, sf).where(F.aggregate("parts", F.lit(0), lambda s, p: s + p["delta"]) != F.col("points")).select("url")


def title_tiers(spark, sf):
    df = board.with_title_keys(jobs(spark, sf, ["url", "title", "title_root"]))
    pts, rel = board.title_points(QUERY)
    return df.select("url", pts.cast("int").alias("points"), rel.alias("related")).where("points > 0")


def term_counts(spark, sf):
    df = jobs(spark, sf, ["url", "title", "body"]).withColumn("blob", F.lower(F.concat_ws(" ", X.text(F.col("title")), X.text(F.col("body")))))
    return df.select("url", *[X.term_hits(t, F.col("blob")).cast("int").alias(f"n{i}") for i, t in enumerate(QUERY.boosts)]).where("n0 + n1 + n2 + n3 > 0")


def eligible_listings(spark, sf):
    q = board.Query.of({"titles": ["Accountant"], "exclude": ["weekends", "night shift"], "remote_only": True, "max_age_days": 200})
    return board.eligible(jobs(spark, sf, ["url", "title", "company", "remote", "posted"]), q, F.to_date(F.lit(AS_OF))).select("url")


def dedupe_listings(spark, sf):
    df = order.numbered(jobs(spark, sf, ["url", "title", "company", "body"]), ["url"], "place", 1)
    got = board.dedupe_listings(df, "place")
    return got.select("place", F.length(X.text(F.col("body"))).alias("body_length"), X.norm_key(F.col("company")).alias("company_key"), X.norm_key(F.col("title")).alias("title_key"))


def _facets(spark, sf):
    stored = [f for f in board.FACETS if f != "apply_via"]
    return jobs(spark, sf, ["url", *stored, "direct_apply"]).withColumn("apply_via", V.apply_via(F.col("direct_apply")))


def facet_counts(spark, sf):
    return board.facet_counts(_facets(spark, sf))


def facet_groups_shown(spark, sf):
    counts = board.facet_counts(_facets(spark, sf))
    return counts.groupBy("facet").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows")).where("n_values >= 2")


def facet_passes(spark, sf):
    return _facets(spark, sf).where(board.passes_facets(CHOSEN)).groupBy("category", "remote").agg(F.count("*").alias("n"))


def facet_exemptions(spark, sf):
    return board.exemptions(_facets(spark, sf), CHOSEN)


def seen_antijoin(spark, sf):
    df = jobs(spark, sf, ["url", "source"])
    seen = df.where(F.col("source").isin(*POLLED)).select("url")
    return df.join(seen, "url", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def sort_newest(spark, sf):
    df = jobs(spark, sf, ["url", "posted"]).withColumn("day", pool.posted_day(F.col("posted")))
    return df.orderBy(F.coalesce("day", F.to_date(F.lit("1970-01-01"))).desc(), "url").limit(50).select("url", F.date_format("day", "yyyy-MM-dd").alias("day"))


def sort_pay_page(spark, sf):
    df = jobs(spark, sf, ["url", "salary_min"])
    return df.orderBy(F.coalesce("salary_min", F.lit(0.0)).desc(), "url").offset(50).limit(50).select("url", "salary_min")


def company_cap(spark, sf):
    df = jobs(spark, sf, ["url", "company", "last_seen"])
    return board.cap_per_group(df, F.lower(F.trim(X.text(F.col("company")))), [F.desc("last_seen"), F.col("url")], 3).select("url", "company")


def norm_keys(spark, sf):
    return jobs(spark, sf, ["url", "company", "title"]).select(X.norm_key(F.col("company")).alias("company_key"), X.norm_key(F.col("title")).alias("title_key")).distinct()


def html_plain(spark, sf):
    return jobs(spark, sf, ["url", "body"]).select("url", F.md5(X.html_plain(F.col("body"))).alias("digest"))


def html_plain_text(spark, sf):
    plain = X.html_plain_text(F.col("body"))
    return jobs(spark, sf, ["url", "body"]).select("url", F.substring(plain, 1, 240).alias("snippet"), F.md5(plain).alias("digest"))


def description_bullets(spark, sf):
    df = jobs(spark, sf, ["url", "title", "body"]).select("url", F.posexplode(X.bullets(F.col("body"), F.col("title"))).alias("at", "bullet"))
    return df.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.length("bullet")).alias("chars"))


def vocabulary_fields(spark, sf):
    df = jobs(spark, sf, ["url", "category", "seniority", "employment_type_raw", "employment_type", "state", "direct_apply"])
    return df.groupBy(
        V.category(F.col("category")).alias("category"), V.seniority(F.col("seniority")).alias("seniority"), V.employment_type(F.col("employment_type_raw")).alias("employment"), V.us_state(F.col("state")).alias("state"), V.apply_via(F.col("direct_apply")).alias("via")
    ).agg(F.count("*").alias("n"))


def salary_fields(spark, sf):
    df = jobs(spark, sf, ["url", "salary", "salary_min", "salary_currency", "salary_period"])
    first, year = V.first_figure(F.col("salary")), V.annual_salary(F.col("salary_min"), F.col("salary_currency"), F.col("salary_period"))
    return df.select("url", first.alias("first_figure"), year.alias("yearly"), V.salary_band(F.coalesce(year, first)).alias("band")).where("first_figure IS NOT NULL OR yearly IS NOT NULL")


def intake_reasons(spark, sf):
    return table(spark, sf, "jobs").groupBy(F.coalesce(pool.reject_reason(), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


def remote_scope(spark, sf):
    """NULL areas are unstated and empty ones world-wide: three kinds."""
    kind = F.when(F.col("remote_areas").isNull(), "unstated").when(F.size("remote_areas") == 0, "worldwide").otherwise("listed")
    return jobs(spark, sf, ["url", "remote_areas", "remote"]).groupBy(kind.alias("scope"), "remote").agg(F.count("*").alias("n"))


def upsert_latest(spark, sf):
    return jobs(spark, sf, ["url", "title", "last_seen", "fetched_at"]).select("url", "title", F.unix_micros("last_seen").alias("last_us"))


def upsert_merge(spark, sf):
    """Deliveries until the end of 2025 as the store, later ones as a batch: first clocks stay, heartbeats move."""
    df = table(spark, sf, "jobs").select("url", "title", "source", "fetched_at", "last_seen")
    at = F.to_timestamp(F.lit("2026-01-01"))
    stored = pool.latest(df.where(F.col("last_seen") < at), "url", ["last_seen", "fetched_at"])
    batch = df.where(F.col("last_seen") >= at).withColumn("seq", F.unix_micros("last_seen"))
    got = pool.upsert(stored, batch, "url", "fetched_at", "last_seen", F.to_timestamp(F.lit(NOW)))
    return got.select("url", "title", F.unix_micros("fetched_at").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def evict_survivors(spark, sf):
    df = jobs(spark, sf, ["url", "source", "posted", "last_seen"])
    return pool.survivors(df, F.to_timestamp(F.lit(NOW)), POLLED, 30, 120, 200, 400).select("url")


def recommend_check(spark, sf):
    """Of all urls that snapshots name, which are in the pool and which are not."""
    asked = table(spark, sf, "job_snapshots").select("url")
    return intake.check_keys(asked, jobs(spark, sf, ["url"]), "url")


def snapshot_meta(spark, sf):
    ok = pool.reject_reason().isNull()
    return table(spark, sf, "jobs").agg(F.count("*").alias("n"), F.count_if(ok).alias("servable"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def fill_rates(spark, sf):
    df = jobs(spark, sf)
    cols = [c for c in df.columns if c != "url"]
    return analytics.fill_rates(df, cols).select(F.col("column").alias("field"), "filled", "rows", F.round("rate", 6).alias("rate"))


def richest_rows(spark, sf):
    df = jobs(spark, sf)
    cols = [c for c in df.columns if c != "url"]
    return df.select("url", analytics.completeness(df, cols).alias("filled")).orderBy(F.desc("filled"), "url").limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        score_board, score_parts, score_reconcile, title_tiers, term_counts, eligible_listings, dedupe_listings, facet_counts, facet_groups_shown, facet_passes, facet_exemptions, seen_antijoin, sort_newest, sort_pay_page, company_cap, norm_keys, html_plain,
        html_plain_text, description_bullets, vocabulary_fields, salary_fields, intake_reasons, remote_scope, upsert_latest, upsert_merge, evict_survivors, recommend_check, snapshot_meta, fill_rates, richest_rows,
    )
}

# --- the same in SQL ---
LATEST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_seen DESC NULLS LAST, fetched_at DESC NULLS LAST) AS rn FROM jobs WHERE trim(coalesce(url, '')) <> '') WHERE rn = 1)"
W = f"WITH pool AS {LATEST}"


def key_sql(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def tier_sql(title: str, key: str) -> str:
    words = X.key_of(title).split()
    bare = " ".join(words[1:]) if words[0] in board.LEVEL_PREFIXES else " ".join(words)
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(CASE WHEN {key} = '' THEN 0 WHEN {key} = '{' '.join(words)}' THEN 100 WHEN list_has_all(string_split({key}, ' '), [{listed}]) THEN 80 WHEN regexp_replace({key}, '^(head of|director of|senior|staff|principal|junior|lead|sr|jr) ', '') = '{bare}' THEN 60 ELSE 0 END)"


def hits_sql(term: str, c: str) -> str:
    return f"len(regexp_extract_all({c}, '{X.term_pattern(term)}'))"


_BEST = "greatest(" + ", ".join(tier_sql(t, k) for t in QUERY.titles for k in ("k1", "k2")) + ")"
_NEAR = "greatest(" + ", ".join(tier_sql(t, k) for t in QUERY.related for k in ("k1", "k2")) + ")"
_DAY = "try_cast(CASE WHEN regexp_matches(substr({0}, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN substr({0}, 1, 10) END AS DATE)"


def _penalty_sql(p: str) -> str:
    if p == "client":
        return f"CASE WHEN {hits_sql(p, 'co')} > 0 THEN -30 ELSE 0 END"
    pat = board.QUALIFIED.get(p, "").replace("'", "''")
    body = f"regexp_matches(bo, '{pat}')" if pat else f"{hits_sql(p, 'bo')} > 0"
    head = f"regexp_matches(he, '{pat}')" if p == "agency" else f"{hits_sql(p, 'he')} > 0"
    return f"CASE WHEN {head} THEN -30 WHEN {body} THEN -15 ELSE 0 END"


_PART = "CASE WHEN {0} <> 0 THEN {{'label': {1}, 'delta': CAST({0} AS INTEGER)}} END"
_SCORED = f"""{W}, a AS (SELECT *, {key_sql("title")} AS k1, {key_sql("title_root")} AS k2, lower(coalesce(title, '') || ' ' || coalesce(company, '')) AS he, lower(coalesce(company, '')) AS co, lower(coalesce(body, '')) AS bo, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS bl FROM pool),
b AS (SELECT *, {_BEST} AS best, {_NEAR} AS near, {", ".join(f"{hits_sql(b, 'bl')} AS h{i}" for i, b in enumerate(QUERY.boosts))}, {", ".join(f"{_penalty_sql(p)} AS p{i}" for i, p in enumerate(QUERY.penalties))} FROM a WHERE {hits_sql("weekends", "he")} = 0),
c AS (SELECT *, CASE WHEN best > 0 THEN best WHEN near > 0 THEN 30 ELSE 0 END AS tier, {", ".join(f"[0, 8, 14, 18, 20][1 + least(h{i}, 4)] AS d{i}" for i in range(len(QUERY.boosts)))} FROM b),
s AS (SELECT url, list_filter([{_PART.format("tier", "CASE WHEN best > 0 THEN 'title' ELSE 'related title' END")}, {", ".join(_PART.format(f"d{i}", f"'{b} ×' || h{i}") for i, b in enumerate(QUERY.boosts))}, {", ".join(_PART.format(f"p{i}", f"'-{p}'") for i, p in enumerate(QUERY.penalties))}], lambda x: x IS NOT NULL) AS parts FROM c),
t AS (SELECT url, parts, CAST(coalesce(list_sum(list_transform(parts, lambda x: x.delta)), 0) AS INTEGER) AS points FROM s)"""
_FACET = " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM pool" for f in ("category", "employment_type", "remote", "seniority", "salary_band", "state")) + " UNION ALL SELECT 'apply_via', CASE WHEN direct_apply THEN 'employer' WHEN NOT direct_apply THEN 'aggregator' ELSE '' END FROM pool"
_PASS = "(category IS NULL OR category = '' OR category IN ('Sales', 'Design', 'Education')) AND (remote IS NULL OR remote = '' OR remote IN ('remote', 'hybrid'))"
_FILLED = {c: f"len({c}) > 0" for c in ("title_qualifiers", "locations", "remote_areas", "remote_regions", "tags")} | {c: f"{c} IS NOT NULL" for c in ("salary_min", "salary_max", "salary_estimated_min", "salary_estimated_max", "direct_apply", "fetched_at", "last_seen")}
_TEXT = "title title_root title_level company team location city state country remote remote_basis remote_scope_raw body category seniority seniority_basis employment_type employment_type_raw salary salary_currency salary_period salary_basis salary_band source source_extra posted expires".split()
_FILLED |= {c: f"{c} IS NOT NULL AND trim({c}) <> ''" for c in _TEXT}
_LOOK = lambda table, c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_CLEAN = "trim(regexp_replace(regexp_replace(replace(lower(coalesce({0}, '')), '&amp;', '&'), '\\s*/\\s*', ' & ', 'g'), '\\s+', ' ', 'g'))"
_KFIG = r"([\d,]+(?:\.\d+)?)\s*[kK]\b"
_PLAIN = r"regexp_extract_all({0}, '[\d,]{{3,}}')"
_REASON = """CASE WHEN trim(coalesce(url, '')) = '' THEN 'blank url'
 WHEN NOT (CASE WHEN upper(trim(coalesce(salary_currency, ''))) NOT IN ('', 'USD') THEN false WHEN upper(trim(coalesce(country, ''))) NOT IN ('', 'US') THEN false
   WHEN len(remote_areas) > 0 THEN len(list_filter(remote_areas, lambda a: upper(a) = 'US' OR starts_with(upper(a), 'US-'))) > 0 ELSE true END) THEN 'not servable'
 WHEN NOT (coalesce(direct_apply, false) OR regexp_matches(lower(url), '^[a-z]+://([^/]*\\.)?adzuna\\.com(/|$)')) THEN 'not direct' ELSE 'admitted' END"""
_STRIPPED = r"regexp_replace(coalesce(body, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
_MARKUP = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?i)</(li|p|div|h[1-6]|tr|ul|ol)\s*>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')".format(_STRIPPED)
_ENT = _MARKUP
for _e, _p in X.ENTITIES.items():
    _ENT = "replace({0}, '{1}', '{2}')".format(_ENT, _e, _p.replace("'", "''"))
_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\*\*([^*\n]+)\*\*', '\1', 'g'), '(?m)^#{{1,4}}\s*', '', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')".format(_ENT)

ORACLES = {
    "score_board": f"{_SCORED} SELECT url, points, array_to_string(list_transform(parts[1:4], lambda x: x.label), ', ') AS why FROM t ORDER BY points DESC, url LIMIT 200",
    "score_parts": f"{_SCORED} SELECT url, CAST(i - 1 AS INTEGER) AS at, parts[i].label AS label, parts[i].delta AS delta FROM t, unnest(generate_series(1, len(parts))) AS u(i)",
    "score_reconcile": f"{_SCORED} SELECT url FROM t WHERE coalesce(list_sum(list_transform(parts, lambda x: x.delta)), 0) <> points",
    "title_tiers": f"{W}, a AS (SELECT url, {key_sql('title')} AS k1, {key_sql('title_root')} AS k2 FROM pool), b AS (SELECT url, {_BEST} AS best, {_NEAR} AS near FROM a) SELECT url, CAST(CASE WHEN best > 0 THEN best WHEN near > 0 THEN 30 ELSE 0 END AS INTEGER) AS points, best = 0 AND near > 0 AS related FROM b WHERE best > 0 OR near > 0",
    "term_counts": f"{W}, a AS (SELECT url, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS bl FROM pool), b AS (SELECT url, {', '.join(f'CAST({hits_sql(b, chr(98) + chr(108))} AS INTEGER) AS n{i}' for i, b in enumerate(QUERY.boosts))} FROM a) SELECT * FROM b WHERE n0 + n1 + n2 + n3 > 0",
    "eligible_listings": f"{W}, a AS (SELECT url, remote, lower(coalesce(title, '') || ' ' || coalesce(company, '')) AS he, {_DAY.format('posted')} AS day FROM pool) SELECT url FROM a WHERE {hits_sql('weekends', 'he')} = 0 AND {hits_sql('night shift', 'he')} = 0 AND remote = 'remote' AND (day IS NULL OR date_diff('day', day, DATE '{AS_OF}') <= 200)",
    "dedupe_listings": f"{W}, a AS (SELECT url, body, {key_sql('company')} AS ck, {key_sql('title')} AS tk, row_number() OVER (ORDER BY url) AS place FROM pool), g AS (SELECT CASE WHEN ck = '' AND tk = '' THEN 'url:' || url ELSE ck || '|' || tk END AS k, * FROM a) SELECT min(place) AS place, CAST(max(length(coalesce(body, ''))) AS INTEGER) AS body_length, min(ck) AS company_key, min(tk) AS title_key FROM g GROUP BY k",
    "facet_counts": f"{W} SELECT facet, value, count(*) AS n FROM ({_FACET}) WHERE value <> '' GROUP BY ALL",
    "facet_groups_shown": f"{W} SELECT facet, count(DISTINCT value) AS n_values, CAST(count(*) AS BIGINT) AS n_rows FROM ({_FACET}) WHERE value <> '' GROUP BY facet HAVING count(DISTINCT value) >= 2",
    "facet_passes": f"{W} SELECT category, remote, count(*) AS n FROM pool WHERE {_PASS} GROUP BY ALL",
    "facet_exemptions": f"{W} SELECT * FROM (SELECT 'category' AS facet, count(*) FILTER (category IS NULL OR category = '') AS n FROM pool WHERE {_PASS} UNION ALL SELECT 'remote', count(*) FILTER (remote IS NULL OR remote = '') FROM pool WHERE {_PASS}) WHERE n > 0",
    "seen_antijoin": f"{W} SELECT source, count(*) AS n FROM pool WHERE url NOT IN (SELECT url FROM pool WHERE source IN {POLLED}) GROUP BY source",
    "sort_newest": f"{W}, a AS (SELECT url, {_DAY.format('posted')} AS day FROM pool) SELECT url, strftime(day, '%Y-%m-%d') AS day FROM a ORDER BY coalesce(day, DATE '1970-01-01') DESC, url LIMIT 50",
    "sort_pay_page": f"{W} SELECT url, salary_min FROM pool ORDER BY coalesce(salary_min, 0) DESC, url LIMIT 50 OFFSET 50",
    "company_cap": f"{W} SELECT url, company FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(coalesce(company, ''))) ORDER BY last_seen DESC, url) AS r FROM pool) WHERE r <= 3",
    "norm_keys": f"{W} SELECT DISTINCT {key_sql('company')} AS company_key, {key_sql('title')} AS title_key FROM pool",
    "html_plain": f"{W} SELECT url, md5({_HTML}) AS digest FROM pool",
    "html_plain_text": f"{W} SELECT url, substr(plain, 1, 240) AS snippet, md5(plain) AS digest FROM (SELECT url, trim(regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '<[^>]+>', ' ', 'g'), '</?[a-zA-Z][^>]*$', ' ', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS plain FROM pool)",
    "description_bullets": f"""{W}, a AS (SELECT url, lower(trim(coalesce(title, ''))) AS t, list_transform(regexp_extract_all(regexp_replace(coalesce(body, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '[^' || chr(1) || ']+'), lambda s: regexp_replace(trim(s), '\\s+', ' ', 'g')) AS parts FROM pool),
b AS (SELECT url, list_filter(parts, lambda s: length(s) >= 24 AND lower(s) <> t AND NOT starts_with(lower(s), t || '.') AND NOT starts_with(lower(s), t || ' ') AND length(regexp_replace(s, '[^0-9]', '', 'g')) <= length(s) * 0.25)[1:20] AS kept FROM a)
SELECT url, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM b, unnest(kept) AS u(s) GROUP BY url""",
    "vocabulary_fields": f"{W}, a AS (SELECT {_LOOK(V.CATEGORIES, _CLEAN.format('category'))} AS category, {_LOOK(V.SENIORITY, _CLEAN.format('seniority'))} AS seniority, coalesce({_LOOK(V.EMPLOYMENT, key_sql('employment_type_raw'))}, '') AS employment, {_LOOK(V.STATES, key_sql('state'))} AS state, CASE WHEN direct_apply IS NULL THEN '' WHEN direct_apply THEN 'employer' ELSE 'aggregator' END AS via FROM pool) SELECT *, count(*) AS n FROM a GROUP BY ALL",
    "salary_fields": f"""{W}, a AS (SELECT url, salary_min, upper(trim(coalesce(salary_currency, ''))) AS cur, lower(trim(coalesce(salary_period, ''))) AS per, list_transform(regexp_extract_all(coalesce(salary, ''), '{_KFIG}', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE) * 1000) AS k, list_transform({_PLAIN.format(f"regexp_replace(coalesce(salary, ''), '{_KFIG}', ' ', 'g')")}, lambda x: try_cast(replace(x, ',', '') AS DOUBLE)) AS p FROM pool),
b AS (SELECT url, CASE WHEN len(k) > 0 THEN list_min(list_concat(k, list_transform(p, lambda v: CASE WHEN v < 1000 THEN v * 1000 ELSE v END))) ELSE list_min(p) END AS first_figure, CASE WHEN salary_min > 0 AND cur IN ('', 'USD') THEN CASE WHEN per = '' THEN CASE WHEN salary_min >= 15000 THEN salary_min END ELSE salary_min * CASE per WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'hour' THEN 2080 WHEN 'day' THEN 260 END END END AS yearly FROM a),
c AS (SELECT *, coalesce(yearly, first_figure) AS f FROM b) SELECT url, first_figure, yearly, CASE WHEN f IS NULL THEN '' WHEN f < 50000 THEN 'under-50k' WHEN f < 80000 THEN '50-80k' WHEN f < 120000 THEN '80-120k' WHEN f < 180000 THEN '120-180k' ELSE '180k-plus' END AS band FROM c WHERE first_figure IS NOT NULL OR yearly IS NOT NULL""",
    "intake_reasons": f"SELECT {_REASON} AS reason, count(*) AS n FROM jobs GROUP BY 1",
    "remote_scope": f"{W} SELECT CASE WHEN remote_areas IS NULL THEN 'unstated' WHEN len(remote_areas) = 0 THEN 'worldwide' ELSE 'listed' END AS scope, remote, count(*) AS n FROM pool GROUP BY ALL",
    "upsert_latest": f"{W} SELECT url, title, epoch_us(last_seen) AS last_us FROM pool",
    "upsert_merge": f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_seen DESC, fetched_at DESC) AS rn FROM jobs WHERE last_seen < TIMESTAMPTZ '2026-01-01 00:00:00+00') WHERE rn = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_seen DESC) AS rn FROM jobs WHERE last_seen >= TIMESTAMPTZ '2026-01-01 00:00:00+00') WHERE rn = 1)
SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN o.url IS NOT NULL THEN epoch_us(o.fetched_at) ELSE epoch_us(TIMESTAMPTZ '{NOW}+00') END AS first_us, CASE WHEN n.url IS NOT NULL THEN epoch_us(TIMESTAMPTZ '{NOW}+00') ELSE epoch_us(o.last_seen) END AS last_us FROM o FULL OUTER JOIN n ON o.url = n.url""",
    "evict_survivors": f"{W}, a AS (SELECT url, last_seen, source, {_DAY.format('posted')} AS day FROM pool) SELECT url FROM a WHERE last_seen >= TIMESTAMPTZ '{NOW}+00' - CASE WHEN source IN {POLLED} THEN INTERVAL 30 DAY ELSE INTERVAL 120 DAY END AND (day IS NULL OR day >= DATE '{AS_OF}' - 200) ORDER BY last_seen DESC, url LIMIT 400",
    "recommend_check": f"{W} SELECT DISTINCT url, url IN (SELECT url FROM pool) AS found FROM job_snapshots WHERE trim(coalesce(url, '')) <> ''",
    "snapshot_meta": f"SELECT count(*) AS n, count(*) FILTER (({_REASON}) = 'admitted') AS servable, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM jobs",
    "fill_rates": f"{W}, a AS ({' UNION ALL '.join(f'''SELECT '{c}' AS field, count(*) FILTER ({x}) AS filled, count(*) AS rows FROM pool''' for c, x in _FILLED.items())}) SELECT field, filled, rows, round(filled / rows, 6) AS rate FROM a",
    "richest_rows": f"{W} SELECT url, CAST({' + '.join(f'(CASE WHEN {x} THEN 1 ELSE 0 END)' for x in _FILLED.values())} AS INTEGER) AS filled FROM pool ORDER BY filled DESC, url LIMIT 20",
}
