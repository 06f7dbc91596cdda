"""Queries of the general problems: snapshot changes (2), timestamps (3) and pay (5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardwright.operators import snapshots, timestamps, units
from boardwright.session import table


def p2_found(spark, sf):
    return snapshots.all_changes(table(spark, sf, "job_snapshots"), table(spark, sf, "company_snapshots"))


def p2_change_counts(spark, sf):
    return p2_found(spark, sf).groupBy("dataset", "snapshot_no", "change_kind").agg(F.count("*").alias("n"))


def p3_found(spark, sf):
    return timestamps.posted_instants(table(spark, sf, "jobs"), table(spark, sf, "feeds"))


def p5_found(spark, sf):
    return units.yearly_pay(table(spark, sf, "jobs"), table(spark, sf, "feeds"), table(spark, sf, "pay_units"))


_TRIM = "regexp_replace(coalesce({0}, ''), '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"


def _changes_sql(name: str, source: str, key: str, version: str, state: str) -> str:
    k = _TRIM.format(key)
    return f"""
    {name}_s AS (SELECT CAST(snapshot_no AS INTEGER) AS no, {k} AS k, {state} AS st,
        row_number() OVER (PARTITION BY snapshot_no, {k} ORDER BY {version} DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn
        FROM {source} WHERE {k} <> '' AND snapshot_no IS NOT NULL),
    {name}_n AS (SELECT no, lag(no) OVER (ORDER BY no) AS prev FROM (SELECT DISTINCT CAST(snapshot_no AS INTEGER) AS no FROM {source} WHERE snapshot_no IS NOT NULL)),
    {name}_a AS (SELECT s.no, k, st FROM {name}_s s JOIN {name}_n n ON s.no = n.no WHERE rn = 1 AND prev IS NOT NULL),
    {name}_b AS (SELECT n.no, k, st FROM {name}_s s JOIN {name}_n n ON s.no = n.prev WHERE rn = 1),
    {name} AS (SELECT '{name}' AS dataset, no AS snapshot_no, k AS rec_key,
        CASE WHEN b.st IS NULL THEN 'added' WHEN a.st IS NULL THEN 'removed' WHEN a.st <> b.st THEN 'changed' END AS change_kind
        FROM {name}_a a FULL OUTER JOIN {name}_b b USING (no, k))"""


_JOB_STATE = " || chr(1) || ".join(_TRIM.format(c) for c in ("title", "company", "location", "salary"))
_P2 = (
    "WITH "
    + _changes_sql("jobs", "job_snapshots", "url", "last_seen", _JOB_STATE)
    + ", "
    + _changes_sql("companies", "company_snapshots", "name_key", "checked_at", f"lower({_TRIM.format('status')})")
)
_BOTH = "(SELECT * FROM jobs WHERE change_kind IS NOT NULL UNION ALL SELECT * FROM companies WHERE change_kind IS NOT NULL)"

QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts, "p3_found": p3_found, "p5_found": p5_found}
_MONTHS = "jan:1 feb:2 fév:2 mar:3 mär:3 apr:4 avr:4 abr:4 may:5 mai:5 jun:6 jul:7 aug:8 ago:8 sep:9 oct:10 okt:10 nov:11 dec:12 dez:12 dic:12"
_ZONES = "utc:0 gmt:0 z:0 est:-300 edt:-240 cst:-360 cdt:-300 mst:-420 mdt:-360 pst:-480 pdt:-420 bst:60 cet:60 cest:120 mez:60 mesz:120 ist:330 jst:540 aest:600 aedt:660"
_MAP = lambda text: "MAP {" + ", ".join("'{}': {}".format(*p.split(":")) for p in text.split()) + "}"
_MERIDIEM = "(\\d{1,2}:\\d{2}(?::\\d{2})?) ?([AaPp])[Mm]\\b"
# dates, times and zones by expressions of their own; a time that occurs twice is tried an hour earlier
_P3 = f"""WITH j AS (SELECT DISTINCT url, trim(posted) AS p, tz_name, date_order AS o FROM jobs LEFT JOIN feeds f ON lower(trim(jobs.source)) = lower(trim(f.source)) WHERE trim(coalesce(posted, '')) <> ''),
k AS (SELECT *, regexp_extract(p, '^(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})([T ,].*)?$', ['y', 'm', 'd', 'r']) AS a, regexp_extract(p, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})(T.*)?$', ['y', 'm', 'd', 'r']) AS b,
 regexp_extract(p, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[-/.](\\d{{4}}|\\d{{2}})( .*)?$', ['u', 'v', 'w', 'r']) AS c, regexp_extract(p, '^(\\p{{L}}+)\\.? (\\d{{1,2}}), (\\d{{4}})( .*)?$', ['m', 'd', 'y', 'r']) AS e, regexp_extract(p, '^(?:\\p{{L}}+, )?(\\d{{1,2}})\\.? (\\p{{L}}+)\\.? (\\d{{4}})([ ,].*)?$', ['d', 'm', 'y', 'r']) AS g FROM j),
l AS (SELECT url, p, tz_name, CASE WHEN a.y <> '' THEN try_cast(a.y AS INT) WHEN b.y <> '' THEN try_cast(b.y AS INT) WHEN e.y <> '' THEN try_cast(e.y AS INT) WHEN g.y <> '' THEN try_cast(g.y AS INT) WHEN c.u <> '' THEN CASE WHEN length(c.w) = 4 THEN CASE WHEN o <> 'ymd' THEN try_cast(c.w AS INT) END WHEN o = 'ymd' THEN 2000 + try_cast(c.u AS INT) ELSE CASE WHEN try_cast(c.w AS INT) < 70 THEN 2000 ELSE 1900 END + try_cast(c.w AS INT) END END AS y,
 CASE WHEN a.y <> '' THEN try_cast(a.m AS INT) WHEN b.y <> '' THEN try_cast(b.m AS INT) WHEN e.y <> '' THEN {_MAP(_MONTHS)}[lower(e.m[1:3])] WHEN g.y <> '' THEN {_MAP(_MONTHS)}[lower(g.m[1:3])] WHEN c.u <> '' THEN try_cast(CASE WHEN o = 'mdy' THEN c.u ELSE c.v END AS INT) END AS m,
 CASE WHEN a.y <> '' THEN try_cast(a.d AS INT) WHEN b.y <> '' THEN try_cast(b.d AS INT) WHEN e.y <> '' THEN try_cast(e.d AS INT) WHEN g.y <> '' THEN try_cast(g.d AS INT) WHEN c.u <> '' THEN try_cast(CASE WHEN o = 'mdy' THEN c.v WHEN o = 'ymd' THEN c.w ELSE c.u END AS INT) END AS d,
 CASE WHEN a.y <> '' THEN a.r WHEN b.y <> '' THEN b.r WHEN e.y <> '' THEN e.r WHEN g.y <> '' THEN g.r WHEN c.u <> '' THEN c.r END AS r FROM k),
t AS (SELECT *, try(make_date(y, m, d)) AS day, regexp_extract(coalesce(r, ''), '(\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?(?:[.,](\\d{{1,6}}))?', ['h', 'i', 's', 'f']) AS c, regexp_extract(coalesce(r, ''), '^T(\\d{{2}})(\\d{{2}})(\\d{{2}})', ['h', 'i', 's']) AS n, lower(regexp_extract(coalesce(r, ''), '{_MERIDIEM}', 2)) AS ap,
 regexp_extract(coalesce(r, ''), ':\\d{{2}}(?:[.,]\\d+)? ?([+-])(\\d{{2}}):?(\\d{{2}})$', ['g', 'h', 'i']) AS off, regexp_extract(coalesce(r, ''), '([A-Z][A-Za-z]+/[A-Za-z_]+)', 1) AS reg, lower(regexp_extract(regexp_replace(coalesce(r, ''), '[AaPp][Mm]|Uhr', ' ', 'g'), '([A-Z]{{1,5}})\\]?$', 1)) AS ab FROM l),
w AS (SELECT *, epoch_us(day::TIMESTAMP) + 1000000::BIGINT * (3600 * (CASE WHEN n.h <> '' THEN try_cast(n.h AS INT) WHEN c.h = '' THEN 0 WHEN ap = 'p' THEN try_cast(c.h AS INT) % 12 + 12 WHEN ap = 'a' THEN try_cast(c.h AS INT) % 12 ELSE try_cast(c.h AS INT) END) + 60 * coalesce(try_cast(CASE WHEN n.h <> '' THEN n.i ELSE c.i END AS INT), 0) + coalesce(try_cast(CASE WHEN n.h <> '' THEN n.s ELSE c.s END AS INT), 0)) + coalesce(try_cast(rpad(nullif(c.f, ''), 6, '0') AS BIGINT), 0) AS us FROM t WHERE day IS NOT NULL),
z AS (SELECT url, us, CASE WHEN off.g <> '' THEN (try_cast(off.h AS INT) * 60 + try_cast(off.i AS INT)) * CASE off.g WHEN '-' THEN -1 ELSE 1 END WHEN ab <> '' AND reg = '' THEN {_MAP(_ZONES)}[ab] END AS minutes, CASE WHEN reg <> '' THEN reg ELSE tz_name END AS tz FROM w),
i AS (SELECT url, us, minutes, tz, epoch_us(timezone(tz, make_timestamp(us))) AS one FROM z)
SELECT DISTINCT url, CASE WHEN minutes IS NOT NULL THEN us - minutes::BIGINT * 60000000 WHEN epoch_us(timezone(tz, make_timestamptz(one - 3600000000))) = us THEN one - 3600000000 ELSE one END AS posted_us FROM i
UNION SELECT url, p::BIGINT * CASE length(p) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END FROM j WHERE regexp_matches(p, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$')"""
_N = "(?:\\d{{1,3}}(?:[ \\x{{00A0}}\\x{{202F}}]\\d{{3}})+|\\d+(?:[.,''’]\\d+)*)"
_UNIT = " ?(k|tsd|thousand|mio|mn|million|millions|m|lakhs?|lacs?|lac|l(?:pa)?|crores?|cr|万)"
_GAP = "(?:[^0-9]{{0,6}}(?:-|–|—|~|〜|～| to | bis )[^0-9]{{0,6}})"


def _amount(x: str, unit: str) -> str:
    """A numeral with its prefix in dollars of whatever currency."""
    t = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    plain = f"""CASE WHEN contains({t}, '.') AND contains({t}, ',') THEN CASE WHEN strpos(reverse({t}), '.') < strpos(reverse({t}), ',') THEN replace({t}, ',', '') ELSE replace(replace({t}, '.', ''), ',', '.') END
 WHEN regexp_matches({t}, '^\\d+[.]\\d{{3}}$') AND {unit} IN ('m', 'mn', 'mio', 'million', 'millions') THEN {t} WHEN regexp_matches({t}, '[.,]\\d{{3}}$') OR len(regexp_extract_all({t}, '[.,]')) > 1 THEN regexp_replace({t}, '[.,]', '', 'g') ELSE replace({t}, ',', '.') END"""
    factor = f"CASE WHEN {unit} IN ('k', 'tsd', 'thousand') THEN 1e3 WHEN {unit} IN ('m', 'mn', 'mio', 'million', 'millions') THEN 1e6 WHEN regexp_matches({unit}, '^(l|lpa|lac|lacs|lakh|lakhs)$') THEN 1e5 WHEN {unit} LIKE 'cr%' THEN 1e7 WHEN {unit} = '万' THEN 1e4 ELSE 1 END"
    return f"try_cast({plain} AS DOUBLE) * {factor}"


# pay by expressions of its own: one or two numerals with a prefix, a currency and a period by their words
_P5 = f"""WITH j AS (SELECT DISTINCT url, lower(trim(nfc_normalize(salary))) AS s, f.currency AS fc, nullif(upper(trim(coalesce(salary_currency, ''))), '') AS sc, nullif(lower(trim(coalesce(salary_period, ''))), '') AS sp FROM jobs LEFT JOIN feeds f ON lower(trim(jobs.source)) = lower(trim(f.source)) WHERE regexp_matches(coalesce(salary, ''), '[0-9]')),
k AS (SELECT *, regexp_extract(s, '({_N})(?:{_UNIT})?', ['n', 'u']) AS a, regexp_extract(s, '({_N})(?:{_UNIT}(?:[^a-z]|$))?(?:[^0-9]*?){_GAP}({_N})(?:{_UNIT}(?:[^a-z]|pa|$))?', ['n', 'u', 'n2', 'u2']) AS r FROM j WHERE NOT regexp_matches(s, 'match|bonuses|yrs\\)|401\\(k')),
l AS (SELECT *, regexp_extract(s, '{_N}{_UNIT}(?:[^a-z]|pa\\b|$)', 1) AS u1 FROM k),
m AS (SELECT *, CASE WHEN r.n2 <> '' THEN {_amount('r.n', 'r.u')} ELSE {_amount('a.n', 'u1')} END AS lo0, CASE WHEN r.n2 <> '' THEN {_amount('r.n2', 'r.u2')} END AS hi0, CASE WHEN r.n2 <> '' AND r.u = '' AND r.u2 <> '' THEN {_amount('r.n', 'r.u2')} END AS lo1, {_amount('r.n2', "''")} AS bare2, {_amount('r.n', "''")} AS bare1 FROM l),
n AS (SELECT url, s, fc, sc, sp, CASE WHEN lo1 IS NOT NULL AND bare1 <= bare2 THEN lo1 ELSE lo0 END AS x, coalesce(hi0, lo0) AS y FROM m),
o AS (SELECT url, CASE WHEN least(x, y) > 0 THEN least(x, y) ELSE greatest(x, y) END AS lo, greatest(x, y) AS hi,
 CASE WHEN regexp_matches(s, 'us\\$|usd|us dollar') THEN 'USD' WHEN regexp_matches(s, 'ca?\\$|cad|cdn') THEN 'CAD' WHEN regexp_matches(s, 'au?\\$|aud') THEN 'AUD' WHEN regexp_matches(s, '€|eur') THEN 'EUR' WHEN regexp_matches(s, '£|gbp|pound') THEN 'GBP' WHEN regexp_matches(s, 'chf|sfr') THEN 'CHF' WHEN regexp_matches(s, '¥|円|jpy|yen') THEN 'JPY' WHEN regexp_matches(s, '₹|inr|\\brs|rupee') THEN 'INR' WHEN regexp_matches(s, '\\$|dollar') THEN CASE WHEN fc IN ('USD', 'CAD', 'AUD') THEN fc ELSE 'USD' END WHEN regexp_matches(s, '[0-9] ?(l|lpa|lac|lakh|cr|crore)') THEN 'INR' ELSE coalesce(sc, fc) END AS cur,
 coalesce(CASE WHEN regexp_matches(s, 'fortnight|bi-?weekly|two weeks|2 weeks|other week|zwei wochen') THEN 'fortnight' WHEN regexp_matches(s, 'hour|/ ?h|\\bhr|p/h|\\bph\\b|stunde|std|stündlich|時給') THEN 'hour' WHEN regexp_matches(s, 'week|/wk|\\bpw\\b|p\\.w|woche|wöchentlich') THEN 'week' WHEN regexp_matches(s, 'month|/mo|pcm|p\\.m|monat|mtl|月') THEN 'month' WHEN regexp_matches(s, '\\bday|/day|daily|diem|tag|täglich|日給') THEN 'day' WHEN regexp_matches(s, 'year|/yr|\\byr|annum|annual|\\bpa\\b|lpa|p\\. ?a|jahr|jährlich|年') THEN 'year' END, sp, CASE WHEN CASE WHEN least(x, y) > 0 THEN least(x, y) ELSE greatest(x, y) END >= 15000 THEN 'year' END) AS per FROM n WHERE greatest(x, y) > 0)
SELECT DISTINCT url, CAST(floor(round(lo * p.factor * c.factor, 6) + 0.5) AS BIGINT) AS usd_year_min, CAST(floor(round(hi * p.factor * c.factor, 6) + 0.5) AS BIGINT) AS usd_year_max FROM o JOIN pay_units p ON p.unit_kind = 'period' AND p.unit_code = per JOIN pay_units c ON c.unit_kind = 'currency' AND c.unit_code = cur"""
_P5 = _P5.replace("{{", "{").replace("}}", "}")
ORACLES = {
    "p3_found": _P3,
    "p5_found": _P5,
    "p2_found": f"{_P2} SELECT dataset, snapshot_no, rec_key, change_kind FROM {_BOTH}",
    "p2_change_counts": f"{_P2} SELECT dataset, snapshot_no, change_kind, count(*) AS n FROM {_BOTH} GROUP BY ALL",
}
