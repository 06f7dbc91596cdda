"""Column expressions of the surface: locations as read, display values, settings in and out, checks of extracted settings."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from boardwright.functions.text import norm_key, text
from boardwright.functions.vocab import STATES

#: How much of a location is read, and shown.
LOCATION_CHARS, SHOWN_CHARS = 120, 60
# Which group a tag of a card belongs to.
TAG_GROUPS = {"remote": ("remote", "hybrid", "onsite"), "seniority": ("entry", "mid", "senior", "executive"), "salary_band": ("under-50k", "50-80k", "80-120k", "120-180k", "180k-plus")}
# Points from which a board's fit reads as strong or good.
STRONG, GOOD = 100, 80
# The fields of a search's settings by kind.
LIST_FIELDS = ("titles", "related_titles", "boosts", "exclude", "rank_down")
SCALAR_FIELDS = ("location", "remote_only", "max_age_days", "min_score")
#: How long a logged title, company, place and other text may be.
LOG_CHARS = {"title": 120, "company": 80, "location": 60, "note": 200}


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    """Without combining marks, letters kept as they are."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) if isinstance(x, str) else x)


def _head(c: Column) -> Column:
    """The head of a location without accents; only texts with some go through Python."""
    h = F.substring(text(c), 1, LOCATION_CHARS)
    return F.coalesce(_bare(F.when(~h.rlike(r"^\p{ASCII}*$"), h)), h)


def location_tokens(c: Column) -> Column:
    """Lower-case words of a location's head between single blanks, with a blank at both ends; two blanks for none."""
    return F.concat(F.lit(" "), norm_key(_head(c)), F.lit(" "))


def comma_segments(c: Column) -> Column:
    """The parts of a location's head between commas, semicolons, slashes, bars and dashes with blanks, as words."""
    parts = F.transform(F.split(_head(c), r"[,;/|]|\s+-\s+"), norm_key)
    return F.filter(parts, lambda p: p != "")


def title_rung(parts: Column) -> Column:
    """The points of the title part of a receipt, 0 without one."""
    first = F.filter(parts, lambda p: p["label"].isin("title", "related title"))
    return F.coalesce(F.try_element_at(first, F.lit(1))["delta"], F.lit(0))


def clipped(name: str, kind: str) -> Column:
    return F.substring(text(F.col(name)), 1, LOG_CHARS[kind])


def fit_band(points: Column) -> Column:
    return F.when(points >= STRONG, "strong").when(points >= GOOD, "good").otherwise("fair")


def bar_width(points: Column, top: Column) -> Column:
    """Percent of the best score, between 3 and 100; 0 where there is no best score."""
    return F.when(top > 0, F.greatest(F.lit(3.0), F.least(F.lit(100.0), points / top * 100))).otherwise(0.0)


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 8.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most))


def tag_group(tag: Column) -> Column:
    """The facet that a tag belongs to; NULL for other tags."""
    out = None
    for group, tags in TAG_GROUPS.items():
        out = (F if out is None else out).when(tag.isin(*tags), group)
    return out


def shown_salary(c: Column) -> Column:
    """A range of two equal ends as one figure; other texts trimmed."""
    t = F.trim(text(c))
    low, high = (F.trim(F.regexp_extract(t, r"(?s)^(.+?)\s*[-–—]\s*(.+)$", k)) for k in (1, 2))
    return F.when((low != "") & (low == high), low).otherwise(t)


def shown_location(c: Column, tags: Column) -> Column:
    """A place fit for a card: the first clause without its county; of prose the work style among the tags; a dash for none."""
    first = F.trim(F.split(text(c), r"[.;|\n]")[0])
    cut = F.trim(F.regexp_replace(first, r"(?i),\s*[^,]*\bcounty\s*$", ""))
    place = F.when(cut == "", first).otherwise(cut)
    style = F.try_element_at(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(*TAG_GROUPS["remote"])), F.lit(1))
    names = F.when(style == "remote", "Remote").when(style == "hybrid", "Hybrid").when(style == "onsite", "On-site")
    prose = F.size(F.split(place, r"\s+")) > 8
    short = F.when(F.length(place) > SHOWN_CHARS, F.concat(F.substring(place, 1, SHOWN_CHARS - 3), F.lit("…"))).otherwise(place)
    return F.when(first == "", "—").when(prose, F.coalesce(names, F.lit("—"))).otherwise(short)


def least_pay(salary_min: Column, salary: Column) -> Column:
    """The stated least pay where it is above zero, else the first figure of the text, K for thousands; NULL for none."""
    s = text(salary)
    number = lambda c: F.try_to_number(F.replace(c, F.lit(","), F.lit("")), F.lit("999999999999.99")).cast("double")
    k = r"([\d,]+(?:\.\d+)?)\s*[kK]\b"
    hit = F.regexp_extract(s, k, 1)
    thousands = number(hit) * 1000
    before = F.regexp_extract(F.regexp_extract(s, r"(?s)^(.*?)" + k, 1), r"(?s)([\d,]+)(?!.*[\d,])", 1)
    lead = number(before)
    lead = F.when(lead < 1000, lead * 1000).otherwise(lead)
    figure = F.when(hit != "", F.least(thousands, lead)).otherwise(number(F.regexp_extract(s, r"\d[\d,]*", 0)))
    return F.when(salary_min > 0, salary_min).otherwise(F.when(figure > 0, figure))


def packed_settings(settings: Column) -> Column:
    """Settings (a struct or map) as the fragment of an address."""
    return F.concat(F.lit("#q="), F.regexp_replace(F.base64(F.encode(F.to_json(settings), "utf-8")), r"\s", ""))


def unpacked_settings(fragment: Column, schema: str) -> Column:
    """Settings of a fragment; NULL where it holds none."""
    code = F.regexp_extract(text(fragment), r"[#&]q=([^&]+)", 1)
    valid = code.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    return F.from_json(F.decode(F.try_to_binary(F.when(valid, code), F.lit("base64")), "utf-8"), schema)


def known_settings(settings: Column) -> Column:
    """A map of settings without keys that searches don't have."""
    return F.map_filter(settings, lambda k, _: k.isin(*LIST_FIELDS, *SCALAR_FIELDS))


def valid_settings(doc: Column) -> Column:
    """Whether a JSON text is an object of known settings, each of its kind, and not empty; NULL and broken texts are not."""
    v = F.try_parse_json(doc)
    keys = F.json_object_keys(doc)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    number = r"^(BIGINT|DOUBLE|DECIMAL.*|INT|SMALLINT|TINYINT|FLOAT)$"
    ok = F.coalesce(F.size(keys) > 0, F.lit(False)) & (F.size(F.array_except(keys, F.array(*map(F.lit, (*LIST_FIELDS, *SCALAR_FIELDS))))) == 0)
    tests = {**{k: r"^(ARRAY<.*>|STRING)$" for k in LIST_FIELDS}, "location": "^STRING$", "remote_only": "^BOOLEAN$", "max_age_days": number, "min_score": number[:-1] + r"|^STRING$|^BOOLEAN$"}
    for k, pattern in tests.items():
        ok = ok & (~F.array_contains(keys, k) | F.coalesce(kind(k).rlike(pattern), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def _words_by_code(c: Column) -> Column:
    """Words of a place with the names of states as their codes."""
    codes = F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (k, v.lower())])
    words = F.split(F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9 ]+", " ")), r"\s+")
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(codes, w), w))


def scalar_score(name: str, pred: Column, gold: Column) -> Column:
    """1.0 where an extracted scalar means what gold says: places by their words, states by code; a flag left out is a miss."""
    if name == "location":
        hit = _words_by_code(pred) == _words_by_code(gold)
    elif name == "remote_only":
        hit = pred.isNotNull() & (F.coalesce(pred, F.lit(False)) == F.coalesce(gold, F.lit(False)))
    elif name == "max_age_days":
        hit = pred.try_cast("bigint") == gold.try_cast("bigint")
    else:
        hit = F.lower(F.trim(pred.cast("string"))) == F.lower(F.trim(gold.cast("string")))
    return F.coalesce(hit, F.lit(False)).cast("double")


def unsupported_items(items: Column, transcript: Column) -> Column:
    """The items of which no word stands in the transcript: words under three letters whole, others by their first four."""
    clean = F.regexp_replace(F.lower(text(transcript)), r"[^a-z0-9 ]+", " ")
    padded = F.concat(F.lit(" "), clean, F.lit(" "))

    def said(w):
        return F.when(F.length(w) < 3, F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))).otherwise(F.contains(clean, F.left(w, F.lit(4))))

    words = lambda x: F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda w: w != "")
    return F.filter(items, lambda x: ~F.exists(words(x), said))


def string_list(c: Column) -> Column:
    """A JSON text as a list of texts; an empty list where it is none."""
    return F.coalesce(F.from_json(F.when(text(c).rlike(r"^\s*\["), c), "array<string>"), F.array().cast("array<string>"))


def lookup(table: Mapping[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def sorted_set(c: Column) -> Column:
    """The distinct items of a list in order, NULLs left out."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def some_errors(c: Column, most: int = 5) -> Column:
    """The first errors of a list, and how many more there are."""
    more = F.size(c) - most
    return F.when(more > 0, F.concat(F.slice(c, 1, most), F.array(F.format_string("… and %d more", more)))).otherwise(c)


def by_priority(choices: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for test, name in choices:
        out = (F if out is None else out).when(test, name)
    return out.otherwise(otherwise)
