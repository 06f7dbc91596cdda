"""Timestamps in mixed formats and zones as UTC instants (problem 3).

Each text becomes a shape mask of character classes (digits 9, letter runs A). A distinct mask is turned into a parser
once; all values of the mask are then cut and converted as columns, zones through transition tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.zones import ZoneTables, zone_bytes

# Month names, weekdays, meridiem marks and filler words in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier febrero",
    3: "march mar märz maerz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonntag"
MERIDIEM = {"am": 0, "pm": 12}
FILLERS = "at um uhr h hrs the of st nd rd th de le"
# Zone abbreviations, in minutes east of Greenwich; the feed's own zone comes first where it knows one.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "brt": -180, "art": -180, "bst": 60, "west": 60, "cet": 60, "cest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "ict": 420, "wib": 420, "sgt": 480, "hkt": 480, "awst": 480,
    "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_MONTH = {w: n for n, ws in MONTHS.items() for w in ws.split()}
_WEEKDAY, _FILLER = set(WEEKDAYS.split()), set(FILLERS.split())
#: Longer texts are no timestamps; they stay in the result as unreadable, without a mask of their own.
MAX_LENGTH = 64
_LETTERS = r"\p{L}+"


def shape_mask(c: Column) -> Column:
    """The character-class shape of a text: every digit 9, every run of letters A, other characters as they are."""
    return F.when(F.length(c) <= MAX_LENGTH, F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "A"), r"[0-9]", "9"))


# The grammar, over one sign per token: a..s a run of 1..19 digits, M month, W weekday, P am or pm, T, Z abbreviation,
# F filler, U another word; all else itself.
_DATES = [
    r"(?P<y>d)(?P<s>[-/.])(?P<m>[ab])(?P=s)(?P<d>[ab])",
    r"(?P<p1>[ab])(?P<s>[-/.])(?P<p2>[ab])(?P=s)(?P<p3>[bd])",
    r"(?:W[.,]* ?)?(?P<mon>M)[. ]+(?P<d>[ab])F?,? +(?P<y>d)",
    r"(?:W[.,]* ?)?(?P<d>[ab])F?\.?[ -](?:F )?(?P<mon>M)\.?,?[ -](?:F )?(?P<y>d)",
    r"(?P<ymd>h)",
]
_TIME = r"(?:(?:T|,? F |, | +|,)(?P<hh>[ab]):(?P<mi>b)(?::(?P<ss>b)(?:[.,](?P<fr>[a-i]))?)?(?: ?(?P<pm>P))?(?: F)?|[T ](?P<hms>f)|[T ](?P<hm>d))?"
_ZONE = r"(?: ?(?P<z>Z)| ?\[(?P<zb>Z)\]| ?\(Z\)| ?(?:Z)?(?P<sg>[+-])(?:(?P<oh>b):?(?P<om>b)|(?P<ohm>d)|(?P<o1>[ab]))(?: \(Z\))?| ?\[?(?P<reg>[U](?:[/_-][UZTFM])+)\]?)?"
_FORMS = [re.compile("^" + d + _TIME + _ZONE + "$") for d in _DATES]
_EPOCH = {"j": 1_000_000, "m": 1_000, "p": 1}  # 10, 13 or 16 digits


def _role(word: str) -> str:
    w = word.lower()
    if w == "t":
        return "T"
    for role, known in (("P", MERIDIEM), ("M", _MONTH), ("W", _WEEKDAY), ("Z", ABBREVIATIONS), ("F", _FILLER)):
        if w in known:
            return role
    return "U"


@lru_cache(maxsize=65536)
def _tokens(mask: str) -> tuple[str, ...]:
    return tuple(re.findall(r"9+|A|[^9A]", mask))


@lru_cache(maxsize=65536)
def parser_for(mask: str, roles: str, order: str) -> dict | None:
    """Field -> token position, for a mask whose letter runs have these roles; None if it names no calendar day."""
    tokens, role = _tokens(mask), iter(roles)
    sign = "".join(chr(96 + len(t)) if t[0] == "9" and len(t) < 20 else next(role) if t == "A" else t if t[0] != "9" else "?" for t in tokens)
    if len(sign) != len(tokens):
        return None
    if sign in _EPOCH:
        return {"epoch": _EPOCH[sign]}
    for form in _FORMS:
        if not (m := form.match(sign)):
            continue
        plan = {k: m.start(k) for k, v in m.groupdict().items() if v is not None and k != "reg"}
        if m["reg"]:
            plan["reg"] = tuple(range(*m.span("reg")))
        if "sg" in plan:
            plan["sg"] = m["sg"]
        if "p1" in plan:
            p = [plan.pop(k) for k in ("p1", "p2", "p3")]
            long_year = sign[p[2]] == "d"
            if order == "ymd":
                if long_year:
                    return None
                plan |= {"y": p[0], "m": p[1], "d": p[2]}
            else:
                d, mth = (p[0], p[1]) if order == "dmy" else (p[1], p[0])
                plan |= {"d": d, "m": mth, "y": p[2]}
        return plan
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which of them exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    real = (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (y >= 1)
    yy = y - (m <= 2)
    era = np.floor_divide(yy, 400)
    yoe = yy - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468, real


def _convert(cols: list, plan: dict, zones: ZoneTables, feed_zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, ok) for the rows of one parser. cols: a string array per token, None for separators."""
    n = len(feed_zone)
    number = lambda k: pc.cast(cols[plan[k]], pa.int64()).to_numpy(zero_copy_only=False)
    if "epoch" in plan:
        return pc.cast(cols[0], pa.int64()).to_numpy(zero_copy_only=False) * plan["epoch"], np.ones(n, bool)
    words = lambda k: [w.lower() for w in cols[plan[k]].to_pylist()]
    if "ymd" in plan:
        v = number("ymd")
        y, m, d = v // 10000, v // 100 % 100, v % 100
    else:
        y, d = number("y"), number("d")
        m = number("m") if "m" in plan else np.array([_MONTH[w] for w in words("mon")])
        y = np.where(y < 100, np.where(y < 70, 2000, 1900) + y, y)
    days, ok = _days(y, m, d)
    h = mi = s = us = np.zeros(n, np.int64)
    if "hh" in plan:
        h, mi = number("hh"), number("mi")
        s = number("ss") if "ss" in plan else s
        if "fr" in plan:
            us = pc.cast(pc.utf8_slice_codeunits(pc.utf8_rpad(cols[plan["fr"]], 6, "0"), 0, 6), pa.int64()).to_numpy(zero_copy_only=False)
        if "pm" in plan:
            ok &= (h >= 1) & (h <= 12)
            h = h % 12 + np.array([MERIDIEM[w] for w in words("pm")])
    elif "hms" in plan:
        v = number("hms")
        h, mi, s = v // 10000, v // 100 % 100, v % 100
    elif "hm" in plan:
        v = number("hm")
        h, mi = v // 100, v % 100
    ok &= (h < 24) & (mi < 60) & (s < 61)
    local = days * 86400 + h * 3600 + mi * 60 + s
    offset = np.zeros(n, np.int64)
    if "sg" in plan:
        if "ohm" in plan:
            v = number("ohm")
            offset = v // 100 * 3600 + v % 100 * 60
        else:
            offset = number("oh" if "oh" in plan else "o1") * 3600 + (number("om") * 60 if "om" in plan else 0)
        offset = -offset if plan["sg"] == "-" else offset
    elif "z" in plan or "zb" in plan:
        named = words("z" if "z" in plan else "zb")
        for key in set(zip(named, feed_zone)):
            own = zones.get(key[1] or "")
            known = {a.lower(): o for a, o in own.abbreviations.items()} if own else {}
            value = known.get(key[0], ABBREVIATIONS[key[0]] * 60)
            offset[[k == key for k in zip(named, feed_zone)]] = value
    else:
        if "reg" in plan:
            parts = [cols[i].to_pylist() if cols[i] is not None else None for i in plan["reg"]]
            seps = plan["reg_text"]
            names = np.array(["".join(p[r] if p is not None else q for p, q in zip(parts, seps)) for r in range(n)], dtype=object)
        else:
            names = feed_zone
        for name in set(names):
            at = np.array([x == name for x in names])
            if zone := zones.get(name or ""):
                offset[at] = zone.offset_of_local(local[at])
            else:
                ok[at] = False
    return (local - offset) * 1_000_000 + us, ok


def _normaliser(version: str, raw: dict[str, bytes]):
    def run(batches):
        zones = ZoneTables(raw)
        for batch in batches:
            n = batch.num_rows
            text, mask = batch.column("__text"), batch.column("__mask")
            order = np.array(batch.column("__order").to_pylist(), dtype=object)
            feed = np.array(batch.column("__zone").to_pylist(), dtype=object)
            out, good = np.zeros(n, np.int64), np.zeros(n, bool)
            masks = pc.dictionary_encode(pc.fill_null(mask, ""))
            code = masks.indices.to_numpy(zero_copy_only=False)
            for k, shape in enumerate(masks.dictionary.to_pylist()):
                tokens = _tokens(shape)
                if not tokens or len(tokens) > 40 or not any(t[0] == "9" for t in tokens):
                    continue
                rows = np.nonzero(code == k)[0]
                values = text.take(pa.array(rows))
                pattern = "^" + "".join(rf"(?P<t{i}>[0-9]{{{len(t)}}})" if t[0] == "9" else rf"(?P<t{i}>\pL+)" if t == "A" else re.escape(t) for i, t in enumerate(tokens)) + "$"
                cut = pc.extract_regex(values, pattern)
                if cut.null_count:  # only the values that their own mask doesn't fit are unreadable
                    fits = cut.is_valid()
                    rows, cut = rows[fits.to_numpy(zero_copy_only=False)], cut.filter(fits)
                    if not len(rows):
                        continue
                cols = [pc.struct_field(cut, f"t{i}") if t[0] in "9A" else None for i, t in enumerate(tokens)]
                letters = [c.to_pylist() for c, t in zip(cols, tokens) if t == "A"]
                role_of = {w: _role(w) for ws in letters for w in set(ws)}
                roles = ["".join(role_of[w] for w in ws) for ws in zip(*letters)] if letters else [""] * len(rows)
                keys = list(zip(roles, order[rows]))
                for key in set(keys):
                    plan = parser_for(shape, key[0], key[1] or "")
                    if plan is None:
                        continue
                    at = np.array([i for i, x in enumerate(keys) if x == key])
                    if "reg" in plan:
                        plan = plan | {"reg_text": [tokens[i] for i in plan["reg"]]}
                    some = pa.array(at)
                    us, ok = _convert([c.take(some) if c is not None else None for c in cols], plan, zones, feed[rows[at]])
                    out[rows[at]], good[rows[at]] = us, ok
            keep = [batch.column(i) for i, f in enumerate(batch.schema) if not f.name.startswith("__")]
            names = [f.name for f in batch.schema if not f.name.startswith("__")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, mask=~good)], names=[*names, "utc_us"])

    run.version = version
    return run


def normalise_timestamps(df: DataFrame, text: str, zone: str, order: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and utc_us: microseconds since 1970 UTC, NULL for texts that name no real calendar day.

    `zone` and `order` (dmy, mdy or ymd) are columns that say how to read values without them. Handles NULL, blank and
    very long texts (NULL), unknown zones (NULL for values that need them). One pass, no shuffle; clashing column names
    do not matter, as only `keep` passes through.
    """
    version, raw = zone_bytes()
    trimmed = F.regexp_replace(F.col(text), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    source = df.select(*keep, F.when(F.length(trimmed) <= MAX_LENGTH, trimmed).alias("__text"), shape_mask(trimmed).alias("__mask"), F.col(zone).alias("__zone"), F.lower(F.trim(F.col(order))).alias("__order"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if not f.name.startswith("__")) + ", utc_us bigint"
    return source.mapInArrow(_normaliser(version, raw), schema)


def posted_instants(jobs: DataFrame, feeds: DataFrame) -> DataFrame:
    """(url, posted_us) of every readable jobs.posted, once each."""
    f = feeds.select(F.lower(F.trim("source")).alias("__feed"), F.col("tz_name").alias("__tz"), F.col("date_order").alias("__do"))
    rows = jobs.select("url", "posted", F.lower(F.trim("source")).alias("__feed")).join(f, "__feed", "left")
    got = normalise_timestamps(rows, "posted", "__tz", "__do", ["url"])
    return got.where("utc_us IS NOT NULL").select("url", F.col("utc_us").alias("posted_us")).distinct()
