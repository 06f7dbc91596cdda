"""Quantities with prefixes, units and exponents in text, brought to common units (problem 5).

A text is cut into numbers and the unit strings between them. Each unit string is segmented by dynamic programming over
tries of prefixes (k, lakh, million), roots (currencies, periods) and exponent marks (per, /, a), and the cheapest
decomposition wins; priors of the field say which dimension is likely next, so `m` is a million after a number and a month
after `per`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings by meaning. Prefixes multiply, roots name a currency or the period a pay is for, marks say "per".
PREFIXES = {
    1e3: "k | thousand | tsd | tausend | grand",
    1e6: "m | mm | mn | mio | million | millions | mil",
    1e5: "l | lac | lacs | lakh | lakhs",
    1e7: "cr | crore | crores",
    1e4: "万 | man",
}
#: Lakh and crore count rupees where no currency is named.
RUPEE_PREFIXES = (1e5, 1e7)
CURRENCIES = {
    "USD": "usd | us$ | us dollars | us dollar | u.s. dollars",
    "EUR": "eur | € | euro | euros",
    "GBP": "gbp | £ | pounds | pound",
    "CAD": "cad | c$ | ca$ | cdn$ | can$ | cdn",
    "AUD": "aud | a$ | au$",
    "CHF": "chf | sfr | fr.",
    "INR": "inr | ₹ | rs | rs. | rupees | rupee",
    "JPY": "jpy | ¥ | 円 | yen",
    "$": "$ | dollars | dollar",
}
PERIODS = {
    "year": "year | years | yr | yearly | annum | annual | annually | pa | p.a. | p.a | p. a. | p. a | jahr | jährlich | im jahr | 年収 | 年俸 | 年 | an | año | anual | annuel",
    "month": "month | mo | mo. | mth | monthly | pcm | p.c.m. | pm | p.m. | monat | monatlich | mtl | mtl. | im monat | 月給 | 月 | mois | mes | mensual | m",
    "fortnight": "fortnight | fortnightly | biweekly | bi-weekly | two weeks | every two weeks | every other week | zwei wochen | alle zwei wochen | 14 tage",
    "week": "week | wk | weekly | pw | p.w. | p/w | woche | wöchentlich | die woche | 週給 | w",
    "day": "day | daily | per diem | diem | pd | p/d | day rate | tag | tagessatz | täglich | am tag | 日給 | d",
    "hour": "hour | hours | hr | hrs | h | hourly | ph | p/h | p.h. | stunde | std | std. | stündlich | die stunde | 時給",
}
EXPONENTS = "per | / | a | an | pro | each | every | je | in der | im | p. | p | par | por"
CONNECTORS = "- | – | — | ~ | 〜 | ～ | to | bis | and | und | à"
QUALIFIERS = (
    "from | up to | upto | circa | ca | ca. | approx | approx. | approximately | about | around | base | base salary | salary | pay | wage | rate | compensation | comp | package | ab | bis zu | starting | starting at"
    " | starts at | min | min. | max | max. | minimum | maximum | ote | gross | net | brutto | netto | doe | plus | bonus | equity | benefits | + | & | commission | depending on experience | dependent on experience"
    " | ( | ) | [ | ] | : | , | ; | . | * | | | • | gehalt | einstiegsgehalt | vb | competitive | negotiable | vhb | zzgl | zzgl. | inkl | inkl. | super | + super | guaranteed | range | pay range | salary range | total | fixed | the | of | at | is | plus bonus | plus benefits"
)
#: Retirement-plan names look like money and aren't; a plain 401k with a currency before it is.
NOT_PAY = re.compile(r"401\s?\(k\)|(?<![$€£¥₹\d.,])401\s?k(?=\s*(?:match|plan|with|retirement|contribution|benefit|vesting|\+|$))")

# Cost of a piece, and how it changes with the dimension before it.
_COST = {"prefix": 1.0, "currency": 0.6, "period": 1.0, "per": 0.8, "link": 0.5, "word": 0.9, "unknown": 12.0}
_PRIOR = {
    ("number", "prefix"): -0.6, ("number", "currency"): -0.3, ("number", "period"): 0.4, ("number", "per"): 0.0, ("per", "period"): -0.8, ("per", "prefix"): 6.0, ("per", "per"): 1.0, ("per", "currency"): 3.0,
    ("start", "prefix"): 6.0, ("currency", "prefix"): 4.0, ("prefix", "prefix"): 6.0, ("prefix", "period"): -0.2, ("period", "prefix"): 6.0, ("word", "prefix"): 6.0, ("link", "prefix"): 6.0, ("period", "period"): 2.0,
}


def _spellings(text: str) -> list[str]:
    return [x.strip() or "|" for x in re.split(r" \| ", text)]


def _trie() -> dict:
    root: dict = {}

    def add(word, dim, value):
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((dim, value))

    for dim, known in (("prefix", PREFIXES), ("currency", CURRENCIES), ("period", PERIODS)):
        for value, words in known.items():
            for w in _spellings(words):
                add(w, dim, value)
    for dim, words in (("per", EXPONENTS), ("link", CONNECTORS), ("word", QUALIFIERS)):
        for w in _spellings(words):
            add(w, dim, w)
    return root


_TRIE = _trie()


def _is_word(ch: str) -> bool:
    return ch.isalpha() and ord(ch) < 0x2E80


def segment(unit: str, before: str) -> tuple[tuple[str, object], ...]:
    """The cheapest decomposition of a unit string into (dimension, value); `before` is number or start.

    A piece of letters may not end within a word, but after a prefix or a currency ("lpa", "kusd").
    """
    n = len(unit)
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][before] = (0.0, None)  # cost, and the pieces as a chain (before, piece)
    for i in range(n):
        here, best[i] = best[i], {}
        for last, (cost, done) in here.items():
            if unit[i].isspace():
                if last not in best[i + 1] or best[i + 1][last][0] > cost:
                    best[i + 1][last] = (cost, done)
                continue
            node, j = _TRIE, i
            while j < n and unit[j] in node:
                node = node[unit[j]]
                j += 1
                for dim, value in node.get("", ()):
                    inside = j < n and _is_word(unit[j - 1]) and _is_word(unit[j])
                    c = cost + _COST[dim] + _PRIOR.get((last, dim), 0.0) + (0 if not inside else 0.5 if dim in ("prefix", "currency") else 20)
                    if dim not in best[j] or best[j][dim][0] > c:
                        best[j][dim] = (c, (done, (dim, value)))
            k = i + 1
            while k < n and _is_word(unit[k]) and _is_word(unit[i]):
                k += 1
            c = cost + _COST["unknown"]
            if "unknown" not in best[k] or best[k]["unknown"][0] > c:
                best[k]["unknown"] = (c, (done, ("unknown", unit[i:k])))
    pieces, chain = [], min(best[n].values(), key=lambda x: x[0])[1] if best[n] else None
    while chain:
        chain, piece = chain
        pieces.append(piece)
    return tuple(reversed(pieces))


_short_segment = lru_cache(maxsize=100_000)(segment)


_NUMBER = re.compile(r"\d{1,3}(?:[    ]\d{3})+(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,'’]\d+)*")


def numeral(text: str, scaled_up: bool = False) -> float | None:
    """A number with any grouping: a mark before exactly three digits groups, but for one point under a million prefix."""
    t = re.sub(r"[\s   '’]", "", text)
    marks = re.findall(r"[.,]", t)
    if not marks:
        return float(t)
    tail = len(t) - max(t.rfind("."), t.rfind(",")) - 1
    if len(set(marks)) == 2 or tail != 3 or (scaled_up and len(marks) == 1 and marks[0] == "."):
        last = max(t.rfind("."), t.rfind(","))
        if len(set(marks)) == 1 and len(marks) > 1:
            return float(re.sub(r"[.,]", "", t))
        return float(re.sub(r"[.,]", "", t[:last]) + "." + t[last + 1 :])
    return float(re.sub(r"[.,]", "", t))


def parse_pay(text: str) -> tuple[float, float, str | None, str | None] | None:
    """(low, high, currency or $ or None, period or None) in the stated units; None without an amount above zero."""
    s = unicodedata.normalize("NFKC", text).lower().strip()
    s = NOT_PAY.sub(" # ", s)
    # a number word inside a period name is part of the unit
    s = re.sub(r"\bevery 2 weeks\b", "every two weeks", s)
    s = re.sub(r"\balle 2 wochen\b", "alle zwei wochen", s)
    spans = [m.span() for m in _NUMBER.finditer(s)]
    if not spans:
        return None
    gaps = [s[: spans[0][0]], *[s[a[1] : b[0]] for a, b in zip(spans, spans[1:])], s[spans[-1][1] :]]
    pieces = [(_short_segment if len(g) <= 200 else segment)(g, "number" if i else "start") for i, g in enumerate(gaps)]
    amounts: list[tuple[float, float | None, int]] = []
    for i, (a, b) in enumerate(spans):
        left, right = pieces[i], pieces[i + 1]
        if right and right[0][0] == "unknown" or (left and left[-1][0] == "unknown" and not s[:a].endswith(" ")):
            continue
        if len(right) > 1 and right[0] == ("word", "+") and right[1][0] == "unknown":
            continue
        prefix = right[0][1] if right and right[0][0] == "prefix" else next((v for d, v in right[:2] if d == "prefix"), None)
        value = numeral(s[a:b], prefix is not None and prefix >= 1e6)
        if value is not None and value < 2**53:  # a longer row of digits is no amount
            amounts.append((value, prefix, i))
    if not amounts:
        return None
    said = [p for ps in pieces for p in ps]
    if any(d == "unknown" for d, _ in said) and not any(d in ("currency", "period", "prefix") for d, _ in said):
        return None
    lo, lo_prefix, at = amounts[0]
    hi, hi_prefix = lo, lo_prefix
    if len(amounts) > 1 and amounts[1][2] == at + 1:
        between = pieces[at + 1]
        if any(d == "link" for d, _ in between) and not any(d == "unknown" for d, _ in between):
            hi, hi_prefix, _ = amounts[1]
            if lo_prefix is None and hi_prefix is not None and lo <= hi:
                lo_prefix = hi_prefix
    lo, hi = lo * (lo_prefix or 1), hi * (hi_prefix or 1)
    lo, hi = min(lo, hi), max(lo, hi)
    if lo <= 0:
        lo = hi
    if hi <= 0:
        return None
    currency = next((v for d, v in said if d == "currency"), None)
    if currency is None and any(d == "prefix" and v in RUPEE_PREFIXES for d, v in said):
        currency = "INR"
    period = next((v for d, v in said if d == "period"), None)
    return lo, hi, currency, period


_short_pay = lru_cache(maxsize=200_000)(parse_pay)


def _parse_batches(batches):
    for batch in batches:
        got = [(_short_pay if len(t) <= 200 else parse_pay)(t) if t else None for t in batch.column("__pay").to_pylist()]
        keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "__pay"]
        names = [f.name for f in batch.schema if f.name != "__pay"]
        col = lambda k, t: pa.array([g[k] if g else None for g in got], t)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([*keep, col(0, pa.float64()), col(1, pa.float64()), col(2, pa.string()), col(3, pa.string())], names=[*names, "low", "high", "currency", "period"])


#: Without any period, amounts from here on are yearly.
YEARLY_FROM = 15_000


def parse_quantities(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` and low, high, currency, period as the text states them; NULLs where it states no amount above zero.

    Handles NULL and blank texts (NULL); long texts are read whole. One pass without a shuffle.
    """
    src = df.select(*keep, F.col(text).alias("__pay"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__pay") + ", low double, high double, currency string, period string"
    return src.mapInArrow(_parse_batches, schema)


def yearly_pay(jobs: DataFrame, feeds: DataFrame, pay_units: DataFrame) -> DataFrame:
    """(url, usd_year_min, usd_year_max), whole US dollars, of every jobs.salary with an amount and a known period."""
    clean = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    f = feeds.select(F.lower(F.trim("source")).alias("__feed"), F.upper(F.trim("currency")).alias("__feed_currency"))
    rows = jobs.where("salary IS NOT NULL").select(
        "url", "salary", F.lower(F.trim("source")).alias("__feed"), F.upper(clean(F.col("salary_currency"))).alias("__said_currency"), F.lower(clean(F.col("salary_period"))).alias("__said_period")
    )
    got = parse_quantities(rows.join(f, "__feed", "left"), "salary", ["url", "__said_currency", "__said_period", "__feed_currency"]).where("low IS NOT NULL")
    dollar = F.when(F.col("__feed_currency").isin("USD", "CAD", "AUD"), F.col("__feed_currency")).otherwise("USD")
    got = got.select(
        "url", "low", "high",
        F.when(F.col("currency") == "$", dollar).otherwise(F.coalesce("currency", "__said_currency", "__feed_currency")).alias("cur"),
        F.coalesce("period", "__said_period", F.when(F.col("low") >= YEARLY_FROM, "year")).alias("per"),
    )
    unit = lambda kind, name: pay_units.where(F.col("unit_kind") == kind).select(F.col("unit_code").alias(name), F.col("factor").alias(f"{name}_factor"))
    usd = lambda c: F.floor(F.round(F.col(c) * F.col("per_factor") * F.col("cur_factor"), 6) + 0.5).cast("bigint")
    return got.join(unit("currency", "cur"), "cur").join(unit("period", "per"), "per").select("url", usd("low").alias("usd_year_min"), usd("high").alias("usd_year_max")).distinct()
