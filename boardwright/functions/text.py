"""Text expressions: keys, term patterns, markup removal and the few Arrow functions that have no built-in."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A plural ending is allowed after words from this length on.
MIN_PLURAL = 4
# Named entities that plain text knows.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&#39;": "'", "&rsquo;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&ndash;": "–", "&mdash;": "—"}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_key(c: Column) -> Column:
    """Letters and digits in lower case, other runs one blank; NULL as blank."""
    return F.lower(F.trim(F.regexp_replace(text(c), r"[^\p{L}\p{N}]+", " ")))


def key_of(value: str | None) -> str:
    """norm_key on the driver, for query terms."""
    return " ".join(re.findall(r"[^\W_]+", value or "")).lower()


def term_pattern(term: str) -> str | None:
    """A pattern over lower-cased text: the words in order, parted by blanks or hyphens, with an optional plural ending."""
    words = key_of(term).split()
    if not words:
        return None
    plural = "(?:s|es)?" if len(words[-1]) >= MIN_PLURAL else ""
    return r"\b" + r"[\s-]+".join(words) + plural + r"\b"


def term_hits(term: str, lowered: Column) -> Column:
    """Occurrences that don't overlap. The literal test guards the regex: CASE evaluates it only where the word occurs."""
    pattern = term_pattern(term)
    if pattern is None:
        return F.lit(0)
    gate = key_of(term).split()[0]
    return F.when(F.contains(lowered, F.lit(gate)), F.regexp_count(lowered, F.lit(pattern))).otherwise(F.lit(0))


def has_term(term: str, lowered: Column) -> Column:
    return term_hits(term, lowered) > 0


def html_plain(c: Column) -> Column:
    """Markup out, block ends as line breaks, nine entities, bold and heading marks removed, blanks collapsed.

    Fixed values: the patterns, which decide what plain text is, and their order.
    """
    t = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(li|p|div|h[1-6]|tr|ul|ol)\s*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    for entity, plain in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*([^*\n]+)\*\*", "$1"), r"(?m)^#{1,4}\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n+", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def html_plain_text(c: Column, entities: bool = True) -> Column:
    """Display text: scripts, tags and a tag cut off at the end as blanks, all entities decoded, white space collapsed."""
    t = F.regexp_replace(text(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"</?[a-zA-Z][^>]*$", " ")
    # only texts with an ampersand go through Python; the others pass it as NULL
    t = F.coalesce(unescape(F.when(F.contains(t, F.lit("&")), t)), t) if entities else t
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without combining marks."""

    def one(x):
        if not isinstance(x, str) or x.isascii():
            return x.lower() if isinstance(x, str) else x
        return "".join(ch for ch in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(ch))

    return s.map(one)


def bullets(body: Column, title: Column) -> Column:
    """Sentences worth a bullet: at least 24 characters, not the title again, at most a quarter digits; the first 20."""
    t = F.lower(F.trim(text(title)))
    parts = F.transform(F.split(text(body), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(F.trim(s), r"\s+", " "))

    def keep(s):
        low = F.lower(s)
        digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
        return (F.length(s) >= 24) & ~((low == t) | F.startswith(low, F.concat(t, F.lit("."))) | F.startswith(low, F.concat(t, F.lit(" ")))) & (digits <= F.length(s) * 0.25)

    return F.slice(F.filter(parts, keep), 1, 20)


_VOWEL = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWEL and not (c == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# The suffix tables of the published Porter algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    """The Porter stem of a lower-case word (Porter 1980)."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted((p.split(":") for p in table.split()), key=lambda p: -len(p[0])):
            if w.endswith(pair[0]):
                if _measure(w[: -len(pair[0])]) > 0:
                    w = w[: -len(pair[0])] + pair[1]
                break
    for s in sorted([*_STEP4.split(), "ion"], key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(s: pd.Series) -> pd.Series:
    return s.map(lambda x: porter(x) if isinstance(x, str) else x)
