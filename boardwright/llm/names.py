"""Variant spellings of employers' names, linked (problem 7).

Trie join: names are sharded by their words (with one letter deleted, so that a misspelt word still meets its shard), the
rest of each name goes into the shard's trie word by word, and a Damerau-Levenshtein automaton walks the trie to enumerate
the neighbours within a bounded distance, with the words of the rest in any order. Words that many employers share (trades,
given names, leading words) are mapped to one form and kept: neighbours whose shared words contradict each other aren't
linked, and what only one of them has weighs against them by its frequency in the data. Every name then points to its most
frequent neighbour, and pointers are followed to the spelling they end in.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.session import cut

# Legal forms, notes and joining words that don't tell employers apart.
LEGAL = set("inc llc ltd plc gmbh co corp corporation company limited incorporated ag sa se bv nv llp lp kg oy ab srl spa pty sarl kgaa mbh ohg pte holdings holding".split())
NOTES = set("careers jobs hq us usa uk emea global careers hiring team recruiting recruitment and und et y the of for".split())
# Kinds of business, with their abbreviations.
BUSINESS = {
    "construction": "const constr construct cnstr", "technologies": "technology tech techs techn technol", "laboratories": "laboratory lab labs", "university": "univ uni", "international": "intl int inter", "management": "mgt mgmt mngt manag", "development": "devt dev devel dvlpmt develop", "services": "service svc svcs serv",
    "pharmaceuticals": "pharmaceutical pharma pharm pharmac", "logistics": "logistic log logist logis", "insurance": "insur ins", "associates": "associate assoc assocs asso", "brothers": "brother bros bro", "group": "grp gr grupo groupe", "solutions": "solution soln solns sol", "transportation": "transport transp trans transpo",
    "manufacturing": "manufacturer mfg manuf manufg", "hospitality": "hosp hospty hospitlity hosplity hospit", "hospital": "hospitals hsptl hosp", "engineering": "engineers engg engrg eng engr engineer", "department": "dept dpt", "stores": "store strs", "systems": "system sys syst", "healthcare": "health hlthcare hlth care healthcr", "industries": "industry ind inds", "partners": "partner ptnrs",
    "enterprises": "enterprise ent entp", "consulting": "consultants consult", "bank": "banking", "energy": "energies", "foods": "food", "media": "", "school": "schools sch", "clinic": "clinics", "center": "centre ctr", "institute": "inst", "national": "natl", "american": "amer", "software": "sw", "financial": "fin financials", "communications": "comm comms", "electric": "elec",
}
# Words before a name, and given names with their short forms.
BEFORE = {"mount": "mt mnt", "saint": "st ste", "north": "n no nth", "south": "s so sth", "east": "e", "west": "w", "fort": "ft", "port": "pt", "new": "", "lake": "lk", "great": "grt", "upper": "", "lower": "", "old": ""}
GIVEN = {
    "alexander": "alex al lex sandy xander", "anthony": "tony ant", "charles": "charlie chuck chas", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie libby bess", "james": "jim jimmy jamie jas", "joseph": "joe joey jos", "katherine": "kate kathy katie kat kathryn catherine kay", "margaret": "peggy maggie meg marge greta",
    "michael": "mike mick mickey", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy thos", "william": "bill will billy willy wm liam", "john": "jack johnny jon", "patricia": "pat patty trish", "jennifer": "jen jenny", "david": "dave davey", "benjamin": "ben benny",
    "samuel": "sam sammy", "daniel": "dan danny", "andrew": "andy drew", "christopher": "chris kit", "nicholas": "nick nicky", "matthew": "matt", "steven": "steve", "peter": "pete", "gregory": "greg", "ronald": "ron", "kenneth": "ken", "lawrence": "larry", "frederick": "fred freddie", "henry": "harry hank", "george": "", "victoria": "vicky", "rebecca": "becky", "deborah": "debbie",
    "barbara": "barb", "dorothy": "dot dolly", "helen": "nell", "mary": "molly polly", "sarah": "sally", "anna": "ann anne annie", "walter": "walt", "albert": "bert", "philip": "phil", "timothy": "tim", "zachary": "zach", "raymond": "ray", "donald": "don", "eugene": "gene", "leonard": "leo len", "vincent": "vince", "martin": "marty", "arthur": "art",
}

#: What a word that many employers share may mean: (kind, full form), several where a short form is ambiguous.
_SHARED: dict[str, frozenset] = {}
for _kind, _table in (("trade", BUSINESS), ("before", BEFORE), ("given", GIVEN)):
    for _full, _short in _table.items():
        for _w in [_full, *_short.split()]:
            _SHARED[_w] = _SHARED.get(_w, frozenset()) | {(_kind, _full)}
_LONG_SHARED = [w for w in _SHARED if len(w) >= 6]

#: Edits in the shard's word and in the rest of a name.
WORD_EDITS, REST_EDITS = 1, 2
#: A shard of more names is sharded again by the next word, at last searched in several tasks for a part of the names each.
SHARD_NAMES, SALT_NAMES = 4_000, 2_000
#: Words of up to so many letters are found by deletions, longer ones by their unchanged beginning or end.
DELETION_LETTERS = 32
#: Share of the weight of two names that must be common to both where one of them has words that the other lacks.
COMMON = 2 / 3
#: Weights are bits of a word's frequency: names that stand behind the data, and how many of them have a shared word.
PRIOR_NAMES, PRIOR_SHARED = 1_000, 50
#: Word frequencies are kept in a sketch of two rows of so many counters, whatever the number of words.
SKETCH = 1 << 16


def _fold(text: str) -> list[str]:
    t = text.casefold().replace("'", "").replace("’", "")
    if not t.isascii():
        t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    return re.findall(r"[^\W_]+", re.sub(r"\((?:careers|jobs|hq|us|usa|uk|emea|global|hiring|[a-z]{2})\)", " ", t))


def _next_row(row: list[int], before: list[int] | None, i: int, ch: str, last: str, word: str, most: int) -> list[int] | None:
    """The state of the automaton after its i-th letter: distances to word[:j] for j from i - most on, most + 1 where larger;
    None where all are."""
    n, far = len(word), most + 1
    cur, least, left = [], far, far
    for k in range(2 * most + 1):
        j = i - most + k
        if j < 0 or j > n:
            v = far
        else:
            v = left + 1
            if k < 2 * most and row[k + 1] < v:  # row's places lie one to the right
                v = row[k + 1] + 1
            if j:
                d = row[k] + (word[j - 1] != ch)
                if d < v:
                    v = d
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == ch and before[k] + 1 < v:
                    v = before[k] + 1
            if v > far:
                v = far
            elif v < least:
                least = v
        cur.append(v)
        left = v
    return cur if least <= most else None


def _first_row(n: int, most: int) -> list[int]:
    return [j if 0 <= j <= n else most + 1 for j in range(-most, most + 1)]


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance, most + 1 where it is larger; only the band that can matter is computed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row, last = None, _first_row(len(b), most), ""
    for i, ch in enumerate(a, 1):
        new = _next_row(row, before, i, ch, last, b, most)
        if new is None:
            return most + 1
        before, row, last = row, new, ch
    return row[len(b) - len(a) + most]


@lru_cache(maxsize=200_000)
def meanings(word: str, misspelt: bool = False) -> frozenset:
    """What a shared word may mean, with `misspelt` also one with a typing error; empty for a word of the name's own."""
    if known := _SHARED.get(word):
        return known | ({("initial", word)} if len(word) == 1 else frozenset())
    if len(word) == 1:
        return frozenset({("initial", word)})
    if misspelt and len(word) >= 6:
        for w in _LONG_SHARED:
            k = 1 if len(w) < 8 else 2
            if abs(len(w) - len(word)) <= k and w[0] == word[0] and distance(word, w, k) <= k:
                return _SHARED[w]
    return frozenset()


@lru_cache(maxsize=300_000)
def name_form(name: str) -> str:
    """A name's own words and, after a tab, the words it shares with many, each in alphabetical order; blank without words.

    Legal forms and notes come off. A name without words of its own is compared by all its words.
    """
    words = [w for w in _fold(name) if w not in LEGAL and w not in NOTES] or _fold(name)
    own = [w for w in words if not meanings(w)]
    shared = [w for w in words if meanings(w)]
    # a word like a misspelt shared word is one only where two words of the name's own are left
    for w in [w for w in own if meanings(w, True)]:
        if len(own) > 2:
            own.remove(w)
            shared.append(w)
    if not own:
        own, shared = [min(full for _, full in meanings(w)) for w in shared], []
    return " ".join(sorted(own)) + "\t" + " ".join(sorted(shared)) if own else ""


def own_words(form: str) -> list[str]:
    return form.split("\t")[0].split(" ")


@lru_cache(maxsize=300_000)
def _shared_words(form: str) -> tuple[frozenset, ...]:
    return tuple(dict.fromkeys(meanings(w, True) for w in form.split("\t")[1].split()))


def _agree(a: frozenset, b: frozenset) -> bool:
    if a & b:
        return True
    first = lambda x, y: any(k == "initial" and any(g == "given" and full[0] == letter for g, full in y) for k, letter in x)
    return first(a, b) or first(b, a)


def missing_words(a: str, b: str) -> list[frozenset] | None:
    """The shared words that only one of two forms has; None if they contradict: each has one of a kind that the other lacks."""
    x, y = _shared_words(a), _shared_words(b)
    left = [m for m in x if not any(_agree(m, o) for o in y)]
    right = [m for m in y if not any(_agree(m, o) for o in x)]
    kinds = lambda ms: {"given" if k == "initial" else k for m in ms for k, _ in m}
    return None if kinds(left) & kinds(right) else left + right


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class Frequencies:
    """Bits of words by the number of names that have them, from a sketch of counts that never counts too few."""

    def __init__(self, counts: np.ndarray, names: int):
        self.counts, self.names = counts, names

    @staticmethod
    def places(word: str) -> tuple[int, int]:
        h = _hash(word) & (1 << 64) - 1
        return h % SKETCH, SKETCH + (h >> 32) % SKETCH

    def bits(self, word: str, prior: int = 1) -> float:
        i, j = self.places(word)
        return math.log2((self.names + PRIOR_NAMES) / (min(self.counts[i], self.counts[j]) + prior))


def _form_batches(batches):
    for batch in batches:
        forms = [name_form(n) if n else "" for n in batch.column("name").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"])


def with_form(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """`keep`, name and form: its own and its shared words; blank for NULL and names without letters."""
    src = df.select(*keep, F.col(name).alias("name"))
    return src.mapInArrow(_form_batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", form string")


def _sketch_batches(batches):
    counts = np.zeros(2 * SKETCH, np.int64)
    for batch in batches:
        for form in batch.column("form").to_pylist():
            own, shared = form.split("\t")
            for w in {*own.split(), *(full for m in _shared_words(form) for _, full in m)} if shared else set(own.split()):
                counts[list(Frequencies.places(w))] += 1
    at = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])


def frequencies(forms: DataFrame) -> Frequencies:
    """At most 2 * SKETCH counters come to the driver."""
    got = forms.select("form").mapInArrow(_sketch_batches, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SKETCH, np.int64)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Frequencies(counts, forms.count())


def _pieces(word: str, edits: int) -> set[str]:
    """Strings of which two words within `edits` edits have one in common."""
    if len(word) <= DELETION_LETTERS:
        out = edge = {word}
        for _ in range(edits if len(word) >= 4 else 0):
            edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
            out = out | edge
        return out
    # of edits + 1 stretches one is untouched, and it lies at most `edits` places from where it was
    out = {word}
    for n in range(len(word) - edits, len(word) + 1):
        step = n // (edits + 1) - 1
        for k in range(edits + 1):
            for at in range(max(0, k * (step + 1) - edits), k * (step + 1) + edits + 1):
                if at + step <= len(word):
                    out.add(f"{k}:{step}:{word[at : at + step]}")
    return out


def keys(words: list[str], edits: int, each: int) -> Iterator[tuple[int, str]]:
    """(word, piece): two sequences of words that differ by at most `edits` edits, `each` in one word, share a piece.

    Of more words than edits one stands unchanged in both, among the edits + 1 least by hash; of fewer, one has at most
    edits // words.
    """
    if len(set(words)) > edits:
        some = sorted(set(words), key=_hash)[: edits + 1]
        for w in some:
            yield words.index(w), w
    else:
        for i, w in enumerate(words):
            if w not in words[:i]:
                for piece in _pieces(w, min(each, edits // len(words))):
                    yield i, piece


def _edits(level: int, left: int) -> int:
    """Edits of a word that `keys` allows for at a level of shards, of so many words that are left."""
    return min(WORD_EDITS, (WORD_EDITS + REST_EDITS) // left) if level == 1 else REST_EDITS // left


@lru_cache(maxsize=300_000)
def _meeting(v: str, w: str, edits: int) -> str | None:
    """The one of the pieces that two words share under which they are compared."""
    return v if v == w else min(_pieces(v, edits) & _pieces(w, edits), default=None)


def _compared_in(met: list[str], theirs: list[str], words: int, level: int) -> int | None:
    """The shard of this level, of all that two names of so many words meet in by these words, that compares them."""
    shard = 0
    for k in range(level):
        piece = _meeting(met[k], theirs[k], _edits(k + 1, words - k)) if k < len(met) else ""
        if piece is None:
            return None
        shard = _hash(f"{shard} {piece}")
    return shard


_SHARDS = "shard bigint, form string, n bigint, used array<int>, word bigint, exact boolean"


def _sharder(level: int):
    """Every name under the keys of its next word; `used` are the places of its words that shards have met, `word` stands for
    these and `exact` says that the shard is theirs, not one of a shorter piece."""

    def run(batches):
        for batch in batches:
            out = []
            for s, c, k, u, h, e in zip(*(batch.column(x).to_pylist() for x in ("shard", "form", "n", "used", "word", "exact"))):
                ws = own_words(c)
                left = [i for i in range(len(ws)) if i not in u]
                some = keys([ws[i] for i in left], WORD_EDITS + REST_EDITS if level == 1 else REST_EDITS, WORD_EDITS if level == 1 else REST_EDITS) if left else [(None, "")]
                for i, piece in some:
                    w = "" if i is None else ws[left[i]]
                    out.append((_hash(f"{s} {piece}"), c, k, u if i is None else [*u, left[i]], _hash(f"{h} {w}"), e and piece == w))
            types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["shard", "form", "n", "used", "word", "exact"])

    return run


#: Under this mark a node of a trie holds the largest n below it.
_MOST = "\0"


def _insert(trie: dict, words: list[str], entry, n: int = 0) -> None:
    node = trie
    for w in words:
        for ch in [*w, " "]:
            node = node.setdefault(ch, {_MOST: n})
            if node[_MOST] < n:
                node[_MOST] = n
    node.setdefault("", []).append(entry)


def _word_ends(node: dict, word: str, most: int, floor: list[int]) -> Iterator[tuple[dict, int]]:
    """(node after the word, distance) of the words below a node within `most` edits, but for branches under floor[0]: the
    automaton's state is the band of a row of distances."""
    n = len(word)
    stack = [(node, 0, "", _first_row(n, most), None)]
    while stack:
        at, depth, last, row, before = stack.pop()
        j = n - depth + most
        for c in reversed(at):  # what was inserted first, the most frequent names, is walked first
            child = at[c]
            if c == "" or c == _MOST or child[_MOST] < floor[0]:
                continue
            if c == " ":
                if 0 <= j <= 2 * most and row[j] <= most:
                    yield child, row[j]
            elif cur := _next_row(row, before, depth + 1, c, last, word, most):
                stack.append((child, depth + 1, c, cur, row))


def allowed(letters: int) -> int:
    return 0 if letters <= 3 else 1 if letters <= 5 else REST_EDITS


def walk(trie: dict, words: tuple[str, ...], most: int, floor: list[int] | None = None) -> Iterator[tuple[int, object]]:
    """(distance, entry) of the trie's sequences within `most` edits of the words in any order; floor[0] may rise meanwhile."""
    floor = floor or [0]
    stack = [(trie, words, 0)]
    while stack:
        node, left, spent = stack.pop()
        if not left:
            for e in node.get("", ()):
                yield spent, e
        for k, w in enumerate(left):
            if k and w == left[k - 1]:
                continue
            for child, d in _word_ends(node, w, min(most - spent, allowed(len(w))), floor):
                stack.append((child, left[:k] + left[k + 1 :], spent + d))


def comparable(a: str, b: str, bits: Frequencies) -> bool:
    """Whether the shared words of two forms, whose own words match, let them be one employer.

    Contradicting words never do. A word that one of them lacks is let pass where two words of their own match that weigh
    enough.
    """
    lacks = missing_words(a, b)
    if not lacks:
        return lacks is not None
    x, y = own_words(a), own_words(b)
    if len(set(x)) < 2:
        return False
    have = min(sum(map(bits.bits, x)), sum(map(bits.bits, y)))
    lack: dict[str, float] = {}
    for m in lacks:
        for kind, full in m:  # words of one kind say one thing: department stores
            lack[kind] = max(lack.get(kind, 0.0), bits.bits(full, PRIOR_SHARED))
    return have >= COMMON * (have + sum(lack.values()))


def _best_in_shard(rows: list[tuple[str, int, list[int], bool]], bits: Frequencies, shard: int, level: int):
    """(form, neighbour, its n, distance) for the most frequent neighbour of each name of one shard, if it is larger than itself.

    Names lie in a trie for each sequence of words that brought them here. Two names meet in many shards, by each piece that
    their words share, but each trie is walked from a name in one of these only.
    """
    groups: dict[tuple, list] = {}
    for form, n, used, own in sorted(rows, key=lambda r: (-r[1], r[0])):  # the most frequent names come first
        ws = own_words(form)
        met = tuple(ws[i] for i in used)
        groups.setdefault((len(ws), met), []).append((form, n, tuple(w for i, w in enumerate(ws) if i not in used), own))
    best: dict[str, tuple] = {}
    floors: dict[str, list[int]] = {}
    tries: dict[tuple, dict] = {}
    for (words, met), mine in groups.items():
        most = max((allowed(sum(map(len, met[1:])) + sum(map(len, rest))) for _, _, rest, own in mine if own), default=-1)
        for (others, theirs), names in groups.items():
            # names with another number of words are never alike; only more frequent names matter
            if others != words or most < 0 or names[0][1] < mine[-1][1]:
                continue
            first = distance(met[0], theirs[0], WORD_EDITS)
            if first > WORD_EDITS or _compared_in(met, theirs, words, level) != shard:
                continue
            before = sum(distance(v, w, REST_EDITS) for v, w in zip(met[1:], theirs[1:]))
            if before > most:
                continue
            trie = tries.setdefault((others, theirs), {})
            if not trie:
                for other, m, rest, _ in names:
                    _insert(trie, rest, (other, m), m)
            for form, n, rest, own in mine:
                spare = allowed(sum(map(len, met[1:])) + sum(map(len, rest))) - before
                # a misspelt name of one word must be long enough
                if not own or spare < 0 or (first and len(met) == 1 and not rest and min(len(met[0]), len(theirs[0])) < 6):
                    continue
                floor = floors.setdefault(form, [n])  # of more frequent names the most frequent
                if names[0][1] < floor[0]:
                    continue
                for d, (other, m) in walk(trie, rest, spare, floor):
                    if other == form or (m, other) <= (n, form) or m < floor[0]:
                        continue
                    far = first + before + d
                    if (form not in best or best[form] < (m, -far, other)) and comparable(form, other, bits):
                        best[form] = (m, -far, other)
                        floor[0] = m
    for form, (m, d, other) in best.items():
        yield form, other, m, -d


def _searcher(blob, level: int):
    """Rows come sorted by shard; one shard is held at a time."""

    def run(batches):
        shard, rows, out = None, [], []

        def flush():
            if len(rows) > 1:
                out.extend(_best_in_shard(rows, blob.value, shard[0], level))

        def emit():
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["form", "other", "m", "d"])
            out.clear()
            return got

        for batch in batches:
            for s, t, c, n, used, own in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (s, t) != shard:
                    flush()
                    shard, rows = (s, t), []
                rows.append((c, n, used, own))
            if len(out) > 20_000:
                yield emit()
        flush()
        if out:
            yield emit()

    return run


def neighbours(forms: DataFrame) -> DataFrame:
    """(form, other, m, d): for (form, n), the most frequent neighbour within each shard that a form meets it in."""
    spark = forms.sparkSession
    bits = spark.sparkContext.broadcast(frequencies(forms))
    rows = forms.select(F.lit(0).cast("bigint").alias("shard"), "form", "n", F.array().cast("array<int>").alias("used"), F.lit(0).cast("bigint").alias("word"), F.lit(True).alias("exact"))
    # by number: the rows are small and the work is not, so partitions aren't to be coalesced by size, here and below
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, level = None, 1
    while True:
        shards = rows.repartition(tasks, "form").mapInArrow(_sharder(level), _SHARDS)
        # shards of one name have no neighbours to offer, nor have those of a shorter piece that only one word has
        left = F.max(F.size(F.split(F.split("form", "\t")[0], " ")) - F.size("used")).alias("left")
        sizes = shards.groupBy("shard").agg(F.count("*").alias("k"), left, (F.max("exact") | (F.min("word") < F.max("word"))).alias("meet")).where("k > 1 AND meet").drop("meet")
        sizes = cut(sizes)
        hot = (F.col("k") > SHARD_NAMES) & (F.col("left") > 0)
        more = not sizes.where(hot).isEmpty()
        met = shards.join(sizes.where(~hot), "shard").withColumn("parts", F.ceil(F.col("k") / SALT_NAMES).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.select("shard", "salt", "form", "n", "used", (F.pmod(F.xxhash64("form"), F.col("parts")) == F.col("salt")).alias("own"))
        best = met.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(_searcher(bits, level), "form string, other string, m bigint, d int")
        found = best if found is None else found.unionByName(best)
        if not more:
            return found
        rows, level = cut(shards.join(sizes.where(hot).select("shard"), "shard", "left_semi")), level + 1


def employers(forms: DataFrame) -> DataFrame:
    """(form, root): for (form, n), the spelling in which the pointers from each form end."""
    pointers = neighbours(forms).groupBy("form").agg(F.max_by("other", F.struct("m", (-F.col("d")).alias("d"), "other")).alias("parent"))
    links = cut(forms.select("form").join(pointers, "form", "left").select("form", F.coalesce("parent", "form").alias("root")))
    while True:  # pointers lead to larger names only, so each round halves the way to the end
        up = links.select(F.col("form").alias("root"), F.col("root").alias("up"))
        jumped = cut(links.join(up, "root").select("form", F.col("up").alias("new"), "root"))
        links = jumped.select("form", F.col("new").alias("root"))
        if jumped.where("new <> root").isEmpty():
            return links


def blank(c) -> object:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{00A0}]+", " ")) == ""


def _owned(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(root, name, name_key): every spelling under its employer; name_key is NULL for those of postings."""
    ledger = companies.where(F.col("name_key").isNotNull()).select("name_key", F.when(blank(F.col("name")), F.col("name_key")).otherwise(F.col("name")).alias("name")).distinct()
    named = jobs.where(F.col("url").isNotNull() & ~blank(F.col("company"))).groupBy(F.col("company").alias("name")).agg(F.count("*").alias("n"))
    both = ledger.select("name", F.lit(1).cast("bigint").alias("n"), "name_key").unionByName(named.withColumn("name_key", F.lit(None).cast("string")))
    rows = cut(with_form(both, "name", ["n", "name_key"]).where("form <> ''"))
    forms = cut(rows.groupBy("form").agg(F.sum("n").alias("n")))
    return cut(rows.join(employers(forms), "form").select("root", "name", "name_key"))


def ledger_classes(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(name_key, employer, members): one row per ledger row, its employer's smallest name_key and number of ledger rows."""
    keys_ = _owned(companies, jobs).where("name_key IS NOT NULL").select("root", "name_key").distinct()
    return keys_.join(keys_.groupBy("root").agg(F.min("name_key").alias("employer"), F.count("*").alias("members")), "root").select("name_key", "employer", "members")


def linked_names(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(link_kind, key_a, key_b), key_a < key_b. `ledger`: two name_keys of one employer. `posting`: the url of a job whose
    company isn't a ledger name to the letter, with the smallest name_key of its employer's ledger rows.

    Postings of employers without ledger rows give none; blank names and NULL keys link to nothing; repeated rows count
    once. Names are compared once each, however many rows carry them, whole, however long; a company that a third of the
    postings name is salted in the join back to its postings. Raises nothing and caps nothing.
    """
    owned = _owned(companies, jobs)
    keys_ = owned.where("name_key IS NOT NULL").select("root", "name_key").distinct()
    a, b = keys_.select("root", F.col("name_key").alias("key_a")), keys_.select("root", F.col("name_key").alias("key_b"))
    pairs = a.join(b, "root").where("key_a < key_b").select(F.lit("ledger").alias("link_kind"), "key_a", "key_b")
    least = keys_.groupBy("root").agg(F.min("name_key").alias("key"))
    typed = owned.where("name_key IS NULL").select("root", "name").distinct().join(companies.select("name").distinct(), "name", "left_anti").join(least, "root").select("name", "key")
    salts = 8
    posted = jobs.where(F.col("url").isNotNull()).select("url", F.col("company").alias("name")).distinct().withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
    wide = typed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = posted.join(wide, ["name", "salt"]).select(F.lit("posting").alias("link_kind"), F.least("url", "key").alias("key_a"), F.greatest("url", "key").alias("key_b")).distinct()
    return pairs.unionByName(found)
