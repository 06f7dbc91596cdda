import itertools
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from boardwright.llm import names as N

LEDGER = [
    ("k1", "Theodore Werkdrock Luckseal Pharmaceuticals Corp."), ("k2", "Ted Werkdrck Luckseal Pharma"), ("k3", "Luckseal, Werkdrock Pharm. LLC"), ("k4", "Brandmea & Stondbrel Tech"), ("k5", "BRANDMEA-STONDBREL"), ("k6", "Brandmea Quilthorn Technologies"), ("k7", ""), ("k8", None), ("k9", "Zosgoa Brurveurk Hospital"),
]
POSTED = [("u1", "Brandmaa and Stondbrle Technologies, Inc."), ("u2", "Brandmea & Stondbrel Tech"), ("u3", "T. Werkdrock Lucksael (Careers)"), ("u4", None), ("u5", " "), ("u6", "Nobody Elsewhere"), ("u1", "Brandmaa and Stondbrle Technologies, Inc."), (None, "Brandmea"), ("u7", "zósgoa brurvuerk hosp")]


def _run(spark, ledger=LEDGER, posted=POSTED):
    co = spark.createDataFrame(ledger, "name_key string, name string")
    jobs = spark.createDataFrame([(*p, "x") for p in posted], "url string, company string, name string")
    return {tuple(r) for r in N.linked_names(co, jobs).collect()}


def test_links(spark):
    assert _run(spark) == {("ledger", "k1", "k2"), ("ledger", "k1", "k3"), ("ledger", "k2", "k3"), ("ledger", "k4", "k5"), ("posting", "k4", "u1"), ("posting", "k1", "u3"), ("posting", "k9", "u7")}


def test_empty_tables(spark):
    assert _run(spark, [], POSTED) == set()
    assert {x[0] for x in _run(spark, LEDGER, [])} == {"ledger"}


def test_walk_against_brute_force():
    words = ["dandpruldis", "dandpruldsi", "dandpruldis", "dnadpruldis", "sharngast", "sharngst", "koldseack", "k"]
    trie = {}
    for i, w in enumerate(words):
        N._insert(trie, [w], i)
    for q in [*words, "dandprulds", "sharnagst", "x"]:
        for most in (0, 1, 2):
            allowed = min(most, N.allowed(len(q)))
            want = {(N.distance(q, w, most), i) for i, w in enumerate(words) if N.distance(q, w, most) <= allowed}
            assert set(N.walk(trie, (q,), most)) == want


def test_walk_in_any_order():
    rows = [p for n in (2, 3, 4) for p in itertools.permutations(["sharngast", "koldseack", "bandmol", "zerst"], n)]
    trie = {}
    for i, p in enumerate(rows):
        N._insert(trie, list(p), i)
    for q in (("bandmol", "koldseack", "sharngast"), ("bnadmol", "kolseack", "sharngast"), ("zerst", "bandmol", "sharngats", "koldseack"), ("aharngast", "bandmol")):
        want = set()
        for i, p in enumerate(rows):
            for o in itertools.permutations(p) if len(p) == len(q) else ():
                d = [N.distance(x, y, 2) for x, y in zip(q, o)]
                if sum(d) <= 2 and all(k <= N.allowed(len(x)) for k, x in zip(d, q)):
                    want.add((sum(d), i))
        assert set(N.walk(trie, q, 2)) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_distance_against_the_whole_table(a, b, most):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert N.distance(a, b, most) == min(d[len(a), len(b)], most + 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=34, max_size=80), st.lists(st.tuples(st.integers(0, 79), st.sampled_from("ixs"), st.sampled_from("abcd")), max_size=2))
def test_long_words_share_a_piece(word, changes):
    other = word
    for at, kind, ch in changes:
        at %= len(other)
        other = other[:at] + {"i": ch + other[at:], "x": other[at + 1 :], "s": ch + other[at + 1 :]}[kind]
    if len(other) > N.DELETION_LETTERS:
        assert N._pieces(word, 2) & N._pieces(other, 2)
        assert len(changes) > 1 or N._pieces(word, 1) & N._pieces(other, 1)


def test_forms():
    assert N.name_form("The Mt. Cimtrea & Wickneest Labs, Inc. (Careers)") == "cimtrea wickneest\tlabs mt"
    assert N.name_form("Kate Bargealmox Cnsto Grp.") == "bargealmox cnsto\tgrp kate"
    assert N.name_form("General Group").split("\t")[0] == "general"
    assert N.name_form("") == "" and N.name_form("  !! ") == ""
    assert len(N.own_words(N.name_form("word " * 5000))) == 5000


def test_unlike_employers_stay_apart(spark):
    names = ["Robert Smith", "James Smith Inc", "Bank of New York", "New York University", "New York Construction LLC", "Johnson Bank", "Johnson Clinic", "North Valley Health", "South Valley Hospital", "Smith & Jones", "Smith", "Johnson"]
    assert _run(spark, [(f"k{i:02}", n) for i, n in enumerate(names)], []) == set()
    assert _run(spark, [("a", "Bob Smith, Inc."), ("b", "Robert Smith"), ("c", "Jas. Smith"), ("d", "James Smith LLC")], []) == {("ledger", "a", "b"), ("ledger", "c", "d")}


def test_whole_names_of_any_length(spark):
    base = [f"word{i}x{i * 7}" for i in range(40)]
    other = [*base[:-1], "different"]
    turned = [*reversed(base[1:]), "zword0x0"]  # a typing error that changes the alphabetical order
    long = "a" * 300
    ledger = [("k1", " ".join(base)), ("k2", " ".join(other)), ("k3", " ".join(turned)), ("k4", long), ("k5", long[:150] + "b" + long[151:]), ("k6", long + "cdef"), ("k7", "zz " * 30_000)]
    assert _run(spark, ledger, []) == {("ledger", "k1", "k3"), ("ledger", "k4", "k5")}


def test_hot_shards_are_split(spark, monkeypatch):
    rng = random.Random(4)
    names = []
    for i in range(60):
        a, b = ("".join(rng.choices("bdklmnrst", k=8)) for _ in range(2))
        names += [f"Hotword {a}", f"{a[:3]}{a[4:]} Hotword", f"Hotword {a} {b}", f"{b[1:]} Hotword {a} Inc"]
    ledger = [(f"k{i}", n) for i, n in enumerate(names)]
    want = _run(spark, ledger, [])
    assert len(want) >= 120
    monkeypatch.setattr(N, "SHARD_NAMES", 5)
    monkeypatch.setattr(N, "SALT_NAMES", 2)
    assert _run(spark, ledger, []) == want


def test_one_employer_in_a_third_of_the_rows(spark):
    posted = [(f"u{i}", f"Brandmea Stondbrel{' Inc' * (i % 2)}" if i % 3 == 0 else f"Other{i}name Some{i}thing") for i in range(300)]
    got = _run(spark, [("k4", "Brandmea & Stondbrel Tech")], posted)
    assert len(got) == 100 and {x[1] for x in got} == {"k4"}


def _local(forms, monkeypatch):
    """The best neighbours of forms, from the shards of one level, and the number of walks through tries."""
    batch = pa.RecordBatch.from_pydict({"shard": [0] * len(forms), "form": list(forms), "n": list(forms.values()), "used": pa.array([[]] * len(forms), pa.list_(pa.int32())), "word": [0] * len(forms), "exact": [True] * len(forms)})
    shards, best, walks, walk = {}, {}, [], N.walk
    for out in N._sharder(1)([batch]):
        for r in out.to_pylist():
            shards.setdefault(r["shard"], []).append((r["form"], r["n"], r["used"], True))
    monkeypatch.setattr(N, "walk", lambda *a: walks.append(a) or walk(*a))
    bits = N.Frequencies(np.zeros(2 * N.SKETCH, np.int64), len(forms))
    for shard, rows in shards.items():
        for form, other, m, d in N._best_in_shard(rows, bits, shard, 1):
            best[form] = max(best.get(form, (0, 0, "")), (m, -d, other))
    return {f: b[2] for f, b in best.items()}, len(walks)


def test_names_that_share_many_pieces_meet_in_one_shard(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(8))
    first = [word() for _ in range(3)]
    forms = {}
    for k in range(60):
        a, b = first[k % 3], word()
        for n, (x, y) in enumerate(((a, b), (a[:4] + "z" + a[5:], b), (a, b[:3] + b[4] + b[3] + b[5:]), (a, "z" + b))):
            forms[" ".join(sorted((x, y))) + "\t"] = 1000 * (4 - n) + k
    got, walks = _local(forms, monkeypatch)

    def near(f, g):
        v, w = N.own_words(f), N.own_words(g)
        return any(N.distance(v[0], x, 2) + N.distance(v[1], y, 2) <= 2 and min(N.distance(v[0], x, 2), N.distance(v[1], y, 2)) <= 1 for x, y in (w, w[::-1]))

    want = {f: max((m, g) for g, m in forms.items() if near(f, g))[1] for f, n in forms.items() if any(near(f, g) and m > n for g, m in forms.items())}
    assert got == want
    # a name goes through a trie for each word that one of its words may be, where every shared piece gave one more
    assert walks <= 10 * len(forms)
