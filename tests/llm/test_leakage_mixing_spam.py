import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardwright.llm import leakage as L
from boardwright.llm import mixing as M
from boardwright.llm import spam as S

ITEM = "Honestly the circuit boards were fine but etching loom parts for 43 hours broke me, being a farrier with a café log"


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "before. " + " ".join(words[3:13]).upper() + " after"), (2, " ".join(words[3:12]) + " other"), (3, "x\n> ".join(["a", "b"])), (4, ITEM.replace("é", "é").replace("fi", "ﬁ")), (4, ITEM), (5, None), (6, ""), (None, ITEM), (7, " ".join(["filler"] * 30_000) + " " + ITEM), (8, ITEM.replace(" ", "\n> ")),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (None, ITEM)], "item_id bigint, text string")
    got = {r.doc_id: r for r in L.leaked_passages(df, items).collect()}
    assert set(got) == {1, 4, 7, 8} and got[1].match_words == 10 and got[7].word_position == 30_000 and got[7].match_words == len(L.words(ITEM))
    assert {r.doc_id for r in L.without_leaks(df, items).collect()} == {2, 3, 5, 6, None}
    assert L.leaked_passages(df.limit(0), items).count() == 0 and L.leaked_passages(df, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 150)
    df = spark.createDataFrame([(i, f"{ITEM} number{i} one two three four five six seven eight nine ten") for i in range(3)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"number{i} one two three four five six seven eight nine") for i in range(6)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_passages(df, items).collect()} == {(0, 0), (1, 1), (2, 2)}


def _longest(doc: str, item: str, least: int = 10):
    a, b = L.words(doc), L.words(item)
    best = (0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, (k, -i))
    return (best[0], -best[1]) if best[0] >= least else None


@pytest.mark.parametrize("tight", [False, True])
def test_leaks_against_brute_force(spark, monkeypatch, tight):
    """Also with a table of bits that lets nearly everything pass, matches taken a few at a time, and many blocks of items."""
    if tight:
        monkeypatch.setattr(L, "MOST_BITS", 1 << 10)
        monkeypatch.setattr(L, "MATCHES", 3)
        monkeypatch.setattr(L, "SHARD_WORDS", 50)
        monkeypatch.setattr(L, "BLOCK_CHARS", 400)
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 40, n))
    shared = text(12)
    items = [(i, f"{text(15)} {shared} {text(9)}" if i % 2 else text(30)) for i in range(12)]
    docs = []
    for i in range(40):
        t = items[int(rng.integers(12))][1].split()
        a = int(rng.integers(0, len(t) - 9))
        docs.append((i, f"{text(20)} {' '.join(t[a : a + int(rng.integers(8, 25))])} {text(5)}" if i % 4 else f"{text(7)} {shared} {text(3)} {shared}"))
    want = {(d, i, *m) for d, x in docs for i, y in items if (m := _longest(x, y))}
    got = L.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "match_words", "word_position").collect()} == want and len(want) > 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(seq):
    a = np.array(seq, np.int64)
    got = L.suffix_array(a, len(seq) + 1)
    assert [seq[i:] for i in got] == sorted(seq[i:] for i in range(len(seq)))


def test_mix(spark):
    rng = np.random.default_rng(2)
    docs = [(i, f" {'Big' if i % 3 else 'SMALL'} ", " ".join(["token"] * int(rng.integers(3, 90)))) for i in range(3000)] + [(9001, None, "x"), (9002, "big", None), (9003, "big", ""), (9004, "untargeted", "some words")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_passes int")
    mix = M.mix_sources(df, goals)
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["big"].reached_share == pytest.approx(5 / 9, abs=0.004) and shares["small"].reached_share == pytest.approx(4 / 9, abs=0.004) and shares["absent"].mixed_tokens == 0
    plan = {r.doc_id: r for r in mix.plan.collect()}
    assert 9001 not in plan and plan[9002].copies == plan[9003].copies == plan[9004].copies == 0
    assert all(r.copies <= (1 if r.source == "big" else 3) for r in plan.values()) and max(abs(r.copies - r.rate) for r in plan.values()) <= 1
    assert M.mix_sources(df.limit(0), goals).plan.count() == 0 and M.mix_sources(df, goals.limit(0)).shares.count() == 0


def test_mix_counts_a_document_once(spark):
    rows = [(1, "a", "one two three four"), (1, "a", "one two three four"), (2, "A ", "five six"), (3, "b", "seven eight nine ten"), (3, "c", "other"), (3, "b", "seven")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_passes int")
    mix = M.mix_sources(df, goals)
    plan = mix.plan.collect()
    assert sorted(r.doc_id for r in plan) == [1, 2, 3] and {r.doc_id: r.source for r in plan}[3] == "b"
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["b"].source_tokens == {r.doc_id: r.tokens for r in plan}[3] and sum(r.reached_share for r in shares.values()) == pytest.approx(1)


def test_mix_near_the_cap_of_small_documents(spark):
    docs = [(i, "a" if i % 2 else "b", " ".join(["token"] * (1 if i % 3 else 900))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_passes int")
    have = {r.source: r.source_tokens for r in M.mix_sources(df, goals).shares.collect()}
    mix = M.mix_sources(df, goals, total_tokens=2 * 2.9999 * min(have.values()))
    assert all(r.reached_share == pytest.approx(0.5, abs=0.01) for r in mix.shares.collect())


def test_token_counts_with_long_texts(spark):
    df = spark.createDataFrame([(1, "s", "word " * 100_000), (2, "s", "<|endoftext|>"), (3, "s", None)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in M.token_counts(df).collect()}
    assert 100_000 <= got[1] <= 100_010 and got[2] > 1 and got[3] == 0


PROSE = ["The person in this role will plan the shift rosters with the night team and report to us at month end.", "We offer a home office stipend, and you can work from the old mill office when it suits you.", "Every team meets the design guild each morning to plan what they will do with the grant proposals.", "They told the finance desk to balance the cash drawers, but nobody asked the people at the depot."]


def test_spam(spark):
    prose = [(i, "\n".join(PROSE[(i + k) % 4] for k in range(6))) for i in range(80)]
    bad = {1000: "welder jobs " * 60, 1001: "\n".join(f"* [welder Boston](http://x{i}.example/{i})" for i in range(40)), 1002: " ".join(f"#tag{i}" for i in range(80)), 1003: ", ".join(f"nurse{i} osaka{i}" for i in range(60)), 1004: PROSE[0] + "\n" + "Find welder jobs and more welder jobs with welder jobs alerts. " * 12, 1005: "\n".join(f"JR-{i} | welder | Boston | $3{i}/hr | apply | save" for i in range(20))}
    good = {2000: "\n".join(PROSE) + "\nSkills we value:\n- welding\n- soldering\n- SQL\n", 2001: None, 2002: "", 2003: "\n".join(PROSE * 800)}
    df = spark.createDataFrame([*prose, *bad.items(), *good.items(), (1000, bad[1000])], "doc_id bigint, text string")
    assert {r.doc_id for r in S.spam_pages(df).collect()} == set(bad)
    assert S.spam_pages(df.limit(0)).count() == 0
    assert S.spam_pages(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")).count() == 0


def test_spam_sides_and_long_tokens(spark):
    prose = [(i, "\n".join(PROSE[(i + k) % 4] for k in range(6))) for i in range(80)]
    stuffed = "Our welder jobs are the best welder jobs, so get the welder jobs now because welder jobs go fast. " * 12
    links = "\n".join(f"* [welder Boston](http://x{i}.example/{i})" for i in range(40))
    chain = "-".join(["word"] * 1_000)
    df = spark.createDataFrame([*prose, (1000, stuffed), (1001, links), (1002, chain), (1003, "www." + "x/" * 5_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.score_pages(df).collect()}
    # repeated keywords in sentences are found by the low side alone, links by the high side
    assert got[1000].low_share > 0.6 > got[1000].high_share and got[1001].high_share > 0.6
    assert got[1002].words == 1_000 and got[1003].words > 4_000
