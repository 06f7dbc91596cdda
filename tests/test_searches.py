import math
import re
from collections import Counter, defaultdict

import numpy as np

from boardwright.operators import dense
from boardwright.plans import retrieval as R


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.array([r.embedding for r in rows], dtype=float)
    return [r.vec_id for r in rows], v / np.linalg.norm(v, axis=1, keepdims=True)


def _near(ids, v):
    """(probe, id) -> rank0 by brute force."""
    out = {}
    for p, q in zip(ids, v):
        if p % 50 == 0:
            sims = v @ q
            for n, i in enumerate(sorted(range(len(ids)), key=lambda i: (-round(float(sims[i]), 9), ids[i]))[:200]):
                out[p, ids[i]] = n
    return out


def _fused(near):
    rrf = defaultdict(float)
    for (_, i), n in near.items():
        rrf[i] += 1 / (60 + n)
    return sorted(rrf.items(), key=lambda x: (-round(x[1], 12), x[0]))


def test_every_fiftieth_vector_is_a_search(spark, sf, monkeypatch):
    near = _near(*_vectors(spark, sf))
    got = {(r.probe, r.id): r.rank0 for r in R.knn_per_probe(spark, sf).collect()}
    assert got == near and len({p for p, _ in got}) == 10
    assert [r.id for r in R.rrf_probes(spark, sf).collect()] == [i for i, _ in _fused(near)[:40]]
    monkeypatch.setattr(dense, "PROBE_BLOCK", 3)
    assert {(r.probe, r.id): r.rank0 for r in R.knn_per_probe(spark, sf).collect()} == near


def test_more_probes_than_one_block_holds(spark, monkeypatch):
    monkeypatch.setattr(dense, "PROBE_BLOCK", 4)
    monkeypatch.setattr(dense, "MAX_PROBES", 20)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0 + i]) for i in range(60)], "id bigint, e array<double>")
    got = dense.top_per_probe(df, "id", "e", df, "id", "e", 1)
    assert got.select("probe").distinct().count() == 60


def test_hybrid_fuses_bm25_and_the_vectors(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "board").collect()
    words = {d.doc_id: re.findall(r"[^\W_]+", (d.text or "").lower()) for d in docs}
    tf = {d: Counter(w)["team"] for d, w in words.items() if "team" in w}
    mean = sum(map(len, words.values())) / len(words)
    idf = math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5))
    idf = idf if idf > 0 else 1e-6
    score = {d: idf * 8 * n * 2.2 / (8 * n + 1.2 * (0.25 + 0.75 * len(words[d]) / mean)) for d, n in tf.items()}
    lex = sorted(score, key=lambda d: (-round(score[d], 9), d))
    den = [i for i, _ in _fused(_near(*_vectors(spark, sf)))[:240]]
    rrf = defaultdict(float)
    for ranked in (lex, den):
        for n, i in enumerate(ranked):
            rrf[i] += 1 / (60 + n)
    board = {d.doc_id: d.board.strip().lower() for d in docs if d.board is not None}
    seen, want = Counter(), []
    for i in sorted(rrf, key=lambda i: (-round(rrf[i], 12), i)):
        b = board.get(i)
        if b is None or seen[b] < 3:
            want.append((i, round(rrf[i], 9)))
        seen[b] += 1
    got = [(r.id, r.rrf) for r in R.hybrid_rrf(spark, sf).collect()]
    assert lex and got == want[:60]
