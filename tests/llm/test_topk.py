"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import queries as Q
from lamina.llm.topk import Block, search_block, pivot_distances, top_k


def brute(rows, every=100, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in good}.items():
        if q % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


def got(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(Q.op4_pivot_top_k(spark, sf)) == brute(rows)


@pytest.mark.parametrize("small", [600, 1 << 25])
def test_odd_rows(spark, small):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1e-4]) for _ in range(4)]) for i in range(-200, 400)]
    rows += [(1000, None), (None, [1.0] * 4), (1001, [1.0, None, 1.0, 1.0]), (1100, [float("nan")] * 4), (1002, [float("inf")] * 4), (1200, [1.0, 2.0]), (1201, [3.0, 4.0]), (1300, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(top_k(frame, small=small, block=50, query_block=2)) == brute(rows)
    assert top_k(frame.limit(0), small=small).count() == 0


def test_elimination():
    """Far candidates are not evaluated, and the answer is the same."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 4000
    x = (centres[rng.integers(0, 20, 5000)] + rng.normal(size=(5000, 16)) * 50).astype(np.int64)
    pivots = x[:32].astype(float)
    block = Block.of(np.arange(5000), x, pivot_distances(x.astype(float), pivots).astype("f4").astype(float))
    q = x[7]
    best, seen = search_block(block, 7, q, pivot_distances(q[None].astype(float), pivots)[0], 10, -np.inf)
    scores = sorted(((int(v), i) for i, v in enumerate(x @ q) if i != 7), key=lambda s: (-s[0], s[1]))[:10]
    assert best == scores and seen < 2500


def test_report(spark):
    """In clusters, most candidates are never evaluated; the report counts those that are."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 12)) * 4
    x = centres[rng.integers(0, 25, 4000)] + rng.normal(size=(4000, 12)) * 0.05
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "score": F.lit(1), "rank": F.lit(2), "v": F.lit(3)})
    out = top_k(frame, report=True, block=512)
    assert got(out.drop("evaluated")) == brute(rows)
    assert out.agg(F.avg("evaluated")).first()[0] < 0.3 * 4000


def test_large_components(spark):
    rows = [(100, [1e300, 0.0]), (1, [1.0, 2.0]), (2, [-1.0, 5.0]), (3, [1e300, 0.0]), (4, [3e15, 3e15]), (200, [2e15, 1e15])]
    have = {r[0]: [max(-(2**63), min(2**63 - 1, math.floor(1024 * c))) for c in r[1]] for r in rows}
    want = set()
    for q in (100, 200):
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(have[q], v, strict=True)))), i) for i, v in have.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    assert got(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == want
