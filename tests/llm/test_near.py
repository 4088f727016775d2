"""Near duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import queries as Q
from lamina.llm.minhash_join import drop_near_duplicates, may_be_in, near_duplicates, node_filter
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute.components(docs)
    rows = Q.op9_minhash_join(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len(rows) == len(docs) and all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.fixture(scope="module")
def group():
    """A hub that drifts: every copy differs from its predecessor a little, and many from one text."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs, last = {}, base
    for i in range(120):
        copy = list(base if i % 3 else last)
        for _ in range(3 if i % 3 else 2):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs[1000 - i] = " ".join(copy)
        if not i % 3:
            last = copy
    return docs


@pytest.mark.parametrize(("rounds", "slack", "short"), [(12, 4, 16), (1, 4, 16), (3, 0, 2)])
def test_group(spark, group, rounds, slack, short):
    frame = spark.createDataFrame([(k, t) for k, t in group.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, width=4, rounds=rounds, slack=slack, short=short).collect()}
    assert got == brute.components(group)


def test_odd_rows(spark):
    body = " ".join(f"v{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\x0bTWO"), (6, "É a"), (7, "é a"), (9, body), (9, body), (8, body.upper()), (None, body), (None, "alone"),
            (10, "z " * 30_000), (11, "z z z z z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit(2), "key": F.lit("k")})
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(frame, width=4).collect()))
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (9, 57, 8, False), (9, 57, 8, False), (8, 57, 8, True),
         (0, 57, 8, False), (0, 1, 0, True), (10, 1, 10, True), (11, 1, 10, False)]
    )
    left = drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_repeated_ids(spark):
    """Rows of one id are judged by their texts: unlinked ones stay, and only true copies go."""
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a") + " end"), (5, text("b")), (7, text("c")), (7, text("d")), (7, text("c")), (8, text("e")), (8, text("e") + " end"), (9, ""), (None, text("f"))]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, (r.text or "-")[:1]) for r in left)
    assert got == [(0, "f"), (1, "a"), (5, "b"), (7, "c"), (7, "d"), (8, "e"), (9, "-")]


def test_text_keys(spark, group):
    frame = spark.createDataFrame([(f"k{k:05}", t) for k, t in group.items()], "doc_id string, text string")
    want = {f"k{k:05}": (n, f"k{c:05}") for k, (n, c) in brute.components(group).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, width=4).collect()} == want
    assert {r.doc_id for r in drop_near_duplicates(frame, width=4).collect()} == {c for _, c in want.values()}


def test_filtered_sets(spark, group):
    """Where the keys are too many to broadcast, a filter finds the sets, with the same result."""
    others = {k: " ".join(f"u{k}x{i}" for i in range(40)) for k in range(2000, 2300)}
    frame = spark.createDataFrame(list((group | others).items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, width=4, limit=0).collect()}
    assert got == brute.components(group | others)


def test_node_filter(spark):
    rng = np.random.default_rng(4)
    nodes, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 50_000)
    held = node_filter(spark.createDataFrame([(int(x),) for x in nodes], "node long"), len(nodes))
    assert may_be_in(held, nodes.view(np.uint64)).all() and may_be_in(held, others.view(np.uint64)).mean() < 0.05
