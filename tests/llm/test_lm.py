"""The language model against a plain one, and what a model must do."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import ngram_lm
from lamina.llm import queries as Q
from lamina.llm.arrays import narrow, squeeze, unsqueeze, widen
from lamina.llm.ngram_lm import discounts, hold_out, score_documents, train
from tests.llm import brute


def tokens(text):
    return brute.words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def plain(docs, held, order):
    """doc -> (n_tokens, n_known, base_score, score), with dictionaries."""
    seen = {k: tokens(t) for k, t in docs.items()}
    grams = lambda own: [tuple((["<s>"] * (order - 1) + own)[i : i + order]) for i in range(len(own))]
    raw, levels = Counter(), {order: Counter()}
    for k, own in seen.items():
        if k not in held:
            raw.update(own)
            levels[order].update(grams(own))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    n, v = sum(raw.values()), len(raw)
    d = {k: discounts(*(sum(c == j for c in found.values()) for j in (1, 2, 3, 4))) for k, found in levels.items()}
    followers = {k: defaultdict(lambda: [0, 0.0]) for k in levels}
    for k, found in levels.items():
        for g, c in found.items():
            followers[k][g[:-1]][0] += c
            followers[k][g[:-1]][1] += d[k][min(c, 3) - 1]
    less = lambda c, k: c - d[k][min(c, 3) - 1] if c else 0

    def p(gram):
        out = 1 / (v + 1)
        for k in range(1, order + 1):
            own = gram[-k:]
            if after := followers[k].get(own[:-1]):
                out = (less(levels[k][own], k) + after[1] * out) / after[0]
        return out

    out = {}
    for k, own in seen.items():
        base = sum(math.log10((raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out[k] = (len(own), sum(raw[w] > 0 for w in own), base, sum(math.log10(p(g)) for g in grams(own)))
    return out, n, p, raw


@pytest.mark.parametrize(("order", "per_file"), [(2, 300), (3, 1 << 21), (3, 300), (4, 300)])
def test_orders(spark, monkeypatch, order, per_file):
    """Against a plain model, in one file a level and in many, with words dealt by themselves and by whole n-grams."""
    monkeypatch.setattr(ngram_lm, "PER_FILE", per_file)
    monkeypatch.setattr(ngram_lm, "HELD", 5_000)
    monkeypatch.setattr(ngram_lm, "SLICE", 3_000)
    table = hold_out(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    docs = {r.doc_id: r.text for r in table.collect()}
    held = {k for k in docs if zlib.crc32(str(k).encode()) % 10 == 0}
    want, n, p, raw = plain(docs, held, order)
    model = train(table.filter("not held_out"), order=order)
    assert model.bits == (0 if per_file > 300 else ngram_lm.bits_for(n)) and (per_file > 300 or model.bits > 3)
    rows = score_documents(table, model, held_out="held_out").collect()
    assert len(rows) == len(docs)
    for r in rows:
        nt, nk, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, nt, nk, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    for gram in (("<s>", "<s>", "<s>"), ("<s>", "the", "of"), ("in", "of", "the")):  # the words and one for all unknown share 1
        assert math.isclose(sum(p((*gram[len(gram) - order + 1 :], w)) for w in [*raw, "never seen"]), 1, rel_tol=1e-9)


def test_query_is_order_three(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain(docs, {k for k in docs if zlib.crc32(str(k).encode()) % 10 == 0}, 3)[0]
    for r in Q.op3_kneser_ney(spark, sf).collect():
        assert math.isclose(r.score, want[r.doc_id][3], rel_tol=1e-9)


def test_higher_orders_score_better_on_held_out(spark):
    docs = hold_out(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    scores = []
    for order in (2, 3):
        rows = score_documents(docs.filter("held_out"), train(docs.filter("not held_out"), order=order))
        scores.append(rows.agg(F.sum("base_score"), F.sum("score")).first())
    assert scores[0][0] < scores[0][1] < scores[1][1]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b a b"), (3, "A B"), (3, "A B"), (4, "x " * 100_000), (5, "new\x0bwords")]
    docs = hold_out(spark.createDataFrame(rows, "doc_id long, text string"))
    model = train(docs)
    got = score_documents(docs, model, held_out="held_out").collect()
    assert [r.n_tokens for r in got] == [1, 1, 5, 3, 3, 100_001, 3] and all(r.score < 0 for r in got)
    nothing = train(docs.limit(0))
    assert [r.n_known for r in score_documents(docs, nothing).collect()] == [0] * 7
    assert score_documents(docs.limit(0), model).count() == 0


def test_extra_columns(spark):
    names = ["key", "held_out", "text", "n_tokens", "score", "bucket", "doc_id"]
    docs = spark.createDataFrame([(1, False, "a b", 5, 0.5, 1, 7)], names)
    got = score_documents(docs, train(docs)).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(7, 3)]


def test_many_counts_of_one_pair(spark):
    rows = [(k, "hot pair " * 50 + (f"w{k}" if k % 3 else "")) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(dict(rows), set(), 3)[0]
    for r in score_documents(table, train(table)).collect():
        assert math.isclose(r.score, want[r.doc_id][3], rel_tol=1e-9)


def test_blocks():
    for columns in ([np.arange(7, dtype="u8") << np.uint64(40), np.arange(7)], [np.zeros(0, "u4"), np.zeros(0, "i8")], [np.array([5], "u8"), np.array([2**62])]):
        assert all((a == b).all() for a, b in zip(unsqueeze(squeeze(columns)), columns, strict=True))


def test_narrow_columns():
    values = np.array([0, 1, 254, 255, 256, 2**40, 3])
    assert (widen(narrow("x", values), "x", np.arange(7)) == values).all()
    rows = np.array([(a + 2 * b + t, a, b, int(t > 0)) for a in range(9) for b in range(6) for t in (0, 3, 4, 9, 10)] + [(2**50, 0, 0, 2)])
    assert (ngram_lm.decode_contexts(ngram_lm.encode_contexts(rows), np.arange(len(rows))) == rows).all()
