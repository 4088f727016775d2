"""Personal data against the plain expressions, and what bootstrapping adds."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import queries as Q
from lamina.llm.pii import base_spans, candidate_spans, extract_pii, KINDS
from tests.llm import brute


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a@b.c_d-1 29+()é\n%40.@5"), max_size=60))
def test_base_spans(text):
    assert sorted((KINDS[r], a, b) for a, r, b in base_spans(text)) == sorted(brute.pii(text))
    base = base_spans(text)
    for a, b in candidate_spans(text, base):
        assert b - a >= 6 and all(b <= s or e <= a for s, _, e in base)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op10_bootstrapped_pii(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        want = brute.pii(docs[r.doc_id])
        text = brute.digest(want, brute.PII_KINDS)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in want) for k in brute.PII_KINDS[:4])
        assert r.base_sha256 == brute.sha(text) and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_bootstrapping(spark):
    """Seeds after 'reach me at' make the pattern strong; it then takes an identifier of no base kind, and a weak pattern doesn't."""
    rows = [(i, f"please reach me at user{i}@mail.example.com today") for i in range(8)]
    rows += [(100, "please reach me at acct-99887766 today"), (101, "é the lot 20240611 and the lot 20240612 and the lot 777777"), (102, None), (None, ""), (100, "nothing")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "base": F.lit("x"), "key": F.lit(2)})
    got = {(r.doc_id, r.base != []): [(s.start, s.end) for s in r.more] for r in extract_pii(frame).collect() if r.more}
    assert got == {(100, False): [(19, 32)]}
    assert extract_pii(frame).count() == len(rows) and extract_pii(frame.limit(0)).count() == 0


def test_very_long(spark):
    frame = spark.createDataFrame([(1, "9" * 300_000 + " " + "a" * 300_000 + "@" * 1000 + " +1" + " " * 100_000)], "doc_id long, text string")
    assert extract_pii(frame).first().base == []


def test_any_filler(spark):
    """Strong contexts discover identifiers without digits, short ones and such in groups; all fillers count against a pattern."""
    others = ["C4F7K", "annasmith", "DE89 3704 0044 0532 0130 00", "555 0199"]
    rows = [(i, f"please reach me at user{i}@mail.example.com today") for i in range(20)]
    rows += [(100 + i, f"please reach me at {x} today") for i, x in enumerate(others)]
    # seeds beside many plain words: a weak pattern
    rows += [(200 + i, f"it is the user{i}@mail.example.org or the number7654{i} of the thing{'abcdefghijklmnop'[i] * 2}") for i in range(12)]
    got = {r.doc_id: [(s.start, s.end) for s in r.more] for r in extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.more}
    assert got == {100 + i: [(19, 19 + len(x))] for i, x in enumerate(others)}


def test_sides(spark):
    """Words count whole, what follows is a context of its own, and so is the text's start."""
    long = "https://files.example.com/" + "a" * 30
    rows = [(i, f"w{i} user{i}@mail.example.com is my account{i}") for i in range(8)]
    rows += [(100, "other C4F7K is my account"), (101, "C4F7L is my account")]
    # a place after the same 40 characters of another word, and one farther than 120 characters from its word's start
    rows += [(400 + i, f"v{i} {long}/key user{i}@mail.example.org x{i}") for i in range(8)] + [(500, f"v {long}/lot A77777 x"), (501, f"v {long}/key A88888 x")]
    rows += [(600 + i, f"u{i} {'b' * 200} user{i}@mail.example.edu x{i}") for i in range(8)] + [(700, f"u {'b' * 199}c A99999 x"), (701, f"u {'b' * 200} A12345 x")]
    found = lambda rows: {r.doc_id: [r.text[s.start : s.end] for s in r.more] for r in extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect() if r.more}
    assert found(rows) == {100: ["C4F7K"], 101: ["C4F7L"], 501: ["A88888"], 701: ["A12345"]}
    starts = [(i, f"user{i}@mail.example.net begins{i} it{i}") for i in range(8)] + [(300, "C4F7M opens this")]
    assert found(starts) == {300: ["C4F7M"]}


def test_bootstrapping_is_brute_force(spark):
    """The discovered spans against a plain version of the whole bootstrapping, on documents and on made ones where it takes several rounds."""
    rng = random.Random(9)
    made = [f"mail user{i}@mail.example.com or call {rng.choice(['desk', 'home'])} now" for i in range(12)]
    made += [f"mail ref-{i}x or call desk now and badge ref-{i}x please" for i in range(6)]
    made += [f"so badge {w} please go" for w in ("alpha7", "beta8", "ref-1x")] + ["badge ref-2x please and room alpha7 here", "room beta8 here", "room nobody here", None, ""]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = []
    for texts in (made, docs + made):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, s.start, s.end) for r in extract_pii(frame).collect() for s in r.more}
        assert got == brute.bootstrap(texts)
        found.append(len(got))
    assert found[0] > 6
