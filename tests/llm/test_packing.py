"""Packing: exact cover, the tokenizer's own ids, little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import queries as Q
from lamina.llm.packing import Encoder, pack_documents, place_lengths, slot_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN, PLAIN = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\t\r\x0b\x1c\x85\xa0abcé'sIll123²½ÿĀɏɐ漢_-!<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoder(text):
    assert OWN.encode(text) == np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_special():
    assert OWN.by_word
    for text in ("a <|endoftext|> b", "", " ", "a  b\n\n c", "don't we'll", "x" * 300):
        assert OWN.encode(text) == np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns(histogram):
    patterns = place_lengths(histogram, 64)
    placed = Counter()
    for packs, runs in patterns:
        assert sum(n * t for n, t in runs) <= 64
        for n, t in runs:
            placed[n] += packs * t
    assert placed == histogram and len(patterns) <= 4 * len(histogram)
    slot_table(patterns)


def check(rows, docs, width=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for k, own in by_doc.items():
        ids = PLAIN.encode(docs[k] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
    return sum(r.length for r in rows) / (width * len(by_sequence))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(Q.op5_pack_histogram(spark, sf).collect(), docs) > 0.97


def test_odd_rows(spark):
    docs = {1: None, 2: "", 3: "漢字 <|endoftext|> é", 4: "long word " * 5000, 5: "x" * 3000, None: "no key", 6: "same", 7: "same"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(pack_documents(frame).collect(), docs)
    check(pack_documents(frame, width=16).collect(), docs, 16)
    assert pack_documents(frame.limit(0)).count() == 0
    assert pack_documents(frame.filter("doc_id = 6").unionAll(frame.filter("doc_id = 6"))).count() == 2
