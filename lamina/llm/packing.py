"""Packing of tokenized documents into sequences by their length histogram."""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialize
from lamina.llm.sharding import number_slots

#: Characters for which the quick splitter and the tokenizer's own agree on what is a letter, a digit or space.
_LETTERS = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[{_LETTERS}\t-\r -~]*")
# The order of the alternatives is the public tokenizer's
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Byte-level vocabularies write bytes as characters: printable ones of Latin-1 as themselves, the others in order from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000


class Encoder(dict):
    """Ids of texts as little-endian 32-bit numbers; remembers the ids of single words.

    A byte-level tokenizer without normalizer merges within words only, so a text's
    ids are those of its words one after another. Texts with characters outside
    the plain set or with the text of a special token go to the tokenizer whole.
    Texts are sequences of code points that UTF-8 can write, as Spark's are; lone
    surrogates raise TypeError.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        splitter = str(self.tokenizer.pre_tokenizer)
        self.model = self.tokenizer.model
        self.by_word = self.tokenizer.normalizer is None and splitter.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in splitter

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        # a word goes to the merges alone, its bytes as the characters that stand for them
        found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file (None: the public byte-level one)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        rows, start, length, crc, total = [], [], [], [], []
        for k, text in enumerate(batch.column("text")):
            ids = own.encode(text.as_py() or "") + end
            n = len(ids) // 4
            for a in range(0, n, width):
                b = min(a + width, n)
                rows.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                total.append(n)
        keys = batch.column("key").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["key", "start", "length", "ids_crc32", "doc_tokens"])


def place_lengths(histogram: dict[int, int], width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs as patterns: (how many packs, [(length, times), ...]) for the pieces that ``histogram`` counts.

    Lengths go longest first, each into the packs that hold least so far and still
    have room; packs that are alike are one group, of which a part splits off when
    fewer pieces than packs are left. Where none has room, new packs take as many of
    the length as they hold. A length splits at most one group and opens at most two,
    so there are at most four groups for each length, whatever the counts.
    """
    rooms: list[int] = []  # the room left that some group has, ascending
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room -> [(packs, pattern as a linked list)]

    def add(room: int, packs: int, pattern: tuple) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            packs, pattern = groups[room].pop()
            if packs > left:
                groups[room].append((packs - left, pattern))
            elif not groups[room]:
                del groups[room]
                rooms.pop()
            used = min(packs, left)
            add(room - length, used, (length, pattern))
            left -= used
        most = width // length
        if left >= most:
            pattern = ()
            for _ in range(most):
                pattern = (length, pattern)
            add(width - most * length, left // most, pattern)
        if left % most:
            pattern = ()
            for _ in range(left % most):
                pattern = (length, pattern)
            add(width - left % most * length, 1, pattern)
    out = []
    for room in rooms:
        for packs, pattern in groups[room]:
            runs: list[tuple[int, int]] = []
            while pattern:
                length, pattern = pattern
                runs.append((length, runs.pop()[1] + 1) if runs and runs[-1][0] == length else (length, 1))
            out.append((packs, runs[::-1]))
    return out


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times, offset), sorted: the pieces of a length from that rank on take these places."""
    rows, rank, sequence = [], {}, 0
    for packs, runs in patterns:
        offset = 0
        for length, times in runs:
            rows.append((length, rank.get(length, 0), sequence, times, offset))
            rank[length] = rank.get(length, 0) + packs * times
            offset += length * times
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Ranks are below this.
_RANKS = 1 << 44


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = table[:, 0] * _RANKS + table[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        slot = table[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
        nth = rank - slot[:, 1]
        sequence = slot[:, 2] + nth // slot[:, 3]
        offset = slot[:, 4] + nth % slot[:, 3] * length
        kept = ["key", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2048, end_id: int = 1, tokenizer: str | None = None
) -> DataFrame:
    """Every document's ids, cut at ``width``, packed into sequences of at most ``width``.

    Returns a row a piece: the key, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``. A null or empty text is one piece
    of the end id alone, a text of any length is cut into as many as it needs; rows that
    repeat or have a null key are documents of their own. An
    empty table gives an empty result. Other columns, whatever their names, are not read.

    Texts are tokenized once; the pieces, without ids, go to the shared folder. The
    driver sees their length histogram, at most ``width`` numbers, and finds the
    patterns. Pieces of a length are ranked by the task that wrote them, no length in one task, and a
    rank is looked up in the slot table, whose size ``width`` bounds.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(rows.mapInArrow(partial(_pieces, path=tokenizer, width=width, end_id=end_id), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slot_table(place_lengths(histogram, width))
    ranked = number_slots(pieces, "length", "rank")
    placed = ranked.mapInArrow(partial(_place, table=table), f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)
