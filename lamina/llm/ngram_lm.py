"""An interpolated modified Kneser-Ney model of any order, counted in Spark, held in sorted hash arrays that workers map."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.arrays import by_value, load, narrow, save, squeeze, unsqueeze, widen
from lamina.llm.common import freed_shuffles, materialize, shared_path
from lamina.llm.tokens import chunks, mix, word_hashes

#: The hash of a text's end, which is a token; no word's bytes hash to it but by chance.
END = np.uint64(0x5D1E9C3AB7F20461)
#: Tokens that a task holds before it counts and sends them on, that it scores at a time, and of which a file holds the counts, about.
HELD = 1 << 21
SLICE = 1 << 20
PER_FILE = 1 << 21
#: Bytes of text that are hashed at a time.
BYTES = 1 << 21
#: What a file tells of an n-gram's hash besides its bucket: 40 bits.
PRINT = np.uint64((1 << 40) - 1)

_FACTOR = np.uint64(0x9E6C63D0876A9A99)
#: What a block's columns are: counts of n-grams, or what follows them as contexts.
COUNTS, CONTEXTS, SUMMARY = 0, 1, 2


def bits_for(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / PER_FILE))))


def upper(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of hashed keys, by their upper bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def gram_keys(ids: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given by a column for each place."""
    out = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        out = mix(out * _FACTOR + x.astype(np.uint64) + np.uint64(1))
    return out


# ---- contexts in a byte ------------------------------------------------------

# A context's total and how many of its followers count one, two and more is a code below 255 where the numbers
# are small: up to 6 of one, 3 of two, and one of 3 to 9 at most.
_ONES, _TWOS, _MORE = 7, 4, 7
_FEW = _ONES * _TWOS
_KNOWN = _FEW * (1 + _MORE)


def _decoder() -> np.ndarray:
    code = np.arange(256)
    ones, twos, more = code % _ONES, code // _ONES % _TWOS, code // _FEW
    out = np.stack([ones + 2 * twos + np.where(more, more + 2, 0), ones, twos, more > 0], axis=1)
    out[_KNOWN:] = 0
    return out.astype(np.int64)


_DECODED = _decoder()


def encode_contexts(sums: np.ndarray) -> dict[str, np.ndarray]:
    """Rows (total, ones, twos, more) as bytes, and whole numbers apart for those that don't fit."""
    total, ones, twos, more = sums.T
    rest = total - ones - 2 * twos
    fits = (ones < _ONES) & (twos < _TWOS) & (more < 2) & (rest < _MORE + 3)
    code = np.where(fits, ones + _ONES * twos + _FEW * np.maximum(rest - 2, 0), 255).astype(np.uint8)
    at = np.flatnonzero(~fits)
    return {"context": code, "context_at": at.astype(np.uint32), "context_of": sums[at].astype(np.int64).reshape(-1)}


def decode_contexts(arrays: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    code = arrays["context"][at]
    out = _DECODED[code]
    big = np.flatnonzero(code == 255)
    if len(big):
        out[big] = arrays["context_of"].reshape(-1, 4)[np.searchsorted(arrays["context_at"], at[big].astype(np.uint32))]
    return out


# ---- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them.

    Ids from 1 on are dealt to words by the bits of their counts, most first, then by
    file and hash; so ids of what is frequent are small, which blocks of them need to
    be. The id 0 stands before a text's first word. Level k holds n-grams of k words.
    The highest counts occurrences, a lower one the different words seen before the
    n-gram.
    """

    path: str
    order: int
    tokens: int
    words: int
    word_bits: int
    starts: np.ndarray  # the first id of the words of a file whose count has so many bits
    bits: int
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    types: int = 0  # n-grams of two words
    left: float = 1.0  # the share of level 1 that goes to all words alike
    there: dict[int, np.ndarray] = field(default_factory=dict)  # which buckets of a level have a file

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their counts; -1 and 0 where unknown."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, raw = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for b, part in by_value(upper(unique, self.word_bits)):
            if self.there[0][b]:
                arrays = load(f"{self.path}/0-{b}")
                at = np.searchsorted(arrays["hash"], unique[part])
                at[at == len(arrays["hash"])] = 0
                hit = np.flatnonzero(arrays["hash"][at] == unique[part])
                at = at[hit]
                n = widen(arrays, "raw", at)
                ids[part.start + hit] = self.starts[b, bit_length(n)] + arrays["nth"][at]
                raw[part.start + hit] = n
        return ids[back], raw[back]

    @property
    def files(self) -> int:
        return 1 << self.bits

    def rare_from(self) -> int:
        """Words from this id on have less than an eighth of the counts that a file holds."""
        return int(self.starts[0, int(bit_length(np.array([max(1, PER_FILE // 8)]))[0]) - 1])

    def buckets(self, ids: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        """The files of n-grams.

        Those of three words and more go by the words that both the n-gram without its
        first word and the one without its last share, which sends what is summed for
        these once; where every shared word is frequent, by all words, so no word or
        phrase makes a file larger than others.
        """
        if len(ids) == 1:
            return ids[0].astype(np.int64) % self.files
        out = upper(keys, self.bits)
        if len(ids) > 2 and self.bits:
            rare = np.flatnonzero(np.maximum.reduce(ids[1:-1]) >= self.rare_from())
            out[rare] = upper(gram_keys([x[rare] for x in ids[1:-1]]), self.bits)
        return out

    def find(self, ids: list[np.ndarray], top: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts of n-grams of known words, and rows (total, ones, twos, more) of them as contexts, unless ``top``."""
        n, k = len(ids[0]), len(ids)
        counts, contexts = np.zeros(n, np.int64), None if top else np.zeros((n, 4), np.int64)
        keys = gram_keys(ids)
        spread = self.buckets(ids, keys)
        prints = keys & PRINT
        # the bucket and the print's upper bits are the order of the files' arrays
        order = np.argsort((spread.astype(np.uint64) << np.uint64(40)) | prints if self.bits <= 24 else np.lexsort((prints, spread)).argsort())
        spread, high, low = spread[order], (prints[order] >> np.uint64(8)).astype(np.uint32), (prints[order] & np.uint64(255)).astype(np.uint8)
        for b, part in by_value(spread):
            if not self.there[k][b]:
                continue
            arrays = load(f"{self.path}/{k}-{b}")
            at, hit = _search(arrays["high"], arrays["low"], high[part], low[part])
            own = order[part][hit]
            counts[own] = widen(arrays, "count", at[hit])
            if contexts is not None:
                contexts[own] = decode_contexts(arrays, at[hit])
        return counts, contexts

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``, for level 1; ids may be -1."""
        counts, contexts = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        spread = np.where(ids >= 0, ids % self.files, self.files)
        order = np.argsort(spread.astype(np.uint16) if self.bits < 16 else spread, kind="stable")
        for b, part in by_value(spread[order]):
            if self.there[1][b]:
                own = order[part]
                arrays, at = load(f"{self.path}/1-{b}"), ids[own] // self.files
                counts[own], contexts[own] = widen(arrays, "count", at), decode_contexts(arrays, at)
        return counts, contexts


def _search(high: np.ndarray, low: np.ndarray, want_high: np.ndarray, want_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of sorted wanted prints in sorted prints, and the numbers of the wanted that are there."""
    at = np.searchsorted(high, want_high)
    hit = np.zeros(len(at), bool)
    left = np.arange(len(at))
    while len(left):
        left = left[at[left] < len(high)]
        left = left[high[at[left]] == want_high[left]]
        same = low[at[left]] == want_low[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
    return at, np.flatnonzero(hit)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of every text and its end, and where each text's tokens begin."""
    words, first = word_hashes(data, offsets)
    n = len(offsets) - 1
    begin = first + np.arange(n + 1)
    out = np.full(len(words) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = words
    return out, begin


def places(x: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """A column for each place of the n-gram that ends at a token; 0 stands before a text's first."""
    out = [x]
    for _ in range(order - 1):
        before = np.empty_like(x)
        before[1:] = out[-1][:-1]
        before[begin[:-1]] = 0
        out.append(before)
    return out[::-1]


def _compact(ids: list[np.ndarray], sums: list[np.ndarray], words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """N-grams in order, neighbours that are equal added up; the order's last bits are left open where 64 don't hold all."""
    width = max(1, int(words).bit_length())
    free, key = 64, np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        take = min(width, free)
        free -= take
        key |= (x.astype(np.uint64) >> np.uint64(width - take)) << np.uint64(free)
        if not free:
            break
    order = np.argsort(key)
    ids = [x[order] for x in ids]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ids[0][1:] != ids[0][:-1]
    for x in ids[1:]:
        fresh[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(fresh)
    return [x[first] for x in ids], [np.add.reduceat(s[order], first) if len(first) else s for s in sums]


BLOCK = "bucket long, role int, data binary"


def _block_batch(rows: list[tuple[int, int, bytes]]) -> dict[str, pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return {"bucket": pa.array(columns[0], pa.int64()), "role": pa.array(columns[1], pa.int32()), "data": pa.array(columns[2], pa.binary())}


def _blocks(ids: list[np.ndarray], sums: list[np.ndarray], role: int, model: Model) -> Iterator[tuple[int, int, bytes]]:
    """N-grams with their sums, in order, as blocks for the files they belong to."""
    if not len(ids[0]):
        return
    spread = model.buckets(ids, gram_keys(ids))
    small = spread.astype(np.uint16) if int(spread.max()) < 1 << 16 else spread
    order = np.argsort(small, kind="stable")
    columns = [c[order] for c in (*ids, *sums)]
    for b, part in by_value(spread[order]):
        yield b, role, squeeze([c[part] for c in columns])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text"), BYTES):
            held.append(token_hashes(data, offsets)[0])
            size += len(held[-1])
            if size >= 2 * HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def bit_length(n: np.ndarray) -> np.ndarray:
    """How many bits numbers below 2**53 have."""
    return np.frexp(n.astype(np.float64))[1]


def _write_words(table: pa.Table, path: str, bits: int) -> pa.Table:
    """Write a file of words; return how many have counts of so many bits."""
    keys, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    b = int(upper(keys[:1], bits)[0])
    kinds = bit_length(n[order])
    by_kind = np.argsort(kinds, kind="stable")
    sizes = np.bincount(kinds, minlength=64)
    nth = np.empty(len(kinds), np.uint32)
    nth[by_kind] = np.arange(len(kinds)) - (np.cumsum(sizes) - sizes)[kinds[by_kind]]
    save(f"{path}/0-{b}", {"hash": keys[order], "nth": nth, **narrow("raw", n[order])})
    return pa.table({"bucket": pa.array([b], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64()))})


def _count_grams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The n-grams of the highest order, counted by parts, as blocks."""
    kind = np.uint32 if model.words < (1 << 32) - 1 else np.uint64

    def out() -> pa.RecordBatch:
        ids = [np.concatenate(c) for c in zip(*held, strict=True)]
        ids, (n,) = _compact(ids, [np.ones(len(ids[0]), np.int64)], model.words)
        return pa.RecordBatch.from_pydict(_block_batch(list(_blocks(ids, [n], COUNTS, model))))

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text"), BYTES):
            hashes, begin = token_hashes(data, offsets)
            held.append(places(model.look_up(hashes)[0].astype(kind), begin, model.order))
            size += len(hashes)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _gather(table: pa.Table, role: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams and sums of all blocks of a role."""
    found = [unsqueeze(d.as_py()) for r, d in zip(table.column("role").to_pylist(), table.column("data"), strict=True) if r == role]
    if not found:
        return [], np.zeros(0)
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return columns[:width], np.stack([c.astype(np.int64) for c in columns[width:]], axis=1)


def _merger(model: Model, level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _merge(table, model, level) if level > 1 else _merge_words(table, model)


def _merge(table: pa.Table, model: Model, level: int) -> pa.Table:
    """Write a file of a level's n-grams; return what is summed for the level below, and counts of counts."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    every: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]] = []
    for role, columns in ((COUNTS, 1), (CONTEXTS, 4)):
        ids, sums = _gather(table, role, level)
        if not ids:
            every.append((np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * level, np.zeros((0, columns), np.int64)))
            continue
        prints = gram_keys(ids) & PRINT
        order = np.argsort(prints)
        prints = prints[order]
        first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        every.append((prints[first], [x[order[first]] for x in ids], np.add.reduceat(sums[order], first, axis=0)))
    (prints, ids, counts), (of, _, sums) = every
    counts = counts[:, 0]
    names = np.union1d(prints, of) if level < model.order else prints
    arrays = {"high": (names >> np.uint64(8)).astype(np.uint32), "low": (names & np.uint64(255)).astype(np.uint8)}
    at = np.searchsorted(names, prints)
    all_counts = np.zeros(len(names), np.int64)
    all_counts[at] = counts
    arrays |= narrow("count", all_counts)
    if level < model.order:
        contexts = np.zeros((len(names), 4), np.int64)
        contexts[np.searchsorted(names, of)] = sums
        arrays |= encode_contexts(contexts)
    save(f"{model.path}/{level}-{bucket}", arrays)
    rows = [(-1, SUMMARY, _summary(level, bucket, counts))]
    one = np.ones(len(counts), np.int64)
    for role, part, values in ((COUNTS, ids[1:], [one]), (CONTEXTS, ids[:-1], [counts, counts == 1, counts == 2, counts > 2])):
        part, values = _compact(part, [v.astype(np.int64) for v in values], model.words)
        rows += _blocks(part, values, role, model)
    return pa.table(_block_batch(rows))


def _summary(level: int, bucket: int, counts: np.ndarray) -> bytes:
    return np.array([level, bucket, *((counts == k).sum() for k in (1, 2, 3, 4)), (counts > 2).sum(), (counts > 0).sum()], np.int64).tobytes()


def _merge_words(table: pa.Table, model: Model) -> pa.Table:
    """Write a file of level 1; return the summaries."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    size = model.words // model.files + 1
    counts, contexts = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
    for role, out in ((COUNTS, counts[:, None]), (CONTEXTS, contexts)):
        ids, sums = _gather(table, role, 1)
        if ids:
            np.add.at(out, ids[0].astype(np.int64) // model.files, sums)
    save(f"{model.path}/1-{bucket}", narrow("count", counts) | encode_contexts(contexts))
    return pa.table(_block_batch([(-1, SUMMARY, _summary(1, bucket, counts))]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes off counts of 1, 2 and more; where counts of counts are missing, a fixed share."""
    if not (n1 and n2):
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def train(docs: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Count all of ``docs`` and write the arrays of a model of ``order`` words, two at least, to the shared folder.

    Words are counted and dealt over files by their hash; a word's id is its place.
    Tasks count their own n-grams of ids first and send them as compressed sorted
    blocks, dealt as Model.buckets says. A file's merge writes its n-grams and sends
    what the level below needs: each n-gram without its first word, to be counted,
    and each without its last, with what follows it. So level by level down to
    words, of which one comes at most twice from each file of pairs. A file is
    named by its level and bucket and written whole, so a lost task is repeated.
    Counts have 64 bits. The driver holds a few numbers for each file.

    Null texts count as empty, an empty text as its end alone, a text of any length
    as one; repeated rows count again. An empty table gives a model that knows no
    word. Other columns are not read.
    """
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark = docs.sparkSession
    path = shared_path(spark, "ngrams")
    texts = docs.select(F.col(text).alias("text"))
    words = materialize(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    size = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    v, n, bits = size["v"], size["n"], bits_for(size["v"])
    keyed = words.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = np.zeros((1 << bits, 64), np.int64)
    for r in keyed.groupBy("bucket").applyInArrow(lambda t: _write_words(t, path, bits), "bucket long, sizes array<long>").collect():
        sizes[r["bucket"]] = r["sizes"]
    # the highest bits first, and of equal ones the first file
    ordered = sizes[:, ::-1].T.reshape(-1)
    starts = 1 + (np.cumsum(ordered) - ordered).reshape(64, -1).T[:, ::-1]
    model = Model(path, order, n, v, bits, starts, bits_for(n), there={0: sizes.any(axis=1)})
    blocks = texts.mapInArrow(partial(_count_grams, model=model), BLOCK)
    for level in range(order, 0, -1):
        blocks = blocks.groupBy("bucket").applyInArrow(_merger(model, level), BLOCK)
    there = {0: model.there[0]} | {k: np.zeros(model.files + 1, bool) for k in range(1, order + 1)}
    of = {k: np.zeros(6, np.int64) for k in range(1, order + 1)}
    with freed_shuffles(spark):
        summaries = blocks.collect()
    for r in summaries:
        level, bucket, *numbers = np.frombuffer(r["data"], np.int64).tolist()
        there[level][bucket] = True
        of[level] += numbers
    found = {k: discounts(*(int(x) for x in of[k][:4])) for k in of}
    types = int(of[2][5])
    left = sum(d * float(k) for d, k in zip(found[1], of[1][[0, 1, 4]], strict=True)) / types if types else 1.0
    return replace(model, discounts=found, types=types, left=left, there=there)


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array((0.0, *d))[np.minimum(counts, 3)], 0)


def _shares(contexts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """A context's total, and what its followers leave to the level below; 0 and 1 for one not seen."""
    out = np.zeros((len(contexts), 2))
    out[:, 0] = contexts[:, 0]
    seen = contexts[:, 0] > 0
    out[:, 1] = 1
    out[seen, 1] = contexts[seen, 1:] @ np.array(d) / contexts[seen, 0]
    return out


def _probabilities(model: Model, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Every token's probability after the ones before it."""
    order, v, n = model.order, model.words, len(ids)
    grams = places(ids, begin, order)
    starts = begin[:-1]

    def after(shares: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(shares)
        out[1:] = shares[:-1]
        out[starts] = first
        return out

    p = np.full(n, model.left / (v + 1))
    for k in range(1, order + 1):
        ahead = after(shares, first) if k > 1 else None  # noqa: F821
        shares = np.zeros((n, 2)) if k < order else None
        # all of a level's n-grams that begin before a text's first word
        none = [np.zeros(1, np.int64)] * k
        if k < order:
            d = model.discounts[k + 1]
            first = _shares(model.of_words(none[0])[1] if k == 1 else model.find(none, False)[1], d)[0]
        for a in range(0, n, SLICE):
            part = slice(a, min(a + SLICE, n))
            if k == 1:
                seen, contexts = model.of_words(ids[part])
                if model.types:
                    p[part] += _less(seen, model.discounts[1]) / model.types
            else:
                own = [g[part] for g in grams[-k:]]
                known = np.flatnonzero(np.minimum.reduce(own) >= 0)
                seen, contexts = np.zeros(part.stop - a, np.int64), np.zeros((part.stop - a, 4), np.int64)
                if len(known):
                    seen[known], more = model.find([g[known] for g in own], k == order)
                    if more is not None:
                        contexts[known] = more
                total, share = ahead[part].T
                p[part] = _less(seen, model.discounts[k]) / np.maximum(total, 1) + share * p[part]
            if k < order:
                shares[part] = _shares(contexts, d)
    return p


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    n, v = model.tokens, model.words
    for batch in batches:
        tokens, known = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        base, score = np.zeros(len(batch)), np.zeros(len(batch))
        held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            # texts of many chunks go through the model's files once
            offset = np.cumsum([0, *(len(x[2]) for x in held)])
            begin = np.concatenate([*(x[4][:-1] + o for x, o in zip(held, offset, strict=False)), offset[-1:]])
            a, b = held[0][0], held[-1][1]
            ids, raw = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            held.clear()
            tokens[a:b] = np.diff(begin)
            known[a:b] = np.add.reduceat((raw > 0).astype(np.int64), begin[:-1])
            base[a:b] = np.add.reduceat(np.log10((raw + 0.1) / (n + 0.1 * (v + 1))), begin[:-1])
            score[a:b] = np.add.reduceat(np.log10(_probabilities(model, ids, begin)), begin[:-1])

        size = 0
        for a, b, data, offsets in chunks(batch.column("text"), BYTES):
            hashes, begin = token_hashes(data, offsets)
            held.append((a, b, *model.look_up(hashes), begin))
            size += len(hashes)
            if size >= SLICE:
                flush()
                size = 0
        if held:
            flush()
        cols = [batch.column("key"), batch.column("held_out"), *(pa.array(x) for x in (tokens, known, np.full(len(batch), n, np.int64), base, score))]
        yield pa.RecordBatch.from_arrays(cols, ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", held_out: str | None = None) -> DataFrame:
    """Every row's token counts, its unigram ``base_score``, the model's ``score`` (both log10 of the text's probability) and ``perplexity``.

    A null or empty text is its end alone, a text of any length is scored whole.
    Rows that repeat or have a null key are scored like others; an empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (F.col(held_out) if held_out else F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.mapInArrow(partial(_score, model=model), schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("key", key)


def hold_out(docs: DataFrame, key: str = "doc_id", parts: int = 10) -> DataFrame:
    """Add ``held_out``: crc32 of the key as text (null: empty) leaves no rest by ``parts``."""
    return docs.withColumn("held_out", F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % parts == 0)
