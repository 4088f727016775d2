"""Exact top-k by inner product with a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialize

#: Candidates of a block that are evaluated between two looks at the bounds.
STEP = 256
#: Bytes of vectors in a block, unless one alone has more.
BYTES = 4 << 20
#: The ends of a score's range.
LAST = (1 << 63) - 1


def quantize(docs: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows whose key or vector is null, or with null or non-finite components, are left out."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False))).select("id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


def choose_pivots(rows: DataFrame, n: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of up to ``n`` pivots, far from each other, out of the ``sample`` rows of the least hashes."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    if not some:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    width = max(len(r["v"]) for r in some)
    some = [r for r in some if len(r["v"]) == width]
    ids, x = np.array([r["id"] for r in some], np.int64), np.array([r["v"] for r in some], np.float64)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return ids[chosen], x[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Block:
    """Candidate vectors with their squared lengths and, from the pivot table, their distances."""

    ids: np.ndarray
    x: np.ndarray
    square: np.ndarray
    far: np.ndarray
    exact: bool  # products fit a double's integers
    small: bool  # products fit 64 bits

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> Block:
        f = x.astype(np.float64)
        most = float(np.abs(f).max()) if x.size else 0.0
        exact = most**2 * x.shape[1] < 2**52
        return Block(ids, f if exact else x, (f * f).sum(1), far, exact, most**2 * x.shape[1] < 2**62)

    def products(self, at: np.ndarray, q: np.ndarray, f: np.ndarray) -> list[int]:
        """Scores of some candidates; those that 64 bits don't hold are the range's ends."""
        size = float(np.abs(f).max()) if len(f) else 0.0
        if self.exact and size**2 * len(f) < 2**52:
            return (self.x[at] @ f).astype(np.int64).tolist()
        if self.small and size**2 * len(f) < 2**62:
            return (self.x[at].astype(np.int64) @ q).tolist()
        whole = self.x[at].astype(np.int64).astype(object) @ q.astype(object) if len(f) else np.zeros(len(at), object)
        return [max(-LAST - 1, min(LAST, int(s))) for s in whole]


def search_block(block: Block, query: int, q: np.ndarray, far: np.ndarray, k: int, floor: float) -> tuple[list[tuple[int, int]], int]:
    """The best k (score, id) of a block for one query, and how many candidates were evaluated.

    The triangle inequality says |d(q, p) - d(x, p)| <= d(q, x) for every pivot p,
    so the largest such difference bounds the inner product from above:
    (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated from the highest bound
    on, and the search ends when the next bound is below the k-th score or ``floor``,
    a score that the whole table's k-th is known to reach. Bounds get a slack for
    rounding, and for distances of 32 bits; ties with the k-th are evaluated.
    """
    f = q.astype(np.float64)
    size = float(f @ f) + block.square
    if block.far.shape[1]:
        # a stored distance is off by its rounding, and by that of a difference of squares
        off = np.abs(block.far - far)
        lower = np.maximum(off - 1e-6 * (block.far + far) - 1, 0).max(1)
    else:
        lower = np.zeros(len(block.ids))
    upper = (size - lower * lower) / 2 + 1e-9 * (size + 1) + 1
    order = np.argsort(-upper, kind="stable")
    best: list[tuple[int, int]] = []
    least, seen = floor, 0
    for a in range(0, len(order), STEP):
        if upper[order[a]] < least:
            break
        at = order[a : a + STEP]
        at = at[upper[at] >= least]
        at = at[block.ids[at] != query]
        seen += len(at)
        best = sorted([*best, *zip(block.products(at, q, f), block.ids[at].tolist(), strict=True)], key=lambda s: (-s[0], s[1]))[:k]
        if len(best) == k:
            least = max(least, best[-1][0])
    return best, seen


BLOCK = "width int, ids binary, vectors binary, far binary"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with vectors packed into rows of one block each, with their part of the pivot table: distances of 32 bits, a row a vector."""
    for batch in batches:
        by_width: dict[int, list[int]] = {}
        for k, v in enumerate(batch.column("v")):
            by_width.setdefault(len(v), []).append(k)
        for width, own in by_width.items():
            step = max(1, min(rows, BYTES // (8 * max(1, width))))
            for a in range(0, len(own), step):
                part = batch.take(pa.array(own[a : a + step]))
                flat = part.column("v").flatten().to_numpy().astype("<i8")
                x = flat.reshape(len(part), width).astype(np.float64)
                far = pivot_distances(x, pivots if pivots.shape[1:] == (width,) else np.zeros((0, width))).astype("<f4")
                columns = [pa.array([width], pa.int32()), *(pa.array([c.tobytes()]) for c in (part.column("id").to_numpy().astype("<i8"), flat, far))]
                yield pa.RecordBatch.from_arrays(columns, ["width", "ids", "vectors", "far"])


def _unpack(width: int, ids: bytes, vectors: bytes, far: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(vectors, "<i8").reshape(len(names), width), np.frombuffer(far, "<f4").reshape(len(names), -1).astype(np.float64)


Packed = tuple[int, bytes, bytes, bytes]


def _answers(candidates: Packed, questions: list[Packed], pivots: np.ndarray, pivot_ids: np.ndarray, k: int) -> Iterator[tuple[int, int | None, int | None, int]]:
    """(query, id, score, 0) of a candidate block for blocks of queries, and for each query (query, null, null, how many were evaluated)."""
    width = candidates[0]
    block = Block.of(*_unpack(*candidates))
    own, names = (pivots, pivot_ids) if block.far.shape[1] else (np.zeros((0, width)), np.zeros(0, np.int64))
    for question in questions:
        if question[0] != width:
            continue
        asked, queries, far = _unpack(*question)
        # pivots are rows of the table: the k-th best of them is reached by the whole table's k-th
        score = queries.astype(np.float64) @ own.T
        for j, query in enumerate(asked.tolist()):
            known = np.sort(score[j][names != query])
            floor = min(known[-k], LAST) * 1.0 - 1 - 1e-6 * abs(known[-k]) if len(known) >= k else -np.inf
            best, seen = search_block(block, query, queries[j], far[j], k, floor)
            yield query, None, None, seen
            for s, i in best:
                yield query, i, s, 0


def _search(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, pivot_ids: np.ndarray, k: int, questions: Broadcast, report: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("width", "ids", "vectors", "far")), strict=True):
            out = [x for x in _answers(row, questions.value, pivots, pivot_ids, k) if report or x[1] is not None]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score", "seen"])


def top_k(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = 10,
    scale: int = 1024,
    pivots: int = 64,
    sample: int = 2000,
    block: int = 2048,
    query_block: int = 1024,
    small: int = 32 << 20,
    report: bool = False,
) -> DataFrame:
    """For each row whose key ``every`` divides, the ``k`` other rows of the highest integer inner product.

    Returns (query_id, rank, vec_id, score), with ``report`` also ``evaluated``, the
    number of candidates whose product was taken for the query; ties go to the smaller id. Vectors that
    are null or hold null or non-finite components take no part; vectors of
    different lengths do not meet. A repeated id is not its own candidate; repeated
    queries count once. Components and products that 64 bits don't hold count as
    the range's ends. Long vectors make smaller blocks. An empty table gives an
    empty result. Other columns, whatever their names, are not read.

    Candidates are packed into rows of ``block`` vectors, with their distances to the
    pivots, and stay where they are. Queries, in rows of ``query_block``, are the
    stated set against all rows: they are broadcast in groups of about ``small``
    bytes, counted first, one group after the other, each of which passes over the
    blocks once; groups beyond the first write their result. A pair of blocks is
    searched by pivots (see search_block) and gives at most k rows a query, which a
    window with a limit thins before and after its shuffle. Pivots come from a
    bounded sample and only speed the search.
    """
    spark = rows.sparkSession
    vectors = materialize(quantize(rows, key, vector, scale), "vectors")
    pivot_ids, table = choose_pivots(vectors, pivots, sample)
    candidates = vectors.repartition("id").mapInArrow(lambda b: _blocks(b, block, table), BLOCK)
    asked = vectors.filter(F.col("id") % every == 0).dropDuplicates(["id"])
    questions = materialize(asked.mapInArrow(lambda b: _blocks(b, query_block, table), BLOCK).withColumn("q", F.monotonically_increasing_id()), "queries")
    size = questions.agg(F.coalesce(F.sum(F.length("vectors") + F.length("ids") + F.length("far")), F.lit(0))).first()[0]
    groups = max(1, -(-size // small)) if small else max(1, questions.count())
    if groups > 1:
        candidates = materialize(candidates, "blocks")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    columns = ["query_id", "rank", "vec_id", "score", *(["evaluated"] if report else [])]
    answers = []
    for g in range(groups):
        own = questions.filter(F.pmod(F.xxhash64("q"), F.lit(groups)) == g) if groups > 1 else questions
        held = spark.sparkContext.broadcast([(r["width"], bytes(r["ids"]), bytes(r["vectors"]), bytes(r["far"])) for r in own.collect()])
        found = candidates.mapInArrow(lambda b, held=held: _search(b, table, pivot_ids, k, held, report), "query_id long, vec_id long, score long, seen long")
        if report:
            found = found.withColumn("evaluated", F.sum("seen").over(Window.partitionBy("query_id")))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).filter("vec_id is not null").select(*columns)
        if groups > 1:
            ranked = materialize(ranked, "answers")
            held.unpersist()
        answers.append(ranked)
    return reduce(DataFrame.unionByName, answers)
