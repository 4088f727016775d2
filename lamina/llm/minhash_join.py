"""Near duplicates by an inverted join of MinHash signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import Scratch, lookup_join, materialize
from lamina.llm.tokens import chunks, mix, shingles, word_hashes

#: Coordinates of a signature, and how many must agree. A pair at similarity 0.8 agrees in 51.2 of 64 on
#: average with a deviation of 3.2; fewer than 36 happens to about four such pairs in a million.
COORDINATES = 64
MATCHES = 36

Keep = Callable[[DataFrame, str], DataFrame]


def _texts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every text its number in the batch and its sorted distinct shingle hashes."""
    for a, _, data, offsets in chunks(batch.column("text")):
        runs, begin = shingles(*word_hashes(data, offsets), width)
        for k in range(len(begin) - 1):
            own = np.sort(runs[begin[k] : begin[k + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield a + k, own


def _nodes(every: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set, from sums over its members that do not depend on their order."""
    one = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1])
    two = np.add.reduceat(mix(every + np.uint64(0x14057B7EF767814F)), ends[:-1])
    return mix(one ^ mix(two + np.diff(ends).astype(np.uint64)))


def _sign(batches: Iterator[pa.RecordBatch], width: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20)
    turn = rng.integers(0, 2**64, coordinates, np.uint64)
    factor = rng.integers(0, 2**64, coordinates, np.uint64) | np.uint64(1)
    for batch in batches:
        n, node = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64)
        signatures = np.zeros((len(batch), coordinates), np.uint64)
        pending: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not pending:
                return
            rows = [k for k, _ in pending]
            begin = np.concatenate(([0], np.cumsum([len(x) for _, x in pending])))[:-1]
            every = np.concatenate([x for _, x in pending])
            n[rows] = [len(x) for _, x in pending]
            node[rows] = _nodes(every, np.append(begin, len(every)))
            for c in range(coordinates):
                drawn = (every ^ turn[c]) * factor[c]
                drawn ^= drawn >> np.uint64(32)
                drawn *= np.uint64(0xD6E8FEB86659FD93)
                signatures[rows, c] = np.minimum.reduceat(drawn, begin)
            pending.clear()

        held = 0
        for k, own in _texts(batch, width):
            if len(own):
                pending.append((k, own))
                held += len(own)
                if held >= 1 << 15:
                    flush()
                    held = 0
        flush()
        flat = pa.array(signatures.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("id"), pa.array(n), pa.array(node.view(np.int64)), pa.FixedSizeListArray.from_arrays(flat, coordinates).cast(pa.list_(pa.int64()))],
            ["key", "id", "n", "node", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """(node, runs) of every text whose node may be among the wanted, in batches of bounded size."""
    for batch in batches:
        pending: list[np.ndarray] = []
        held = 0
        for _, own in _texts(batch, width):
            if len(own):
                pending.append(own)
                held += len(own)
            if held >= 1 << 18:
                yield _set_batch(pending, wanted)
                pending, held = [], 0
        if pending:
            yield _set_batch(pending, wanted)


def _set_batch(own: list[np.ndarray], wanted: Broadcast | None) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    every = np.concatenate(own)
    nodes = _nodes(every, ends)
    runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every.view(np.int64)))
    out = pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), runs], ["node", "runs"])
    return out if wanted is None else out.filter(pa.array(may_be_in(wanted.value, nodes)))


def finder(docs: DataFrame, key: str, text: str) -> Column:
    """A number that finds a row's text again: its id, if that is a number, or a hash of it; for a null id a hash of the text."""
    own = F.col(key) if docs.schema[key].dataType == T.LongType() else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    return F.coalesce(own, F.xxhash64(F.col(text)))


def signatures(docs: DataFrame, key: str, text: str, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """(key, id, n, node, signature) of every row: what finds it, its id, the size of its shingle set, the set's own hash, and its minima."""
    rows = docs.select(finder(docs, key, text).alias("key"), F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(partial(_sign, width=width, coordinates=coordinates), f"key long, id {kind}, n long, node long, signature array<long>")


# ---- which texts are needed again ----------------------------------------------


#: A filter has so many bits for a node, up to so many bits in all, in chunks of so many.
FILTER_BITS, FILTER_MOST, FILTER_CHUNK = 10, 31, 20
_PROBES = (0, 11, 22, 33)


def node_filter(nodes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` nodes, which are hashes already: a bit array of up to 256 MB whatever the input."""
    bits = min(FILTER_MOST, max(FILTER_CHUNK, (FILTER_BITS * n).bit_length()))
    places = F.array(*[F.shiftrightunsigned("node", p).bitwiseAND(F.lit((1 << bits) - 1)) for p in _PROBES])
    each = nodes.select(F.explode(places).alias("place"))
    each = each.select(F.shiftright("place", FILTER_CHUNK).alias("chunk"), F.col("place").bitwiseAND(F.lit((1 << FILTER_CHUNK) - 1)).cast("int").alias("place")).distinct()

    def chunk(t: pa.Table) -> pa.Table:
        held = np.zeros(1 << FILTER_CHUNK, bool)
        held[t.column("place").to_numpy()] = True
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int64()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (FILTER_CHUNK - 3)
    for r in each.groupBy("chunk").applyInArrow(chunk, "chunk long, held binary").toLocalIterator():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["held"], np.uint8)
    return out


def may_be_in(held: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    out = np.ones(len(nodes), bool)
    for p in _PROBES:
        at = (nodes >> np.uint64(p)) & np.uint64(8 * len(held) - 1)
        out &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return out


def active_sets(docs: DataFrame, active: DataFrame, members: DataFrame, key: str, text: str, width: int, limit: int) -> DataFrame:
    """(node, runs) of the active nodes, from their texts.

    Up to ``limit`` keys are broadcast to the scan. Beyond, all texts are shingled
    again and sets of other nodes left out by a filter of bounded size, so texts are
    never shuffled; the few that it lets through fall out by the join that follows.
    """
    texts = docs.select(finder(docs, key, text).alias("key"), F.col(text).alias("text"))
    keys = active.select("key").distinct()
    held = None
    if keys.count() <= limit:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    else:
        held = docs.sparkSession.sparkContext.broadcast(node_filter(members, members.count()))
    found = texts.mapInArrow(lambda b: _sets(b, width, held), "node long, runs array<long>")
    # a key may have several texts: only sets of active nodes stay
    return found.join(members, "node", "left_semi").dropDuplicates(["node"])


def postings(nodes: DataFrame, keep: Keep, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(token, node, weight) for the prefix of every node whose signature could meet another in ``matches`` coordinates.

    A token is a coordinate with its value. Ordered from rare to frequent, two
    signatures with ``matches`` tokens in common share one among the first
    ``coordinates - matches + 1`` of each. Tokens that only one node has come first
    and find nothing, so a node with m shared tokens posts its m + matches' rarest
    beyond them, and nodes with fewer shared tokens than ``matches`` post nothing.
    """
    tokens = nodes.select("node", F.posexplode("signature").alias("c", "v")).select("node", F.xxhash64("c", "v").alias("token"))
    shared = keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "tokens")
    held = tokens.join(shared, "token")
    lists = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("all")).filter(F.size("all") >= matches)
    prefix = F.slice("all", F.lit(1), F.size("all") - matches + 1)
    weight = F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + x["freq"])
    return lists.select("node", weight.alias("weight"), F.explode(prefix).alias("x")).select(F.col("x.token").alias("token"), "node", "weight")


def merge_components(labels: DataFrame, links: DataFrame, keep: Keep) -> DataFrame:
    """Join the components of ``labels`` (node, comp) that ``links`` (a, b) of nodes connect; a component is named by its least name.

    Works on the graph of components. Every turn takes the least name among the
    neighbours and then, twice, the name of that name, so paths shorten fast.
    """
    of = labels.select(F.col("node"), F.col("comp"))
    edges = links.join(of.withColumnRenamed("node", "a").withColumnRenamed("comp", "x"), "a").join(of.withColumnRenamed("node", "b").withColumnRenamed("comp", "y"), "b")
    edges = edges.filter("x != y").select("x", "y").distinct()
    edges = keep(edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    names = keep(edges.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.least("v", "y").alias("name")), "names")
    while True:
        near = edges.join(names, edges.y == names.v).groupBy("x").agg(F.min("name").alias("least"))
        lower = names.join(near, names.v == near.x).select("v", F.least("name", "least").alias("to"), "name")
        for _ in range(2):
            jump = names.select(F.col("v").alias("to"), F.col("name").alias("further"))
            lower = lower.join(jump, "to").select("v", F.least("to", "further").alias("to"), "name")
        new = keep(lower.select("v", F.col("to").alias("name"), (F.col("to") != F.col("name")).alias("moved")), "names")
        names = new.select("v", "name")
        if not new.filter("moved").limit(1).count():
            break
    renamed = labels.join(names.select(F.col("v").alias("comp"), "name"), "comp", "left")
    return keep(renamed.select("node", F.coalesce("name", "comp").alias("comp")), "components")


def still_open(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, n, foreign) of the nodes that may yet link with another component, exactly.

    A partner's set holds ``percent`` of the node's own runs at least, so as many of
    them must occur in some other component. Nodes with more runs of their own, or
    of their component's, can be left out of all lists.
    """
    runs = sets.join(labels, "node").select("node", "comp", F.explode("runs").alias("run"))
    spread = runs.groupBy("run").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("run")
    foreign = runs.select("node", "run").join(spread, "run").groupBy("node").agg(F.count(F.lit(1)).alias("foreign"))
    return sets.select("node", F.size("runs").cast("long").alias("n")).join(foreign, "node").filter(100 * F.col("foreign") >= percent * F.col("n"))


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether two nodes' sizes and foreign runs leave room for a link: what they share is foreign to both."""
    most = F.least(f"foreign_{x}", f"foreign_{y}")
    return (100 + percent) * most >= percent * (F.col(f"n_{x}") + F.col(f"n_{y}"))


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, keep: Keep, matches: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that agree in ``matches`` coordinates and whose whole sets overlap by ``percent`` of their union."""
    sign = nodes.select("node", "n", "signature")
    left = sign.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = sign.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    close = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(agree >= matches)
    close = keep(close.select("a", "b", "na", "nb"), "close")
    ra, rb = sets.select(F.col("node").alias("a"), F.col("runs").alias("ra")), sets.select(F.col("node").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    return close.join(ra, "a").join(rb, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def links_to_large(against: DataFrame, large: DataFrame, sets: DataFrame, labels: DataFrame, keep: Keep, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) of nodes with large components, one for each node and block of a component at most.

    ``against`` has (x, comp): node x is to be compared with all members of the
    component. Members are dealt to blocks of about ``block`` sets, nodes to
    blocks of their own, and each pair of blocks is one comparison by a table of the
    nodes' runs, so no pair of sets becomes a row and no group meets in one task.
    """
    wide = F.ceil(F.col("size") / block).cast("int")
    members = sets.join(labels, "node").join(large, "comp").withColumn("part", F.pmod(F.xxhash64("node"), wide).cast("int"))
    nodes = against.join(large, "comp").join(sets.select(F.col("node").alias("x"), F.col("runs")), "x")
    each = nodes.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("lanes"))
    nodes = nodes.join(each, "comp").withColumn("lane", F.pmod(F.xxhash64("x"), F.col("lanes")).cast("int"))
    nodes = nodes.select("comp", "lane", F.explode(F.sequence(F.lit(0), wide - 1)).alias("part"), F.col("x").alias("node"), "runs")
    members = members.join(each, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "part", "node", "runs")

    nodes, members = keep(nodes, "against"), keep(members, "members")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _links(left, right, percent)

    keys = ["comp", "lane", "part"]
    return nodes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _links(nodes: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    found: list[tuple[int, int]] = []
    if len(nodes) and len(members):
        runs = [np.asarray(x.values) for x in nodes.column("runs")]
        size = np.array([len(x) for x in runs])
        flat = np.concatenate(runs)
        order = np.argsort(flat, kind="stable")
        table, owner = flat[order], np.repeat(np.arange(len(runs)), size)[order]
        first = np.flatnonzero(np.concatenate(([True], table[1:] != table[:-1])))
        values, last = table[first], np.append(first[1:], len(table))
        names, open_nodes = nodes.column("node").to_pylist(), np.ones(len(runs), bool)
        for member, own in zip(members.column("node").to_pylist(), members.column("runs"), strict=True):
            own = np.asarray(own.values)
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            at = at[values[at] == own]
            many = last[at] - first[at]
            hit = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
            both = np.bincount(owner[hit], minlength=len(runs))
            linked = open_nodes & ((100 + percent) * both >= percent * (size + len(own)))
            for k in np.flatnonzero(linked):
                found.append((names[k], member))
            open_nodes &= ~linked
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    rounds: int = 12,
    slack: int = 4,
    short: int = 16,
    limit: int = 1_000_000,
) -> DataFrame:
    """Components of documents whose shingle sets overlap by ``percent`` of their union.

    Returns for every row the key, ``n_shingles``, ``component_id`` (the least key
    reachable) and ``kept`` (it is the row's own). Rows without words have
    ``n_shingles`` 0 and link with nothing. Rows with equal sets form one node from
    the start, so copies are never paired; repeated rows and keys are such copies,
    or linked by their texts alone. Rows with a null key take part; their component
    is the least key that is not null, null if there is none. Keys are of any type
    that has an order. Texts of any length are taken whole; an empty table gives an
    empty result; other columns, whatever their names, are not read.

    Nodes are posted under the rare part of their signatures' tokens. Instead of
    pairing all nodes of a list, each round pairs a list's nodes with one of them,
    the hub of that round (lists up to ``short`` are paired whole), and drops nodes that can link with no other component and
    lists that have become one component. Once the pairs between what a list's
    largest component leaves out and the list are at most ``slack`` for each
    posting, or a round has not halved them, or after ``rounds``, exactly those pairs
    that cross components are made, so no link is lost, and a large group costs as
    many pairs as it has members for each hub; components over ``short`` are then compared in blocks.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keep = scratch.keep
    # tables with signatures are the largest, and go as soon as smaller ones have what is needed of them
    signed = keep(signatures(docs, key, text, width, coordinates), "signatures")
    grouped = signed.filter("n > 0").groupBy("node")
    whole = keep(grouped.agg(F.min("key").alias("key"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    rows = keep(signed.select("id", "n", "node"), "rows")
    scratch.free(signed)
    mark = scratch.mark()
    posted = keep(postings(whole, keep, coordinates, matches), "postings")
    scratch.free_since(mark, posted)
    members = keep(posted.select("node").distinct(), "posted")
    active = keep(whole.join(members, "node", "left_semi"), "active")
    nodes = keep(whole.select("node", "least"), "least")
    scratch.free(whole)
    sets = keep(active_sets(docs, active, members, key, text, width, limit), "sets")
    labels = members.select("node", F.col("node").alias("comp"))
    labels = keep(labels, "components")
    tried, before = None, None
    for turn in range(rounds):
        mark = scratch.mark()
        # what is out stays out: components only grow
        alive = keep(still_open(sets, labels, percent), "alive")
        sets, posted = sets.join(alive, "node", "left_semi"), posted.join(alive, "node", "left_semi")
        placed = posted.join(labels, "node").join(alive, "node")
        # at first the node whose tokens most others have, then any
        rank = -F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        hub = F.min(F.struct(rank.alias("rank"), "node", "comp", "n", "foreign")).alias("hub")
        lists = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), hub).filter("low != high").select("token", "hub")
        # written first: a join of two shuffled tables can split a hot token's rows, one on top of an aggregate can't
        lists = keep(lists, "lists")
        inside = keep(placed.drop("weight").join(lists, "token"), "inside")
        by = inside.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = keep(by.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")), "main")
        work, size = main.agg(F.sum((F.col("all") - F.col("m.k")) * F.col("all")), F.sum("all")).first()
        if not size:
            break
        last = turn == rounds - 1 or work <= slack * size or (before is not None and 2 * work > before)
        before = work
        # a pair meets at every token of both prefixes, and is made at the least of them
        held = inside.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        inside = keep(inside.join(held, "node"), "prefixes")
        once = F.array_min(F.array_intersect("tokens_x", "tokens_y")) == F.col("token")
        side = lambda c: [F.col("tokens").alias(f"tokens_{c}"), F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"), F.col("n").alias(f"n_{c}"), F.col("foreign").alias(f"foreign_{c}")]
        meet = (F.col("token") == F.col("__token")) & (F.col("comp_x") != F.col("comp_y")) & may_link("x", "y", percent) & once
        some = main.select("token", F.col("m.comp").alias("main"), "all") if last else main.filter(F.col("all") <= short).select("token", F.lit(None).cast("long").alias("main"), "all")
        out = inside.join(some, "token").filter("main is null or comp != main").select(F.col("token").alias("__token"), *side("x"))
        others = inside.select("token", *side("y"))
        if last:
            sizes = keep(labels.join(alive, "node").groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
            large = sizes.filter(F.col("size") > short)
            others = others.join(large.select(F.col("comp").alias("comp_y")), "comp_y", "left_anti")
        pairs = others.join(out, meet).select("x", "y")
        if not last:
            hubs = inside.filter("comp != hub.comp").select(*side("x"), *[F.col(f"hub.{c}").alias(n) for c, n in (("node", "y"), ("n", "n_y"), ("foreign", "foreign_y"))])
            pairs = pairs.union(hubs.filter(may_link("x", "y", percent)).select("x", "y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = confirm(pairs, active, sets, keep, matches, percent)
        if last:
            held_large = by.join(large, "comp").select(F.col("token").alias("__token"), "comp")
            against = out.select("__token", "x", "comp_x").join(held_large, "__token").filter("comp != comp_x").select("x", "comp").distinct()
            links = links.union(links_to_large(against, large, sets, labels, keep, percent))
        labels = merge_components(labels, links, keep)
        if last:
            break
        scratch.free_since(mark, alive, pairs, labels)
    least = labels.join(active.select("node", "least"), "node")
    names = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = least.join(names, "comp").select("node", "component_id")
    final = nodes.join(named, "node", "left").select("node", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    final = keep(final, "named")
    linked = rows.filter("n > 0").select("id", "n", "node").join(final, "node").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    # all that came before is freed
    out = materialize(linked.unionByName(alone), "near-duplicates")
    scratch.remove()
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: its least key's first row.

    Rows with a null key stay. Where keys repeat, rows are told apart by key and text,
    so texts of one key that don't link are judged each for itself, and one of equal
    rows stays; only then texts are shuffled. What to drop is broadcast after a count,
    or else joined by salt.
    """
    repeats = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count() > 0
    name = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())) if repeats else F.col(key)
    named = docs.withColumn("__key", name)
    judged = near_duplicates(named.select("__key", F.col(text).alias("__text")), "__key", "__text", width, percent)
    if repeats:
        judged = judged.filter("__key is not null").select("__key", "component_id").distinct()
        judged = materialize(judged.join(named.select("__key", F.col(key).alias("__id")).distinct(), "__key"), "judged")
        first = judged.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("first"))
        judged = judged.join(first, "component_id").select("__key", (F.col("__key") == F.col("first.__key")).alias("kept"))
    else:
        judged = judged.select("__key", "kept")
    drop = materialize(judged.filter("not kept").select("__key").distinct(), "dropped")
    left = lookup_join(named, drop, ["__key"], "left_anti", 1_000_000)
    if repeats:
        left = left.filter("__key is null").unionByName(left.filter("__key is not null").dropDuplicates(["__key"]))
    return left.select(*docs.columns)
