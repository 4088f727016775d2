"""Personal data: fixed kinds, and identifiers found by bootstrapping from their contexts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lookup_join, materialize

#: Kinds in their order; the last is what the method finds.
KINDS = ("email", "ip", "card", "phone", "learned")

# The expressions of the base kinds. The address's local part is walked back from its "@".
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which the look-behind says to spare other starts
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PUNCTUATION = "\"'`()[]{}<>,;:.!?#$%&*|="


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every match of the four kinds, sorted."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words of six characters or more with four digits or more that touch no base span, without punctuation around them: a shape that the extraction does not ask for."""
    out: list[tuple[int, int]] = []
    at = 0
    taken = sorted((a, b) for a, _, b in base)
    k = 0
    for m in _DIGITS.finditer(text):
        if m.start() < at:
            continue
        a = m.start()
        while a > at and not _is_space(text[a - 1]):
            a -= 1
        end = _WORD.match(text, a).end()
        at = end
        word = text[a:end]
        a += len(word) - len(word.lstrip(_PUNCTUATION))
        b = end - (len(word) - len(word.rstrip(_PUNCTUATION)))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= 6 and sum(map(str.isdigit, text[a:b])) >= 4 and not any(s < b and a < e for s, e in taken[k : k + 4]):
            out.append((a, b))
    return out


def _is_space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


#: A slot takes a word, or a run of up to this many: an account number of 34 characters in groups of four has nine.
MAX_WORDS = 9
#: Longer words stand in patterns by their hash.
LONG_WORD = 40
_MEMO = 200_000


class Token(NamedTuple):
    """A word, parted into its core and the punctuation around it, or a base span."""

    lead: str
    core: str
    trail: str
    #: how patterns name it; a word of punctuation alone is its own name
    name: str
    #: 0 plain, 1 with digits or in capitals, 2 capitalised, 3 a base span
    shape: int


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _name(word: str) -> str:
    return word if len(word) <= LONG_WORD else f"~{_hash(word):x}"


def _token(word: str) -> Token:
    core = word.strip(_PUNCTUATION)
    if not core:
        return Token("", "", "", _name(word), 0)
    at = word.index(core)
    shape = 1 if any(map(str.isdigit, core)) or (len(core) > 1 and core.isupper()) else 2 if core[0].isupper() else 0
    return Token(word[:at], core, word[at + len(core) :], _name(core.lower()), shape)


class Places:
    """Texts as tokens, and the fillers of slots in them; remembers the words it has met."""

    def __init__(self) -> None:
        self._tokens: dict[str, Token] = {}
        self._hashes: dict[str, int] = {}

    def tokens(self, text: str, base: list[tuple[int, int, int]]) -> list[Token]:
        """The words of the text in order, each stretch of base spans that overlap being one token."""
        if len(self._tokens) > _MEMO:
            self._tokens.clear()
        out: list[Token] = []
        at = 0
        for a, b in merged(base):
            out += map(self._word, _WORD.findall(text, at, a))
            core = text[a:b]
            out.append(Token("", core, "", _name(core.lower()), 3))
            at = b
        out += map(self._word, _WORD.findall(text, at))
        return out

    def _word(self, word: str) -> Token:
        got = self._tokens.get(word)
        if got is None:
            got = _token(word)
            if len(word) <= LONG_WORD:
                self._tokens[word] = got
        return got

    def instance(self, tokens: list[Token], i: int, j: int) -> int:
        """The hash of what tokens i to j hold, whatever the case and the spaces."""
        text = tokens[i].core.lower() if i == j else " ".join(t.core for t in tokens[i : j + 1]).lower()
        got = self._hashes.get(text)
        if got is None:
            if len(self._hashes) > _MEMO:
                self._hashes.clear()
            got = self._hashes[text] = _hash(text)
        return got


def merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in base:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def joined(tokens: list[Token], j: int) -> bool:
    """Whether a filler may go on from token j to the next: no punctuation and no base span between or after."""
    if j + 1 >= len(tokens) or tokens[j].trail or tokens[j].shape == 3:
        return False
    t = tokens[j + 1]
    return bool(t.core) and not t.lead and t.shape != 3


def units(tokens: list[Token]) -> list[int]:
    """For every token the last token of its unit: a run of two to MAX_WORDS words of one shape belongs to its first word, all others stand alone."""
    out = list(range(len(tokens)))
    i, n = 0, len(tokens)
    while i < n:
        j = i
        if tokens[i].shape in (1, 2):
            while joined(tokens, j) and tokens[j + 1].shape == tokens[i].shape:
                j += 1
            if j - i < MAX_WORDS:
                out[i] = j
        i = j + 1
    return out


def sides(tokens: list[Token], i: int, j: int) -> tuple[str | None, str, str, str | None]:
    """The names of the two words before tokens i to j and of the two after; punctuation at the filler is a word, and so are the text's start and end (\"\")."""
    before = [tokens[k].name for k in range(max(0, i - 2), i)]
    after = [t.name for t in tokens[j + 1 : j + 3]]
    before = ([] if i > 1 else [""]) + before + ([tokens[i].lead] if tokens[i].lead else [])
    after = ([tokens[j].trail] if tokens[j].trail else []) + after + ([] if j + 2 < len(tokens) else [""])
    return (before[-2] if len(before) > 1 else None, before[-1], after[0], after[1] if len(after) > 1 else None)


def pattern_names(two: str | None, one: str, after: str, second: str | None) -> list[str]:
    """A pattern is the word or two words before, the words on both sides, or the word or two words after; words hold no spaces."""
    out = [f"1 {one}", f"3 {one} {after}", f"4 {after}"]
    if two is not None:
        out.append(f"2 {two} {one}")
    if second is not None:
        out.append(f"5 {after} {second}")
    return out


class Side:
    """What is known of the patterns with one word beside the slot."""

    __slots__ = ("alone", "pairs", "across")

    def __init__(self) -> None:
        self.alone: int | None = None
        self.pairs: dict[str, int] = {}
        self.across: dict[str, int] = {}


class Index:
    """Patterns by their words."""

    def __init__(self, patterns: list[str]) -> None:
        self.heads: dict[str, Side] = {}
        self.tails: dict[str, Side] = {}
        self.patterns = patterns
        for k in range(len(patterns)):
            sides, near, kind, far = self._where(k)
            side = sides.setdefault(near, Side())
            if kind in "14":
                side.alone = k
            else:
                (side.across if kind == "3" else side.pairs)[far] = k

    def _where(self, k: int) -> tuple[dict[str, Side], str, str, str]:
        kind, *words = self.patterns[k].split(" ")
        near, far = (words[1], words[0]) if kind == "2" else (words[0], words[-1])
        return (self.tails if kind in "45" else self.heads), near, kind, far

    def drop(self, k: int) -> None:
        sides, near, kind, far = self._where(k)
        side = sides[near]
        if kind in "14":
            side.alone = None
        else:
            del (side.across if kind == "3" else side.pairs)[far]
        if side.alone is None and not side.pairs and not side.across:
            del sides[near]

    def fillers(self, tokens: list[Token]) -> Iterator[tuple[int, int, int]]:
        """(pattern, first token, last token) of every slot that is filled.

        A pattern with a left side alone takes the unit that begins there, one with a
        right side alone the unit that ends there, one with both the shortest run of up
        to MAX_WORDS words between them.
        """
        heads, tails = self.heads, self.tails
        ends: list[int] | None = None
        begins: dict[int, int] = {}
        prev = ""
        last = len(tokens) - 1
        for i, t in enumerate(tokens):
            if t.core:
                head = heads.get(t.lead or prev)
                tail = tails.get(t.trail or (tokens[i + 1].name if i < last else ""))
                if head or tail:
                    if ends is None:
                        ends = units(tokens)
                        begins = {e: b for b, e in enumerate(ends) if e > b}
                    if head:
                        if head.alone is not None:
                            yield head.alone, i, ends[i]
                        if head.pairs and (k := head.pairs.get(sides(tokens, i, i)[0])) is not None:
                            yield k, i, ends[i]
                        if head.across:
                            for j in range(i, min(last + 1, i + MAX_WORDS)):
                                k = head.across.get(tokens[j].trail or (tokens[j + 1].name if j < last else ""))
                                if k is not None:
                                    yield k, i, j
                                    break
                                if not joined(tokens, j):
                                    break
                    if tail:
                        if tail.alone is not None:
                            yield tail.alone, begins.get(i, i), i
                        if tail.pairs and (k := tail.pairs.get(sides(tokens, i, i)[3])) is not None:
                            yield k, begins.get(i, i), i
            prev = t.name


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The patterns around every base span, with the span's instance."""
    places = Places()
    for batch in batches:
        pairs = set()
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            if base:
                tokens = places.tokens(text, base)
                for i, t in enumerate(tokens):
                    if t.shape == 3:
                        h = places.instance(tokens, i, i)
                        pairs.update((p, h) for p in pattern_names(*sides(tokens, i, i)))
        yield _pairs(pairs)


def _pairs(pairs: Iterable[tuple[str, int | None]]) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([h for _, h in pairs], pa.int64())], ["pattern", "instance"])


def _count(wanted: Broadcast[pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fillers of the wanted patterns; one with more than its cap gives a row with no instance instead, as it is too weak whatever else fills it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, caps = (wanted.value.column(c).to_pylist() for c in ("pattern", "cap"))
        index, places = Index(patterns), Places()
        found: dict[int, set[int]] = defaultdict(set)
        over: set[int] = set()
        held = 0
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py() or ""
                tokens = places.tokens(text, base_spans(text))
                for k, i, j in index.fillers(tokens):
                    some = found[k]
                    held -= len(some)
                    some.add(places.instance(tokens, i, j))
                    held += len(some)
                    if len(some) > caps[k]:
                        held -= len(found.pop(k))
                        over.add(k)
                        index.drop(k)
            if held > 500_000:
                yield _pairs((patterns[k], h) for k, some in found.items() for h in some)
                found.clear()
                held = 0
        yield _pairs((patterns[k], h) for k, some in found.items() for h in some)
        yield _pairs((patterns[k], None) for k in over)

    return run


def _touch(fresh: Broadcast[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The patterns around every place of the given instances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = set(fresh.value.tolist()), Places()
        for batch in batches:
            pairs = set()
            for value in batch.column("text"):
                text = value.as_py() or ""
                tokens = places.tokens(text, base_spans(text))
                ends = units(tokens)
                begins = {e: b for b, e in enumerate(ends) if e > b}
                for i, t in enumerate(tokens):
                    if not t.core or t.shape == 3:
                        continue
                    for j in range(i, min(len(tokens), i + MAX_WORDS)):
                        h = places.instance(tokens, i, j)
                        if h in known:
                            kinds = ("3", *("12" if j == ends[i] else ""), *("45" if i == begins.get(j, j) else ""))
                            pairs.update((p, h) for p in pattern_names(*sides(tokens, i, j)) if p[0] in kinds)
                        if not joined(tokens, j):
                            break
            yield _pairs(pairs)

    return run


def _mark(accepted: Broadcast[tuple[list[str], np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every text's base spans and the places where an accepted instance fills one of its patterns."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, which, instances = accepted.value
        index, places = Index(patterns), Places()
        pairs = set(zip(which.tolist(), instances.tolist()))
        for batch in batches:
            bases, mores = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": a, "rank": r, "kind": KINDS[r], "end": b} for a, r, b in base])
                hits = set()
                if pairs:
                    tokens = places.tokens(text, base)
                    hits = {(i, j) for k, i, j in index.fillers(tokens) if tokens[i].shape != 3 and (k, places.instance(tokens, i, j)) in pairs}
                more: list[tuple[int, int]] = []
                if hits:
                    at = positions(text, base)
                    # a run's own words go with it
                    for a, b in sorted(((at[i][0], at[j][1]) for i, j in hits), key=lambda s: (s[0], -s[1])):
                        if not more or b > more[-1][1]:
                            more.append((a, b))
                mores.append([{"start": a, "rank": 4, "kind": KINDS[4], "end": b} for a, b in more])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bases, span), pa.array(mores, span)], ["key", "base", "more"])

    return run


def positions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of every token's core."""
    out: list[tuple[int, int]] = []

    def words(start: int, end: int) -> None:
        for m in _WORD.finditer(text, start, end):
            t = _token(m[0])
            out.append((m.start() + len(t.lead), m.end() - len(t.trail)))

    at = 0
    for a, b in merged(base):
        words(at, a)
        out.append((a, b))
        at = b
    words(at, len(text))
    return out


def learn_instances(rows: DataFrame, rounds: int, min_support: int, min_confidence: float, min_score: float) -> DataFrame:
    """(pattern, instance) pairs by which instances that are no seeds are accepted.

    ``rows`` has texts. A round takes the patterns that enough known instances touch
    and counts all their distinct fillers in the texts: confidence is the sum of the
    fillers' scores, seeds counting 1 and unknown ones 0, over all of them and one
    more. Fillers of confident patterns get 1 - product(1 - confidence). A pattern
    with more fillers than the known ones' scores can make confident is dropped at
    that number, which changes no verdict and bounds what is written; the others'
    fillers are kept, so a round looks for those of new patterns only. Rounds end
    when the pairs of confident patterns and accepted instances are those of the
    round before, or after ``rounds``.
    """
    spark, pair = rows.sparkSession, "pattern string, instance long"
    texts = rows.select("text")
    touched = materialize(texts.mapInArrow(_look, pair).distinct(), "seeds")
    seeds = materialize(touched.select("instance", F.lit(1.0).alias("score")).distinct(), "scores")
    scores, held, last, fillers = seeds, None, None, None
    whole: set[str] = set()
    weak: dict[str, int] = {}
    for turn in range(rounds):
        known = lookup_join(touched, scores, ["instance"]).groupBy("pattern").agg(
            F.sum("score").alias("total"), F.sum((F.col("score") >= min_score).cast("int")).alias("support")
        )
        known = known.filter(F.col("support") >= min_support)
        wanted = known.select("pattern", F.floor(F.col("total") / min_confidence - 1 + 1e-9).cast("long").alias("cap")).toArrow()
        if not wanted.num_rows:
            break
        # what fills a pattern is counted once; again only where the known ones' scores now allow more than made it too weak
        todo = wanted.filter(pa.array([p not in whole and cap > weak.get(p, -1) for p, cap in zip(wanted["pattern"].to_pylist(), wanted["cap"].to_pylist())], pa.bool_()))
        if todo.num_rows:
            found = materialize(texts.mapInArrow(_count(spark.sparkContext.broadcast(todo)), pair).distinct(), "fillers")
            over = {r[0] for r in found.filter("instance is null").select("pattern").distinct().collect()}
            for p, cap in zip(todo["pattern"].to_pylist(), todo["cap"].to_pylist()):
                if p in over:
                    weak[p] = cap
                else:
                    whole.add(p)
            nulls = found.filter("instance is null").select("pattern").distinct()
            counted = materialize(found.join(nulls, "pattern", "left_anti"), "whole")
            fillers = counted if fillers is None else fillers.unionByName(counted)
        each = fillers.join(scores, "instance", "left").groupBy("pattern").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("instance") + 1)).alias("confidence"))
        strong = materialize(each.filter(F.col("confidence") >= min_confidence), "patterns")
        held = materialize(lookup_join(fillers, strong, ["pattern"], "inner"), "held")
        raised = held.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("now"))
        before = scores
        scores = before.join(raised, "instance", "full").select("instance", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("now", F.lit(0.0))).alias("score"))
        scores = materialize(scores, "scores")
        good = scores.filter(F.col("score") >= min_score).select("instance")
        # counts and order-free sums of hashes tell one set of pairs from another
        sign = F.struct(F.count(F.lit(1)), *[F.sum(F.shiftright(F.xxhash64(F.lit(k), *c), 16)) for k, c in enumerate((("pattern", "instance"),) * 2)])
        now = held.join(good, "instance", "left_semi").agg(sign.alias("s")).first()[0]
        if turn + 1 == rounds or now == last:
            break
        last = now
        fresh = scores.join(before, "instance", "left_anti").select("instance").toArrow().column(0).to_numpy()
        if len(fresh):
            more = texts.mapInArrow(_touch(spark.sparkContext.broadcast(fresh)), pair).distinct()
            touched = materialize(touched.unionByName(more), "touched")
        elif scores.join(before, ["instance", "score"], "left_anti").isEmpty():
            break
    if held is None:
        return spark.createDataFrame([], pair)
    good = scores.filter(F.col("score") >= min_score).join(seeds, "instance", "left_anti").select("instance")
    return held.join(good, "instance", "left_semi").select("pattern", "instance").distinct()


def extract_pii(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 10, min_support: int = 3, min_confidence: float = 0.6, min_score: float = 0.75
) -> DataFrame:
    """Every row's key, its ``base`` spans and ``more``: identifiers that strong contexts discover.

    Spans are (start, rank, kind, end) in code points, sorted. Base spans seed the
    bootstrapping; whatever word, or run of words, fills a slot beside a base span
    is a candidate, of any shape. Null or empty texts have no spans; repeated rows
    and null keys keep rows and spans of their own; texts of any length are read
    whole; an empty table gives an empty result; other columns, whatever their names,
    are not read. Texts are read once for the seeds, once or twice a round and once for the
    result; the patterns that a round counts and the accepted pairs go to every worker.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    accepted = learn_instances(rows, rounds, min_support, min_confidence, min_score).toArrow()
    names = accepted.column("pattern").combine_chunks().dictionary_encode()
    pairs = (names.dictionary.to_pylist(), names.indices.to_numpy(), accepted.column("instance").to_numpy())
    spans = "array<struct<start:int,rank:int,kind:string,end:int>>"
    marked = rows.mapInArrow(_mark(docs.sparkSession.sparkContext.broadcast(pairs)), f"key {kind.simpleString()}, base {spans}, more {spans}")
    return marked.select(F.col("key").alias(key), "base", "more")
