"""URL verdicts: rules first, else naive Bayes over words that host and path are segmented into."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lookup_join, materialize

#: What a letter that no word covers costs, in log10, beside a word seen once.
STRAY = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, its A-Z lower-cased, and the path of a url; both empty for null or without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. A rule is (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """(word, n): the letters-only words between the tags of all pages, lower-cased."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html), F.lit(""))), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_words(piece: str, words: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most likely words of a piece under a unigram model; letters that no word covers stay together.

    ``words`` has (start, length, count) of the piece's substrings that are words. Of
    equally likely splits, the one counts whose last word is the longest, and before
    it again.
    """
    best = [0.0] + [-math.inf] * len(piece)
    back: list[tuple[int, bool]] = [(0, True)] * (len(piece) + 1)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for start, length, count in sorted(words):
        by_start.setdefault(start, []).append((length, count))
    base = math.log10(total + 1)
    for a in range(len(piece)):
        stray = best[a] - base - STRAY
        if stray > best[a + 1]:
            best[a + 1], back[a + 1] = stray, (a, False)
        for length, count in by_start.get(a, ()):
            score = best[a] + math.log10(count) - base
            if score > best[a + length]:
                best[a + length], back[a + length] = score, (a, True)
    out: list[str] = []
    b, strays = len(piece), 0
    while b:
        a, known = back[b]
        if known:
            if strays:
                out.append(piece[b : b + strays])
            out.append(piece[a:b])
            strays = 0
        else:
            strays += b - a
        b = a
    if strays:
        out.append(piece[:strays])
    return out[::-1]


def _split(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces, found = batch.column("piece").to_pylist(), batch.column("found").to_pylist()
        words = [split_words(p, [(w["start"], w["length"], w["n"]) for w in f or []], total) for p, f in zip(pieces, found, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))], ["piece", "words"])


def _substrings(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """All substrings of the given lengths, with the piece's number and the start."""
    for batch in batches:
        ids, starts, words = [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(words, pa.string())], ["pid", "start", "word"])
            for x in (ids, starts, words):
                x.clear()
            return made

        for pid, piece in zip(batch.column("pid").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            for a in range(len(piece)):
                for n in lengths:
                    if a + n > len(piece):
                        break
                    ids.append(pid)
                    starts.append(a)
                    words.append(piece[a : a + n])
                if len(ids) >= 1 << 16:
                    yield out()
        yield out()


def segment(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for distinct ``pieces``, with materialised ``counts`` of (word, n).

    The substrings of the distinct pieces, of all lengths that words have, are joined
    with the counts by lookup_join, as some words are in nearly every piece; so the
    dictionary is never gathered, and each piece gets the words that lie in it. Of
    the dictionary, the driver sees which lengths there are.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())
    # the numbers are written with the pieces, so they are the same for all that follows
    named = materialize(pieces.select("piece", F.monotonically_increasing_id().alias("pid")), "numbered")
    parts = named.mapInArrow(lambda b: _substrings(b, lengths), "pid long, start int, word string")
    found = lookup_join(parts, counts, ["word"], "inner").groupBy("pid").agg(F.collect_list(F.struct("start", F.length("word").alias("length"), "n")).alias("found"))
    return named.join(found, "pid", "left").select("piece", "found").mapInArrow(lambda b: _split(b, total), "piece string, words array<string>")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", smoothing: float = 1.0
) -> DataFrame:
    """Every row's key, ``host``, ``path``, ``rule``, ``verdict`` ("allow" or "block") and ``log_odds`` of block.

    Urls that a rule judges are the labelled ones: their tokens are counted by
    verdict over the whole table, and multinomial naive Bayes with additive
    smoothing judges the rest, block if its log odds are above 0. A token is a word
    of a host label or of a path part, with its place; runs of digits are one token.
    Words come from a unigram Viterbi split of the table's distinct labels and parts,
    the counts from the text of its pages. Null urls, and tables in which no rule applies, are
    allowed. Repeated rows and null keys get a row each; urls and pages of any length are read
    whole; an empty table gives an empty result; other columns, whatever their names, are not read.

    Tokens are counted by class before the shuffle; lookups of pieces and tokens, some of
    which most urls have, go by lookup_join.
    """
    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "said": verdict, "rid": F.monotonically_increasing_id()})
    seen = materialize(seen, "urls")
    digits = lambda c: F.transform(c, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    cut = lambda c: F.filter(digits(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+")), lambda x: x != "")
    named = lambda c, place: F.transform(cut(c), lambda x: F.struct(F.lit(place).alias("place"), x.alias("piece")))
    parts = seen.select("rid", "said", F.explode(F.concat(named("host", "h"), named("path", "p"))).alias("x")).select("rid", "said", "x.place", "x.piece")
    pieces = parts.select("piece").distinct()
    words = materialize(segment(materialize(pieces, "pieces"), materialize(word_counts(pages, html), "words")), "segments")
    tokens = lookup_join(parts, words, ["piece"], "inner").select("rid", "said", F.explode("words").alias("word"), "place")
    tokens = tokens.select("rid", "said", F.concat_ws(":", "place", "word").alias("token"))
    one = lambda v: F.sum((F.col("said") == v).cast("long"))
    counts = materialize(tokens.filter("said is not null").groupBy("token").agg(one("block").alias("block"), one("allow").alias("allow")), "tokens")
    n = counts.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    docs = seen.agg(one("block"), one("allow")).first()
    block, allow, v = (n[0] or 0), (n[1] or 0), n[2]
    prior = math.log((docs[0] + smoothing) / (docs[1] + smoothing)) if docs[0] and docs[1] else -math.inf
    odds = F.log((F.col("block") + smoothing) / (block + smoothing * (v + 1))) - F.log((F.col("allow") + smoothing) / (allow + smoothing * (v + 1)))
    weights = materialize(counts.select("token", odds.alias("odds")), "weights")
    unseen = math.log((allow + smoothing * (v + 1)) / (block + smoothing * (v + 1)))
    open_tokens = tokens.filter("said is null").select("rid", "token")
    summed = lookup_join(open_tokens, weights, ["token"]).groupBy("rid").agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("sum"))
    judged = seen.join(summed, "rid", "left").withColumn("log_odds", F.when(F.col("said").isNull(), F.lit(prior) + F.coalesce("sum", F.lit(0.0))))
    said = F.coalesce("said", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", said.alias("verdict"), "log_odds")
