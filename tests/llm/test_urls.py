"""Url verdicts: rules by brute force, segmentation and the classifier on cases of their own."""

import itertools
import math
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from lamina.llm import queries as Q
from lamina.llm.common import materialize
from lamina.llm.url_filter import judge_urls, segment, split_words


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in Q.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def check(rows, urls):
    for r in rows:
        host, path = parts(urls[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = Q.op1_segmented_hosts(spark, sf).collect()
    assert len(rows) == len(urls)
    check(rows, urls)


ODD = ["http://a.com", "http://A.COM/x?y#z", "https://WWW.example.com/en/1", "http://m.example.com/en/", "http://example.com/EN/", "no scheme", None, "", "x://net/es/", "http://notnet/es/",
       "http://a.net/fr/?q=://b.com/", "http://é.org/ü/1", "a://b://c.com/", "http://x.com#/en/", "http://" + "longhost" * 2000 + ".org/" + "p" * 5000]


def test_odd_rows(spark):
    frame = spark.createDataFrame([*enumerate(ODD), (None, "http://z.org/"), (3, ODD[3])], "page_id long, url string").withColumn("html", F.lit("<p>long host</p>"))
    extra = frame.withColumns({"rid": F.lit(1), "host": F.lit("h"), "word": F.lit("w")})
    rows = judge_urls(extra, Q.URL_RULES).collect()
    assert len(rows) == len(ODD) + 2
    check([r for r in rows if r.page_id is not None], dict(enumerate(ODD)))
    assert judge_urls(frame.limit(0), Q.URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(frame, []).collect()} == {"allow"}


def test_segmentation(spark):
    counts = {"cheap": 50, "pills": 30, "the": 900, "rapist": 3, "therapist": 40, "spam": 20}
    total = sum(counts.values())
    frame = spark.createDataFrame([(k,) for k in ["cheappills", "therapist", "xqspam", "the", "zzz"]], "piece string")
    got = {r.piece: r.words for r in segment(frame, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "therapist": ["therapist"], "xqspam": ["xq", "spam"], "the": ["the"], "zzz": ["zzz"]}
    # against all ways to split
    small = {"a": 5, "ab": 3, "b": 2, "ba": 4, "aab": 1}
    for piece in map("".join, itertools.product("ab", repeat=6)):
        words = [(i, n, small[piece[i : i + n]]) for i in range(6) for n in range(1, min(4, 7 - i)) if piece[i : i + n] in small]
        score = lambda ws: sum(math.log10(small[w]) - math.log10(16) for w in ws)
        ways = [[piece[i:j] for i, j in zip((0, *c), (*c, 6), strict=True)] for n in range(6) for c in itertools.combinations(range(1, 6), n)]
        assert math.isclose(score(split_words(piece, words, 15)), max(score(w) for w in ways if all(x in small for x in w)))


def test_learns(spark):
    """Unruled hosts made of the words of blocked ones are blocked."""
    rows = [(i, f"http://cheappills{i}.net/es/", "<b>cheap pills good books</b>") for i in range(20)]
    rows += [(100 + i, f"http://goodbooks{i}.com/de/", "") for i in range(20)] + [(200, "http://pillscheap.org/it/", ""), (201, "http://booksgood.org/it/", "")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), Q.URL_RULES).collect()}
    assert (got[200], got[201]) == ("block", "allow")


def plain_verdicts(pages):
    """page_id -> (verdict, log odds), with dictionaries."""
    counts = Counter(w for r in pages for w in regex.split(r"[^\p{L}]+", re.sub("<[^>]*>", " ", (r.html or "").lower())) if w)
    total = sum(counts.values())
    cut = lambda x: [re.sub("[0-9]+", "#", p) for p in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if p]

    def tokens(url):
        out = []
        for place, piece in [(k, p) for k, x in zip("hp", parts(url), strict=True) for p in cut(x)]:
            known = [(a, b - a, counts[piece[a:b]]) for a in range(len(piece)) for b in range(a + 1, len(piece) + 1) if piece[a:b] in counts]
            out += [f"{place}:{w}" for w in split_words(piece, known, total)]
        return out

    said = {r.page_id: rule(*parts(r.url))[1] for r in pages}
    seen = {v: Counter(t for r in pages if said[r.page_id] == v for t in tokens(r.url)) for v in ("block", "allow")}
    v, n = len(set(seen["block"]) | set(seen["allow"])), {k: sum(c.values()) for k, c in seen.items()}
    labels = Counter(said.values())
    p = lambda t, k: math.log((seen[k][t] + 1) / (n[k] + v + 1))
    out = {}
    for r in pages:
        odds = None if said[r.page_id] else math.log((labels["block"] + 1) / (labels["allow"] + 1)) + sum(p(t, "block") - p(t, "allow") for t in tokens(r.url))
        out[r.page_id] = (said[r.page_id] or ("block" if odds > 0 else "allow"), odds)
    return out


def test_verdicts(spark):
    """Every verdict against a plain classifier."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = plain_verdicts(pages.collect())
    rows = judge_urls(pages, Q.URL_RULES).collect()
    assert len(rows) == len(want) and any(r.log_odds is not None for r in rows)
    for r in rows:
        verdict, odds = want[r.page_id]
        assert (r.log_odds is None) == (odds is None) and (odds is None or math.isclose(r.log_odds, odds, rel_tol=1e-9, abs_tol=1e-9))
        assert r.verdict == verdict or abs(odds) < 1e-9


def test_long_words(spark):
    """A word is found whatever its length, and two pieces never share their words."""
    long = "donaudampfschifffahrtsgesellschaft"
    frame = spark.createDataFrame([("x" + long,), ("the" + long + "the",)], "piece string")
    got = {r.piece: r.words for r in segment(frame, materialize(spark.createDataFrame([(long, 5), ("the", 50)], "word string, n long"), "w")).collect()}
    assert got == {"x" + long: ["x", long], "the" + long + "the": ["the", long, "the"]}
