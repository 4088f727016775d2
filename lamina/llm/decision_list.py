"""Quality rules: text statistics and a learned decision list over them, in native functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import NOT_SPACE, materialize, words_of

#: Words in a window that counts as repeated.
WINDOW = 8
#: The statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "digit_share")

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rule and FEATURES to every row, in the place of columns of their names; the text's words are looked at once.

    Null texts count as empty. ``n_repeat_words`` takes windows of eight words by a
    64-bit hash: a row whose hashes are all distinct has none, the rest sort their
    hashes with positions, keep those equal to a neighbour and add up the words that
    each further window covers anew.
    """
    keep = [c for c in docs.columns if c not in STATS]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    a = docs.withColumns({"__words": words_of(F.col(text)), "__lines": lines})
    a = a.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "__upper": F.length(F.regexp_replace(body, r"\P{Lu}+", "")),
            "__digits": F.length(F.regexp_replace(body, r"[^0-9]+", "")),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__distinct": F.size(F.array_distinct("__words")),
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines")
    starts = F.sequence(F.lit(0), F.size("__hashes") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("__hashes", i + j) for j in range(WINDOW)]))
    b = a.withColumn("__windows", F.when(F.size("__hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("__hashes")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    c = b.withColumn("__placed", F.when(again, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("__windows")
    same = lambda s, i, j: F.coalesce(F.get("__placed", i + j)["h"] == s["h"], F.lit(False))
    twice = F.filter("__placed", lambda s, i: same(s, i, -1) | same(s, i, 1))
    at = F.sort_array(F.transform(twice, lambda s: s["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(at, zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    d = c.withColumn("n_repeat_words", covered.cast("long")).drop("__placed")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    stats = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("__upper") / chars,
        "digit_share": F.col("__digits") / chars,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("__distinct") / words,
        "words_per_line": F.col("n_words") / lines,
    }
    # one struct in an array, taken out again: filters on the statistics stay above this step, where
    # pushing them down would repeat the expressions of all steps inside each other
    return d.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in stats.items()]))))


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def decision_list(rules: list[Rule]) -> Column:
    """The first rule that a row meets, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def _gain(p1: float, n1: float, p0: float, n0: float) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def widen_margin(covered: DataFrame, rule: Rule) -> Rule:
    """The rule with every threshold moved halfway to the nearest of the rows it is to cover, which all stay covered."""
    ends = covered.agg(*[(F.min if x.above else F.max)(x.feature).alias(f"c{k}") for k, x in enumerate(rule)]).first()
    return tuple(Literal(x.feature, x.above, (x.threshold + end) / 2) for x, end in zip(rule, ends, strict=True))


def learn_rules(
    rows: DataFrame,
    label: str,
    features: tuple[str, ...] = FEATURES,
    max_rules: int = 8,
    max_literals: int = 3,
    min_precision: float = 0.95,
    min_cover: int = 3,
    bins: int = 24,
) -> list[Rule]:
    """Sequential covering: grow a conjunction for the rows whose ``label`` is true, prune it, set aside what it covers, repeat.

    ``rows`` holds a bounded labelled sample. Thresholds are each feature's
    quantiles among the rows of either label. A step of growing is one aggregate over the rows that are still there:
    counts by (feature, bin, label, part), at most features * 2 * bins * 4 rows, from which
    the driver reads every literal's gain. Two of three rows, by hash, grow a rule;
    the third decides at which literal it is cut off, and whether it is good enough.
    Thresholds then move halfway to the covered rows, away from the others. Rows with a null
    label or no rows give no rules.
    """
    points = [0.005, 0.01, *[k / bins for k in range(1, bins)], 0.99, 0.995]
    rows = rows.filter(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("boolean").alias("__y"))
    cuts: dict[str, list[float]] = {}
    for r in rows.groupBy("__y").agg(*[F.percentile_approx(f, points, 10000).alias(f) for f in features]).collect():
        for f in features:
            cuts[f] = sorted({*cuts.get(f, []), *map(float, r[f])})
    if not cuts:
        return []

    def bin_of(f: str) -> Column:
        # the number of cuts below the value: "bin <= k" is "value <= cuts[k]"
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)))

    grows = F.pmod(F.xxhash64(F.lit("part"), *features), F.lit(3)) > 0
    long = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in features])
    binned = materialize(rows.withColumn("__grow", grows).withColumn("__bins", long), "labelled")
    rules: list[Rule] = []
    left = F.lit(True)

    def counts(rule: Rule) -> dict:
        found: dict = {}
        spread = binned.filter(left & holds(rule)).select("__y", "__grow", F.explode("__bins").alias("x"))
        for r in spread.groupBy("x.f", "x.b", "__y", "__grow").count().collect():
            found[r["f"], r["b"], r["__y"], r["__grow"]] = r["count"]
        return found

    def total(found: dict, y: bool, grow: bool) -> int:
        return sum(n for (f, _, y1, g), n in found.items() if f == features[0] and y1 == y and g == grow)

    while len(rules) < max_rules:
        rule: Rule = ()
        found = counts(rule)
        marks = []  # for every length of the rule, what it covers in the pruning part
        while True:
            p0, n0 = total(found, True, True), total(found, False, True)
            marks.append((total(found, True, False), total(found, False, False)))
            if len(rule) == max_literals or not p0 or not n0:
                break
            best: tuple[float, Literal | None] = (1e-9, None)
            for f in features:
                below_p = below_n = 0
                for k, cut in enumerate(cuts[f]):
                    below_p += found.get((f, k, True, True), 0)
                    below_n += found.get((f, k, False, True), 0)
                    for above, p1, n1 in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        gain = _gain(p1, n1, p0, n0)
                        # of equal literals, the one that rejects least
                        if p1 >= min_cover and (gain > best[0] or above and best[1] and gain == best[0]):
                            best = (gain, Literal(f, above, cut))
            if best[1] is None:
                break
            rule = (*rule, best[1])
            found = counts(rule)
        # the shortest rule of the highest worth (p - n) / (p + n) on the pruning part
        worth = [((p - n) / (p + n) if p + n else -1.0) for p, n in marks]
        cut = max(range(1, len(marks)), key=lambda k: (worth[k], -k), default=0)
        if not cut:
            break
        p, n = marks[cut]
        rule = rule[:cut]
        if p < min_cover or p / (p + n) < min_precision:
            break
        rule = widen_margin(binned.filter(left & holds(rule) & F.col("__y")), rule)
        rules.append(rule)
        left = left & ~holds(rule)
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, key: str, quality: str, text: str, max_labelled: int) -> DataFrame:
    """FEATURES and ``__bad`` for at most ``max_labelled`` labelled documents, those with the least hashes of their key."""
    known = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(key).agg(F.min(quality).alias("__quality"))
    some = known.orderBy(F.xxhash64(F.lit("sample"), key), key).limit(max_labelled).select(F.col(key).alias("__key"), "__quality")
    some = materialize(some, "sample")
    found = docs.select(key, text).join(F.broadcast(some), F.col(key) == F.col("__key"))
    return text_stats(found.select(text, "__quality"), text).withColumn("__bad", F.col("__quality") == 0)


def judge_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", max_labelled: int = 20_000, max_rules: int = 8, max_literals: int = 3
) -> tuple[DataFrame, list[Rule]]:
    """Every row with its statistics, ``base_failed``, ``rule`` and ``kept``, and the rules.

    The rules are learned from at most ``max_labelled`` labelled documents, a bound
    that also proves the size of what is broadcast (ids and labels). There are at most
    ``max_rules`` rules of at most ``max_literals`` thresholds each. A document is
    kept if the base rule passes and no learned rule rejects it; without labels the
    base rule alone decides. Null or empty texts have no words and are not kept.
    Null keys and repeated rows are judged like all others, texts of any length whole;
    an empty table gives an empty result. Columns of ``docs`` named like the
    statistics give way to them.
    """
    labelled = materialize(labelled_stats(docs, labels, key, quality, text, max_labelled).select(*FEATURES, "__bad"), "labelled-stats")
    rules = learn_rules(labelled, "__bad", max_rules=max_rules, max_literals=max_literals)
    judged = text_stats(docs, text).withColumn("base_failed", base_failed()).withColumn("rule", decision_list(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
