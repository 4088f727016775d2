"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lookup_join, materialize

#: Means above this are split into equal parts that are drawn apart, so exp(-mean) never underflows.
MEAN_PART = 64.0
#: Means above so many parts are drawn at once, by an expansion of the distribution's inverse.
MAX_PARTS = 64
#: Copies that one row makes at once; a document of more is dealt out as ranges of copies first.
RANGE = 1 << 13
SEED = 11

# Coefficients of Acklam's rational functions for the inverse of the normal distribution
_MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def uniform(*parts: Column) -> Column:
    """A double in [0, 1), of 48 bits, that depends on the texts of ``parts`` alone."""
    digest = F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """The inverse of the normal distribution function, for u between 0 and 1, to about nine digits."""
    q = u - 0.5
    middle = q * _polynomial(q * q, _MIDDLE_OVER) / _polynomial(q * q, _MIDDLE_UNDER)
    side = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = _polynomial(side, _TAIL_OVER) / _polynomial(side, _TAIL_UNDER)
    return F.when(F.abs(q) <= 0.5 - _TAIL, middle).when(q < 0, tail).otherwise(-tail)


def large_poisson(mean: Column, u: Column) -> Column:
    """The inverse of the Poisson distribution at u for a mean over MEAN_PART * MAX_PARTS.

    The Cornish-Fisher expansion to the order 1 / sqrt(mean), from the normal
    quantile: at such means it misses the inverse by less than a hundredth before rounding.
    """
    z = normal_quantile(F.greatest(u, F.lit(0.5 / (1 << 48))))
    root = F.sqrt(mean)
    return F.greatest(F.lit(0), F.ceil(mean + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root) - 0.5)).cast("long")


def poisson_table(mean: Column) -> Column:
    """P(n <= k) for k = 0, 1, ... up to where a draw of 48 bits can't reach, for a mean of at most MEAN_PART."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, budget: float | None) -> DataFrame:
    """A row for each source: its characters, its mean repetition rate and the Poisson table of one part of it (none for large rates).

    ``rate = budget * weight / (all weights * characters of the source)``, so that
    the expected characters drawn from the sources are as the weights and sum to
    ``budget`` (None: the characters there are). Sources that ``weights`` doesn't
    name have weight 0 if it is given, 1 if it is None. Null is a source of its own,
    named by None in ``weights``. A source without characters has rate 0.
    """
    chars = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")).alias("chars"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    each = materialize(chars.withColumn("weight", weight), "sources")
    live = each.filter("chars > 0").agg(F.sum("weight"), F.sum("chars")).first()
    total = F.lit(float(live[1] or 0) if budget is None else float(budget))
    rate = F.when((F.col("chars") > 0) & (F.col("weight") > 0), total * F.col("weight") / (F.lit(live[0] or 1.0) * F.col("chars"))).otherwise(F.lit(0.0))
    small = F.col("rate") <= MEAN_PART * MAX_PARTS
    parts = F.when(small, F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PART)).cast("int")).otherwise(0)
    rated = each.withColumn("rate", rate).withColumn("parts", parts)
    table = F.when(small, poisson_table(F.when(small, F.col("rate") / F.col("parts")).otherwise(F.lit(0.0))))
    return rated.withColumn("cdf", table).select("__source", "chars", "rate", "parts", "cdf")


def draw_copies(docs: DataFrame, rates: DataFrame, key: str, source: str, seed: int) -> DataFrame:
    """``docs`` with ``__n`` (long), the number of copies of each row by the rate of its source."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))
    table = rates.select(named("__source").alias("__named"), F.col("rate").alias("__rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    drawn = lookup_join(docs.withColumn("__named", named(source)), table, ["__named"], limit=5_000)
    one = lambda j: F.size(F.filter(F.col("__cdf"), lambda c: c <= uniform(F.lit(str(seed)), ident, j.cast("string"))))
    many = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, j: acc + one(j))
    first = uniform(F.lit(str(seed)), ident, F.lit("1"))
    single = F.size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    count = F.when(F.col("__parts") == 1, single).when(F.col("__parts") > 1, many).otherwise(large_poisson(F.col("__rate"), F.col("__u")))
    return drawn.withColumn("__u", first).withColumn("__n", count.cast("long"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = SEED,
    with_copies: bool = True,
) -> DataFrame:
    """Repeat every document a Poisson number of times, so that sources meet their weights, and shuffle all copies.

    Adds ``copy`` (from 1), ``n_copies`` and ``shuffle_key`` to the columns of
    ``docs``, in the place of columns of these names, unless ``with_copies`` is false; documents drawn 0 times have no row. The draw inverts the Poisson
    distribution at a hash of seed and key, so it is the same on every run and
    machine, a document's copies do not depend on other documents but for the
    source's rate, and rows that repeat a key are drawn alike. A rate over MEAN_PART
    is drawn as a sum of equal parts, one over MAX_PARTS parts by large_poisson. The copies are dealt to partitions by a hash
    of seed, key and copy and sorted by it there, which is one shuffle of the rows
    with no sampling pass; ``shuffle_key`` orders them all. Where some source's rate
    is over RANGE, its documents are first dealt out as rows for RANGE copies each,
    so no task makes all copies of a document. No source is gathered: rates are
    one aggregated row a source, broadcast after a count or else joined by salt.
    Null keys count as the text "null", null texts as no characters, texts of any
    length by all their characters. An empty table gives an empty one.
    """
    rates = materialize(source_rates(docs, source, text, weights, budget), "rates")
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    counted = draw_copies(docs, rates, key, source, seed).filter("__n > 0")
    last = F.col("__n")
    first = F.lit(1).cast("long")
    if (rates.agg(F.max("rate")).first()[0] or 0) > RANGE:
        counted = counted.withColumn("__range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RANGE))))
        counted = counted.repartition(F.xxhash64(ident, "__range"))
        first, last = F.col("__range") * RANGE + 1, F.least(F.col("__n"), (F.col("__range") + 1) * RANGE)
    copies = counted.withColumn("__copy", F.explode(F.sequence(first, last)))
    order = F.md5(F.encode(F.concat_ws(":", F.lit(f"{seed} order"), ident, F.col("__copy").cast("string")), "UTF-8"))
    keyed = copies.withColumn("__order", order).select(*docs.columns, "__copy", "__n", "__order")
    shuffled = keyed.repartition("__order").sortWithinPartitions("__order")
    if not with_copies:
        return shuffled.select(*docs.columns)
    added = {"copy": "__copy", "n_copies": "__n", "shuffle_key": "__order"}
    return shuffled.select(*[c for c in docs.columns if c not in added], *[F.col(v).alias(k) for k, v in added.items()])
