"""Secret scans: candidate spans, and who owns a candidate across the corpus; native functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import lookup_join, materialize

# The kinds of the base scan and their expressions.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run is taken whole, so a minimum in the expression equals dropping short matches afterwards
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the method looks at besides: long runs that mix cases and digits.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")

#: A credential may be repeated over some of its owner's repositories; more than this many hold a copied example.
MAX_REPOSITORIES = 20

FOUND = "array<struct<rank:int,pos:int,before:int,length:int,fits:boolean,hash:string,shaped:boolean>>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,live:boolean,owners:bigint,repositories:bigint,reach:int>>"
#: Code points of a text's blocks, and of the blocks that are cut into these, in redaction.
BLOCK, LARGE_BLOCK = 1 << 13, 1 << 20


def find_matches(text: Column, pattern: str, kind: str, fits: Callable[[Column], Column] | None = None, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches (FOUND): their number, length, and the length of what lies between each and the one before.

    The pieces between the matches come from splitting by the same expression.
    Places follow by adding up over rows of matches (see place_matches), as arrays
    have no running sum that is linear. ``fits`` tells which values count.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), values.alias("v"))
    one = lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), i.alias("pos"), F.length(x["p"]).alias("before"), F.length(x["m"]).alias("length"),
        (fits(x["v"]) if fits else F.lit(True)).alias("fits"), F.sha2(x["v"], 256).alias("hash"), looks_live(x["v"]).alias("shaped"),
    )
    return F.when(text.rlike(pattern), F.transform(parts, one).cast(FOUND)).otherwise(F.array().cast(FOUND))


def may_hold(text: Column) -> Column:
    """Whether any of the expressions meets the text."""
    return text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | (text.rlike("[0-9]") & text.rlike(OPAQUE))


def all_matches(body: Column) -> Column:
    """The matches of the four kinds."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.concat(
        find_matches(body, ASSIGN, "assign", lambda v: F.length(v) >= 6, 2),
        find_matches(body, ACCESS, "access"),
        find_matches(body, HEX, "hex"),
        F.when(body.rlike("[0-9]"), find_matches(body, OPAQUE, "opaque", mixed)).otherwise(F.array().cast(FOUND)),
    )


def place_matches(each: DataFrame) -> DataFrame:
    """(__rid, repository, owner, start, rank, end, hash, shaped) of the matches that count: all of the base kinds, and opaque ones that touch none of them.

    Running sums over a row's matches; all are of one text.
    """
    before = Window.partitionBy("__rid", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(before).cast("int")
    placed = each.withColumn("end", end).filter("fits").withColumn("start", F.col("end") - F.col("length"))
    base = F.col("rank") < 3
    # base spans that start no later may end beyond an opaque one's start, the next one may start before its end
    up = Window.partitionBy("__rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__rid").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__until", F.max(F.when(base, F.col("end"))).over(up)).withColumn("__next", F.min(F.when(base, F.col("start"))).over(down))
    touches = F.coalesce(F.col("__until") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("end"), F.lit(False))
    return placed.filter(base | ~touches).select("__rid", "repository", "owner", "start", "rank", "end", "hash", "shaped")


def looks_live(value: Column) -> Column:
    """Enough different characters, none of the words that examples use, and more than half of it outside filler runs, which random values also hold by chance."""
    letters = F.size(F.array_distinct(F.split(value, "")))
    lower = F.lower(value)
    # What placeholders are called, and what they are filled with
    rest = F.regexp_replace(lower, "x{4,}|0{4,}|0?1234567(?:89?0?)?(?:abcdef)?", "")
    return (letters >= 5) & (2 * F.length(rest) > F.length(value)) & ~lower.rlike("example|sample|dummy|placeholder|changeme|your_")


def ownership(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """For every candidate hash its distinct repositories and owners and the verdict ``live``: shaped, and within both bounds.

    ``found`` has (hash, repository, owner, shaped). Distinct counts are aggregated
    before and after the shuffle, so a candidate that a third of all documents
    share costs a row for each task. Null owners or repositories count as one.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("null"))
    each = found.select("hash", named("repository").alias("r"), named("owner").alias("o"), "shaped")
    counted = each.groupBy("hash").agg(F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"), F.max("shaped").alias("shaped"))
    return counted.select("hash", "repositories", "owners", (F.col("shaped") & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"))


def scan_secrets(
    docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", carry: list[str] | None = None, max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """Every row's base spans, the opaque spans judged live, and what the corpus says of each.

    Returns the columns ``carry`` (None: all of ``docs``; not those named like the next), ``base`` and ``more``:
    arrays of (start, rank, kind, end, live, owners, repositories, reach), by start, then
    kind; ``reach`` is the furthest end of the live spans before. A candidate that more than ``max_owners`` distinct owners or more than
    ``max_repositories`` distinct repositories hold is a copied example; one of few
    of both that also looks random is live. ``more`` has live
    spans only. Null texts have no spans; repeated rows are kept, each with its own
    spans; texts of any length and with any number of matches are searched whole, in
    time in proportion; an empty table gives an empty result.

    Texts are read once: every row's matches, without the text, are written to the
    shared folder with ``carry``. Only rows that have some are exploded, placed,
    looked up and gathered by row again, a row's matches being as many as its own
    text holds.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("base", "more")]
    body = F.coalesce(F.col(text), F.lit(""))
    seen = docs.withColumns({"__found": all_matches(body), "__rid": F.monotonically_increasing_id(), "__repository": F.col(repository), "__owner": F.col(owner)})
    rows = materialize(seen.select(*carry, "__rid", "__repository", "__owner", "__found"), "candidates")
    some = rows.filter(F.size("__found") > 0)
    each = some.select("__rid", F.col("__repository").alias("repository"), F.col("__owner").alias("owner"), F.inline("__found"))
    each = materialize(place_matches(each), "spans")
    verdicts = materialize(ownership(each.select("hash", "repository", "owner", "shaped"), max_owners, max_repositories), "verdicts")
    judged = lookup_join(each.drop("repository", "owner", "shaped"), verdicts, ["hash"])
    earlier = Window.partitionBy("__rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("live"), F.col("end"))).over(earlier), F.lit(0)).alias("reach")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1).alias("kind")
    span = F.struct("start", "rank", kind, "end", "live", "owners", "repositories", "reach")
    gathered = judged.withColumn("reach", reach).groupBy("__rid").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("__all"))
    none = F.array().cast(SPANS)
    base = F.filter("__all", lambda s: s["rank"] < 3)
    more = F.filter("__all", lambda s: (s["rank"] == 3) & s["live"])
    with_some = some.join(gathered, "__rid", "left").select(*carry, F.coalesce(base, none).alias("base"), F.coalesce(more, none).alias("more"))
    return rows.filter(F.size("__found") == 0).select(*carry, none.alias("base"), none.alias("more")).unionByName(with_some)


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, sorted by start and with its ``reach``, replaced by ``mark``.

    The text is cut into blocks of BLOCK code points once, and what lies between
    spans is taken from them, so the time grows with the text and the spans, not
    with their product.
    """
    cut = lambda t, n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / n).cast("int"))), lambda i: F.substring(t, i * n + 1, F.lit(n)))
    blocks = F.flatten(F.transform(cut(text, LARGE_BLOCK), lambda t: cut(t, BLOCK)))

    def between(held: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        of = lambda i: F.coalesce(F.get(held, i), F.lit(""))
        inner = F.array_join(F.slice(held, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
        apart = F.concat(F.substring(of(first), a % BLOCK + 1, F.lit(BLOCK)), inner, F.substring(of(last), F.lit(1), b % BLOCK))
        return F.when(first == last, F.substring(of(first), a % BLOCK + 1, b - a)).otherwise(apart)

    def build(held: Column) -> Column:
        pieces = F.transform(spans, lambda s: F.when(s["start"] >= s["reach"], F.concat(between(held, s["reach"], s["start"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(held, end, F.length(text)))

    # the blocks are made once, as the one element of an array
    return F.get(F.transform(F.array(blocks), build), 0)


def redact_live(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with every live-looking secret of its texts replaced; copied examples and all rows stay. ``n_chars`` follows the text, if it is there.

    Texts that no expression meets pass by, which takes a second look at them but
    keeps them from being written twice. Null texts, repeated rows, texts of any
    length and empty tables are as for scan_secrets.
    """
    maybe = may_hold(F.coalesce(F.col(text), F.lit("")))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    asked = docs.filter(maybe).select(row, *[F.col(c).alias(f"__{k}") for k, c in enumerate((text, repository, owner))])
    scanned = scan_secrets(asked, "__0", "__1", "__2", ["__row"], max_owners, max_repositories)
    marked = scanned.withColumn("__live", F.sort_array(F.filter(F.concat("base", "more"), lambda s: s["live"])))
    changed, old = F.size("__live") > 0, F.col("__row")[text]
    marked = marked.withColumn("__text", F.when(changed, redact(old, F.col("__live"))).otherwise(old))
    new = {text: F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__text").cast("long")).otherwise(F.col("__row")["n_chars"])
    return docs.filter(~maybe).unionByName(marked.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns]))
