"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import read_table, span_list
from lamina.llm.decision_list import judge_quality
from lamina.llm.minhash_join import near_duplicates
from lamina.llm.mixing import SEED as MIX_SEED
from lamina.llm.mixing import mix_sources
from lamina.llm.ngram_lm import hold_out, score_documents, train
from lamina.llm.packing import pack_documents
from lamina.llm.pii import extract_pii
from lamina.llm.secrets import scan_secrets
from lamina.llm.sharding import shard_documents
from lamina.llm.topk import top_k
from lamina.llm.url_filter import judge_urls

#: The rules of op1.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_segmented_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls under the fixed rules and what naive Bayes learns from them."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).withColumn("log_odds", F.round("log_odds", 6))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn so that every source has the same share of characters in one epoch."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    digest = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    return mixed.select("doc_id", "source", F.col("copy").cast("long"), F.col("n_copies").cast("long"), "shuffle_key", digest.alias("text_md5"))


OP2_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
each AS (SELECT source, CAST(sum(length(body)) AS BIGINT) AS chars FROM sized GROUP BY source),
live AS (SELECT CAST(sum(chars) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM each WHERE chars > 0),
rated AS (SELECT source, CASE WHEN chars > 0 THEN total / (n * chars) ELSE 0 END AS rate FROM each, live),
parted AS (SELECT source, rate / greatest(1, ceil(rate / 64)) AS mean, CAST(greatest(1, ceil(rate / 64)) AS BIGINT) AS parts FROM rated),
points AS (SELECT source, parts, mean, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 24) AS BIGINT) + 1)) AS k FROM parted),
mass AS (SELECT source, parts, k, exp(-mean) * CASE WHEN k = 0 THEN 1 ELSE pow(mean, k) / gamma(k + 1) END AS p FROM points),
tables AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM
  (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass) GROUP BY source, parts),
draws AS (SELECT d.doc_id, d.source, d.body, t.cdf, unnest(range(1, t.parts + 1)) AS part
  FROM sized d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
hashed AS (SELECT *, CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || part), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM draws),
counted AS (SELECT doc_id, source, body, CAST(sum(len(list_filter(cdf, lambda c: c <= u))) AS BIGINT) AS n_copies FROM hashed GROUP BY ALL),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0)
SELECT doc_id, source, copy, n_copies,
  md5('{MIX_SEED} order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS shuffle_key, md5(body) AS text_md5
FROM copies
"""


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the model of those that are not held out."""
    docs = hold_out(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score_documents(docs, train(docs.filter("not held_out")), held_out="held_out")


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by inner product for every hundredth vector, among all."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op6_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, a document being a repository and its source the owner."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    live = F.size(F.filter("base", lambda s: s["live"])) + F.size("more")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "more")).alias("spans"), live.cast("long").alias("n_live"),
    )


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over eight shards of equal weight."""
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the base rule and the rules learned from labels."""
    judged, _ = judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, by shingles of four words."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = extract_pii(read_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_learned"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_segmented_hosts, op2_mix_sources, op3_kneser_ney, op4_pivot_top_k, op5_pack_histogram, op6_secret_owners, op7_rendezvous_shards, op8_quality_rules, op9_minhash_join, op10_bootstrapped_pii]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op4_pivot_top_k": OP4_SQL}
