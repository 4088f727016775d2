"""A corpus through five stages: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
``documents``, the last one the packed pieces. ``run`` applies them, each result
written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import materialize, read_table
from lamina.llm.decision_list import judge_quality
from lamina.llm.minhash_join import drop_near_duplicates
from lamina.llm.mixing import mix_sources
from lamina.llm.packing import pack_documents
from lamina.llm.secrets import redact_live


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the rules learned from ``labels`` keep."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), "doc_id", "text")
    judged, _ = judge_quality(rows, read_table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words overlap by 0.8."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets in their texts replaced; copied examples stay."""
    return redact_live(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson draw so that every source has the same share of characters."""
    return mix_sources(docs, with_copies=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Learned rules, MinHash and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
