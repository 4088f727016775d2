"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as entry
from pyspark.sql import functions as F

from lamina.llm.common import materialize
from lamina.llm.decision_list import judge_quality
from tests.llm import brute
from tests.llm.test_packing import PLAIN

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs, frame = docs.columns, [docs], docs
    for name, stage in P.STAGES:
        frame = materialize(stage(spark, frame, SF), name.replace(" ", "-"))
        outs.append(frame)
        assert name == P.STAGES[-1][0] or frame.columns == columns
    first, rules, near, clean, mixed = ({r.doc_id: r for r in o.collect()} for o in outs[:5])
    # quality: the base rule by brute force, the learned part as the operator judges
    judged = {r.doc_id: r.kept for r in judge_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))[0].collect()}
    assert set(rules) == {k for k, v in judged.items() if v} and not any(brute.quality(r.text)[5] for r in rules.values())
    # near duplicates: the least id of each component
    assert set(near) == {k for k, (_, c) in brute.components({k: r.text for k, r in rules.items()}, width=5).items() if k == c}
    # secrets: no row goes, texts without candidates stay as they are
    assert set(clean) == set(near)
    changed = [k for k in clean if clean[k].text != near[k].text]
    assert changed and all("<secret>" in clean[k].text and clean[k].n_chars == len(clean[k].text) for k in changed)
    assert all(brute.secrets(near[k].text) for k in changed) or len(changed) < len(near) / 4
    # mixing repeats whole rows
    assert all(r == clean[k] for k, r in mixed.items())
    # packing holds every copy
    copies = Counter(r.doc_id for r in outs[4].collect())
    ids = Counter()
    for r in outs[5].collect():
        ids[r.doc_id] += r.length
    assert ids == {k: n * (len(PLAIN.encode(clean[k].text, add_special_tokens=False).ids) + 1) for k, n in copies.items()}


def test_registered_and_optional(spark, sf):
    names = entry.queries()
    assert names["pipeline"] is P.run and "pipeline" not in entry.oracle_sql()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert P.run(spark, sf).count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0


def test_clashing_and_odd(spark):
    """Columns named like the operators' own stay as they are; nulls, empty texts and repeated rows go through."""
    names = ["n_words", "kept", "rule", "base", "more", "copy", "shuffle_key", "hash", "freq", "key", "node", "rid"]
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(1, prose, "s"), (1, prose, "s"), (None, prose + " end", None), (2, None, "s"), (3, "", None), (4, "password = Kq7vLm2xRt9z " + prose[::-1], "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(f"own {n}") for n in names}).withColumn("n_chars", F.lit(None).cast("long"))
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), "odd")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(r[n] == f"own {n}" for r in docs.collect() for n in names)
        if name == "secret scan":
            assert sorted((r.doc_id or 0, "<secret>" in r.text) for r in docs.collect()) == [(0, False), (1, False), (4, True)]
    assert docs.count() > 0
