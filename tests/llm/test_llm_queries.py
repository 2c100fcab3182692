"""The registered queries against SQL, and the pipeline against brute force."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tests.llm.helpers import (ODD_TEXTS, SMALL, SMOKE, documents, near_duplicates,
                               without_repeats)
from tests.llm.test_tokens import check_packing, packed_ids
from tests.oracle_compare import compare
from tidepool.llm.oracles import ORACLES
from tidepool.llm.quality_gbt import fit_quality
from tidepool.llm.quality_rules import _rule_values, fit_rules, quality_rules
from tidepool.llm.statistics import document_statistics


def test_every_operator_has_one_query():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, SMOKE, [name], verbose=False)[name] == "ok"


def labels(spark):
    return spark.read.parquet(f"{SMOKE}/labels.parquet")


def expected_kept(spark, docs):
    """(id, text) after the four filters, each by its plain version. Both
    models are fitted on labelled rows of the whole table."""
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    forest, cut = fit_rules(docs, labels(spark))
    assert forest is not None
    counts, ratios = document_statistics([t for _, t in rows])
    scores = fit_quality(docs, labels(spark)).score(ratios)
    fixed = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
    usual = forest.mean_path(_rule_values(ratios)) >= cut
    assert (fixed & (scores >= 0.3) & ~usual).any()  # the forest has something to reject
    rows = [r for r, k in zip(rows, fixed & (scores >= 0.3) & usual) if k]
    group, _ = near_duplicates([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    return rows, without_repeats(rows)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows, kept_words = expected_kept(spark, docs)
    stage_docs = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stage_docs, SMOKE)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        stage_docs = spark.createDataFrame(out.collect(), docs.schema)
    got = {r.doc_id: r for r in stage_docs.collect()}
    assert sorted(got) == [i for i, _ in rows]
    for i, r in got.items():
        assert [w.decode() for w in r.text.encode().split()] == kept_words[i]
        assert r.n_chars == len(r.text)
    ids = sorted(got)
    place = {d: k for k, d in enumerate(ids)}
    packed = [r.asDict() for r in corpus_pipeline.run(spark, SMOKE).collect()]
    assert {r["doc_id"] for r in packed} == set(ids)
    check_packing([SimpleNamespace(**{**r, "doc_id": place[r["doc_id"]]}) for r in packed],
                  packed_ids([got[i].text for i in ids]))


def test_rules_stage_has_a_forest_after_the_classifier(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = (quality_rules(docs, known).where("NOT base_failed AND NOT kept")
           .join(known.where("quality = 0"), "doc_id").agg(F.min("doc_id")).collect()[0][0])
    assert odd is not None
    left = stages["quality_classifier"](spark, docs, SMALL).collect()
    usual = spark.createDataFrame(left, docs.schema)
    given = usual.unionByName(docs.where(F.col("doc_id") == odd)
                              .withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)))
    out = {r.doc_id for r in stages["quality_rules"](spark, given, SMALL).collect()}
    assert -1 not in out  # no label, and the fixed rules pass it
    assert len(out) > 0.95 * len(left)


def test_stages_take_odd_and_empty_tables(spark):
    extra = ["_score", "_verdict", "group_id", "n_removed", "sequence_id"]
    for texts in (ODD_TEXTS, []):
        docs = documents(spark, texts, ids=[None, *range(1, len(texts))] if texts else None,
                         extra=extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMOKE)
            assert out.columns == docs.columns
            assert out.count() <= len(texts)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMOKE).where(
            F.col("start") == 0).count() == len(texts)


def test_a_lazy_stage_keeps_its_tables(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(60)
    once = stages["near_duplicates"](spark, docs, SMOKE)
    cut = stages["repeated_passages"](spark, once, SMOKE)  # reads what is not written yet
    again = stages["near_duplicates"](spark, docs, SMOKE)
    assert once.count() == again.count() == cut.count()


def test_packing_stage_has_no_gaps(spark):
    rows = corpus_pipeline.STAGES[-1][1](
        spark, spark.read.parquet(f"{SMOKE}/documents.parquet"), SMOKE).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert np.mean(list(fill.values())) > 0.97 * 2048
    assert P.path("word_bpe_49k.json")
