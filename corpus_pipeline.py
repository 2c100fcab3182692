"""A corpus pipeline: quality classifier, quality rules, near duplicates,
repeated passages, packing.

Every stage takes the documents its predecessor kept. A stage's result may
read scratch tables that the stage wrote; they are its own and stay until the
caller drops them: :func:`run` does once the result is written, other callers
open ``scratch_scope`` around a stage and the use of its result. The trained
stages learn from the labelled rows of the whole documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import dropped, live_tables, written
from tidepool.llm.ngram_join import one_of_each_group
from tidepool.llm.packing import pack_documents
from tidepool.llm.quality_gbt import PREDICT_FROM, fit_quality, score_texts
from tidepool.llm.quality_rules import fit_rules, judge
from tidepool.llm.suffix_dedup import remove_repeats

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_classifier(spark, docs, sf_dir):
    """Documents whose quality score is at least ``PREDICT_FROM`` stay."""
    model = fit_quality(docs, _labels(spark, sf_dir))
    score = _free_name(docs, "_score")
    return docs.withColumn(score, score_texts(docs, model)).where(
        F.col(score) >= F.lit(PREDICT_FROM)).select(*docs.columns)


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the fixed rules and the isolation forest stay.

    The forest and its threshold are fitted on labelled rows of the whole
    table: the classifier has left hardly any bad ones in ``docs``."""
    model = fit_rules(_documents(spark, sf_dir), _labels(spark, sf_dir))
    verdict = _free_name(docs, "_verdict")
    return docs.withColumn(verdict, judge(docs, model)).where(
        F.col(f"{verdict}.kept")).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of every group of near duplicates stays."""
    return one_of_each_group(docs)


def repeated_passages(spark, docs, sf_dir):
    """Passages of 50 words and more that occurred before are cut out;
    ``n_chars`` follows the text. All rows stay."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark, docs, sf_dir):
    """Every piece of every document with its place in a sequence. The tasks
    take less memory and more time than by default: the JVM has grown by then."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"),
                          known_words=200_000, slice_bytes=1 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

# SQL cannot express the trained stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; the result of each
    but the last is written and read again, then the scratch tables it read
    are dropped. What the last stage's result reads stays."""
    docs, last = _documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        before = set(live_tables()) - {last}
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*[t for t in live_tables() if t not in before and t != kept.scratch])
        docs, last = kept, kept.scratch
    return STAGES[-1][1](spark, docs, sf_dir)
