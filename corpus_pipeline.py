"""A corpus pipeline: from raw documents to a mixed, clean training set.

Stages, in order: reject documents the quality classifier finds poor, cut boilerplate lines, keep one document of each
group of near-duplicates, drop documents into which a benchmark leaks, and mix sources to their target weights. Each
takes what its predecessor kept. ``run`` gives the documents with the copies and words that the mix takes of each.

Rows are documents, whether or not they share a doc_id or have none: no stage drops a row for another row's text, but
for the stages that name documents by id (decontamination), where all rows of a leaking id go. Documents without text
pass every stage that doesn't reject them (the classifier scores them as empty texts), and weigh nothing in the mix. An
empty corpus gives an empty result, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.op01_mix import mix
from tessera.llm.op02_decontaminate import drop_leaks
from tessera.llm.op03_lines import drop_boilerplate
from tessera.llm.op08_jaccard import drop_near_duplicates
from tessera.llm.op10_quality import score_quality, train
from tessera.llm.shared import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that go to a Python worker at once: a batch of texts is held on both sides, and Spark's default of 10,000
#: rows would be some 35 MB each for a task. Stages set it for the session; results don't depend on it.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCORED_ROWS, SEARCHED_ROWS = 4_000, 1_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    spark.conf.set(BATCH, str(SCORED_ROWS))
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With their host's boilerplate lines cut, and n_chars of what is left."""
    cut = drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, 0.8); documents without a word stay."""
    spark.conf.set(BATCH, str(SEARCHED_ROWS))
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents into which a benchmark item leaks."""
    spark.conf.set(BATCH, str(SEARCHED_ROWS))
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With size, source_size, target, rate, copies and taken of the mix of sources."""
    return mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained classifiers and numeric optimisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
