"""A training-corpus pipeline: each stage applies one operator to what its predecessor kept.

Stages take (spark, docs, sf_dir) and return all columns of docs, whatever they are called;
the last adds which copy of a document a row is. Rows are judged, filtered and masked where
they stand, never looked up again by an id: null and repeated doc_ids, and repeated rows, are
rows like others. Only near duplicates need a row's number, given before they are searched.
Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.decontaminate import decontaminated
from claimlens.llm.mix_sources import mixed
from claimlens.llm.ngram_join import ngram_join
from claimlens.llm.pii_bootstrap import mask
from claimlens.llm.quality_classifier import accepted, fit
from claimlens.llm.shared import cut, cut_rows, fits_broadcast, numbered


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: of the smallest doc_id, and the first of its
    rows. Repeated rows are near duplicates like others. As in the operator, rows of a null
    doc_id take part in nothing and stay."""
    plain, at = numbered(docs)
    rows = cut(plain.withColumn("_row", F.monotonically_increasing_id()))
    known = rows.where(F.col(at("doc_id")).isNotNull())
    groups = ngram_join(known.select(F.col("_row").alias("doc_id"), F.col(at("text")).alias("text"))).where("n_links > 0")
    groups = groups.select(F.col("doc_id").alias("_row"), "class_id").join(known.select("_row", F.col(at("doc_id")).alias("id")), "_row")
    groups = cut(groups)
    first = cut(groups.groupBy("class_id").agg(F.min(F.struct("id", "_row")).alias("first")))
    gone = fits_broadcast(cut(groups.join(first, "class_id").where("_row <> first._row").select("_row")))
    return rows.join(gone, "_row", "left_anti").drop("_row").toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that it takes n times has n rows, numbered in a last column `copy`
    (with underscores added while docs have a column of that name)."""
    name = "copy"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return mixed(docs, name)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("pii", pii), ("mix", mix)]
#: No SQL expresses the learned score of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_rows(docs)
    return docs
