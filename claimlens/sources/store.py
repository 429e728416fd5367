"""The reference store on disk: Parquet in buckets of ids, of which an update touches few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.plans.stage import staged
from claimlens.sources.cache import upsert

BUCKETS = 1024
_BUCKET = "_bucket"


def bucket_of(reference_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(reference_id), F.lit(buckets)).cast("int")


def write_store(refs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new store at a path: one folder for each bucket of ids, one row for each id."""
    rows = upsert(refs.limit(0), refs).withColumn(_BUCKET, bucket_of(F.col("reference_id"), buckets))
    rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)


def update_store(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS, order: str | None = None) -> int:
    """Put new references in place of those of the same id; the number of buckets rewritten.

    Only buckets that hold a new id are read and replaced, each at once when the write commits;
    a broken write leaves the store as it was. `buckets` must be the store's own number; `order`
    names the column that tells which of two new records of one id counts."""
    new = staged(new.withColumn(_BUCKET, bucket_of(F.col("reference_id"), buckets)))
    touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # no more than there are buckets
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col(_BUCKET).isin(*touched))
    # What is overwritten can't be read meanwhile.
    rows = staged(upsert(old.select(new.columns), new, order))
    rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    return len(touched)
