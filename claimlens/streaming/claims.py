"""Claims as a stream. The reference works in single runs; this is an addition to it.

A stream of claims meets the static reference store; results are appended, and references
that are missing go to the worklist. Both writes carry the batch id, so that a repeated
batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlens.operators.validate import validate
from claimlens.plans.config import ValidationConfig
from claimlens.plans.lifecycle import unresolved

CLAIM = "claim_id long, supporting_text string, reference_id string, expected_title string, path string"


def read_claims(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", files_per_batch).json(path)


def validated(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """Strict verdicts on a stream: a stream-static join without state."""
    return validate(claims, refs, config, suggest=False)


def start(claims: DataFrame, store: str, results: str, worklist: str, checkpoint: str, config: ValidationConfig | None = None, once: bool = True) -> StreamingQuery:
    """Validate each batch against the store as it is then, with suggestions for failures."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        refs = batch.sparkSession.read.parquet(store)
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        for df, path in ((validate(batch, refs, config), results), (unresolved(batch, refs, config), worklist)):
            df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch").parquet(path)

    writer = claims.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Verdicts per window of their time `ts`; rows later than `late` are dropped with the window's state."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("claims"), F.count_if("is_valid").alias("valid")).select(F.col("w.start").alias("start"), "claims", "valid")


#: What is known of a reference's full text, by the attempts so far.
RETRY = "reference_id string, attempts int, last_error string, state string"


def missing_once(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """(reference_id, source) of the references that a stream of claims names and the store lacks,
    each once in the stream's life: what has been asked for is state, which a restart keeps."""
    return unresolved(claims, refs, config).dropDuplicates(["reference_id"])


def retries(attempts: DataFrame, most: int = 5) -> DataFrame:
    """RETRY rows for a stream of attempts to get a full text (reference_id, usable, error: null
    if none): a row for each reference that a batch says something new of, with its state.

    'found' once an attempt was usable, 'none' after one that neither failed nor was usable, and
    both for good; 'retry' while all have failed, and 'given up' after `most` of them. Attempts
    of a batch count together: an error only if none of them went through. Null ids are passed over."""
    import pandas as pd

    def step(key, batches, held):
        count, error, state = held.get if held.exists else (0, None, "retry")
        rows = pd.concat(list(batches))
        if state in ("found", "none"):
            return
        count += 1
        failed = rows["error"].notna()
        if rows["usable"].fillna(False).any():
            error, state = None, "found"
        elif failed.any():
            error = sorted(rows["error"][failed])[-1]
            state = "given up" if count >= most else "retry"
        else:
            error, state = None, "none"
        held.update((count, error, state))
        yield pd.DataFrame({"reference_id": [key[0]], "attempts": [count], "last_error": [error], "state": [state]})

    keyed = attempts.where("reference_id is not null").select("reference_id", "usable", "error").groupBy("reference_id")
    return keyed.applyInPandasWithState(step, RETRY, "attempts int, last_error string, state string", "update", "NoTimeout")
