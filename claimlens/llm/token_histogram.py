"""Operator 7. Token counts by an exact length histogram.

Whole texts are encoded with a public byte-level BPE vocabulary, whose file is a parameter.
Documents of equal encoded length are one bin of the histogram; suffix sums over the bins
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import cut, pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's authors split text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bins of one range of lengths are summed in one task.
RANGE = 64
#: Code points encoded at a time; see pieces().
CHUNK = 1 << 16
_loaded: dict = {}


def encoding(vocabulary: str):
    """The encoder of a rank file, loaded once per worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a long text before a space that follows a letter and precedes one: the splitting
    pattern ends a piece there in any case, so that the counts add up."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for each row of (doc_id, text); null texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            counts = [sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "tokens": pa.array(counts, pa.int64())})

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def token_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per encoded length that occurs in (doc_id, text): tokens, n_docs (of just that
    length), docs_from and tokens_from (of documents of at least that length), total_docs,
    total_tokens, truncated_total (tokens kept by that context limit), quantile (share of
    documents of at most that length).

    Null and empty texts have length 0; null and repeated ids count as rows. An empty table
    gives an empty result; further columns are ignored, whatever they are called. Suffix sums
    run over ranges of RANGE lengths: within a range in one task, over the ranges' totals in
    another, which has a row for every 64 lengths up to the longest document at most (15,625 if
    that has a million tokens)."""
    bins = cut(token_counts(docs, vocabulary).groupBy("tokens").agg(F.count("*").alias("n_docs")))
    bins = bins.withColumn("part", F.floor(F.col("tokens") / RANGE))
    weight = (F.col("tokens") * F.col("n_docs")).alias("w")
    parts = bins.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("tokens") * F.col("n_docs")).alias("w"))
    after = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("w").over(after), F.lit(0)).alias("w_after"), F.sum("d").over(whole).alias("total_docs"), F.sum("w").over(whole).alias("total_tokens"))
    here = Window.partitionBy("part").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        bins.select("tokens", "n_docs", "part", weight)
        .select("tokens", "n_docs", "part", F.sum("n_docs").over(here).alias("d"), F.sum("w").over(here).alias("w"))
        .join(parts, "part")
        .select("tokens", "n_docs", (F.col("d") + F.col("d_after")).alias("docs_from"), (F.col("w") + F.col("w_after")).alias("tokens_from"), "total_docs", "total_tokens")
    )
    kept = F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("tokens")
    return found.withColumn("truncated_total", kept).withColumn("quantile", (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any context limits, from the histogram:
    the shortest length at or above a limit has what lies beyond it."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = histogram.agg(F.max("total_tokens")).first()[0] or 0
    met = asked.join(histogram, F.col("tokens") > F.col("context_limit"), "left")
    first = met.groupBy("context_limit").agg(F.min_by(F.struct("docs_from", "tokens_from"), "tokens").alias("x"))
    over = F.coalesce("x.docs_from", F.lit(0))
    return first.select("context_limit", over.alias("docs_over"), (F.lit(total) - F.coalesce("x.tokens_from", F.lit(0)) + over * F.col("context_limit")).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, tokens): the shortest length that the share of documents doesn't exceed."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(histogram, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("tokens").alias("tokens"))
