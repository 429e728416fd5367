"""The sentence of a document that is closest to a query, as a join and an aggregation.

Only documents that queries name are read. They are cut into sentences once each and meet
their queries by key. Sentences that share no significant word with a query can't score and
are dropped before the costly ratio. That runs over the rest in Arrow batches, all pairs of a
batch at once: first those with enough common words, then those of the others that may still
beat the best of their query in the batch, as a score is at most twice the overlap. The best
is one aggregate per query of what the batches found, so a document that many queries name is
split like any skewed join, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from claimlens.functions import text
from claimlens.functions.fuzzy import partial_ratios
from claimlens.plans.stage import staged

MIN_WORDS = 5
MIN_OVERLAP = 50.0
EXCELLENT = 95.0


def _scored(met: DataFrame, key: str, min_overlap: float) -> DataFrame:
    """Rows of (key, q_norm, pos, sentence, s_norm, overlap) that may decide, with their ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.names.index(name))  # noqa: B023, E731
            asked, sentences, overlap = column("q_norm").to_numpy(False), column("s_norm").to_numpy(False), column("overlap").to_numpy()
            _, query = np.unique(column("_query").to_numpy(), return_inverse=True)
            score = np.zeros(len(overlap))
            best = np.zeros(query.max(initial=-1) + 1)
            enough = np.flatnonzero(overlap >= min_overlap)
            score[enough] = partial_ratios(asked[enough], sentences[enough])
            np.maximum.at(best, query[enough], score[enough])
            rest = np.flatnonzero((overlap < min_overlap) & (100.0 * overlap / min_overlap >= best[query]))
            score[rest] = partial_ratios(asked[rest], sentences[rest])
            kept = pa.array(np.sort(np.concatenate([enough, rest])))
            yield pa.RecordBatch.from_arrays([*batch.take(kept).columns[:-1], pa.array(score).take(kept)], names=[*batch.schema.names[:-1], "ratio"])

    found = met.select(key, "q_norm", "pos", "sentence", "s_norm", "overlap")
    return found.withColumn("_query", F.xxhash64(key)).mapInArrow(run, StructType([*found.schema.fields, StructField("ratio", DoubleType())]))


def fuzzy_search(queries: DataFrame, contents: DataFrame, threshold: float = 85.0, max_chars: int | None = None, min_overlap: float = MIN_OVERLAP, key: str = "claim_id") -> DataFrame:
    """One row per query of (key, query, ref_key): key, query, found, score (0-100), best_match.

    contents: ref_key, content, one row per key. A query that the content contains, but for
    white space and case, scores 100 and is its own best match. Otherwise queries under five
    words find nothing, nor does any in contents over max_chars (None: of any length). The
    first sentence of 95 or more with enough common words ends the search; else the best
    counts, the earlier among equals, a score being lowered in proportion where fewer than
    min_overlap percent of the query's significant words occur."""
    contents = contents.select("ref_key", "content").join(queries.select("ref_key").distinct(), "ref_key", "left_semi")
    q = queries.select(key, "query", "ref_key", text.normalize_whitespace(F.col("query")).alias("q_norm"))
    flat = contents.select("ref_key", F.length("content").alias("chars"), text.normalize_whitespace(F.col("content")).alias("t_norm"))
    held = q.join(flat, "ref_key")
    fits = F.lit(True) if max_chars is None else F.col("chars") <= max_chars
    state = F.when(~fits, "none").when(F.contains("t_norm", "q_norm"), "exact").when(F.size(F.split("q_norm", " ")) < MIN_WORDS, "none").otherwise("search")
    judged = staged(held.select(key, "query", "ref_key", "q_norm", state.alias("state")))
    asked = judged.where("state = 'search'").select(key, "ref_key", "q_norm", text.significant_words(F.col("query")).alias("q_words"))
    # Only documents with a query that is searched for are cut into sentences.
    open_ = contents.join(asked.select("ref_key").distinct(), "ref_key", "left_semi")
    sentences = open_.select("ref_key", F.posexplode(text.split_sentences(F.col("content"))).alias("pos", "sentence"))
    sentences = sentences.select("ref_key", "pos", "sentence", text.normalize_whitespace(F.col("sentence")).alias("s_norm"), text.significant_words(F.col("sentence")).alias("s_words"))
    met = asked.join(sentences, "ref_key").withColumn("overlap", text.overlap_of_words(F.col("q_words"), F.col("s_words"))).where("overlap > 0")
    enough = F.col("overlap") >= min_overlap
    scored = _scored(met, key, min_overlap).withColumn("effective", F.when(enough, F.col("ratio")).otherwise(F.col("ratio") * F.col("overlap") / min_overlap))
    best = scored.where("effective > 0").groupBy(key).agg(
        F.min(F.when((F.col("ratio") >= EXCELLENT) & enough, F.struct("pos", "ratio", "sentence"))).alias("first"),
        F.max(F.struct("effective", (-F.col("pos")).alias("back"), "overlap", "sentence")).alias("top"),
    )
    out = judged.join(best, key, "left")
    exact, first = F.col("state") == "exact", F.col("first").isNotNull()
    score = F.when(exact, 100.0).when(first, F.col("first.ratio")).otherwise(F.coalesce(F.col("top.effective"), F.lit(0.0)))
    found = exact | first | F.coalesce((F.col("top.effective") >= threshold) & (F.col("top.overlap") >= min_overlap), F.lit(False))
    return out.select(key, "query", found.alias("found"), score.alias("score"), F.when(exact, F.col("query")).when(first, F.col("first.sentence")).otherwise(F.col("top.sentence")).alias("best_match"))
