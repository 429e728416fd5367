"""Operator 10. Mixing sources to target weights by capped water-filling.

Targets share the corpus by weight. A source stops at `epochs` times its size; what it can't
take is dealt again by weight among the others, round by round, until none is above. A
document is then taken floor(target / source size) times, and once more if it falls into the
fractional part: documents of a source stand in a seeded hash order, and those whose middle
lies within the fraction of the source's words are taken. So the words of a source miss its
target by half a document at most, and reruns agree.

The hash order is cut into 4,096 ranges of each source. Their sizes tell in which range the
fraction ends, so that a document's range decides for all but that one, whose documents alone
are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import cut, fits_broadcast, numbered, pick

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
#: Hex digits of a document's hash that name its range.
BIN_DIGITS = 3
SEED = 17


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without gathering them in one task:
    a range sort, then each partition's offset. The sort is written first, as both read it."""
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return ordered.join(starts, part == F.col("_p")).select("source", "source_size", (F.coalesce("_start", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target) for sources of (source, source_size).

    Sources of size 0 have target 0. Should all be capped, the rest is dealt to none."""
    ring = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size") * float(epochs)
    open_ = cut(_ranked(sources).withColumn("weight", F.element_at(ring, (F.col("rank") % len(weights) + 1).cast("int"))).select("source", "source_size", "weight", (F.col("source_size") <= 0).alias("capped")))
    budget = float(open_.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        spent, weight = open_.agg(F.sum(F.when(F.col("capped"), cap).otherwise(0.0)), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight")))).first()
        level = max(0.0, budget - (spent or 0.0)) / weight if weight else 0.0
        over = ~F.col("capped") & (F.col("weight") * level > cap)
        if not open_.where(over).limit(1).count():
            return open_.select("source", "source_size", "weight", F.when(F.col("capped"), cap).otherwise(F.col("weight") * level).alias("target"))
        open_ = cut(open_.withColumn("capped", F.col("capped") | over))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, text, source) with size, place in the hash order and range of it; rows without
    a doc_id have a place by their text."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).cast("binary"))
    sized = docs.withColumn("size", words(F.col("text"))).withColumn("_h", order)
    return sized.withColumn("bin", F.conv(F.substring("_h", 1, BIN_DIGITS), 16, 10).cast("int"))


def _plan(bins: DataFrame, weights: Sequence[float], epochs: float, share: float) -> DataFrame:
    """Per source of bins (source, bin, bin_size): source_size, target, rate, edge and
    edge_start: the range in which the fraction ends (-1: none is taken once more) and the
    words before it."""
    targets = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, epochs, share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut(targets.withColumn("rate", rate).withColumn("end", (rate - F.floor(rate)) * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    met = targets.alias("t").join(starts.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")) & (F.col("rate") > F.floor("rate")) & (F.col("start") <= F.col("end")) & (F.col("end") < F.col("start") + F.col("bin_size")), "left")
    found = met.select("t.source", "source_size", "target", "rate", "end", F.coalesce("bin", F.lit(-1)).alias("edge"), F.coalesce("start", F.lit(0)).alias("edge_start"))
    return fits_broadcast(cut(found))


def _edge_extra(*order: str) -> Column:
    """Whether a row of its source's last range still lies within the fraction."""
    within = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("edge_start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2 <= F.col("end")


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "_source")
    return sized.join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, share: float = 1.0) -> DataFrame:
    """One row per row of (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    size counts words (null or empty text: 0; texts of any length are counted whole), copies
    says how often the mix takes the document, taken = copies * size. A null source is a
    source of its own, the last; null and repeated doc_ids are rows like others, ties in the
    hash order go by doc_id and size. An empty table gives an empty result; further columns
    are ignored, whatever they are called."""
    sized = cut(_sized(pick(docs, "doc_id", "text", "source"), seed).select("doc_id", "source", "size", "_h", "bin"))
    bins = cut(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    placed = _with_plan(sized, _plan(bins, weights, epochs, share))
    inner = placed.where(F.col("bin") != F.col("edge")).withColumn("extra", F.col("bin") < F.col("edge"))
    last = placed.where(F.col("bin") == F.col("edge")).withColumn("extra", _edge_extra("_h", "doc_id", "size"))
    copies = (F.floor("rate") + F.col("extra").cast("long")).cast("long")
    return inner.unionByName(last).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, copy: str = "copy", weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, share: float = 1.0) -> DataFrame:
    """docs, all columns, with as many rows of each as mix_sources() takes of it, numbered from
    1 in a last column named `copy`.

    Rows are judged where they stand, by the place of the last one taken once more of their
    source; texts aren't shuffled, but for the rows equal to that one in place and text, if
    some of these are taken and others aren't."""
    plain, at = numbered(docs)
    named = plain.select("*", *[F.col(at(n)).alias(n) for n in ("doc_id", "text", "source")])
    sized = _sized(named, seed).withColumn("_place", F.struct("_h", "size", F.xxhash64("text").alias("text")))
    bins = cut(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    plan = _plan(bins, weights, epochs, share)
    # The last range of each source, without its texts.
    ends = _with_plan(sized.select("source", "size", "bin", "_place"), plan).where(F.col("bin") == F.col("edge"))
    ends = cut(ends.select("source", "_place", _edge_extra("_place").alias("extra")))
    last = ends.where("extra").groupBy("source").agg(F.max("_place").alias("last"))
    run = ends.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")) & (F.col("e._place") == F.col("l.last"))).groupBy("l.source", "last").agg(F.count("*").alias("equal"), F.count_if("extra").alias("some"))
    p, r = plan.alias("p"), run.alias("r")
    plan = fits_broadcast(cut(p.join(r, F.col("p.source").eqNullSafe(F.col("r.source")), "left").select("p.*", "last", "equal", "some")))
    placed = _with_plan(sized, plan)
    split = F.coalesce((F.col("_place") == F.col("last")) & (F.col("some") < F.col("equal")), F.lit(False))
    before = F.coalesce(F.col("_place") <= F.col("last"), F.lit(False))
    extra = F.when(F.col("bin") == F.col("edge"), before).otherwise(F.col("bin") < F.col("edge"))
    whole = placed.withColumn("_extra", extra)
    if plan.where("some < equal").limit(1).count():
        among = placed.where(split).withColumn("_extra", F.row_number().over(Window.partitionBy("source").orderBy("_place")) <= F.col("some"))
        whole = whole.where(~split).unionByName(among)
    copies = (F.floor("rate") + F.col("_extra").cast("int")).cast("int")
    numbers = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return whole.withColumn("_copy", F.explode(numbers)).select(*plain.columns, "_copy").toDF(*docs.columns, copy)
