"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.plans.stage import staged as cut


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name and position, so that further columns whose
    names repeat or differ in case only cannot make a reference ambiguous."""
    have = df.columns
    numbered = df.toDF(*[f"_{i}" for i in range(len(have))])
    return numbered.select(*[F.col(f"_{have.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """df with its columns named by position, and the function from old names to new ones:
    for joins that keep all columns whatever they are called. toDF() names them back."""
    have = df.columns
    return df.toDF(*[f"_{i}" for i in range(len(have))]), lambda name: f"_{have.index(name)}"


def cut_rows(df: DataFrame) -> DataFrame:
    """cut() for tables whose columns may have any names, also ones that differ in case only."""
    return cut(numbered(df)[0]).toDF(*df.columns)


def filter_texts(docs: DataFrame, judge: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of docs, with all columns, whose `text` passes. judge() is called once in each
    task; what it returns gets a list of texts and says which pass. Rows are judged where they
    stand: none is looked up again, whatever its id is or repeats."""
    plain, k = numbered(docs)[0], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(k).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: Rows of a few numbers each that a table may have to be broadcast: some 50 MB in a JVM.
BROADCAST_ROWS = 400_000


def fits_broadcast(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has BROADCAST_ROWS at most;
    a larger one is joined by a shuffle. Parquet's footers tell the count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def parts(spark: SparkSession) -> int:
    """Partitions for Python work that is dear per byte and so must not be coalesced by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_block_pairs(df: DataFrame, group: str, item: str, blocks: Column) -> DataFrame:
    """Replicate the rows of each group so that every pair of its rows meets in exactly one
    (group, i, j) with i <= j: a row of block b goes to (b, x) or (x, b) for each block x.

    Rows fall into `blocks` blocks by the hash of `item`. A group of one block stays as it
    is. Tasks hold two blocks at most, however large the group is."""
    b = F.pmod(F.xxhash64(F.col(item)), F.col("_n"))
    return (
        df.withColumn("_n", blocks.cast("int"))
        .withColumn("_b", b.cast("int"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("i", F.least("_b", "_x"))
        .withColumn("j", F.greatest("_b", "_x"))
        .withColumn("block", F.col("_b"))
        .drop("_n", "_b", "_x")
    )


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], dict | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Apply fn to the rows of each group of `keys` (long or int columns without nulls).

    fn gets a pyarrow table, and returns a dict of equally long arrays, one for each column of
    the schema (long, double or binary), or None. Groups must be of bounded size (see in_block_pairs); thousands of small
    ones share an Arrow batch, which applyInPandas would hand over one by one."""

    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    out = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def emit(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            made: list[dict] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                got = fn(table.slice(a, b - a))
                if got is not None:
                    made.append(got)
            if made:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([m[k] for m in made]), kind) for k, kind in out})

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            change = np.zeros(table.num_rows, dtype=bool)
            change[0] = True
            for k in keys:
                v = table.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            yield from emit(table.combine_chunks(), starts)
            rest = table.slice(int(starts[-1])).combine_chunks()
        if rest is not None:
            yield from emit(rest, np.array([0, rest.num_rows]))

    spark = df.sparkSession
    return df.repartition(parts(spark), *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links a[k]-b[k], the smallest node that each is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


#: Links that one task contracts at a time.
CONTRACT = 1_000_000


def _contracted(links: DataFrame) -> DataFrame:
    """links (u, v) with those of each part of a partition as stars: the same components, by
    fewer links. Without a shuffle, and however the links are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars() -> pa.RecordBatch:
            ids, at = np.unique(np.concatenate(held), return_inverse=True)
            at = at.reshape(-1, 2)
            root = roots(at[:, 0], at[:, 1], len(ids))
            tied = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_pydict({"u": ids[tied], "v": ids[root[tied]]})

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            if sum(map(len, held)) >= CONTRACT:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _at_rest(links: DataFrame) -> bool:
    """Whether links (u, v) are stars: no u has two partners, or is one."""
    sides = links.select(F.col("u").alias("x"), "v").unionByName(links.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
    unrest = sides.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or(F.col("v").isNull()).alias("is_v"))
    return unrest.where("lo <> hi or (lo is not null and is_v)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of edges (a, b), longs: root is the smallest connected id.

    Alternating large and small stars (Kiveris et al., 2014), after each partition's links have
    been contracted. Minima come from partial aggregation and go back by a join, so that a star
    of any size is split like any other skewed join. Each round is written to the shared
    folder. No link, an empty table."""
    now = cut(_contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    while not _at_rest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first: joined to a table instead of to an aggregate of its own stage, a hub's rows can be split.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now = cut(_contracted(small.distinct()))
    return now.unionByName(now.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("id"), F.col("v").alias("root"))
