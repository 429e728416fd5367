"""Operator 11. Hard-negative mining over k-means inverted lists.

Vectors of whole numbers are scored by their inner product. Centroids are fitted to a bounded
sample; every vector is put into the list of its nearest centroid, and each list keeps the
radius of what it holds. By Cauchy-Schwarz, no vector of a list scores above
<q, centroid> + |q| radius for an anchor q, nor below <q, centroid> - |q| radius.

Anchors visit lists in the order of that upper bound, in rounds that grow: a list of which
every score lies outside the window is skipped, and an anchor stops when the bound falls
strictly below its kth score so far. Ties are still visited, so the results are those of an
exhaustive search. The first search is for positives, among the lists' rows of the anchor's
label; each positive's score sets a window, in which the second search looks for the first
rows of other labels.

A round is a join of visits with lists: both sides are dealt into tiles of bounded size, as a
list may hold a third of all rows, or be visited by all anchors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import cut, map_groups, pick

POSITIVES = 5
NEGATIVES = 10
#: Negatives score at least LOW and at most HIGH hundredths of their positive's score.
LOW, HIGH = 30, 90
#: Vectors that centroids are fitted to, centroids, numbers in all centroids of a dimension, and steps of the fit.
SAMPLE_ROWS = 16_384
MOST_LISTS = 1_024
MOST_NUMBERS = 1 << 20
STEPS = 8
#: Lists that an anchor visits in the first round; each round looks at so many times more.
FIRST_LISTS = 8
GROWTH = 16
#: Rows and visits of a tile. Small tables have smaller ones, so that tasks are even.
TILE_ROWS = 16_384
LEAST_ROWS = 512
TILE_VISITS = 1_024
_ROWS = "vec_id long, label long, dim int, numbers binary"


def whole_numbers(v: list, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component; None if some component is null or not finite, or so
    large that inner products could leave a long."""
    if v is None or None in v:
        return None
    x = np.floor(scale * np.array(v, np.float64))
    if not np.isfinite(x).all() or float(x @ x) >= 2.0**62:
        return None
    return x.astype(np.int64)


def _prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, one for each vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for vec_id, v, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = whole_numbers(v, scale)
                if x is not None:
                    made.append((vec_id, label, len(x), x.tobytes(), hashlib.blake2b(x.tobytes(), digest_size=8).digest()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["vec_id", "label", "dim", "numbers", "digest"])

    known = vectors.where("vec_id is not null and label is not null").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = known.mapInArrow(run, f"{_ROWS}, digest binary")
    # Of rows that repeat an id, one: of the smallest label, then the smallest digest.
    return rows.groupBy("vec_id").agg(F.min_by(F.struct("label", "dim", "numbers"), F.struct("label", "dim", "digest")).alias("r")).select("vec_id", "r.*")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - (centroids * centroids).sum(axis=1) / 2, axis=1)


def fit_lists(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of each dimension, fitted to SAMPLE_ROWS rows by the order of a hash, or to
    fewer if they would hold more than 16 times MOST_NUMBERS numbers. A dimension that the
    sample lacks has one list around zero."""
    total = rows.count()
    widest = rows.agg(F.max("dim")).first()[0] or 0
    few = max(1, min(SAMPLE_ROWS, 16 * MOST_NUMBERS // max(1, widest)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).select("dim", "numbers").toPandas()
    rng = np.random.default_rng(7)
    out: dict[int, np.ndarray] = {}
    for dim, held in sample.groupby("dim"):
        dim = int(dim)
        x = np.frombuffer(b"".join(held["numbers"]), np.int64).reshape(len(held), dim).astype(np.float64)
        wanted = min(MOST_LISTS, MOST_NUMBERS // max(1, dim), math.isqrt(total), max(1, len(x) // 8))
        distinct = np.unique(x, axis=0) if dim else x[:1]
        centroids = distinct[rng.choice(len(distinct), size=min(max(1, wanted), len(distinct)), replace=False)]
        for _ in range(STEPS):
            of = _nearest(x, centroids)
            n = np.bincount(of, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, of, x)
            centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        out[dim] = centroids
    return out


def _listed(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """rows with their list and their distance from its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            of, distance = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                x = _matrix(batch.column(3).take(pa.array(here)), d).astype(np.float64)
                c = centroids.get(d, np.zeros((1, d)))
                of[here] = _nearest(x, c)
                distance[here] = np.sqrt(((x - c[of[here]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of), pa.array(distance)], [*batch.schema.names, "list", "distance"])

    return rows.mapInArrow(run, f"{_ROWS}, list long, distance double")


class Bounds:
    """What an anchor can know of the lists of its dimension: their centroids and radii."""

    def __init__(self, centroids: dict[int, np.ndarray], radii: dict[tuple[int, int], float]):
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in {d for d, _ in radii}:
            number = np.array(sorted(k for of, k in radii if of == d), np.int64)
            self.lists[d] = number, centroids.get(d, np.zeros((1, d)))[number], np.array([radii[d, k] for k in number.tolist()])

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists in the order of their upper bounds, these, and the lower bounds, each
        loosened by what double precision may lose."""
        number, c, r = self.lists[len(q)]
        score, reach = c @ q.astype(np.float64), math.sqrt(float(q.astype(np.float64) @ q)) * r
        slack = 1e-9 * (np.abs(c) @ np.abs(q.astype(np.float64)) + reach) + 1e-6
        upper = score + reach + slack
        by = np.lexsort((number, -upper))
        return number[by], upper[by], (score - reach - slack)[by]


def _visits(state: DataFrame, bounds: Bounds, begin: int, end: int) -> DataFrame:
    """The lists from place `begin` on, and before `end`, that an anchor has still to visit:
    one row (anchor, label, dim, list) for each. state: vec_id, label, dim, numbers, and of each
    of the anchor's windows the lower and upper end and the kth score, as arrays of long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for numbers, *windows in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                number, upper, lower = bounds.of(np.frombuffer(numbers, np.int64))
                wanted = np.zeros(len(number), bool)
                for low, high, kth in zip(*windows, strict=True):
                    wanted |= (upper >= max(low, kth)) & (lower <= high)
                lists.append(number[begin:end][wanted[begin:end]])
            if lists:
                anchor = pa.array(np.repeat(np.arange(len(lists)), list(map(len, lists))))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(anchor) for k in range(3)), pa.array(np.concatenate(lists))], ["anchor", "label", "dim", "list"])

    return state.select("vec_id", "label", "dim", "numbers", "lows", "highs", "kths").mapInArrow(run, "anchor long, label long, dim int, list long")


def _tiles(visits: DataFrame, state: DataFrame, cells: DataFrame, sizes: DataFrame, keys: list[str], tile_rows: int) -> DataFrame:
    """Rows of cells and the visits to them, dealt so that each visit meets each row of its
    cell in one tile (*keys, block, chunk). sizes: the number of rows of each cell."""
    counted = cut(visits.groupBy(*keys).agg(F.count("*").alias("visits")).join(sizes, keys))
    blocks, chunks = F.ceil(F.col("rows") / tile_rows).cast("int"), F.ceil(F.col("visits") / TILE_VISITS).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = cells.join(counted, keys).withColumns({"block": F.pmod(F.xxhash64("vec_id"), blocks).cast("int"), "chunk": upto(chunks)})
    held = held.select(*keys, "block", "chunk", F.lit(0).alias("visit"), F.col("vec_id").alias("id"), F.col("label").alias("own"), "numbers", F.lit(None).cast("array<long>").alias("lows"), F.lit(None).cast("array<long>").alias("highs"))
    come = visits.join(counted, keys).withColumns({"chunk": F.pmod(F.xxhash64("anchor"), chunks).cast("int"), "block": upto(blocks)})
    come = come.join(state.select(F.col("vec_id").alias("anchor"), F.col("label").alias("own"), "numbers", "lows", "highs"), "anchor")
    return held.unionByName(come.select(*keys, "block", "chunk", F.lit(1).alias("visit"), F.col("anchor").alias("id"), "own", "numbers", "lows", "highs"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: by floating point where no sum can leave its whole numbers."""
    most = math.sqrt(float((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * float((b.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _scored(tiles: DataFrame, keys: list[str], k: int, same: bool) -> DataFrame:
    """Of each tile, the first k rows of each visit's windows: (anchor, window, id, score)."""

    def run(table: pa.Table) -> dict | None:
        visit = table.column("visit").to_numpy()
        if visit[0] or not visit[-1]:
            return None
        n = int(np.searchsorted(visit, 1))
        ids, labels, raw = table.column("id").to_numpy(), table.column("own").to_numpy(), table.column("numbers")
        dim = len(raw[0].as_py()) // 8
        x, q = _matrix(raw.slice(0, n), dim), _matrix(raw.slice(n), dim)
        by = np.argsort(ids[:n], kind="stable")  # of equal scores, the smaller id is found first
        ids_x, labels_x, x = ids[:n][by], labels[:n][by], x[by]
        score = _products(q, x)
        out: list[tuple[np.ndarray, ...]] = []
        lows, highs = table.column("lows").slice(n).to_pylist(), table.column("highs").slice(n).to_pylist()
        for v in range(len(q)):
            own, mine = score[v], labels_x == labels[n + v]
            fits = mine & (ids_x != ids[n + v]) if same else ~mine
            for window, (low, high) in enumerate(zip(lows[v], highs[v], strict=True)):
                at = np.flatnonzero(fits & (own >= low) & (own <= high))
                if len(at) > k:
                    least = np.partition(own[at], len(at) - k)[len(at) - k]
                    at = np.r_[at[own[at] > least], at[own[at] == least]][:k]
                out.append((np.full(len(at), ids[n + v]), np.full(len(at), window), ids_x[at], own[at]))
        return {name: np.concatenate([o[c] for o in out]).astype(np.int64) for c, name in enumerate(("anchor", "window", "id", "score"))} if out else None

    return map_groups(tiles, [*keys, "block", "chunk"], run, "anchor long, window long, id long, score long", ["visit"])


def _search(anchors: DataFrame, cells: DataFrame, keys: list[str], lists: int, bounds: Bounds, k: int, tile_rows: int) -> DataFrame:
    """(anchor, window, id, score, place): of each window of each anchor the first k, of which
    those of the anchor's label (keys holds it) or those of other labels are looked for.

    anchors: vec_id, label, dim, numbers, lows, highs."""
    same = "label" in keys
    sizes = cut(cells.groupBy(*keys).agg(F.count("*").alias("rows")))
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    found: DataFrame | None = None
    begin, end = 0, FIRST_LISTS
    while begin < lists:
        if found is None:
            state = anchors.withColumn("kths", F.col("lows"))
        else:
            kth = found.where(F.col("place") == k).groupBy(F.col("anchor").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
            state = anchors.join(kth, "vec_id", "left").withColumn("kths", F.transform("lows", lambda low, i: F.coalesce(F.get(F.map_values(F.map_filter("kth", lambda w, _: w == i)), 0), low))).drop("kth")
        visits = cut(_visits(state, bounds, begin, end).select("anchor", *keys))
        if not visits.isEmpty():
            # Rows below the kth score so far are nobody's: they stay in their tiles.
            asking = state.withColumn("lows", F.zip_with("lows", "kths", lambda low, kth: F.greatest(low, kth)))
            made = _scored(_tiles(visits, asking, cells, sizes, keys, tile_rows), keys, k, same)
            both = made if found is None else made.unionByName(found.drop("place"))
            found = cut(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
        elif found is None:
            found = cut(visits.select("anchor", F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("place")))
        begin, end = end, end * GROWTH
    return found


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors
    (vec_id, embedding, label): for each anchor and each of its first `positives` other rows of
    its label, the first `negatives` rows of other labels whose score is `low` to `high`
    hundredths of the positive's.

    Components count as floor(scale * component), in double precision; scores are inner products
    of these whole numbers, exact. Higher scores come first, of equal ones the smaller vec_id.
    Vectors of different dimensions are never compared. No part take rows of a null vec_id or
    label, null vectors, ones that hold null or non-finite components, and ones so long that
    scores could leave a long. Rows that repeat a vec_id are one row, of the smallest label,
    then the smallest digest. Anchors without positives, and positives without negatives, have
    no rows; an empty table gives an empty result. Further columns are ignored.

    The driver holds the sample of fit_lists() and a radius for each list, MOST_LISTS of them
    for a dimension at most."""
    rows = cut(_prepared(pick(vectors, "vec_id", "embedding", "label"), scale))
    centroids = fit_lists(rows)
    cells = cut(_listed(rows, centroids))
    radii = {(r["dim"], r["list"]): r["r"] for r in cells.groupBy("dim", "list").agg(F.max("distance").alias("r")).collect()}
    bounds, lists = Bounds(centroids, radii), max([1, *map(len, centroids.values())])
    tile_rows = max(LEAST_ROWS, min(TILE_ROWS, rows.count() // 64))
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1)
    anchors = cut(rows.where(is_anchor).select("vec_id", "label", "dim", "numbers", F.array(least).alias("lows"), F.array(most).alias("highs")))
    near = _search(anchors, cells, ["dim", "list", "label"], lists, bounds, positives, tile_rows)
    # A window for each positive, in its order: from ceil(low * score / 100) to floor(high * score / 100).
    per_cent = lambda n, up: F.expr(f"({n} * score + {99 if up else 0} - pmod({n} * score + {99 if up else 0}, 100)) div 100")
    windows = near.select("anchor", "place", "id", "score", per_cent(low, True).alias("low"), per_cent(high, False).alias("high"))
    ends = windows.groupBy(F.col("anchor").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    asking = cut(anchors.drop("lows", "highs").join(ends, "vec_id").select("vec_id", "label", "dim", "numbers", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")))
    far = _search(asking, cells, ["dim", "list"], lists, bounds, negatives, tile_rows)
    return far.join(near.select("anchor", (F.col("place") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
