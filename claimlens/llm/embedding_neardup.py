"""Operator 3. Near-duplicate embeddings by randomised-rotation binary codes (after RaBitQ, Gao and Long, 2024).

A unit vector u is rotated at random several times; each rotation keeps the signs of its D
coordinates and the factor f = <signs/sqrt(D), rotated u>. For any unit v,
<signs/sqrt(D), rotated v> / f estimates <u, v> without bias, with a standard error of
sqrt((1 - f*f) / (f*f * (D - 1))); the mean over the rotations has a smaller one. A pair
whose estimate plus `sigmas` standard errors is below the threshold is settled by that bound;
the others are computed exactly, in double precision.

Pairs that are looked at share a run of sign bits in some table, the label and the dimension.
Vectors at the threshold differ in a sign with probability acos(threshold) / pi, which sets
the number of tables for the target recall. In a table only codes travel: pairs whose codes
differ in more signs than vectors at the threshold do, by `sigmas` standard errors, are
dropped. The vectors of groups tied by the others are then verified pair by pair. Equal
vectors of a label are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.shared import components, cut, in_block_pairs, map_groups, pick, roots

THRESHOLD = 0.98
TARGET_RECALL = 0.999
SIGMAS = 4.0
#: Rows of a block of codes and of a block of vectors; two of them meet in a group. Groups of
#: up to MANY small blocks keep those, so that their pairs are dealt out; larger ones fill large blocks.
CODE_BLOCK = 256
VERIFY_BLOCK = 64
LARGE_BLOCK = 1024
MANY = 16


def tables_for(rows: int, threshold: float, target: float) -> tuple[int, int]:
    """(bits, tables): bits keep buckets small as rows grow, tables keep the recall."""
    bits = max(16, math.ceil(math.log2(max(2, rows))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - target) / math.log(1 - alike))


def rotations(dim: int, bits: int) -> np.ndarray:
    """As many random orthonormal matrices of the dimension as yield `bits` signs, and four at least."""
    rng = np.random.default_rng(dim * 7919 + 11)
    n = max(4, -(-bits // dim))
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of x, and which rows have one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        x = x[ok] / top[ok, None]
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], ok


def table_keys(signs: np.ndarray, bits: int, tables: int) -> bytes:
    """The sign bits of each table, `bits` of them and no more, padded to whole bytes."""
    return np.packbits(signs[: bits * tables].reshape(tables, bits), axis=1).tobytes()


_CODES = (("vec_id", pa.int64()), ("fp", pa.binary()), ("label", pa.int64()), ("dim", pa.int32()), ("keys", pa.binary()), ("code", pa.binary()), ("factor", pa.binary()), ("unit", pa.binary()))


def _codes(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            by_dim: dict[int, list[tuple]] = {}
            for vec_id, v, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if label is not None and v and None not in v:
                    by_dim.setdefault(len(v), []).append((vec_id, v, label))
            for d, rows in by_dim.items():
                raw = np.array([r[1] for r in rows], dtype=np.float64)
                units, ok = _units(raw)
                if not ok.any():
                    continue
                if d not in turn:
                    turn[d] = rotations(d, bits * tables)
                y = np.einsum("nij,kj->kni", turn[d], units, optimize=True)
                signs = y.reshape(len(units), -1) >= 0
                factor = np.abs(y).sum(axis=2) / math.sqrt(d)
                kept = [r for r, good in zip(rows, ok, strict=True) if good]
                fps = [hashlib.blake2b(f"{r[2]}:".encode() + x.tobytes(), digest_size=16).digest() for r, x in zip(kept, raw[ok], strict=True)]
                made = ([r[0] for r in kept], fps, [r[2] for r in kept], [d] * len(kept), [table_keys(x, bits, tables) for x in signs], [x.tobytes() for x in np.packbits(signs, axis=1)], [x.tobytes() for x in factor], [x.tobytes() for x in units])
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(_CODES, made, strict=True)})

    return vectors.mapInArrow(run, "vec_id long, fp binary, label long, dim int, keys binary, code binary, factor binary, unit binary")


def _stacked(column: pa.ChunkedArray, first: np.ndarray, kind: type) -> np.ndarray:
    """A matrix of equally long binaries, one for each of the rows `first`."""
    return np.frombuffer(b"".join(column.take(pa.array(first)).to_pylist()), dtype=kind).reshape(len(first), -1)


def most_signs(bits: int, threshold: float, sigmas: float) -> float:
    """The signs in which codes of vectors at the threshold differ, and `sigmas` standard errors more."""
    p = math.acos(min(1.0, threshold)) / math.pi
    return bits * p + sigmas * math.sqrt(bits * p * (1 - p))


def differing(code: np.ndarray) -> np.ndarray:
    """How many bits differ between the rows of packed codes, pairwise, by a product of signs."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return (signs.shape[1] - signs @ signs.T) / 2


def upper_bounds(code: np.ndarray, factor: np.ndarray, unit: np.ndarray, turn: np.ndarray, sigmas: float) -> np.ndarray:
    """Upper confidence bounds of all inner products: the smaller of the two directions."""
    n, d = len(turn), unit.shape[1]
    signs = (np.unpackbits(code, axis=1, count=n * d).reshape(len(unit), n, d).astype(np.float32) * 2 - 1) / math.sqrt(d)
    bound = np.zeros((len(unit), len(unit)), dtype=np.float32)
    for r in range(n):
        bound += (signs[:, r] @ (turn[r] @ unit.T).astype(np.float32)) / factor[:, r, None].astype(np.float32)
    error = np.sqrt(np.sum((1 - factor**2).clip(0) / factor**2, axis=1) / max(1, d - 1)) / n
    bound = bound / n + (sigmas * error[:, None] + 1e-5).astype(np.float32)  # and what single precision may lose
    return np.minimum(bound, bound.T)


def _candidates(nodes: DataFrame, bits: int, tables: int, threshold: float, sigmas: float) -> DataFrame:
    # Table t takes the sign bits from t * bits on; its key fills whole bytes, which substring() cuts out.
    width = -(-bits // 8)
    keys = F.array(*[F.xxhash64("label", "dim", F.lit(t), F.substring("keys", 1 + t * width, width)) for t in range(tables)])
    leaves = nodes.select("node", F.explode(keys).alias("bucket"))
    crowded = cut(leaves.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    met = cut(leaves.join(crowded, "bucket"))
    placed = in_block_pairs(met, "bucket", "node", F.ceil(F.col("members") / CODE_BLOCK)).select("bucket", "i", "j", "node")
    placed = placed.join(nodes.select("node", "code"), "node")

    def link(table: pa.Table) -> dict | None:
        if table.num_rows < 2:
            return None
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        code = _stacked(table.column("code"), first, np.uint8)
        a, b = np.nonzero(np.triu(differing(code) <= most_signs(code.shape[1] * 8, threshold, sigmas), 1))
        root = roots(a, b, len(ids))
        tied = np.flatnonzero(root != np.arange(len(root)))
        return {"a": ids[root[tied]], "b": ids[tied]} if len(tied) else None

    return map_groups(placed, ["bucket", "i", "j"], link, "a long, b long")


def _verified(nodes: DataFrame, groups: DataFrame, bits: int, threshold: float, sigmas: float) -> DataFrame:
    members = groups.join(nodes, F.col("id") == F.col("node")).select("node", "rows", "code", "factor", "unit", "root")
    members = members.join(cut(groups.groupBy("root").agg(F.count("*").alias("n"))), "root")
    few = F.least(F.lit(MANY), F.ceil(F.col("n") / VERIFY_BLOCK))
    placed = in_block_pairs(members, "root", "node", F.greatest(few, F.ceil(F.col("n") / LARGE_BLOCK)))
    turn: dict[int, np.ndarray] = {}

    def verify(table: pa.Table) -> dict | None:
        if table.num_rows < 2:
            return None
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        unit, factor = (_stacked(table.column(c), first, np.float64) for c in ("unit", "factor"))
        d = unit.shape[1]
        if d not in turn:
            turn[d] = rotations(d, bits)
        weight, part = (table.column(c).to_numpy()[first] for c in ("rows", "block"))
        open_ = np.triu(upper_bounds(_stacked(table.column("code"), first, np.uint8), factor, unit, turn[d], sigmas) >= threshold, 1)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            open_ &= part[:, None] != part[None, :]  # pairs within a block meet in (i, i)
        a, b = np.nonzero(open_)
        exact = np.concatenate([np.einsum("ij,ij->i", unit[a[at : at + 65536]], unit[b[at : at + 65536]]) for at in range(0, len(a), 65536)]) if len(a) else np.empty(0)
        a, b = a[exact >= threshold], b[exact >= threshold]
        if not len(a):
            return None
        root, n = roots(a, b, len(ids)), len(ids)
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        on = np.flatnonzero(links)
        return {"node": ids[on], "root": ids[root[on]], "links": links[on].astype(np.int64)}

    return map_groups(placed, ["root", "i", "j"], verify, "node long, root long, links long")


def embedding_neardup(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, sigmas: float = SIGMAS) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Linked are vectors of one label (not null) and dimension whose cosine is `threshold` or
    more. Null, empty or zero vectors, and ones that hold null or non-finite components, have
    no links and are components of their own, as are rows of a null vec_id (component_id
    null, kept). Rows that repeat a vec_id are one vector (of the smallest fingerprint, should
    they differ). An empty table gives an empty result; further columns are ignored."""
    vectors = pick(vectors, "vec_id", "embedding", "label")
    bits, tables = tables_for(vectors.count(), threshold, target_recall)
    coded = cut(_codes(vectors.where("vec_id is not null"), bits, tables))
    named = coded.groupBy("vec_id").agg(F.min("fp").alias("fp"))
    groups_of = cut(named.groupBy("fp").agg(F.min("vec_id").alias("node"), F.count("*").alias("rows")))
    nodes = cut(coded.withColumnRenamed("vec_id", "node").join(groups_of, ["node", "fp"]).dropDuplicates(["node"]).drop("fp"))
    groups = components(_candidates(nodes, bits, tables, threshold, sigmas))
    checked = cut(_verified(nodes, groups, bits * tables, threshold, sigmas))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("root").alias("a"), F.col("node").alias("b"))).withColumnRenamed("id", "node")
    judged = groups_of.join(links, "node", "left").join(classes, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    found = named.join(judged, "fp").select("vec_id", "n_links", "component_id")
    ids = vectors.select("vec_id").where("vec_id is not null").distinct()
    out = ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.unionByName(vectors.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
