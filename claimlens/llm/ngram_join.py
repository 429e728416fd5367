"""Operator 1. N-gram Jaccard join by a MinHash LSH forest.

Texts become sets of five-word shingles (lower case, words between white space; a text of
fewer words is one shingle, an empty one the empty set). Rows with equal sets form a node.
The lowest bytes of a node's MinHash values make one path of `longest` bytes in each of
`trees` prefix tries. A path is a number whose leading bytes are its prefixes, and a trie is
its sorted leaves: those below any prefix are one run of numbers.

The descent starts at the longest prefixes and shortens them step by step. At each length,
nodes below one prefix whose signatures agree well enough are tied. Then each node is judged:
pairs as alike as its weakest tie have met with a known probability, and once that is the
target recall, the node is settled and another one of its group stands for it, so that
shorter prefixes hold a node of each tight group instead of all. Nodes without ties or with
weaker ones go on, STEP values shorter each time, until a pair at the threshold is met with the target recall. Within the
groups of all ties every pair is verified exactly on its shingle sets; members of a large
group travel as their differences from the group's first node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.shared import components, cut, fits_broadcast, in_block_pairs, map_groups, pick, roots

WORDS = 5
THRESHOLD = 0.8
TREES = 20
#: Values by which prefixes are shortened at a time.
STEP = 2
#: Values of a path, eight at most: their bytes are a long.
LONGEST = 8
TARGET_RECALL = 0.995
#: The recall, for pairs as alike as its weakest tie, at which a group needs no shorter prefixes.
SETTLED_RECALL = 0.9999
#: Rows of a signature block and of a verification block; two of them meet in a group. Groups
#: of up to MANY small blocks keep those, so that their pairs are dealt out; larger ones fill large blocks.
SIGNATURE_BLOCK = 256
VERIFY_BLOCK = 48
LARGE_BLOCK = 512
MANY = 24
VERIFY_SHINGLES = 1_000_000
#: Signature agreement that keeps a pair together: below the threshold by several standard errors.
AGREE = 0.6
NEAR = 0.9

_SPAN = 1 << 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept per worker on purpose
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(cache.get("up", ())) < n:
        base = 0xD6E8FEB86659FD93
        size = max(n, 1 << 17)
        for name, step in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, step, dtype=np.uint64)
            p[0] = 1
            cache[name] = np.cumprod(p, dtype=np.uint64)
    return cache["up"], cache["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    flat = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    if not flat:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(flat, dtype=np.uint8)
    gap = np.flatnonzero(raw == 32)
    start = np.concatenate(([0], gap + 1))
    end = np.concatenate((gap, [len(raw)]))
    n = max(1, len(start) - words + 1)
    last = end[min(words, len(end)) - 1 :][:n]
    found = []
    for at in range(0, n, _SPAN):  # long texts go span by span
        s, e = start[at : at + _SPAN][: n - at], last[at : at + _SPAN]
        lo, hi = int(s[0]), int(e[-1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        found.append(_mix((total[e - lo] - total[s - lo]) * down[s - lo] + (e - s).astype(np.uint64)))
    return np.unique(np.concatenate(found))


def met_with(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair shares a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int, longest: int, target: float) -> int:
    """The longest prefix by which a pair at the threshold is met with the target recall."""
    depth = longest
    while depth > 1 and met_with(threshold, depth, trees) < target:
        depth -= 1
    return depth


def _signature(hashes: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash values: the least of each odd multiple plus offset of the hashes, all of 32 bits."""
    best = np.full(len(mult), np.iinfo(np.uint32).max, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        turned = mult[:, None] * x[at : at + 4096]
        turned += add[:, None]
        np.minimum(best, turned.min(axis=1), out=best)
    return best


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _features(docs: DataFrame, words: int, trees: int, longest: int) -> DataFrame:
    """fp, size and paths of each row: the path in each tree, a byte for each of its values."""
    width = trees * longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240501)
        mult = rng.integers(0, 1 << 32, width, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 1 << 32, width, dtype=np.uint32)
        for batch in batches:
            fp, size = [], []
            path = np.zeros((batch.num_rows, trees, 8), dtype=np.uint8)
            for k, text in enumerate(batch.column(1).to_pylist()):
                h = shingles(text, words)
                fp.append(_fingerprint(h))
                size.append(len(h))
                path[k, :, :longest] = _signature(h, mult, add).astype(np.uint8).reshape(trees, longest)
            paths = pa.ListArray.from_arrays(np.arange(0, path.size // 8 + 1, trees, dtype=np.int32), path.reshape(-1).view(">i8").astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": fp, "size": pa.array(size, pa.int32()), "paths": paths})

    return docs.mapInArrow(run, "doc_id long, fp binary, size int, paths array<long>")


def _values(paths: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The bytes of the paths, a row for each node."""
    flat = paths.combine_chunks() if isinstance(paths, pa.ChunkedArray) else paths
    return flat.flatten().to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(len(paths), -1)


def _near(sig: np.ndarray, agree: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that span the rows whose signatures agree by `agree` or more, and their agreement.

    Leaders are taken in order; rows within `near` of one need not lead. Jaccard distance is
    a metric, so partners at the threshold share a leader within reach of `agree`."""
    open_, a, b, how = np.ones(len(sig), dtype=bool), [], [], []
    for at in range(len(sig)):
        if not open_[at]:
            continue
        same = (sig == sig[at]).mean(axis=1)
        open_[same >= near] = False
        met = np.flatnonzero(same >= agree)
        a.append(np.full(len(met), at))
        b.append(met)
        how.append(same[met])
    return np.concatenate(a), np.concatenate(b), np.concatenate(how)


def _prefix(depth: int) -> Column:
    """A leaf's prefix of so many values, as one number with its tree."""
    return F.xxhash64("tree", F.shiftrightunsigned("path", 8 * (8 - depth)))


def _leaves(sigs: DataFrame, shortest: int) -> DataFrame:
    """The sorted leaves (tree, path, node) that share a shortest prefix with another node."""
    leaves = sigs.select("node", F.posexplode("paths").alias("tree", "path"))
    tops = leaves.groupBy(_prefix(shortest).alias("top")).agg(F.count("*").alias("members"))
    shared = fits_broadcast(cut(tops.where("members > 1").select("top")))
    return leaves.withColumn("top", _prefix(shortest)).join(shared, "top").drop("top").sortWithinPartitions("tree", "path")


def _ties(live: DataFrame, sigs: DataFrame, depth: int, agree: float) -> DataFrame:
    """(a, b, alike) between nodes below one prefix that belong to different groups.

    live: tree, path, node, root. A crowded prefix is first held against its first node: those
    as near to it as NEAR are done, as all their partners are tied to it too. The rest of the
    rows, and those of smaller prefixes, meet pairwise in blocks."""
    low = sigs.select("node", "paths")
    at = live.select(_prefix(depth).alias("bucket"), "node", "root")
    crowd = cut(at.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("first"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", "members", "first"))
    rows = cut(at.select("bucket", "node").join(fits_broadcast(crowd), "bucket"))
    large = F.col("members") > SIGNATURE_BLOCK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_values(batch.column("paths")) == _values(batch.column("lead"))).mean(axis=1)
                yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "first": batch.column("first"), "node": batch.column("node"), "alike": same})

    alike = rows.where(~large).select("bucket", "members", "node")
    star = None
    if not crowd.where(large).isEmpty():
        leaders = cut(crowd.where(large).join(low.withColumnRenamed("node", "first"), "first").select("bucket", F.col("paths").alias("lead")))
        met = rows.where(large).join(leaders, "bucket").join(low, "node").select("bucket", "first", "node", "paths", "lead")
        starred = cut(met.mapInArrow(compare, "bucket long, first long, node long, alike double"))
        others = starred.where(F.col("first") != F.col("node"))
        rest = others.where(F.col("alike") < NEAR).select("bucket", "node")
        left = cut(rest.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
        alike = alike.unionByName(rest.join(left, "bucket").select("bucket", "members", "node"))
        star = others.where(F.col("alike") >= agree).select(F.col("first").alias("a"), F.col("node").alias("b"), "alike")
    placed = in_block_pairs(alike.join(low, "node"), "bucket", "node", F.ceil(F.col("members") / SIGNATURE_BLOCK)).select("bucket", "i", "j", "node", "paths")

    def link(table: pa.Table) -> dict | None:
        if table.num_rows < 2:
            return None
        ids = table.column("node").to_numpy()
        a, b, alike = _near(_values(table.column("paths")), agree, NEAR)
        root = roots(a, b, len(ids))
        weakest = np.ones(len(ids))
        np.minimum.at(weakest, root[a], alike)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return {"a": ids[root[tied]], "b": ids[tied], "alike": weakest[root[tied]]} if len(tied) else None

    met = map_groups(placed, ["bucket", "i", "j"], link, "a long, b long, alike double")
    return met if star is None else met.unionByName(star)


def _groups(sigs: DataFrame, trees: int, longest: int, shortest: int, target: float, agree: float) -> DataFrame:
    """(id, root) of the nodes that the descent ties, by group.

    At each length a node takes the smallest node it is tied to as its head. It is settled if
    pairs as alike as its weakest tie are met so far with the target recall; settled nodes
    leave the tries, where their heads, or the heads' heads, stand for them."""
    live = cut(_leaves(sigs, shortest).withColumn("root", F.col("node")))
    ties = None
    for depth in [*range(longest, shortest, -STEP), shortest]:
        found = cut(_ties(live, sigs, depth, agree))
        ties = found if ties is None else ties.unionByName(found)
        if depth > shortest:
            settled = 1 - F.pow(1 - F.pow(F.min("alike"), F.lit(depth)), F.lit(trees)) >= target
            heads = cut(ties.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("head"), settled.alias("settled")))
            live = live.join(heads, "node", "left").where(~F.coalesce("settled", F.lit(False)))
            live = cut(live.withColumn("root", F.coalesce("head", "root")).drop("head", "settled"))
    return components(ties.select("a", "b"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (not of a set with itself), by products
    of 0/1 matrices over slices of the elements that two sets or more have."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocab, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    number = np.cumsum(times > 1) - 1
    row, col, n = row[shared], number[col[shared]], int((times > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, n, 8192):
        lo, hi = np.searchsorted(col, [at, at + 8192])
        m = np.zeros((len(sets), min(8192, n - at)), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        common += m @ m.T
    return common


def _linked(common: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _links(linked: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> dict | None:
    a, b = np.nonzero(linked)
    if not len(a):
        return None
    root, touched = roots(a, b, len(ids)), linked.any(axis=1)
    return {"node": ids[touched], "root": ids[root[touched]], "links": (linked @ weight)[touched].astype(np.int64)}


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, root, links) for each node and group: its smallest partner in reach there, and
    the rows it is linked to by pairs of that group. nodes: node, rows, size, fp.

    A group of one block is verified where its sets meet. The members of others become their
    differences from the set of the group's first node, which every block of it gets: with
    r elements of that set P missing, two members have |P| - r1 - r2 + |D1 & D2| in common."""
    members = cut(groups.join(nodes, F.col("id") == F.col("node")).select("node", "fp", "rows", "size", "root"))
    sums = cut(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s")))
    blocks = F.greatest(F.ceil(F.col("n") / VERIFY_BLOCK), F.ceil(F.col("s") / VERIFY_SHINGLES)).cast("int")
    members = fits_broadcast(cut(members.join(sums.select("root", blocks.alias("blocks")), "root")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            # Rows of this doc_id with another text are not this node.
            same = pa.array([_fingerprint(h) == fp for h, fp in zip(found, batch.column("fp").to_pylist(), strict=True)], pa.bool_())
            out = {c: batch.column(c) for c in ("node", "rows", "root", "blocks")}
            yield pa.RecordBatch.from_pydict({**out, "set": pa.array([h.tobytes() for h in found], pa.binary())}).filter(same)

    held = docs.join(members, docs["doc_id"] == members["node"])
    held = held.select("node", "rows", "root", "blocks", "fp", "text").mapInArrow(sets, "node long, rows long, root long, blocks int, set binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    held = held.withColumn("own", own).withColumn("block", F.explode(everywhere))

    def meet(table: pa.Table) -> dict | None:
        node = table.column("node").to_numpy()
        ids, first = np.unique(node, return_index=True)
        raw, rows = table.column("set").take(pa.array(first)).to_pylist(), table.column("rows").to_numpy()[first]
        found = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        if table.column("blocks")[0].as_py() == 1:
            size = np.array([len(x) for x in found], dtype=float)
            got = _links(_linked(_overlaps(found), size, threshold), ids, rows) if len(ids) > 1 else None
            return got and {**got, "group": got["root"], "rows": got["links"], "size": got["links"], "lost": got["links"], "diff": np.array([None] * len(got["node"]), dtype=object)}
        root, block = table.column("root")[0].as_py(), table.column("block")[0].as_py()
        pivot = found[int(np.searchsorted(ids, root))]
        mine = np.flatnonzero(table.column("own").to_numpy()[first] == block)
        diffs = [np.setxor1d(found[k], pivot, assume_unique=True) for k in mine]
        size = np.array([len(found[k]) for k in mine], dtype=np.int64)
        lost = np.array([(len(d) + len(pivot) - n) // 2 for d, n in zip(diffs, size, strict=True)], dtype=np.int64)
        none = np.zeros(len(mine), dtype=np.int64)
        return {"node": ids[mine], "root": ids[mine], "links": none, "group": np.full(len(mine), root), "rows": rows[mine], "size": size, "lost": lost, "diff": np.array([d.tobytes() for d in diffs], dtype=object)} if len(mine) else None

    met = cut(map_groups(held, ["root", "block"], meet, "node long, root long, links long, group long, rows long, size long, lost long, diff binary"))
    apart = met.where("diff is not null").select("node", "group", "rows", "size", "lost", "diff")
    totals = cut(apart.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("diff") / 8).alias("s")))
    few = F.least(F.lit(MANY), F.ceil(F.col("n") / VERIFY_BLOCK))
    placed = in_block_pairs(apart.join(totals, "group"), "group", "node", F.greatest(few, F.ceil(F.col("n") / LARGE_BLOCK), F.ceil(F.col("s") / VERIFY_SHINGLES)))

    def verify(table: pa.Table) -> dict | None:
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        raw = table.column("diff").take(pa.array(first)).to_pylist()
        weight, block, lost, size = (table.column(c).to_numpy()[first] for c in ("rows", "block", "lost", "size"))
        diffs = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        pivot = size[0] - len(diffs[0]) + 2 * lost[0]
        linked = _linked(pivot - lost[:, None] - lost[None, :] + _overlaps(diffs), size.astype(float), threshold)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked &= block[:, None] != block[None, :]  # pairs within a block meet in (i, i)
        return _links(linked, ids, weight)

    return met.where("diff is null").select("node", "root", "links").unionByName(map_groups(placed, ["group", "i", "j"], verify, "node long, root long, links long"))


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target_recall: float = TARGET_RECALL, settled_recall: float = SETTLED_RECALL) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, class_id, n_links, kept.

    n_links counts the other documents whose Jaccard similarity of word n-gram sets is at
    least `threshold`; class_id is the smallest doc_id reachable by links; kept marks it.

    Null and empty texts have the empty set and equal one another. A null doc_id takes part
    in nothing: n_links 0, class_id null, kept. Rows that repeat a doc_id are one document
    (with the text of the smallest fingerprint, should texts differ). Ties go to the smaller
    doc_id. Texts of any length are read whole. An empty table gives an empty result; further
    columns are ignored, whatever they are called."""
    docs = pick(docs, "doc_id", "text")
    shortest = depth_for(threshold, trees, longest, target_recall)
    features = cut(_features(docs.where("doc_id is not null"), words, trees, longest))
    named = features.groupBy("doc_id").agg(F.min("fp").alias("fp"))
    nodes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    sized = features.withColumnRenamed("doc_id", "node").join(nodes, ["node", "fp"]).dropDuplicates(["node", "fp"])
    sigs = cut(sized.select("node", "fp", "rows", "size", "paths"))
    # Sets of fewer elements than this can't be so alike without being equal.
    able = sigs.where(F.col("size") * (1 - threshold) >= threshold - 1e-9)
    groups = _groups(able, trees, longest, shortest, settled_recall, AGREE + (threshold - THRESHOLD))
    checked = cut(_verified(docs, sigs.select("node", "fp", "rows", "size"), groups, words, threshold))
    classes = components(checked.select(F.col("root").alias("a"), F.col("node").alias("b")))
    found = checked.select("node", "links", F.lit(None).cast("long").alias("root")).unionByName(classes.select(F.col("id").alias("node"), F.lit(None).cast("long").alias("links"), "root"))
    found = found.groupBy("node").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    judged = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = named.join(judged, "fp").select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return out.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")))
