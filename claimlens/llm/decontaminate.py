"""Operator 6. Benchmark decontamination by pigeonhole edit matching.

Both sides are normalised alike (lower case, runs of other than letters and digits become
one space). A test item with an error budget of e edits is cut into e + 1 pieces: a document
that holds the item within e edits holds one piece unchanged. Exact piece hits come from an
Aho-Corasick automaton over a block of items; each hit's surroundings are verified with
Myers' bit-parallel distance (1999). Hits of one item near one diagonal share a verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.shared import cut_rows, filter_texts, pick

ERROR_RATE = 0.08
#: Characters of test items that one pass over the documents holds; more items, more passes.
BLOCK_CHARS = 8_000_000
#: A piece shorter than this says too little; shorter items get fewer edits.
MIN_PIECE = 12

#: Whether a code point is a letter or a number.
_word = np.array([chr(c).isalnum() for c in range(0x110000)])


def normal(text: str | None) -> str:
    if not text:
        return ""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _word[code]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of each run of others stays, as a space
    return np.where(word, code, 32)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").strip()


def budget(n: int, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    """Edits allowed to an item of n normalised characters."""
    return max(0, min(int(n * rate), n // min_piece - 1))


def cuts(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The item's error-budget-plus-one pieces, with their offsets."""
    n, k = len(item), budget(len(item), rate) + 1
    bounds = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def distance(item_masks: dict[str, int], m: int, window: str) -> int:
    """Smallest edit distance between the item of length m and any substring of the window."""
    if m == 0:
        return 0
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    for c in window:
        eq = item_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
    return best


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in id order, in lists of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for row in benchmark.orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text or row["item_id"] is None:
            continue
        if block and held + len(text) > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield block


class _Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.texts, self.masks, self.rate = items, {}, rate
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for at, piece in cuts(text, rate):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, edits) of the items that the normalised text holds within their budget."""
        near: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                near.setdefault(k, []).append(end - n + 1 - at)
        found: dict[int, int] = {}
        for k, starts in near.items():
            item_id, item = self.texts[k]
            m, e = len(item), budget(len(item), self.rate)
            if k not in self.masks:
                self.masks[k] = masks(item)
            starts = sorted(set(starts))
            at = 0
            while at < len(starts):
                upto = at
                while upto + 1 < len(starts) and starts[upto + 1] - starts[upto] <= 2 * e and starts[upto + 1] - starts[at] <= m:
                    upto += 1
                d = distance(self.masks[k], m, text[max(0, starts[at] - e) : starts[upto] + m + e])
                if d <= e and d < found.get(item_id, m + 1):
                    found[item_id] = d
                if d == 0:
                    break
                at = upto + 1
        return sorted(found.items())


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits) for each row of (doc_id, text) and each item of (item_id,
    text) that the text holds within the item's budget: error_rate of its normalised length, and
    one edit less than it has pieces of MIN_PIECE characters (none below 2 * MIN_PIECE). Whole
    texts are searched, however long.

    Items of empty normalised text or null item_id match nothing, and so do null and empty
    documents. Rows and items that repeat give a hit each (items of one id and the smaller
    distance are one). Either table may be empty; further columns are ignored, whatever they
    are called. Documents
    aren't shuffled: each task reads whole texts and carries one bounded block of items."""
    docs = pick(docs, "doc_id", "text")
    spark, found = docs.sparkSession, None
    for block in _blocks(pick(benchmark, "item_id", "text"), block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = _Matcher(held.value, error_rate)
            for batch in batches:
                rows = [(i, item, d) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for item, d in matcher.find(normal(t))]
                yield pa.RecordBatch.from_pydict({k: pa.array([r[n] for r in rows], pa.int64()) for n, k in enumerate(("doc_id", "item_id", "edits"))})

        hits = docs.mapInArrow(run, "doc_id long, item_id long, edits long")
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "doc_id long, item_id long, edits long") if found is None else found


def decontaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, all columns, without the rows that hold an item as benchmark_hits() finds them,
    judged where they stand. One pass for each block of items, written before the next."""
    spark = docs.sparkSession
    for n, block in enumerate(_blocks(pick(benchmark, "item_id", "text"), block_chars)):
        held = spark.sparkContext.broadcast(block)

        def judge(held=held):
            matcher = _Matcher(held.value, error_rate)
            return lambda texts: [not (t and matcher.find(normal(t))) for t in texts]

        docs = filter_texts(cut_rows(docs) if n else docs, judge)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per doc_id with hits: doc_id, n_items, min_edits, items (sorted)."""
    hits = benchmark_hits(docs, benchmark, error_rate)
    return hits.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.min("edits").alias("min_edits"), F.sort_array(F.collect_set("item_id")).alias("items"))
