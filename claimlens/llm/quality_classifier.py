"""Operator 8. Quality by compression: zstandard dictionaries built from good and bad text.

A text is cut into short spans that are compressed on their own with either dictionary, so
that a dictionary's help isn't drowned by what a long text teaches about itself. So is the
text's shape, in which runs of letters and digits are one character each: it tells layouts
apart whatever the words are. Lines that occur in both classes teach neither dictionary. The
two differences of compressed sizes per byte (good text is shorter with the good dictionary)
become a probability by a logistic curve, fitted to rows that its dictionaries haven't seen.
Texts under EVIDENCE bytes, of which no dictionary saves any, have a prior of their own: the
curve's offset is another one for them. Nothing else enters the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import filter_texts, pick

#: Bounds of the sample that the fit uses: labelled rows of each class, all whole, and bytes of all of them.
#: The curve is fitted to rows that `CROSS` further pairs of dictionaries haven't seen. What is scored is scored whole.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 12_000_000
CROSS = 3
DICTIONARY_BYTES = 65536
SPAN = 256
#: Bytes below which a text holds no evidence for compression.
EVIDENCE = 32
#: Inverse variances of the prior on the standardised differences, on the offset of texts without evidence and on the offset.
PRIOR = (1e-2, 1e-2, 1 / 9, 1e-3)
LEVEL = 3
FOLDS = 5
REJECT_BELOW = 0.3


class _Shapes(dict):
    """Code points to their kind: a letter, a capital, a digit, or themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        return self[code]


_shapes = _Shapes()


def shape(text: str) -> str:
    """A text's layout: runs of letters, of capitals and of digits are one character each."""
    kinds = text.translate(_shapes)
    for run, one in (("a+", "a"), ("A+", "A"), ("0+", "0")):
        kinds = re.sub(run, one, kinds)
    return kinds


Pair = tuple[bytes, bytes]


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (good, bad) of texts and of shapes, and the weights of the curve. Without
    text of both classes there are none, and the score is constant."""

    pairs: tuple[Pair, Pair] | None
    weights: tuple[float, ...]  # of the two differences, and the offsets without evidence and in general

    def scorer(self):
        compress = _compressors(self.pairs) if self.pairs else None

        def scored(texts: list[str | None]) -> np.ndarray:
            x = features(texts, compress) if compress else np.zeros((len(texts), len(self.weights) - 1))
            return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -500, 500)))

        return scored


def _compressor(content: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _compressors(pairs: tuple[Pair, Pair]) -> list[tuple]:
    return [tuple(map(_compressor, pair)) for pair in pairs]


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def difference(text: str, good, bad) -> float:
    """How many bytes per byte the good dictionary saves over the bad one; empty: 0."""
    raw, saved = _raw(text), 0
    for at in range(0, len(raw), SPAN):
        piece = raw[at : at + SPAN]
        saved += len(bad(piece)) - len(good(piece))
    return saved / max(1, len(raw))


def features(texts: list[str | None], compress: list[tuple]) -> np.ndarray:
    """Per text: the difference, that of its shape, and whether it is too short for either."""
    return np.array([[difference(t, *compress[0]), difference(shape(t), *compress[1]), len(_raw(t)) < EVIDENCE] for t in (x or "" for x in texts)], dtype=float).reshape(len(texts), 3)


def _dictionary(texts: list[str], shared: set[str]) -> bytes:
    import zstandard

    own = ["\n".join(line for line in t.split("\n") if line not in shared) for t in texts]
    spans = [raw[at : at + SPAN] for raw in map(_raw, own) for at in range(0, len(raw), SPAN)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, spans).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(spans)[-DICTIONARY_BYTES:]


def _dictionaries(rows: list) -> tuple[Pair, Pair] | None:
    """Both pairs from rows (rank, id, label, text); None if a class has no text of its own."""
    texts = {q: [r[3] for r in rows if r[2] == q] for q in (0, 1)}
    lines = {q: {line for t in texts[q] for line in t.split("\n")} for q in (0, 1)}
    words = tuple(_dictionary(texts[q], lines[0] & lines[1]) for q in (1, 0))
    shapes = tuple(_dictionary([shape(t) for t in texts[q]], set()) for q in (1, 0))
    return (words, shapes) if all((*words, *shapes)) else None


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and offset by Newton steps on the log loss. Priors keep them finite."""
    scale = np.r_[x[:, :2].std(axis=0), 1.0]
    scale[scale == 0] = 1
    design = np.c_[x / scale, np.ones(len(x))]
    w, prior = np.zeros(design.shape[1]), np.array(PRIOR)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + prior * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (*(float(v) for v in w[:-1] / scale), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds, is 0; those rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from the labelled rows that aren't held out: whole texts in the order of a hash of
    their id, at most `sample_rows` of each class, and so many of them as have `sample_bytes`
    together, so that the driver gets a few megabytes however large the tables are. An id that
    repeats teaches one text, of the smallest hash. Ids or labels that are null, and labels
    other than 0 and 1, teach nothing; further columns are ignored."""
    labels = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    rank = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = None
    for q in (0, 1):
        one = labels.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(sample_rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    # 2 * sample_rows ids at most: a bound that doesn't grow. Repeats are reduced before they are collected.
    found = pick(docs, "doc_id", "text").where("text <> ''").join(F.broadcast(chosen.distinct()), "doc_id")
    found = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    so_far = F.sum(F.octet_length("t.text")).over(Window.partitionBy("quality").orderBy(rank, "doc_id"))
    found = found.select("doc_id", "quality", rank.alias("rank"), "t.text", so_far.alias("bytes")).where(F.col("bytes") <= sample_bytes)
    rows = sorted((r["rank"], r["doc_id"], r["quality"], r["text"]) for r in found.collect())
    y = np.array([r[2] for r in rows], dtype=float)
    # The classes are sampled at different rates; the offset undoes that.
    total = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rates = [max(1.0, total.get(q, 0) / sample_rows) for q in (0, 1)]
    shift = math.log(rates[1] / rates[0])
    share = (y.sum() + 1) / (len(y) + 2)
    constant = QualityModel(None, (0.0, 0.0, 0.0, math.log(share / (1 - share)) + shift))
    pairs = _dictionaries(rows)
    if pairs is None:
        return constant
    x, unseen = np.empty((len(rows), 3)), np.zeros(len(rows), dtype=bool)
    for k in range(CROSS):
        others = _dictionaries([r for n, r in enumerate(rows) if n % CROSS != k])
        if others is not None and rows[k::CROSS]:
            x[k::CROSS] = features([r[3] for r in rows[k::CROSS]], _compressors(others))
            unseen[k::CROSS] = True
    if len(set(y[unseen])) < 2:
        return constant
    *weights, offset = _logistic(x[unseen], y[unseen])
    return QualityModel(pairs, (*weights, offset + shift))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, text).

    score, from 0 to 1, is the chance that the label is 1, of the whole text alone; null and
    empty texts get that of no difference. A null doc_id isn't held out. Repeated rows are
    scored alike; an empty table gives an empty result; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scored(batch.column(1).to_pylist()), pa.float64())})

    found = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs, all columns, without the rows that score() predicts 0 for, judged where they stand."""

    def judge():
        scored = model.scorer()
        return lambda texts: list(scored(texts) >= REJECT_BELOW)

    return filter_texts(docs, judge)


def quality_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """fit() and score() over the same documents."""
    return score(docs, fit(docs, labels, sample_rows, sample_bytes))
