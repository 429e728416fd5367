"""Operator 12. Alignment of two tokenizers' ids by counts of packed pairs.

Each text is encoded by a byte-level BPE vocabulary (A) and by a piece model (B). Tokens of A
and B whose byte ranges overlap are linked, and a pair of ids is one int64, A's id in the upper
half. Each task counts the documents in which a pair is linked, with np.unique over its blocks;
these partial counts are written, range-partitioned by key and sorted, and runs of a key are
summed into shards: sorted arrays of keys and of counts, one file each, in the shared folder.
A second pass over the texts maps the shards into memory and looks its pairs up by
searchsorted. No table of pairs is held in a process, sent to the driver or broadcast; what the
driver gets is the shards' first keys and, for each id of A, its highest count, as many numbers
as A has ids.

Texts are cut before spaces that follow a letter, digit or sign. No token of A or B reaches over
such a place (checked for B when its model is loaded), so that a block's distinct parts are
encoded and aligned once.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from claimlens.llm.bpe_codec import byte_letters
from claimlens.llm.shared import cut, parts, pick
from claimlens.llm.text_units import Parts, at_runs, offsets, spread, text_blocks
from claimlens.llm.token_histogram import PATTERN
from claimlens.plans.stage import shared_dir

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters encoded in one call.
CALL_CHARS = 1 << 17
#: Counted pairs of a task that are summed up at a time, and rows of a shard at which another is added.
HELD_PAIRS = 1 << 20
SHARD_ROWS = 1 << 22
#: Where a text may be cut: before a space, after what no tokenizer takes for white space.
_CUT = re.compile(r"(?<=[!-~\w])(?= )")
_ODD = r"(^|[^!-~\pL\pN_]) "
_CLEAN = re.compile(r"[!-~\w]\Z")
_loaded: dict[tuple[str, str], Tokenizers] = {}


class Tokenizers:
    """The two tokenizers, and how many bytes each of their tokens stands for."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_a = [b""] * max(self.a.get_vocab_size(), max(ids.values()) + 1)
        for s, k in ids.items():
            self.bytes_a[k] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        # Where ids are ranks and words are cut in the usual way, ASCII goes through a faster encoder of the same vocabulary.
        ranks = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        usual = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_a[k]: k for k in range(256 + len(ranks))}, special_tokens={}) if usual and ranks == list(range(256, 256 + len(ranks))) else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: a piece reaches over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.len_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.lead = self.b.encode("x")

    def parts(self, text: str) -> list[str]:
        """A text with a space before it, cut; each part without its first space. Texts whose
        every space is such a place, which _ODD tells, are simply cut at spaces."""
        return [p[1:] for p in _CUT.split(" " + text)]

    def _call(self, run: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids of parts, one after another; None if bytes get lost."""
        text = " " + " ".join(run)
        fast = self.fast is not None and text.isascii()
        a = self.fast.encode_ordinary(text) if fast else self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode("x" + text)[len(self.lead) :] if run[0] == "" or run[0][0] == " " else self.b.encode(text[1:])
        whole = text.encode()
        if b"".join([self.bytes_a[k] for k in a]) != whole or b"".join([self.bytes_b[k] for k in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct parts: which of them keep their bytes, A's ids and the number of A's
        ids in each, and the same of B. Parts that end in a letter, digit or sign go through
        the tokenizers many at a time."""
        good = np.zeros(len(units), bool)
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        runs: list[list[int]] = []
        open_: dict[bool, list[int]] = {True: [], False: []}
        chars = {True: 0, False: 0}
        for k, u in enumerate(units):
            if not _CLEAN.search(u):
                runs.append([k])
                continue
            kind = u.isascii()
            open_[kind].append(k)
            chars[kind] += len(u) + 1
            if chars[kind] >= CALL_CHARS:
                runs.append(open_[kind])
                open_[kind], chars[kind] = [], 0
        runs += open_.values()
        while runs:
            run = runs.pop()
            if run:
                got = self._call([units[k] for k in run])
                if got is not None:
                    found.append((run, *got))
                    good[run] = True
                elif len(run) > 1:  # some part among them
                    runs += [run[: len(run) // 2], run[len(run) // 2 :]]
        out: list[np.ndarray] = [good]
        size = np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units))
        order = np.array([k for run, *_ in found for k in run], np.int64)
        for side, lengths in ((1, self.len_a), (2, self.len_b)):
            counts = np.zeros(len(units), np.int64)
            for f in found:
                bounds = np.searchsorted(np.cumsum(lengths[f[side]]), np.cumsum(size[f[0]]), side="left") + 1
                counts[f[0]] = np.diff(bounds, prepend=0)
            begins = np.zeros(len(units), np.int64)
            begins[order] = offsets(counts[order])[:-1]
            flat = np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64)
            out += [flat[spread(begins, counts)], counts]
        return tuple(out)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers of two files, loaded once per worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _joined(strings: pa.Array, counts: np.ndarray, by: str) -> pa.Array:
    """Ragged rows of strings, each row joined to one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), strings), by)


class Block:
    """The texts of a block, cut, with their distinct parts encoded and aligned."""

    def __init__(self, held: Tokenizers, texts: pa.Array):
        self.parts = parts = Parts(texts, pc.match_substring_regex(texts, _ODD), held.parts)
        good, a, self.n_a, b, self.n_b = held.encode(parts.distinct)
        end_a, end_b = np.cumsum(held.len_a[a]), np.cumsum(held.len_b[b])
        # Between two neighbouring ends, of whichever side, one token of A and one of B overlap.
        ends = np.sort(np.concatenate([end_a, end_b]))
        first = at_runs(ends)
        both, ends = ends[:-1][ends[1:] == ends[:-1]], ends[first]
        self.link_a, link_b = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]
        self.keys = self.link_a << 32 | link_b
        part_end = np.r_[0, end_a][np.cumsum(self.n_a)]
        self.n_links = np.diff(np.searchsorted(ends, part_end, side="right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(both, part_end, side="right"), prepend=0)
        self.a, self.b = a, b
        self.group_a, self.group_b = (np.diff(np.searchsorted(end, both) + 1, prepend=0) for end in (end_a, end_b))
        self.link_at = offsets(self.n_links)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        #: Texts that have tokens.
        self.held = ~empty & (parts.sums(~good) == 0)

    def units(self) -> np.ndarray:
        """The numbers of the parts of all texts that have tokens."""
        return self.parts.flat[spread(self.parts.starts[self.held], self.parts.counts[self.held])]

    def document_counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct keys, sorted, and in how many texts each is linked, for runs of texts."""
        keys, number = np.unique(self.keys, return_inverse=True)
        rows = np.flatnonzero(self.held)
        run = np.cumsum(self.parts.sums(self.n_links)[rows]) // HELD_PAIRS
        for r in np.split(rows, at_runs(run)[1:]):
            units = self.parts.flat[spread(self.parts.starts[r], self.parts.counts[r])]
            row = np.repeat(np.repeat(np.arange(len(r)), self.parts.counts[r]), self.n_links[units])
            seen = np.sort(row << 32 | number[spread(self.link_at[units], self.n_links[units])])
            total = np.bincount(seen[at_runs(seen)] & 0xFFFFFFFF, minlength=len(keys))
            yield keys[total > 0], total[total > 0]

    def group_texts(self) -> pa.Array:
        """The groups of each text, as `a1,a2|b1;a3|b2,b3`."""
        a, b = (_joined(pc.cast(pa.array(x), pa.string()), n, ",") for x, n in ((self.a, self.group_a), (self.b, self.group_b)))
        of_part = _joined(pc.binary_join_element_wise(a, b, "|"), self.n_groups, ";")
        return _joined(of_part.take(pa.array(self.units())), np.where(self.held, self.parts.counts, 0), ";")

    def sums(self, of_part: np.ndarray) -> pa.Array:
        return pa.array(np.where(self.held, self.parts.sums(of_part), 0), pa.int64())


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([h[k] for h in held]) if held else np.empty(0, np.int64) for k in (0, 1))
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


def partial_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, n) of each task: packed pairs, and in how many of its documents each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in text_blocks(batches, 0):
            for found in Block(both, texts).document_counts():
                held.append(found)
                if sum(len(k) for k, _ in held) >= HELD_PAIRS:
                    held = [_summed(held)]
                    if len(held[0][0]) >= HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_pydict({"key": held[0][0], "n": held[0][1]})
                        held = []
        if held:
            keys, counts = _summed(held)
            yield pa.RecordBatch.from_pydict({"key": keys, "n": counts})

    return docs.mapInArrow(run, "key long, n long")


def mounted_dir(spark: SparkSession) -> str:
    """The shared folder as a path: files that are mapped into memory have to be mounted."""
    where = urlparse(shared_dir(spark))
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if (where.scheme or urlparse(default).scheme) != "file":
        raise ValueError(f"spark.checkpoint.dir is {where.geturl()}; memory-mapped shards need a folder that driver and executors have mounted (file:)")
    return unquote(where.path)


def count_shards(partial: DataFrame) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Sum (key, n) over the corpus into sorted shards: (path, first key) of each, in order of
    keys, and the highest count of each id of A. Files appear under their names once whole; a
    task that is repeated replaces them by equal ones."""
    spark = partial.sparkSession
    partial = cut(partial)
    folder = os.path.join(mounted_dir(spark), f"pairs-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    n = max(parts(spark), -(-partial.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = os.path.join(folder, f"{task.partitionId():06d}")
        own = f"{path}.{task.taskAttemptId()}"
        best_a, best_n = [], []
        first: int | None = None
        rest: tuple[np.ndarray, np.ndarray] = np.empty(0, np.int64), np.empty(0, np.int64)
        with open(f"{own}.keys", "wb") as keys_to, open(f"{own}.counts", "wb") as counts_to:

            def write(keys: np.ndarray, counts: np.ndarray) -> None:
                if len(keys):
                    keys.tofile(keys_to)
                    counts.tofile(counts_to)
                    a = keys >> 32
                    starts = at_runs(a)
                    best_a.append(a[starts])
                    best_n.append(np.maximum.reduceat(counts, starts))

            for batch in batches:
                keys = np.concatenate([rest[0], batch.column(0).to_numpy()])
                counts = np.concatenate([rest[1], batch.column(1).to_numpy()])
                if not len(keys):
                    continue
                starts = at_runs(keys)
                keys, counts = keys[starts], np.add.reduceat(counts, starts)
                first = int(keys[0]) if first is None else first
                write(keys[:-1], counts[:-1])
                rest = keys[-1:], counts[-1:]
            write(*rest)
        if first is None:
            os.remove(f"{own}.keys")
            os.remove(f"{own}.counts")
            return
        os.replace(f"{own}.keys", f"{path}.keys")
        os.replace(f"{own}.counts", f"{path}.counts")
        a, highest = np.concatenate(best_a), np.concatenate(best_n)
        starts = at_runs(a)
        yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "a": [a[starts].astype(np.int32).tobytes()], "best": [np.maximum.reduceat(highest, starts).tobytes()]})

    made = partial.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "path string, first long, a binary, best binary").collect()
    made.sort(key=lambda r: r["first"])
    best = np.zeros(1 + max((int(np.frombuffer(r["a"], np.int32).max()) for r in made), default=0), np.int64)
    for r in made:
        np.maximum.at(best, np.frombuffer(r["a"], np.int32), np.frombuffer(r["best"], np.int64))
    return [(r["path"], r["first"]) for r in made], best


def looked_up(shards: list[tuple[str, int]]) -> Callable[[np.ndarray], np.ndarray]:
    """The counts of sorted keys, from shards mapped into memory as they are needed."""
    firsts = np.array([first for _, first in shards], np.int64)
    mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(firsts, keys, side="right") - 1
        for k in np.unique(of).tolist():
            if k not in mapped:
                mapped[k] = tuple(np.memmap(f"{shards[k][0]}.{kind}", np.int64, "r") for kind in ("keys", "counts"))
            here = np.flatnonzero(of == k)
            at = np.minimum(np.searchsorted(mapped[k][0], keys[here]), len(mapped[k][0]) - 1)
            if not np.array_equal(mapped[k][0][at], keys[here]):
                raise RuntimeError("a pair has no count: the texts have changed between the passes")
            out[here] = mapped[k][1][at]
        return out

    return find


def align_tokens(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = MODEL_B) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_a and n_b (tokens), n_groups, n_links, n_best
    (links whose count is the highest of their A id), count_sum (over links), groups.

    A encodes a space and the text, B the text, to which it adds the space. Groups end where
    tokens of A and B both end; `groups` lists them as `a1,a2|b1;a3|b2,b3`, ids in order. Links
    are the pairs of token occurrences whose bytes overlap. The count of a pair of ids is the
    number of rows, corpus-wide, in which it is linked.

    Texts that are null, empty, or whose bytes A's or B's tokens don't give back have no tokens:
    zeros, and no groups (''). Rows of null or repeated ids, and repeated rows, are documents
    like others. An empty table gives an empty result; further columns are ignored, whatever
    they are called. The table is read twice and must not change between."""
    docs = pick(docs, "doc_id", "text")
    shards, best = count_shards(partial_counts(docs.select("text"), path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts_of = tokenizers(path_a, path_b), looked_up(shards)
        for table, texts in text_blocks(batches, 1):
            block = Block(both, texts)
            # Only the links of parts that some text with tokens holds have counts.
            used = np.zeros(len(block.n_links), bool)
            used[block.units()] = True
            at = spread(block.link_at[:-1][used], block.n_links[used])
            keys, number = np.unique(block.keys[at], return_inverse=True)
            count = np.zeros(len(block.keys), np.int64)
            count[at] = counts_of(keys)[number]
            top = np.zeros(len(block.keys), np.int64)
            top[at] = count[at] == best[block.link_a[at]]
            n_best, count_sum = (np.diff(np.r_[0, np.cumsum(x)][block.link_at]) for x in (top, count))
            numbers = {"n_a": block.n_a, "n_b": block.n_b, "n_groups": block.n_groups, "n_links": block.n_links, "n_best": n_best, "count_sum": count_sum}
            out = pa.table({"doc_id": table.column(0)} | {k: block.sums(v) for k, v in numbers.items()} | {"groups": block.group_texts()})
            yield from out.to_batches(max_chunksize=4096)

    return docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
