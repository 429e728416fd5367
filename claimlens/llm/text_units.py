"""Work shared by operators that tokenize: texts of a partition in blocks, and their repeated
parts as numbers, so that each distinct part is tokenized once in a block."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a block of texts; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20


def text_blocks(batches: Iterable[pa.RecordBatch], column: int, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, pa.Array]]:
    """The rows of a partition in blocks of about `size` bytes of text, in order: a table of
    the rows, and their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    room = size

    def block() -> tuple[pa.Table, pa.Array]:
        table = pa.Table.from_batches(held)
        return table, pc.fill_null(pa.concat_arrays(table.column(column).chunks), "")

    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            end = int(np.searchsorted(total, before + room)) + 1
            held.append(batch.slice(start, end - start))
            if end > batch.num_rows:
                room -= int(total[-1]) - before
                break
            yield block()
            held, room, start = [], size, end
    if held:
        yield block()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] times, then on from starts[1], and so on: where
    the elements of ragged rows lie in the array that holds all rows one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    """Where ragged rows of so many elements begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def at_runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


class Parts:
    """Texts cut at spaces: the distinct parts, the parts of all texts as numbers one after
    another, and where those of each text begin and how many they are.

    odd and cut: texts that `odd` marks are cut by the function `cut` instead."""

    def __init__(self, texts: pa.Array, odd: pa.Array | None = None, cut: Callable[[str], list[str]] | None = None):
        plain = pc.split_pattern(texts if odd is None else texts.filter(pc.invert(odd)), " ")
        flat, counts = plain.flatten(), pc.list_value_length(plain).to_numpy(zero_copy_only=False)
        self.counts = counts.astype(np.int64)
        if odd is not None and pc.any(odd).as_py():
            other = pa.array([cut(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
            flat = pa.concat_arrays([flat, other.flatten()])
            self.counts = np.concatenate([self.counts, pc.list_value_length(other).to_numpy(zero_copy_only=False)]).astype(np.int64)
        self.starts = offsets(self.counts)[:-1]
        if len(self.counts) and odd is not None:
            at = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")  # the row at each place
            back = np.empty(len(at), np.int64)
            back[at] = np.arange(len(at))
            self.counts, self.starts = self.counts[back], self.starts[back]
        coded = flat.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.flat = coded.indices.to_numpy(zero_copy_only=False)

    def sums(self, of_part: np.ndarray) -> np.ndarray:
        """For each text, the sum of its parts' numbers."""
        total = np.r_[0, np.cumsum(of_part[self.flat].astype(np.int64))]
        return total[self.starts + self.counts] - total[self.starts]
