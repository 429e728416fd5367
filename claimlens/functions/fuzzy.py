"""Similarity scores that Spark lacks, over many pairs of strings at once.

Scores are 0 to 100: twice the longest common subsequence over both lengths. For a pair
(a, b) that of `a` with every part of b comes from one pass over their characters: each column
of b has a strand, which ends up where the part has to begin for that column to be lost
(semi-local comparison by combing; Tiskin, 2008). All cells of an antidiagonal, of hundreds of
pairs, are one array operation; no window is compared by itself, and no character in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of an antidiagonal that are worked on together.
CELLS = 1 << 16


def _codes(strings: Sequence[str], width: int, pad: int) -> np.ndarray:
    """Code points as columns of `width` rows, padded at the end."""
    out = np.full((len(strings), width), pad, np.uint32)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(width) < length[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(out.T)


def _lost_from(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """For pairs of similar lengths, by columns: the place in b from which on a part that ends
    behind column r doesn't gain column r. A part of b from i on has as many characters in
    common with a as it has columns of which that place is before i."""
    n, m = max(map(len, a)), max(map(len, b))
    # Padding equals nothing, on either side, and so changes no common subsequence.
    x, y = _codes(a, n, 0x110000)[::-1], _codes(b, m, 0x110001)
    if max(x[x < 0x110000].max(initial=0), y[y < 0x110001].max(initial=0)) < 0xFFFE:
        x, y = np.minimum(x, 0xFFFF).astype(np.uint16), np.where(y < 0x110000, y, 0xFFFE).astype(np.uint16)
    kind = np.int16 if n + m < 2**15 else np.int32
    rows = np.repeat(np.arange(n, dtype=kind)[:, None], len(a), axis=1)
    columns = np.repeat(np.arange(n, n + m, dtype=kind)[:, None], len(a), axis=1)
    for d in range(n + m - 1):
        first, last = max(0, d - n + 1), min(m, d + 1)
        r, c = slice(n - 1 - d + first, n - 1 - d + last), slice(first, last)
        equal = -(x[r] == y[c]).astype(kind)
        h, v = rows[r], columns[c]
        low, high = np.minimum(h, v), np.maximum(h, v)
        # Of two strands the later one leaves downwards; where characters are equal, the one from the left does.
        turn = (low ^ v) & equal
        np.bitwise_xor(low, turn, out=h)
        np.bitwise_xor(high, turn, out=v)
    return columns.astype(np.int32) - n


def _per_column(at: np.ndarray, some: np.ndarray, rows: int) -> np.ndarray:
    """How often each row is named in each column of `at`, where `some` holds."""
    k = at.shape[1]
    return np.bincount((at * k + np.arange(k))[some], minlength=rows * k).reshape(rows, k)


def _best_windows(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best ratio of a to a part of b of its length, parts at the ends being cut off, for
    pairs of similar lengths of which a isn't the longer. No string is empty."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    lost = _lost_from(a, b).astype(np.int64)
    place = np.arange(len(lost))[:, None]
    lost[place >= m] = -1
    # Column r is lost by the parts [i, i + n) from max(0, r - n + 1) to the place, m - n at most.
    begin, end = np.maximum(place - n + 1, 0), np.minimum(lost, m - n)
    some = (lost >= 0) & (begin <= end)
    missed = np.cumsum(_per_column(begin, some, len(lost) + 1) - _per_column(end + 1, some, len(lost) + 1), axis=0)
    best = np.where(np.arange(len(lost) + 1)[:, None] <= m - n, n - missed, 0).max(axis=0) / n
    # The first w columns miss those that are lost from 0 on, the last w those lost from m - w on.
    width = place + 1
    front = width - np.cumsum(lost >= 0, axis=0)
    after = np.cumsum(_per_column(np.maximum(lost, 0), lost >= 0, len(lost))[::-1], axis=0)[::-1]
    back = m - place - after
    for kept, w in ((front, width), (back, m - place)):
        best = np.maximum(best, np.where((w > 0) & (w < n), 2 * kept / np.maximum(n + w, 1), 0).max(axis=0))
    return 100.0 * best


def _in_batches(a: Sequence[str], b: Sequence[str], over) -> np.ndarray:
    """over(a, b) for pairs in batches of similar lengths."""
    out = np.zeros(len(a))
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    order = np.lexsort((n, m))
    at = 0
    while at < len(order):
        size = max(1, CELLS // int(m[order[at]]))
        # One that is much longer than the first would pad the others.
        limit = m[order[at]] * 5 // 4 + 8
        size = min(size, int(np.searchsorted(m[order[at : at + size]], limit, side="right")))
        batch = order[at : at + size]
        out[batch] = over([a[k] for k in batch], [b[k] for k in batch])
        at += size
    return out


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """For each pair, the best ratio of the shorter string to a part of the other. Two empty
    strings score 100, one scores 0. Of equally long ones, either may be the part."""
    out = np.array([100.0 if x == y or (x and y and (x in y or y in x)) else 0.0 for x, y in zip(a, b, strict=True)])
    short, long, of = [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y and out[k] == 0:
            pairs = [(x, y), (y, x)] if len(x) == len(y) else [(x, y) if len(x) < len(y) else (y, x)]
            for s, t in pairs:
                short.append(s)
                long.append(t)
                of.append(k)
    if of:
        np.maximum.at(out, np.array(of), _in_batches(short, long, _best_windows))
    return out


def _common_parts(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    m = np.fromiter(map(len, b), np.int64, len(b))
    lost = _lost_from(a, b)
    return m - ((lost >= 0) & (np.arange(len(lost))[:, None] < m)).sum(axis=0)


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """For each pair, the ratio of the two whole strings; 100 if both are empty."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    some = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    common = np.zeros(len(total))
    common[some] = _in_batches([a[k] for k in some], [b[k] for k in some], _common_parts)
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])


def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(*(" ".join(sorted(x.split())) for x in (a, b)))


def token_sort_ratio_col(a: Column, b: Column) -> Column:
    """The ratio of two columns' words in alphabetical order; null where one is null."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
        out = np.full(len(a), np.nan)
        x, y = ([" ".join(sorted(s.iloc[k].split())) for k in known] for s in (a, b))
        out[known] = ratios(x, y)
        return pd.Series(out)

    found = F.pandas_udf(over, "double")(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), found)
