"""Operator 13. BPE encoding and decoding by a pair occurrence index.

The texts of a partition are taken in blocks. A block's distinct words are laid out as one row
of symbols, and an index maps each pair of neighbouring symbols that some merge joins to all
the positions where it stands. Merges are applied in ascending rank, each at all positions of
its pair at once; the pairs that this makes with the neighbours enter the index, under ranks
that are still to come. Only ranks that occur are touched. As words don't influence each
other, and no merge makes a pair of a smaller rank (checked when a vocabulary is loaded), each
word undergoes the merges that it would undergo alone.

How text is normalised and cut into words is the vocabulary's own business: the tokenizers
library's normalizer and pre-tokenizer for that file are used for it, or for ASCII the same
expression, on the block's distinct strings between spaces. Vocabulary files of byte-level BPE whose words leave white space out are
read, with or without a word-end suffix; their path is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from claimlens.llm.shared import pick
from claimlens.llm.text_units import Parts, offsets, spread, text_blocks

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of text whose pairs are indexed together.
BLOCK_BYTES = 10 << 20
#: Characters that are normalised and cut into words in one call.
CALL_CHARS = 1 << 17
#: Lists of fewer positions are merged one by one, longer ones as arrays.
FEW = 12
_loaded: dict[str, Vocabulary] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others, in order, from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library. ValueError: it asks for
    something that this operator doesn't do."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError(f"{path}: not a plain BPE vocabulary")
        self.splitter = Tokenizer.from_str(text)
        if spec.get("decoder") or [w for w, _ in self.splitter.pre_tokenizer.pre_tokenize_str(" a  b ")] != ["a", "b"]:
            raise ValueError(f"{path}: white space is part of the words")
        # Lower case and a cut by an expression: for ASCII, both are the same everywhere.
        steps, cuts = (spec.get("normalizer") or {}).get("normalizers", []), spec["pre_tokenizer"].get("pretokenizers", [{}])
        usual = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and [n["type"] for n in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"] + "| ") if usual else None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with rules of their own")
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None

        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        first_made = np.full(self.size, -1, np.int64)
        first_made[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(first_made[self.left], first_made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge precedes one that makes its parts")
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_of = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}

        letters = byte_letters()
        self.inner = np.full(0x200, -1, np.int64)
        self.last = np.full(0x200, -1, np.int64)
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = ids.get(c, -1), ids.get(c + suffix, -1)
        if min(self.inner[[ord(c) for c in letters]].min(), self.last[[ord(c) for c in letters]].min()) < 0:
            raise ValueError(f"{path}: a byte has no symbol")
        strings: list[str | None] = [None] * self.size
        for s, k in [*ids.items(), *self.added.items()]:
            strings[k] = s
        self.strings, self.known = pa.array(strings, pa.string()), np.array([s is not None for s in strings])

    # Words

    def words_of(self, strings: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of strings without spaces, and without added tokens: distinct words, the
        number of words of each string, and the words' numbers, in order.

        Strings are joined by spaces, at which any word ends. Printable ASCII is cut by the
        vocabulary's own expression, where that is known to be all; the rest by the library, of
        which strings that hold white space of another kind, which might vanish between two
        strings, go alone."""
        simple = [k for k, s in enumerate(strings) if s and s.isascii() and s.isprintable()] if self.pattern else []
        cut = pa.array(self.pattern.findall(" ".join([strings[k] for k in simple]).lower()) if simple else [], pa.string()).dictionary_encode()
        words, of_word = cut.dictionary.to_pylist(), cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(strings), np.int64)
        if simple:
            space = words.index(" ") if " " in words else len(words)
            between = of_word == space
            counts[simple] = np.bincount(np.cumsum(between)[~between], minlength=len(simple))
            of_word = of_word[~between]
            of_word -= of_word > space
            words = [w for w in words if w != " "]

        held = set(simple)
        other = [k for k in range(len(strings)) if k not in held]
        plain = {k for k in other if strings[k].split() == [strings[k]]}
        runs: list[list[int]] = [[k] for k in other if k not in plain and strings[k]]
        run: list[int] = []
        chars = 0
        for k in [k for k in other if k in plain]:
            run.append(k)
            chars += len(strings[k]) + 1
            if chars >= CALL_CHARS:
                runs.append(run)
                run, chars = [], 0
        runs.append(run)
        more: list[str] = []
        for run in runs:
            text = " ".join([strings[k] for k in run])
            if self.splitter.normalizer:
                text = self.splitter.normalizer.normalize_str(text)
            found = self.splitter.pre_tokenizer.pre_tokenize_str(text)
            more += [w for w, _ in found]
            if len(run) > 1:
                ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                at = np.searchsorted(ends, np.fromiter((span[0] for _, span in found), np.int64, len(found)), side="right")
                counts[run] = np.bincount(at, minlength=len(run))
            elif run:
                counts[run[0]] = len(found)
        cut = pa.array(more, pa.string()).dictionary_encode()
        of_word = np.concatenate([of_word, cut.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(words)])
        order = np.array([*simple, *(k for run in runs for k in run)], np.int64)
        begins = np.zeros(len(strings), np.int64)
        begins[order] = offsets(counts[order])[:-1]
        return words + cut.dictionary.to_pylist(), counts, of_word[spread(begins, counts)]

    # Merging

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words spelt in byte letters once all merges are applied: how many
        each word has, and all of them in order."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length) - 1
        sym = self.inner[letters]
        sym[end] = self.last[letters[end]]
        n = len(sym)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[end] = -1
        before[end - length + 1] = -1

        index: list[list[int] | None] = [None] * len(self.made)
        at = np.flatnonzero(following >= 0)
        self._enter(index, at, sym[at] * self.size + sym[at + 1])
        for rank, positions in enumerate(index):
            if positions is not None:
                few = len(positions) < FEW or self.left[rank] == self.right[rank]
                (self._join_few if few else self._join)(index, rank, positions, sym, following, before)
                index[rank] = None
        kept = sym >= 0
        return np.add.reduceat(kept, end - length + 1), sym[kept]

    def _enter(self, index: list, at: np.ndarray, keys: np.ndarray) -> None:
        """Enter the positions whose pairs some merge joins."""
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        joined = self.keys[place] == keys
        ranks, at = self.order[place[joined]], at[joined]
        if len(at) > 4 * FEW:
            by = np.argsort(ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                index[r] = (index[r] or []) + at[a:b].tolist()
            return
        for r, a in zip(ranks.tolist(), at.tolist(), strict=True):
            if index[r] is None:
                index[r] = [a]
            else:
                index[r].append(a)

    def _join(self, index: list, rank: int, positions: list[int], sym: np.ndarray, following: np.ndarray, before: np.ndarray) -> None:
        """One merge at all its positions. Its two symbols differ, so no two of them overlap."""
        p = np.sort(np.array(positions))
        p = p[np.r_[True, p[1:] != p[:-1]]]
        q = following[p]
        stands = (sym[p] == self.left[rank]) & (q >= 0) & (sym[q] == self.right[rank])
        p, q = p[stands], q[stands]
        sym[p], sym[q] = self.made[rank], -1
        after = following[q]
        following[p] = after
        some = after >= 0
        before[after[some]] = p[some]
        ahead = before[p]
        at = np.concatenate([ahead[ahead >= 0], p[some]])
        self._enter(index, at, sym[at] * self.size + sym[following[at]])

    def _join_few(self, index: list, rank: int, positions: list[int], sym: np.ndarray, following: np.ndarray, before: np.ndarray) -> None:
        """One merge, position by position from the left: also for a symbol that meets itself,
        where of overlapping pairs the left one is joined."""
        a, b, c = int(self.left[rank]), int(self.right[rank]), int(self.made[rank])
        find, size = self.rank_of.get, self.size
        for p in sorted(positions):
            q = following[p]
            if q < 0 or sym[p] != a or sym[q] != b:
                continue
            sym[p], sym[q] = c, -1
            after = following[p] = following[q]
            ahead = before[p]
            pairs = []
            if after >= 0:
                before[after] = p
                pairs.append((p, c * size + int(sym[after])))
            if ahead >= 0:
                pairs.append((int(ahead), int(sym[ahead]) * size + c))
            for at, key in pairs:
                r = find(key)
                if r is not None:
                    if index[r] is None:
                        index[r] = [at]
                    else:
                        index[r].append(at)

    # Texts

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order)."""
        for other in "\n\t\r":
            texts = pc.replace_substring(texts, other, " ")
        parts = Parts(texts)
        pieces, n_pieces, special = parts.distinct, np.ones(len(parts.distinct), np.int64), np.full(len(parts.distinct), -1, np.int64)
        whole = " ".join(pieces)
        if any(token in whole for token in self.added):  # one inside a part ends the words around it
            cut = [self.cut.split(s) for s in pieces]
            pieces = [x for found in cut for x in found]
            n_pieces = np.array(list(map(len, cut)), np.int64)
            special = np.array([self.added[x] if at % 2 else -1 for found in cut for at, x in enumerate(found)], np.int64)
        words, n_words, of_word = self.words_of(pieces if (special < 0).all() else ["" if m >= 0 else p for p, m in zip(pieces, special.tolist(), strict=True)])
        length, ids = self.merged(words)
        # The ids of each word, then of each piece, then of each part, then of each text.
        own = length[of_word]
        ids = ids[spread(offsets(length)[:-1][of_word], own)]
        n_ids = np.diff(np.r_[0, np.cumsum(own)][offsets(n_words)])
        marked = special >= 0
        if marked.any():
            ids = np.insert(ids, offsets(n_ids)[:-1][marked], special[marked])
            n_ids = n_ids + marked
        begin = offsets(n_ids)[offsets(n_pieces)]
        n_ids = np.diff(begin)
        return parts.sums(n_ids), ids[spread(begin[:-1][parts.flat], n_ids[parts.flat])]

    def decoded(self, lists: pa.Array) -> pa.Array:
        """As the library decodes, special tokens included. Ids outside the vocabulary say nothing."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < self.size)
        known[known] = self.known[ids[known]]
        counts = np.diff(np.r_[0, np.cumsum(known)][offsets(counts)])
        said = self.strings.take(pa.array(ids[known]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), said), " ")


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for each row of (doc_id, text): the ids of the whole text, without special
    tokens around it; strings of special tokens inside a text are those tokens.

    Null and empty texts have no ids; rows of null or repeated ids, and repeated rows, are rows
    like others. A text of any length is encoded whole. An empty table gives an empty result;
    further columns are ignored, whatever they are called. A task holds a block of texts."""

    return _encoded(docs, path, False)


def encode_and_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encode() and decode() in one pass over the rows: (doc_id, ids, decoded)."""
    return _encoded(docs, path, True)


def _encoded(docs: DataFrame, path: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for table, texts in text_blocks(batches, 1, BLOCK_BYTES):
            counts, ids = held.encoded(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), pa.array(ids, pa.int32()))
            made = pa.table({"doc_id": table.column(0), "ids": lists})
            for batch in made.to_batches(max_chunksize=2048):
                yield batch.append_column("decoded", held.decoded(batch.column(1))) if decoded else batch
            pa.default_memory_pool().release_unused()

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) for each row of (doc_id, ids): the text that the ids stand for,
    special tokens included. Null and empty lists give an empty text; null ids and ids outside
    the vocabulary say nothing. Further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held.decoded(batch.column(1))], ["doc_id", "ids", "decoded"])

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
