"""Operators 11 to 13 against brute force and the libraries themselves, and their defined results
for nulls, empties, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import bpe_codec as bpe
from claimlens.llm import hard_negatives as hard
from claimlens.llm import token_alignment as align
from claimlens.llm.queries import op11_hard_negatives, op12_token_alignment, op13_bpe_codec
from claimlens.llm.text_units import text_blocks

DATA = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, `Text` string")


# 11


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, `Label` string")


def mined(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    """All pairs, one by one."""
    held = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = [math.floor(scale * float(np.float32(x))) for x in v], y
    out = []
    for a in sorted(i for i in held if anchors(i)):
        q, y = held[a]
        scored = sorted((-sum(p * r for p, r in zip(q, v, strict=True)), i, z == y) for i, (v, z) in held.items() if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(hard, "FIRST_LISTS", 2)
    monkeypatch.setattr(hard, "GROWTH", 3)
    monkeypatch.setattr(hard, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard, "TILE_VISITS", 3)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rng.standard_normal(8) * (0.1 if seed == 1 else 1)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    rows += [(700 + i, rows[7][1], i % 2) for i in range(300)]  # a group of copies
    got = found(hard.hard_negatives(vectors(spark, rows), "vec_id % 50 = 0"))
    assert got == mined(rows, lambda i: i % 50 == 0)
    assert len(got) > 100


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [0.9, 0.0], 2), (4, [0.5, -0.5], 3),
        (5, None, 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [0.5, 0.0], None), (None, [0.5, 0.0], 2),
        (10, [-1.0, 0.0], 1), (100, [0.5], 1), (101, [0.5], 1), (102, [0.25], 2), (200, [], 1), (201, [], 1), (202, [], 2), (300, [1e30, 0.0], 2),
    ]
    got = found(hard.hard_negatives(vectors(spark, rows)))
    assert got == mined([r for r in rows if r[0] != 300], lambda i: i % 100 == 0)
    # 0.9 is just above the window's end (230 of 256 times 256), and a window of negative scores is empty.
    assert [r[:4] for r in got if r[0] == 0] == [(0, 1, 1, 3), (0, 1, 2, 2), (0, 1, 3, 4)]
    assert (200, 201, 1, 202, 0, 0) in got
    again = rows + [(0, [1.0, 0.0], 1), (3, [0.1, 0.0], 3)]  # repeated ids: the smaller label
    assert found(hard.hard_negatives(vectors(spark, again))) == got
    assert hard.hard_negatives(vectors(spark, [])).collect() == []
    assert hard.hard_negatives(vectors(spark, [(0, [1.0], 1)])).collect() == []


def test_lists_are_skipped(spark):
    """Anchors don't visit lists out of reach, and bounds hold for every row."""
    rng = np.random.default_rng(3)
    centres = np.eye(8)
    rows = [(i, [float(x) for x in centres[i % 8] + rng.standard_normal(8) * 0.01], i % 3) for i in range(800)]
    held = hard._prepared(hard.pick(vectors(spark, rows), "vec_id", "embedding", "label"), 256).collect()
    numbers = {r.vec_id: np.frombuffer(r.numbers, np.int64) for r in held}
    x = np.array(list(numbers.values()), np.float64)
    centroids = {8: np.array([x[np.argmax(x @ c)] for c in centres])}
    of = hard._nearest(x, centroids[8])
    radii = {(8, k): float(np.linalg.norm(x[of == k] - centroids[8][k], axis=1).max()) for k in range(8)}
    bounds = hard.Bounds(centroids, radii)
    for q in x[:20]:
        number, upper, lower = bounds.of(q.astype(np.int64))
        assert (np.diff(upper) <= 0).all()
        for k, up, low in zip(number, upper, lower, strict=True):
            scores = x[of == k] @ q
            assert low <= scores.min() and scores.max() <= up
    kth = np.sort(x @ x[0])[-5]
    assert (bounds.of(x[0].astype(np.int64))[1] >= kth).sum() == 1


def test_op11_has_its_label_rule(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert found(op11_hard_negatives(spark, DATA)) == mined(rows, lambda i: i % 100 == 0)


# 12

STRANGE = [
    "", " ", "  ", "a ", " a", "a  b", "a　b", "　", "a <|endoftext|> b<s></s>c <|endoftext", "don't I'LL we'Ve 's", "1234 ½ ² x₂", "\x1c a\x1cb \x85 c᠎d​e", "日本語 テスト", "👍🏽👍 a",
    "a\n\n\tb\r\nc", "\x00 \x00a", "a b   c", "a▁b c", "▁", "foo▁ bar", "x \n y", "\n", "a \n", "a \x1c b", "a  b", "é ́", "aaaa" * 300, "ΟΔΟΣ ΣΑΣ.", "İstanbul", "ﬁ Å",
    "a <|startoftext|> b<|endoftext|>c <|endoftext", "<|endoftext|><|endoftext|>", "Ǆ ß ẞ", None,
]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeABΣς é́'　\n\t12½.,!<|>endoftext日👍 \x1c▁   ") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def aligned(texts):
    """Token by token."""
    both = align.Tokenizers(align.VOCABULARY_A, align.MODEL_B)
    held = []
    for t in texts:
        got = None
        if t:
            a, b, whole = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t), (" " + t).encode()
            bytes_a, bytes_b = [both.bytes_a[k] for k in a], [both.bytes_b[k] for k in b]
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                spans = []
                for parts in (bytes_a, bytes_b):
                    at, cuts = 0, []
                    for p in parts:
                        cuts.append((at, at := at + len(p)))
                    spans.append(cuts)
                links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (f, g) in zip(b, spans[1], strict=True) if max(s, f) < min(e, g)]
                ends, groups, i, j = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), [], 0, 0
                for end in ends:
                    m, n = [e for _, e in spans[0]].index(end) + 1, [e for _, e in spans[1]].index(end) + 1
                    groups.append(f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
                    i, j = m, n
                got = len(a), len(b), len(groups), links, ";".join(groups)
        held.append(got or (0, 0, 0, [], ""))
    count = Counter(pair for h in held for pair in set(h[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(h[0], h[1], h[2], len(h[3]), sum(count[p] == best[p[0]] for p in h[3]), sum(count[p] for p in h[3]), h[4]) for h in held]


def test_alignment_equals_token_by_token(spark):
    texts = STRANGE + random_texts(300) + ["the same words again"] * 3
    got = sorted(map(tuple, align.align_tokens(docs(spark, texts)).collect()))
    assert [r[1:] for r in got] == aligned(texts)


def test_alignment_in_small_pieces(spark, monkeypatch):
    """Many runs of documents and calls make no difference."""
    monkeypatch.setattr(align, "HELD_PAIRS", 7)
    monkeypatch.setattr(align, "CALL_CHARS", 9)
    texts = [t for t in random_texts(60) if t] + ["the same words again"] * 3
    both = align.Tokenizers(align.VOCABULARY_A, align.MODEL_B)
    runs = list(align.Block(both, pa.array(texts)).document_counts())
    keys, counts = align._summed(runs)
    monkeypatch.undo()
    whole = align._summed(list(align.Block(both, pa.array(texts)).document_counts()))
    assert len(runs) > 10 and keys.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def test_shards_hold_summed_counts_in_order(spark, monkeypatch):
    monkeypatch.setattr(align, "SHARD_ROWS", 100)
    rng = np.random.default_rng(1)
    rows = [(int(a) << 32 | int(b), int(n)) for a, b, n in zip(rng.integers(0, 40, 3000), rng.integers(0, 30, 3000), rng.integers(1, 9, 3000), strict=True)]
    want = Counter()
    for k, n in rows:
        want[k] += n
    shards, best = align.count_shards(spark.createDataFrame(rows, "key long, n long").repartition(5))
    assert len(shards) > 4 and [f for _, f in shards] == sorted(f for _, f in shards)
    keys = np.array(sorted(want), np.int64)
    assert align.looked_up(shards)(keys).tolist() == [want[k] for k in keys.tolist()]
    assert best.tolist() == [max(n for k, n in want.items() if k >> 32 == a) for a in range(len(best))]
    with pytest.raises(RuntimeError):
        align.looked_up(shards)(np.array([39 << 32 | 31], np.int64))


def test_alignment_edges(spark):
    assert align.align_tokens(docs(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in align.align_tokens(docs(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    rows = spark.createDataFrame([(None, "same text"), (1, "same text"), (1, "same text")], "doc_id long, text string")
    assert {r.count_sum for r in align.align_tokens(rows).collect()} == {3 * r for r in {r.n_links for r in align.align_tokens(rows).collect()}}
    long = "word and word, " * 20_000
    one = align.align_tokens(docs(spark, [long])).first()
    assert one.n_links == one.count_sum == one.n_best + (one.n_links - one.n_best) and one.n_a > 60_000


def test_op12_over_a_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    short = [(i, t) for i, t in texts if len(t or "") < 1500]
    want = {i: w for (i, _), w in zip(short, aligned([t for _, t in short]), strict=True)}
    got = {r.doc_id: r for r in op12_token_alignment(spark, DATA).collect()}
    assert len(got) == len(texts)
    for i, w in want.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == w[:4]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


# 13


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.VOCABULARY)


def test_codec_equals_the_library(spark):
    texts = STRANGE + random_texts(500)
    got = [tuple(r) for r in bpe.decode(bpe.encode(docs(spark, texts))).orderBy("doc_id").collect()]
    held = library()
    for (_, ids, decoded), t in zip(got, texts, strict=True):
        want = held.encode(t or "", add_special_tokens=False).ids
        assert ids == want, t
        assert decoded == held.decode(want, skip_special_tokens=False)


def test_every_character_is_encoded_as_in_the_library():
    held, own = library(), bpe.vocabulary(bpe.VOCABULARY)
    texts = [" ".join(f"a{chr(c)}{chr(c)}1 x{chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000) for start in [*range(0, 0x3400, 64), *range(0xA000, 0x11000, 64), *range(0x1D400, 0x1FB00, 64)]]
    counts, ids = own.encoded(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == held.encode(t, add_special_tokens=False).ids
        at += n


def merged_alone(held, word):
    """A word's merges one at a time: the smallest rank, then the leftmost."""
    sym = [int(held.inner[ord(c)]) for c in word[:-1]] + [int(held.last[ord(word[-1])])]
    while True:
        ranks = [(held.rank_of[k], i) for i, k in enumerate(a * held.size + b for a, b in zip(sym, sym[1:], strict=False)) if k in held.rank_of]
        if not ranks:
            return sym
        r, i = min(ranks)
        sym[i : i + 2] = [int(held.made[r])]


@pytest.mark.parametrize("few", [0, 12, 10**6])
def test_index_equals_merging_one_by_one(monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW", few)
    held, rng = bpe.vocabulary(bpe.VOCABULARY), random.Random(9)
    words = sorted({"".join(rng.choice("aehinorst" if k % 2 else "ab") for _ in range(rng.randint(1, 30))) for k in range(600)} | {"a" * n for n in (1, 2, 3, 7, 500)})
    counts, sym = held.merged(words)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        assert sym[at : at + n].tolist() == merged_alone(held, w)
        at += n


def test_codec_edges(spark):
    assert bpe.encode(docs(spark, [])).collect() == bpe.encode_and_decode(docs(spark, [])).collect() == []
    assert [r.ids for r in bpe.encode(docs(spark, [None, ""])).collect()] == [[], []]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, None, -1, 10**7, 49407])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows).orderBy("doc_id").collect()] == ["", "", f"{bpe.vocabulary(bpe.VOCABULARY).strings[320].as_py()} <|endoftext|>"]
    long = "x" * 50_000 + " the end of " * 50_000
    assert len(bpe.encode(docs(spark, [long])).first().ids) == len(library().encode(long, add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        bpe.Vocabulary(align.VOCABULARY_A)  # its words hold their spaces


def test_op13_over_a_whole_table(spark):
    held = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_bpe_codec(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = held.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), held.decode(ids, skip_special_tokens=False))))


def test_blocks_keep_all_rows_in_order():
    texts = ["a" * n for n in (0, 5, 3, 100, 1, 1, 1, 40)] + [None, "b"]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(k, k + 5)), "t": texts[k : k + 5]}) for k in (0, 5)]
    blocks = list(text_blocks(batches, 1, 8))
    assert [t for _, b in blocks for t in b.to_pylist()] == [t or "" for t in texts]
    assert [i for t, _ in blocks for i in t.column("id").to_pylist()] == list(range(10))
    assert max(len(b) for _, b in blocks) <= 5
