"""Quotes without an identifier: which documents contain them.

A containment is a theta join. It is rewritten as an equi-join on word shingles: the rarest
shingle of a quote (by document count) selects its candidates, contains() decides. Quotes too
short for a shingle are searched by an automaton that reads each document once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import normalize_text
from claimlens.plans.stage import staged

WORDS = 4
#: Characters of short quotes that one pass over the documents holds; more quotes, more passes.
BLOCK_CHARS = 8_000_000


def _shingles(tokens: Column, words: int) -> Column:
    """Hashes of the word runs of a column of words. It must be a column by itself: an
    expression inside the lambda would be computed again for every element."""
    starts = F.sequence(F.lit(1), F.size(tokens) - words + 1)
    return F.when(F.size(tokens) >= words, F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice(tokens, k, words)))))


def _blocks(quotes: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Quotes (quote_id, q_norm) in lists of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for row in quotes.toLocalIterator():
        if block and held + len(row["q_norm"]) > limit:
            yield block
            block, held = [], 0
        block.append((row["quote_id"], row["q_norm"]))
        held += len(row["q_norm"])
    if block:
        yield block


def _searched(quotes: DataFrame, documents: DataFrame, block_chars: int) -> DataFrame | None:
    """(quote_id, doc_id) of documents (doc_id, d_norm) that contain quotes (quote_id, q_norm),
    by an Aho-Corasick automaton for each block of quotes; None without quotes."""
    found = None
    schema = f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, doc_id {documents.schema['doc_id'].dataType.simpleString()}"
    for block in _blocks(quotes, block_chars):
        held = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, ids = ahocorasick.Automaton(), {}
            for quote_id, text in held.value:
                ids.setdefault(text, []).append(quote_id)
            for text, same in ids.items():
                automaton.add_word(text, tuple(same))
            automaton.make_automaton()
            for batch in batches:
                pairs = [(q, doc_id) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for q in {q for _, same in automaton.iter(text) for q in same}]
                if pairs:
                    yield pa.RecordBatch.from_pydict({"quote_id": [p[0] for p in pairs], "doc_id": pa.array([p[1] for p in pairs], batch.column(0).type)})

        hits = documents.select("doc_id", "d_norm").mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def passage_containment(quotes: DataFrame, documents: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(quote_id, doc_id) for quotes (quote_id, text) whose normalised text the document
    (doc_id, text) contains.

    A quote may start and end within a word of the document, so that its inner words alone
    make shingles; quotes of fewer than words + 2 words go to the automaton. Documents are
    normalised once."""
    q = quotes.select("quote_id", normalize_text(F.col("text")).alias("q_norm")).where("q_norm <> ''")
    d = staged(documents.select("doc_id", normalize_text(F.col("text")).alias("d_norm")))
    tokens = F.split("q_norm", " ")
    long = F.size(tokens) >= words + 2
    asked = q.where(long).select("quote_id", F.slice(tokens, F.lit(2), F.size(tokens) - 2).alias("words")).select("quote_id", F.explode(_shingles(F.col("words"), words)).alias("shingle"))
    held = d.select("doc_id", F.split("d_norm", " ").alias("words")).select("doc_id", F.explode(_shingles(F.col("words"), words)).alias("shingle"))
    held = staged(held.join(asked.select("shingle").distinct(), "shingle", "left_semi"))
    often = held.groupBy("shingle").agg(F.count("*").alias("n"))
    # A shingle that no document holds settles a quote: it comes first, and meets none.
    rarest = asked.join(often, "shingle", "left").groupBy("quote_id").agg(F.min_by("shingle", F.coalesce("n", F.lit(0))).alias("shingle"))
    pairs = staged(rarest.join(held, "shingle").select("quote_id", "doc_id"))
    met = pairs.join(q, "quote_id").join(d, "doc_id").where(F.contains("d_norm", "q_norm")).select("quote_id", "doc_id")
    few = _searched(q.where(~long), d, block_chars)
    return met if few is None else met.unionByName(few)
