"""Many quotes of one document: all their parts in one pass over its text.

Where claims name a document thousands of times, a join would pair its text with each of them
and search it as often. Here the distinct parts of a document's quotes are gathered into
blocks of bounded size; the text meets each block once, and an automaton over the block's
parts reads it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the parts of a block.
BLOCK_CHARS = 1_000_000
#: Parts of up to so many characters, which may match anywhere, are looked for one by one.
SHORT = 3


def parts_within(parts: list[str], text: str) -> list[str]:
    """The parts that occur in the text, each once."""
    import ahocorasick

    held = [p for p in parts if len(p) <= SHORT and p in text]
    automaton = ahocorasick.Automaton()
    for p in parts:
        if len(p) > SHORT:
            automaton.add_word(p, p)
    if len(automaton):
        automaton.make_automaton()
        held += {p for _, p in automaton.iter(text)}
    return held


def held_parts(parts: DataFrame, texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(ref_key, part) of those parts (ref_key, part) that occur in the text (ref_key, text) of
    their document. Repeated parts count once; the empty part occurs in every text; nulls, and
    parts of documents without text, don't occur."""
    parts = parts.where("part is not null").distinct()
    sizes = parts.groupBy("ref_key").agg(F.ceil(F.sum(F.length("part")) / block_chars).alias("n"))
    placed = parts.join(sizes, "ref_key").withColumn("block", F.pmod(F.xxhash64("part"), F.greatest("n", F.lit(1))))
    blocks = placed.groupBy("ref_key", "block").agg(F.collect_list("part").alias("parts"))
    met = blocks.join(texts.where("text is not null"), "ref_key").select("ref_key", "parts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = parts_within(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.array(found, pa.string())], ["ref_key", "part"])

    return met.mapInArrow(run, "ref_key string, part string")
