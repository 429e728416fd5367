"""Text files by line, against a plain split of the whole text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimlens.operators import extract
from claimlens.plans import file_queries

END = re.compile(r"\r\n|\r|\n")


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    dice = random.Random(4)
    texts = {name: "".join("é" * dice.choice((0, 1, 30, 3000 * (dice.random() < 0.05))) + dice.choice(("\n", "\r", "\r\n")) for _ in range(n)) + end for name, n, end in (("a.txt", 2000, "x"), ("b.txt", 300, "\n"), ("c.txt", 1, "\r\n"))}
    for name, value in texts.items():
        (tmp_path / name).write_bytes(value.encode())
    lines = extract.text_lines(spark, str(tmp_path))
    tasks = lines.where(F.col("file").endswith("a.txt")).select(F.spark_partition_id()).distinct().count()
    assert tasks > 10
    want = {(name, k, line) for name, value in texts.items() for k, line in enumerate(END.split(re.sub(r"(\r\n|\r|\n)\Z", "", value)), 1)}
    got = [(r.file.rpartition("/")[2], r.line_number, r.line) for r in lines.collect()]
    assert len(got) == len(want) and set(got) == want
    parts = extract.text_lines(spark, str(tmp_path), F.lit("all")).collect()
    whole = [line for name in sorted(texts) for line in END.split(re.sub(r"(\r\n|\r|\n)\Z", "", texts[name]))]
    assert sorted((r.line_number, r.line) for r in parts) == list(enumerate(whole, 1)) and {r.file for r in parts} == {"all"}


def test_lines_of_all_documents(spark, tmp_path, small_splits):
    dice = random.Random(5)
    langs = ("en", "", None, "a/b=c %20", "none")
    rows = [(i, dice.choice((None, "", "\n", "a\rb", "c\r\n\r\nd\n", f"{i} " + "ü" * 700)), dice.choice(langs)) for i in range(400)] + [(None, "the last", lang) for lang in langs]
    dice.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for lang in langs:
        whole = "\n".join(t for _, t, of in sorted(rows, key=lambda r: (r[0] is None, r[0])) if of == lang and t is not None)
        want |= {(lang, k, hashlib.md5(line.encode()).hexdigest()) for k, line in enumerate(END.split(whole), 1)}
    got = [tuple(r) for r in file_queries.text_file_lines(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
