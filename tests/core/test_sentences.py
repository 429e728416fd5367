"""Queries over sentences that begin or end like the number of their place, or with spaces."""

import pytest

from claimlens.plans import queries

LONG = "jump club buzz gummy puppy"


def text_of(i):
    """Twelve sentences; the one at k begins and ends with k's digits. Spaces at both ends."""
    return "  " + " ".join(f"{k} the rain of document {i} is {LONG} {k}{'.!?'[k % 3]}" for k in range(12)) + "  "


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame([(i, text_of(i)) for i in range(40)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def sentences(i):
    return [f"{k} the rain of document {i} is {LONG} {k}" for k in range(12)]


def test_sentences_are_whole(spark, documents):
    got = {r.doc_id: (r.n, r.sentences) for r in queries.split_sentences(spark, documents).collect()}
    assert got == {i: (12, "|".join(sentences(i))) for i in range(40)}


def test_inserted_ellipses_join_whole_sentences(spark, documents):
    got = {r.claim_id: r.repaired_text for r in queries.ellipsis_insertion(spark, documents).collect()}
    assert got == {i: " ... ".join(sentences(i)[k] for k in (0, 4)) for i in range(40)}


def test_suggestions_are_whole_sentences(spark, documents):
    # The documents whose quotes are scrambled, and whose references are there.
    got = {r.claim_id: r.best_match for r in queries.validate_with_suggestions(spark, documents).where("best_match is not null").collect()}
    assert got == {i: sentences(i)[1] for i in (23, 29, 35)}
