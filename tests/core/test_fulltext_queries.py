"""The full-text queries against a plain loop over whole documents."""

import hashlib

import pytest

from claimlens.operators import fulltext
from claimlens.plans import queries

LENGTHS = (0, 1, 300, 495, 700, 990, 1500, 40_000)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """(folder, texts by doc_id): each length at 18 ids, so that every provider fails somewhere."""
    texts = {i: "é" * LENGTHS[i // 18] + f" end {i}" for i in range(18 * len(LENGTHS))}
    folder = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def chain(i, text):
    """(usable offers in order, whether a provider failed)"""
    usable, failed = [], False
    for rank, provider in enumerate(fulltext.PROVIDERS, 1):
        offer = text + " more text" * (i * rank * 7 % 120)
        error = (i + rank) % 9 == 0
        failed |= error
        if not error and len(offer.strip()) >= 500 and (provider != "pmc" or len(offer) > 1000):
            usable.append((provider, offer))
    return usable, failed


def test_every_provider_offers_the_whole_text(spark, documents):
    folder, texts = documents
    offers = [(int(r.reference_id[4:]), r.text) for r in queries._candidates(spark, folder).select("reference_id", "text").collect()]
    assert all(text.startswith(texts[i]) for i, text in offers)
    assert sum(len(texts[i]) > 1000 for i, _ in offers) == 4 * sum(len(t) > 1000 for t in texts.values())


def test_first_success_over_whole_texts(spark, documents):
    folder, texts = documents
    want = {}
    for i, text in texts.items():
        usable, failed = chain(i, text)
        provider, offer = usable[0] if usable else (None, None)
        want[f"DOC:{i}"] = (provider, offer and len(offer), len(usable), failed)
    got = {r[0]: tuple(r[1:]) for r in queries.fulltext_first_success(spark, folder).collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {*fulltext.PROVIDERS, None}


def test_enrich_merges_whole_texts(spark, documents):
    folder, texts = documents
    want = {}
    for i, text in texts.items():
        usable, failed = chain(i, text)
        content, kind, provider, attempted = text, "full_text_html", None, False
        if i % 3 == 0:
            kind, attempted = ("full_text_xml", True) if usable else ("abstract_only", not failed)
            if usable:
                provider, offer = usable[0]
                content = f"{text.strip()}\n\n{offer.strip()}"
        want[f"DOC:{i}"] = (kind, provider, attempted, hashlib.md5(content.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.fulltext_enrich(spark, folder).collect()}
    assert got == want
