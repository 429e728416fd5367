"""Scalar functions against golden pairs and a plain Python version."""

import re

import pytest
from pyspark.sql import functions as F

from claimlens.functions import fields, fuzzy, ids, jsonpath, text
from claimlens.functions.fuzzy import partial_ratio, partial_ratios, ratio, ratios, token_sort_ratio


def column(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def plain_norm(s):
    for letter, name in zip(text.GREEK_UPPER + text.GREEK_FOLDED, text.GREEK_NAMES + text.GREEK_NAMES, strict=False):
        s = s.replace(letter, "sigma" if letter == "ς" else name)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()


NORMAL = {
    "Hello, World!": "hello world",
    "T-Cell Receptor": "t cell receptor",
    "  Multiple   Spaces  ": "multiple spaces",
    "α-catenin": "alpha catenin",
    "Δ-opioid": "delta opioid",
    "ς-factor": "sigma factor",
    "ΔNp63": "deltanp63",
    "α-catenin vs β-catenin": "alpha catenin vs beta catenin",
    "½ and x_y H₂O!": "½ and x_y h₂o",
    "": "",
    "!!!": "",
    "µ ά": "µ ά",
}


def test_normalize_text(spark):
    assert column(spark, list(NORMAL), text.normalize_text) == list(NORMAL.values())


def test_normalize_text_equals_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.normalize_text(F.col("text")).alias("n")).collect()
    assert all(r.n == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", r.text.lower())).strip() for r in docs)


SPLIT = [
    ("protein functions in cells", (), ["protein functions in cells"]),
    ("protein functions ... in cells", (), ["protein functions", "in cells"]),
    ("protein [important] functions", (), ["protein functions"]),
    ("protein [important] binds [2Fe-2S] cluster", (r"\d",), ["protein binds [2Fe-2S] cluster"]),
    ("export of [poly(A)+] RNA [important] in cells", ("[()+]",), ["export of [poly(A)+] RNA in cells"]),
    ("[only a note]", (), []),
    ("a [b\nc] d", (), ["a [b c] d"]),
    ("open [ bracket..end", (), ["open [ bracket", "end"]),
    ("one… two", (), ["one… two"]),
    ("", (), []),
    (" .... ", (), []),
]


@pytest.mark.parametrize(("quote", "literal", "parts"), SPLIT)
def test_split_query(spark, quote, literal, parts):
    assert column(spark, [quote], lambda c: text.split_query(c, literal)) == [parts]


def test_sentences_words_and_fragments(spark):
    s = "This is the first longer sentence. This is the second longer sentence."
    assert column(spark, [s], lambda c: F.size(text.split_sentences(c))) == [2]
    assert column(spark, ["Short. This is a sentence that is longer than twenty characters."], lambda c: F.size(text.split_sentences(c))) == [1]
    assert column(spark, ["A B C. D E F."], lambda c: text.split_sentences(c, 3)) == [["A B C", "D E F."]]
    assert column(spark, ["Hello world. Goodbye world."], text.split_fragments) == [["Hello world", "Goodbye world."]]
    assert column(spark, ["The JAK1 protein is a tyrosine kinase, été"], text.significant_words) == [["jak1", "protein", "tyrosine", "kinase"]]
    assert column(spark, ["jak1 kinase", "the is"], lambda c: text.word_overlap(c, F.lit("a kinase"))) == [50.0, 0.0]


def test_character_mappings_go_one_after_another(spark):
    assert column(spark, ["H2O2 CO2 +/- 5 +-"], text.character_mapping) == ["H₂O₂ CO₂ ± 5 ±"]


def test_confidence(spark):
    scores = {"1.0": "HIGH", "0.95": "HIGH", "0.94": "MEDIUM", "0.8": "MEDIUM", "0.79": "LOW", "0.5": "LOW", "0.49": "VERY_LOW", "0": "VERY_LOW"}
    assert column(spark, list(scores), lambda c: text.confidence(c.cast("double"))) == list(scores.values())
    assert column(spark, ["WARNING", "warn", "INFO", "odd"], text.severity) == ["WARN", "WARN", "INFO", "ERROR"]


def test_reference_ids(spark):
    forms = {"PMID:1": "PMID:1", "pmid 12": "PMID:12", "123": "PMID:123", " DOI: 10.1/x ": "DOI:10.1/x", "https://x.org/a": "url:https://x.org/a", "file:a.md": "file:a.md", "FILE:a": "file:a", "odd": "odd", "": ""}
    assert column(spark, list(forms), ids.normalize_reference_id) == list(forms.values())
    assert column(spark, ["geo:GSE1", "ncbi:5"], lambda c: ids.normalize_reference_id(c, {"ncbi": "PMID"})) == ["GEO:GSE1", "PMID:5"]
    assert column(spark, ["SRA:1", "sra:1", "SRA 1", "x"], lambda c: ids.is_skipped(c, ["sra"])) == [True, True, False, False]
    assert column(spark, ["url:https://x.org/a?b=c"], ids.cache_name) == ["url_https___x.org_a_b_c.md"]
    assert column(spark, ["PMID:1", "7", "GSE12", "NCT00000001", "PRJNA5", "SAMN5", "my:1", "zz9"], lambda c: ids.source_of(c, [("my", [r"^zz\d+$"])])) == ["PMID", "PMID", "GEO", "clinicaltrials", "BIOPROJECT", "BIOSAMPLE", "my", "my"]
    assert column(spark, ["PPR:123"], lambda c: ids.build_identifiers(c)["pprid"]) == ["PPR123"]


def test_roles(spark):
    assert column(spark, ["oa:exact", "http://www.w3.org/ns/oa#exact", "dcterms:title"], fields.is_excerpt_uri) == [True, True, False]
    assert column(spark, ["dcterms:references", "ex:hasReference", "ex:user_preference", "ex:dereference"], fields.is_reference_uri) == [True, True, False, False]
    assert column(spark, ["title", "dcterms:title", "subtitle"], fields.is_title_uri) == [True, True, False]


def test_json_paths(spark):
    doc = '{"a": [{"b-c": 1}, {"b-c": "x"}], "d": {"e": ["", "p", "q"]}, "t": true}'
    paths = {"$.a[1].b-c": "x", "a[0].b-c": "1", "$.a[*].b-c": "1", "$..e[1]": "p", "$.a[-1].b-c": "x", "$.none": None, "$.[[": None, "$.t": "true"}
    for path, want in paths.items():
        assert column(spark, [doc], lambda c, p=path: jsonpath.first_match(c, p)) == [want], path
    assert column(spark, [doc], lambda c: jsonpath.extra_content(jsonpath.extra_fields(c, {"e": "$.d.e", "no": "$.x"}))) == ["### e\n\np q"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    """Window by window."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for s, t in [(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]:
        windows = [t[max(0, e - len(s)) : e] for e in range(1, len(s) + len(t))]
        best = max(best, *(200 * lcs(s, w) / (len(s) + len(w)) for w in windows if w))
    return best


@pytest.mark.parametrize("cells", [1, 300, 1 << 16])
def test_ratios_equal_the_plain_table(monkeypatch, cells):
    """In batches of any size, with characters beyond the basic plane, and of all lengths."""
    import random

    monkeypatch.setattr(fuzzy, "CELLS", cells)
    rng = random.Random(cells)
    a, b = (["".join(rng.choice("abc é日😀\uffff") for _ in range(rng.randint(0, most))) for _ in range(300)] for most in (14, 25))
    assert ratios(a, b).tolist() == pytest.approx([200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)])
    assert partial_ratios(a, b).tolist() == pytest.approx([plain_partial(x, y) for x, y in zip(a, b, strict=True)])
    assert partial_ratio("protein x", "the protein x here") == 100.0 and partial_ratio("", "a") == 0.0
    assert token_sort_ratio("b a", "a b") == 100.0 and ratio("", "") == 100.0
    long = "ab" * 20_000
    assert partial_ratio("abcab", long) == pytest.approx(100 * 8 / 9)
