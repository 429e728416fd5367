"""Verdicts, suggestions, repairs and reports on hand-made claims, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from claimlens.functions import text
from claimlens.functions.fuzzy import partial_ratio
from claimlens.operators.fuzzy_search import fuzzy_search
from claimlens.operators.quote_parts import held_parts
from claimlens.operators.repair import ellipsis_insertion, repair
from claimlens.operators.report import format_report, repair_report, validation_report, with_repair_report, with_validation_report
from claimlens.operators.validate import failures, validate, validate_title, validate_typed
from claimlens.plans.config import RepairConfig, ValidationConfig, load_config

CONTENT = (
    "Protein X functions in cell cycle regulation and plays a critical role in genomic stability. "
    "CO₂ levels were measured at various time points during the whole experiment. "
    "Several other findings were reported by the authors in this long paper. "
    "The protein localizes to the nucleus during chromosome segregation."
)
REFS = [("PMID:1", "A Title.", CONTENT, "abstract_only"), ("PMID:2", "Empty", "", "abstract_only"), ("PMID:3", None, "Some text. [2Fe-2S] cluster binds.", "full_text_xml"), ("PMID:4", "Null", None, "unavailable")]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "reference_id string, title string, content string, content_type string")


def claims(spark, rows):
    return spark.createDataFrame([(k, *r, *[None] * (4 - len(r))) for k, r in enumerate(rows)], "claim_id long, supporting_text string, reference_id string, expected_title string, path string")


CASES = [
    (("protein x FUNCTIONS in cell cycle", "pmid:1"), True, "INFO", "Supporting text validated successfully in pmid:1"),
    (("Protein X functions ... localizes to the nucleus", "1", "a title"), True, "INFO", "Supporting text validated successfully in 1, title validated"),
    (("Protein X functions", "PMID:1", "Other"), False, "ERROR", "Title mismatch: expected 'Other' but got 'A Title.'"),
    (("not there at all", "PMID:1"), False, "ERROR", "Text part not found as substring: 'not there at all' (note: only abstract available for PMID:1, full text may contain this excerpt)"),
    (("[note only]", "PMID:3"), False, "ERROR", "Query is empty after removing brackets and splitting"),
    (("x", "PMID:9"), False, "WARN", "Could not fetch reference: PMID:9"),
    (("x", "PMID:2"), False, "ERROR", "No content available for reference: PMID:2"),
    (("x", "sra:5"), True, "INFO", "Skipping validation for reference with prefix 'SRA': sra:5"),
    (("!!!", "PMID:3"), True, "INFO", "Supporting text validated successfully in PMID:3"),
]


def test_validate(spark, refs):
    config = ValidationConfig(skip_prefixes=("SRA",), unknown_prefix_severity="WARN")
    results = validate(claims(spark, [c[0] for c in CASES]), refs, config)
    got = {r.claim_id: r for r in results.collect()}
    assert len(got) == len(CASES)
    for k, (_, valid, level, message) in enumerate(CASES):
        assert (got[k].is_valid, got[k].severity, got[k].message) == (valid, level, message)
    assert got[0].match.similarity_score == 1.0 and got[1].match.matched_text == "Protein X functions ... localizes to the nucleus"
    assert got[5].match is None and got[7].match is None
    assert failures(results).count() == sum(not c[1] for c in CASES)
    n = validation_report(results).first()
    assert (n.total_validations, n.valid_count, n.error_count, n.warning_count, n.is_valid) == (9, 4, 4, 1, False)


def test_repeated_claims_have_a_result_each(spark, refs):
    once = claims(spark, [("Protein X functions in cell cycle regulations and plays critical role", "PMID:1"), ("CO2 levels were measured", "PMID:1"), ("x", "PMID:9")])
    twice = once.unionByName(once)
    for made in (validate(twice, refs), validate(twice, refs, many=1), validate(twice, refs, suggest=False), repair(twice, refs)):
        rows = made.collect()
        assert sorted(r.claim_id for r in rows) == [0, 0, 1, 1, 2, 2]
        assert len({str(r) for r in rows}) == 3


def test_many_quotes_of_a_document(spark, refs):
    """The same results, however many claims make a document's quotes be searched together."""
    asked = claims(spark, [c[0] for c in CASES] * 3 + [("x [2Fe-2S] ... binds", "PMID:3"), ("", "PMID:1"), (None, "PMID:1"), ("a", "PMID:1")])
    apart, together = (sorted(map(str, validate(asked, refs, suggest=False, many=n).collect())) for n in (10**6, 1))
    assert apart == together and len(apart) == 31


def test_parts_in_blocks(spark):
    rng = random.Random(2)
    texts = {k: "".join(rng.choice("ab cé日") for _ in range(2000)) for k in "xy"}
    parts = {(k, "".join(rng.choice("ab cé日") for _ in range(rng.randint(0, 7)))) for k in "xyz" for _ in range(400)}
    asked = spark.createDataFrame([*parts, *parts, ("x", None)], "ref_key string, part string")
    held = spark.createDataFrame([*texts.items(), ("z", None)], "ref_key string, text string")
    want = sorted((k, p) for k, p in parts if k in texts and p in texts[k])
    for size in (10**6, 100, 1):
        assert sorted(map(tuple, held_parts(asked, held, size).collect())) == want
    assert held_parts(asked.limit(0), held).collect() == []


def test_typed_claims(spark, refs):
    rows = [(1, "Protein X functions", "PMID:1", None, "p", "excerpt"), (2, None, "PMID:1", "a title", "p", "title"), (3, None, "PMID:1", "other", "p", "title"), (4, "x y", "PMID:9", None, "p", None)]
    made = validate_typed(spark.createDataFrame(rows, "claim_id long, supporting_text string, reference_id string, expected_title string, path string, kind string"), refs)
    got = {r.claim_id: (r.kind, r.is_valid, r.message) for r in made.collect()}
    assert got == {
        1: ("excerpt", True, "Supporting text validated successfully in PMID:1"),
        2: ("title", True, "Title validated successfully for PMID:1"),
        3: ("title", False, "Title mismatch for PMID:1: expected 'other' but got 'A Title.'"),
        4: ("excerpt", False, "Could not fetch reference: PMID:9"),
    }


def test_reports_are_filled_while_results_are_written(spark, refs, tmp_path):
    """The same counts as by a pass of their own."""
    asked = claims(spark, [c[0] for c in CASES])
    for made, report, counted in ((validate(asked, refs), validation_report, with_validation_report), (repair(asked, refs), repair_report, with_repair_report)):
        results, seen = counted(made)
        results.write.parquet(str(tmp_path / report.__name__))
        assert seen.get == report(made).first().asDict() and seen.get


def test_literal_brackets(spark, refs):
    c = claims(spark, [("[2Fe-2S] cluster", "PMID:3")])
    assert not validate(c, refs, ValidationConfig(literal_bracket_patterns=(r"\d",)), suggest=False).where("not is_valid").count()
    got = validate(claims(spark, [("x [2Fe-2S] cluster", "PMID:3")]), refs, suggest=False).first()
    assert got.message.endswith("'x cluster'")


def test_suggestions_never_make_a_claim_valid(spark, refs):
    c = claims(spark, [("Protein X functions in cell cycle regulations and plays critical role", "PMID:1"), ("wholly different words that nothing here shares", "PMID:1")])
    got = {r.claim_id: r for r in validate(c, refs).collect()}
    assert not got[0].is_valid and got[0].match.suggested_fix.startswith("Very close match (") and got[0].match.similarity_score > 0.9
    assert got[0].match.best_match.startswith("Protein X functions")
    assert got[1].match.suggested_fix is None and got[1].match.similarity_score < 0.5


def test_validate_title(spark, refs):
    c = claims(spark, [("", "PMID:1", "a  title"), ("", "PMID:1", "title"), ("", "PMID:3", "x"), ("", "PMID:9", "x"), ("", "SRA:1", "x")])
    got = {r.claim_id: (r.is_valid, r.severity, r.message) for r in validate_title(c, refs, ValidationConfig(skip_prefixes=("SRA",))).collect()}
    assert got == {
        0: (True, "INFO", "Title validated successfully for PMID:1"),
        1: (False, "ERROR", "Title mismatch for PMID:1: expected 'title' but got 'A Title.'"),
        2: (False, "ERROR", "Reference PMID:3 has no title to validate against"),
        3: (False, "ERROR", "Could not fetch reference: PMID:9"),
        4: (True, "INFO", "Skipping title validation for reference with prefix 'SRA': SRA:1"),
    }


def plain_search(query, content, threshold, cols):
    """The search sentence by sentence, from the columns that Spark computed."""
    q_norm, t_norm, sentences = cols
    if q_norm in t_norm:
        return True, 100.0, query
    if len(q_norm.split()) < 5:
        return False, 0.0, None
    best, match, share = 0.0, None, 0.0
    for s, s_norm, overlap in sentences:
        score = partial_ratio(q_norm, s_norm)
        effective = score if overlap >= 50 else score * overlap / 50
        if effective > best:
            best, match, share = effective, s, overlap
        if score >= 95 and overlap >= 50:
            return True, score, s
    return best >= threshold and share >= 50, best, match


def test_fuzzy_search_equals_a_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    contents = docs.select(F.col("doc_id").cast("string").alias("ref_key"), F.col("text").alias("content"))
    q = docs.select(F.col("doc_id").alias("claim_id"), F.concat(F.substring("text", 30, 60), F.lit(" the "), F.substring("text", 200, 40)).alias("query"), F.col("doc_id").cast("string").alias("ref_key"))
    got = {r.claim_id: r for r in fuzzy_search(q, contents, 70.0).collect()}
    rows = q.join(contents, "ref_key").withColumn("s", text.split_sentences(F.col("content")))
    flat = rows.select("claim_id", "query", "content", text.normalize_whitespace(F.col("query")).alias("qn"), text.normalize_whitespace(F.col("content")).alias("tn"), F.transform("s", lambda s: F.struct(s, text.normalize_whitespace(s), text.word_overlap(F.col("query"), s))).alias("s")).collect()
    assert len(got) == len(flat) == 40
    for r in flat:
        found, score, match = plain_search(r.query, r.content, 70.0, (r.qn, r.tn, [tuple(x) for x in r.s]))
        g = got[r.claim_id]
        assert (g.found, g.best_match) == (found, match) and g.score == pytest.approx(score)


def test_ellipsis(spark, refs):
    contents = refs.where("content <> ''").select(F.col("reference_id").alias("ref_key"), "content")
    rows = [
        (0, "Protein X functions in cell cycle regulation. The protein localizes to the nucleus", "PMID:1"),
        (1, "Protein X functions in cell cycle regulation and plays a critical role", "PMID:1"),
        (2, "The protein localizes to the nucleus. Protein X functions", "PMID:1"),
        (3, "Protein X functions. and never said this at all anywhere", "PMID:1"),
        (4, "Protein X functions ... genomic. stability", "PMID:1"),
        (5, "genomic stability. CO₂ levels", "PMID:1"),
    ]
    got = {r.claim_id: r.repaired_text for r in ellipsis_insertion(spark.createDataFrame(rows, "claim_id long, query string, ref_key string"), contents).collect()}
    assert got == {0: "Protein X functions in cell cycle regulation ... The protein localizes to the nucleus", 2: "Protein X functions ... The protein localizes to the nucleus"}


def test_repair(spark, refs):
    rows = [
        ("Protein X functions", "PMID:1"),
        ("CO2 levels were measured", "PMID:1"),
        ("Protein X functions in cell cycle regulation. The protein localizes to the nucleus", "PMID:1"),
        ("Protein X functions in the cell cycle regulation and plays a critical role in genomic stability", "PMID:1"),
        ("nothing of this kind occurs anywhere within", "PMID:1"),
        ("whatever", "PMID:4"),
        ("whatever", "PMID:7"),
        ("skipped", "PMID:8"),
        ("nothing of this kind occurs anywhere within", "PMID:3"),
    ]
    results = repair(claims(spark, rows), refs, RepairConfig(skip_references=("PMID:8",), trusted_low_similarity=("PMID:3",)))
    got = {r.claim_id: r for r in results.collect()}
    kinds = {k: [a.action_type for a in r.actions] for k, r in got.items()}
    assert got[0].was_valid and got[0].message == "Already valid" and not kinds[0]
    assert kinds[1] == ["CHARACTER_NORMALIZATION"] and got[1].repaired_text == "CO₂ levels were measured" and got[1].actions[0].can_auto_fix
    assert kinds[2] == ["ELLIPSIS_INSERTION"] and got[2].is_repaired and got[2].actions[0].confidence == "MEDIUM"
    assert kinds[3] == ["FUZZY_CORRECTION"] and got[3].actions[0].confidence == "HIGH" and got[3].is_repaired
    assert kinds[4][-1] == "REMOVAL" and got[4].message.startswith("Flagged for removal")
    assert kinds[5] == kinds[6] == ["UNVERIFIABLE"]
    assert got[7].message == "Skipped - reference PMID:8 is in skip list" and not got[7].was_valid
    assert "REMOVAL" not in kinds[8] and got[8].message.startswith("Flagged for removal")
    n = repair_report(results).first()
    assert (n.total_items, n.already_valid_count, n.repaired_count, n.auto_fixed_count, n.suggested_count, n.removal_count, n.unverifiable_count) == (9, 1, 3, 2, 1, 1, 2)
    shown = format_report(results, verbose=True)
    assert "HIGH CONFIDENCE FIXES" in shown and "  Removals: 1" in shown


def test_config(tmp_path):
    (tmp_path / ".claimlens.yaml").write_text("validation: {skip_prefixes: [SRA], unknown_prefix_severity: WARN}\nrepair: {removal_threshold: 0.4}\n")
    v, r = load_config(directory=str(tmp_path))
    assert v.skip_prefixes == ("SRA",) and v.unknown_prefix_severity == "WARN" and r.removal_threshold == 0.4
    with pytest.raises(ValueError):
        RepairConfig(removal_threshold=2)
