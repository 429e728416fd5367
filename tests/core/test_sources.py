"""Readers, parsers, extraction, full text, write-back, streams and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimlens.__main__ import main
from claimlens.operators import extract, fulltext
from claimlens.operators.containment import passage_containment
from claimlens.plans import lifecycle, stage
from claimlens.plans.config import RepairConfig
from claimlens.sources import cache, custom, formats, payloads, schema, store
from claimlens.streaming import claims as stream

MD = """---
reference_id: PMID:1
title: "A: title"
authors:
- A One
- B Two
year: "2020"
content_type: abstract_only
keywords: single
supplementary_files:
- filename: a.csv
  size_bytes: 5
- description: no name
---
# A: title

## Content

CO₂ levels were measured here.
More text of the paper.
"""
LEGACY = "ID: PMID:2\nTitle: T\nAuthors: A, B\nYear: 1999\nContentType: full_text_xml\n\nBody text.\n"


def test_cache_files(spark, tmp_path):
    (tmp_path / "PMID_1.md").write_text(MD)
    (tmp_path / "PMID_1.txt").write_text(LEGACY.replace("PMID:2", "PMID:1"))
    (tmp_path / "PMID_2.txt").write_text(LEGACY)
    (tmp_path / "bad.md").write_text("---\n: [\n---\n")
    refs = cache.read_cache(spark, str(tmp_path))
    got = {r.reference_id: r for r in refs.collect()}
    assert set(got) == {"PMID:1", "PMID:2"}
    one = got["PMID:1"]
    assert (one.title, one.authors, one.year, one.keywords) == ("A: title", ["A One", "B Two"], "2020", ["single"])
    assert one.content == "CO₂ levels were measured here.\nMore text of the paper." and [f.filename for f in one.supplementary_files] == ["a.csv"]
    assert got["PMID:2"].authors == ["A", "B"] and got["PMID:2"].content == "Body text."
    out = tmp_path / "out"
    out.mkdir()
    cache.write_markdown(refs, str(out))
    again = {r.reference_id: r for r in cache.read_cache(spark, str(out)).collect()}
    assert again == got
    assert json.loads(cache.lookup(refs, ["PMID:1"], "json").first().value)["title"] == "A: title"
    for form in ("yaml", "text", "md"):
        assert "A: title" in cache.lookup(refs, ["PMID:1"], form).first().value
    assert cache.upsert(refs, refs.where("reference_id = 'PMID:1'")).count() == 2


def body(spark, source, data, rid="X:1"):
    return spark.createDataFrame([(rid, source, data if isinstance(data, str) else json.dumps(data))], "reference_id string, source string, body string")


def test_payloads(spark):
    crossref = body(spark, "crossref", {"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}, {"name": "Group"}], "container-title": ["J"], "published-online": {"date-parts": [[2021, 2]]}, "abstract": "<p>Abs &amp; more</p>", "subject": ["s", ""], "type": "posted-content", "DOI": "10.1/x"}})
    r = payloads.parse_crossref(crossref).first()
    assert (r.title, r.authors, r.journal, r.year, r.content, r.keywords, r.is_preprint, r.content_type) == ("T", ["A B", "C", "Group"], "J", "2021", "Abs & more", ["s"], True, "abstract_only")
    datacite = body(spark, "datacite", {"data": {"attributes": {"titles": [{"title": "D"}], "creators": [{"name": "Z, Y"}], "publisher": "P", "publicationYear": 2019, "descriptions": [{"descriptionType": "Other", "description": "no"}, {"descriptionType": "Abstract", "description": "yes"}], "subjects": [{"subject": "k"}]}}})
    d = payloads.parse_datacite(datacite).first()
    assert (d.title, d.authors, d.journal, d.year, d.content, d.keywords) == ("D", ["Z, Y"], "P", "2019", "yes", ["k"])
    assert payloads.parse_doi(crossref.unionByName(datacite)).first().title == "T"
    ppr = body(spark, "ppr", {"resultList": {"result": [{"source": "MED", "title": "no"}, {"source": "PPR", "title": "yes", "authorString": "A B, C D.", "pubYear": "2022", "abstractText": ""}]}})
    p = payloads.parse_ppr(ppr).first()
    assert (p.title, p.authors, p.content, p.content_type, p.is_preprint) == ("yes", ["A B", "C D"], None, "unavailable", True)
    geo = payloads.parse_summary(body(spark, "GEO", {"Title": " ", "description": "from here", "Summary": ["a", "b"]})).first()
    assert (geo.title, geo.content, geo.content_type) == ("from here", "a; b", "summary")
    trial = payloads.parse_trials(body(spark, "ct", {"protocolSection": {"identificationModule": {"briefTitle": "B"}, "descriptionModule": {"briefSummary": "S"}, "statusModule": {"overallStatus": "DONE"}}})).first()
    assert (trial.title, trial.content, trial.metadata) == ("B", "S", {"status": "DONE"})
    xml = """<PubmedArticle><MedlineCitation><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1998 Dec</MedlineDate></PubDate></JournalIssue></Journal>
    <Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="END">two</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><Initials>A</Initials></Author></AuthorList>
    <PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>D</DescriptorName><QualifierName>q1</QualifierName><QualifierName>q2</QualifierName></MeshHeading><MeshHeading><DescriptorName>E</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"""
    m = payloads.parse_pubmed(body(spark, "PMID", xml, "PMID:1")).first()
    assert (m.title, m.journal, m.year, m.content, m.authors, m.publication_types, m.keywords) == ("T", "J", "1998", "AIM: one\n\nEND: two", ["L A"], ["Review"], ["D/q1, q2", "E"])
    api = payloads.parse_json_api(body(spark, "my", {"t": "T", "x": {"c": "C", "l": ["p", "q"]}}), {"my": {"fields": {"title": "$.t", "content": "$.x.c"}, "extra_fields": {"more": "$.x.l"}}}).first()
    assert (api.title, api.content) == ("T", "C\n\n### more\n\np q")
    z = payloads.repository_files(body(spark, "zenodo", {"files": [{"key": "f", "size": 3, "links": {"self": "u"}}, {"size": 1}]})).first()
    assert [(f.filename, f.size_bytes, f.download_url) for f in z.supplementary_files] == [("f", 3, "u")]
    refs = payloads.parse_trials(body(spark, "ct", {"protocolSection": {}, "a": 1}))
    extra = payloads.with_extra_fields(refs, body(spark, "ct", {"a": ["v", "w"]}), {"ct": {"A": "$.a"}}).first()
    assert (extra.content, extra.content_type, extra.metadata["extra_fields_captured"]) == ("\n\n### A\n\nv w", "summary", "A")


def test_parse_all_sources(spark, tmp_path):
    every = body(spark, "crossref", {"message": {"title": ["T"]}}, "DOI:1").unionByName(body(spark, "datacite", {"data": {"attributes": {"titles": [{"title": "D"}]}}}, "DOI:1"))
    every = every.unionByName(body(spark, "GEO", {"title": "G", "summary": "S"}, "GEO:1")).unionByName(body(spark, "my", {"t": "M"}, "my:1"))
    got = {r.reference_id: (r.title, r.content) for r in payloads.parse(every, {"my": {"fields": {"title": "$.t"}}}, {"GEO": {"T": "$.title"}}).collect()}
    assert got == {"DOI:1": ("T", None), "GEO:1": ("G", "S\n\n### T\n\nG"), "my:1": ("M", None)}
    formats.write_files(spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "name string, content binary"), str(tmp_path))
    assert (tmp_path / "a.pdf").read_bytes() == b"%PDF"


def test_custom_sources(tmp_path):
    (tmp_path / "a.yaml").write_text("sources:\n- {prefix: X, fields: {title: $.t}}\n- {prefix: Y}\n")
    (tmp_path / "b.yaml").write_text("X: {fields: {title: $.u}}\n")
    assert custom.load_custom_sources([tmp_path], {"sources": {"Z": {"fields": {"title": "$.z"}}}}) == {"X": {"prefix": "X", "fields": {"title": "$.u"}}, "Z": {"prefix": "Z", "fields": {"title": "$.z"}}}
    assert custom.fill_template("h/{doi}", {"doi": "1"}) == "h/1" and custom.fill_template("h/{doi}", {"doi": None}) is None
    assert custom.fill_headers({"k": "a${CLAIMLENS_NOT_SET}b"}) == {"k": "ab"}


def test_formats(spark):
    rows = [(bytearray(b"%PDF-1.4"), None, None), (bytearray(b"  <!DOCTYPE html><p>"), "text/plain", None), (bytearray(b"<?xml?>"), None, "a.pdf"), (bytearray(b"x"), "application/pdf; q", None), (bytearray(b"x"), None, "http://a/b.XML?c"), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c binary, t string, u string")
    assert [r[0] for r in df.orderBy("k").select(formats.resolve_format(F.col("c"), F.col("t"), F.col("u"), F.lit("hint"))).collect()] == ["pdf", "html", "xml", "pdf", "xml", "hint"]
    assert formats.html_text("<p>out</p><article><p>a <b>b</b></p><script>x</script><p>c</p></article>") == "a b\n\nc"
    assert formats.html_text("<div>no paragraphs</div>") == "no paragraphs"
    assert formats.xml_text("<a><front><p>n</p></front><body><sec><p>x <i>y</i></p><p>z</p></sec></body></a>") == "x y\n\nz"
    assert formats.xml_text("<a><body><p>restricted</p></body></a>") is None
    with pytest.raises(ValueError):
        formats.pdf_text(b"", "odd")


def test_claims_of_lines(spark, tmp_path):
    f = tmp_path / "s.obo"
    f.write_text('first\r\ndef: "x" [a] {ex:supporting_text="quoted text[PMID:1]"}  \nno\n')
    got = extract.claims_from_lines(extract.text_lines(spark, str(f))).collect()
    assert [(r.line_number, r.supporting_text, r.reference_id) for r in got] == [(2, "quoted text", "PMID:1")]
    assert got[0].original_line.endswith("}")


NESTED = {"name": "n", "evidence": [{"reference": "PMID:1", "snippet": "s1"}], "members": [{"role": "r", "has_evidence": [{"supporting_text": "s2", "reference": {"id": "PMID:2", "title": "T"}}]}], "odd": 3}


def test_nested_claims(spark):
    docs = spark.createDataFrame([("a.json", json.dumps(NESTED)), ("b.yaml", "- {supporting_text: q, reference_id: 'P:1'}\n- {snippet: '', reference: x}\n"), ("c.yaml", "just text")], "file string, value string")
    got = sorted((r.file, r.path or "", r.supporting_text, r.reference_id, r.expected_title) for r in extract.nested_claims(docs).collect())
    assert got == [("a.json", "evidence[0]", "s1", "PMID:1", None), ("a.json", "members[0].has_evidence[0]", "s2", "PMID:2", "T"), ("b.yaml", "[0]", "q", "P:1", None), ("c.yaml", "", None, None, None)]
    by_class = {"Top": {"ranges": {"members": "Member"}}, "Member": {"ranges": {"has_evidence": "Evidence"}}, "Evidence": {"roles": {"excerpt": ["supporting_text"], "reference": ["reference"]}}}
    assert [(r.path, r.supporting_text) for r in extract.nested_claims(docs.where("file = 'a.json'"), "Top", by_class).collect()] == [("members[0].has_evidence[0].supporting_text", "s2")]


def test_json_in_the_jvm_equals_the_walk_in_python(spark):
    """Random trees of any depth: the same claims level by level as by recursion."""
    rng = random.Random(11)
    keys = ["evidence", "has_evidence", "supporting_text", "snippet", "reference", "reference_id", "title", "reference_title", "id", "x-y", "é"]

    def tree(depth):
        kind = rng.random()
        if depth == 6 or depth and kind < 0.5:
            return {k: tree(depth - 1) for k in rng.sample(keys, rng.randint(2, 9))}
        if depth and kind < 0.65:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["", "quote \"q\" é", "P:1", "t", 0, 3, 2.5, True, False, None, [], {}])

    deep = {"supporting_text": "far down", "reference": "P:2"}
    for _ in range(5):
        deep = {"a": [deep]}
    texts = [json.dumps(tree(6), ensure_ascii=rng.random() < 0.5) for _ in range(300)] + [json.dumps(deep), "[]", "3", "null", '"s"', '[{"supporting_text": "q", "reference": "P:3"}]', "{bad", "", '{"supporting_text": "a", "supporting_text": "b", "reference": "P:4"}']
    docs = spark.createDataFrame([(f"{k}.json", t) for k, t in enumerate(texts)] + [("n.json", None)], "file string, value string")
    want = []
    for k, t in [*enumerate(texts), ("n", "")]:
        data = extract.load_instances(t, "x.json")
        if data is None:
            want.append((f"{k}.json", None, None, None, None))
            continue
        for n, one in enumerate(data):
            want += [(f"{k}.json", *c[:3], c[3] if isinstance(c[3], str) else None) for c in extract.walk_names(one, f"[{n}]" if len(data) > 1 else "")]
    got = [tuple(r) for r in extract.nested_claims(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[2] is not None for w in want) > 40
    only = extract.nested_claims(docs.where("file = '300.json'"))
    assert [r.reference_id for r in only.collect()] == ["P:2"] and "Python" not in only._jdf.queryExecution().toString() and "MapInPandas" not in only._jdf.queryExecution().toString()


def test_cache_files_appear_whole_and_records_replace_each_other(spark, tmp_path):
    """No part of a file is left where a writer breaks off, and of two new records the later one counts."""
    refs = spark.createDataFrame([("P:1", "old", "1"), ("P:2", "kept", "1")], "reference_id string, content string, year string")
    new = spark.createDataFrame([("P:1", "newer", "3"), ("P:1", "new", "2"), ("P:3", "added", "1")], "reference_id string, content string, year string")
    got = {r.reference_id: r.content for r in cache.upsert(refs, new, "year").collect()}
    assert got == {"P:1": "newer", "P:2": "kept", "P:3": "added"} and cache.upsert(refs, new, "year").count() == 3
    full = refs.select("reference_id", "content", F.lit("summary").alias("content_type"), *[F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("journal", "string"))])
    cache.write_markdown(full, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["P_1.md", "P_2.md"]

    class Broken(dict):
        def __getitem__(self, key):
            if key == "value":
                return "text" + 3  # breaks off while a file is being written
            return dict.__getitem__(self, key)

    with pytest.raises(TypeError):
        cache.write_files_whole(iter([Broken(file="P_1.md")]), str(tmp_path))
    assert "old" in (tmp_path / "P_1.md").read_text() and len(list(tmp_path.iterdir())) == 2


def test_named_references_open_their_files_alone(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"P_{k}.md").write_text(f"---\nreference_id: P:{k}\n---\n## Content\n\ntext {k}\n")
    (tmp_path / "P_7.txt").write_text("ID: P:7\n\nolder\n")
    (tmp_path / "Q_1.txt").write_text("ID: Q:1\n\nlegacy\n")
    for k in range(20, 300):  # whoever opened these would fail
        (tmp_path / f"P_{k}.md").write_bytes(b"\xff\xfe\xff")
    wanted = spark.createDataFrame([("P:7",), ("Q:1",), ("P:7",), ("no:1",), ("",), (None,)], "reference_id string")
    opened = sorted((r.reference_id, r.content) for r in cache.read_named(wanted, f"file://{tmp_path}").collect())
    assert opened == [("P:7", "text 7"), ("Q:1", "legacy")]


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    refs = spark.range(400).select(F.concat(F.lit("P:"), "id").alias("reference_id"), F.lit("old").alias("content"), F.lit(1).alias("version"))
    store.write_store(refs.unionByName(refs.limit(1)), path, 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    new = spark.createDataFrame([("P:1", "new", 2), ("P:1", "newest", 3), ("Q:1", "added", 1)], "reference_id string, content string, version int")
    assert store.update_store(spark, path, new, 16, "version") == len({r[0] for r in new.select(store.bucket_of(F.col("reference_id"), 16)).collect()}) <= 2
    got = {r.reference_id: r.content for r in store.read_store(spark, path).collect()}
    assert len(got) == 401 == store.read_store(spark, path).count() and got["P:1"] == "newest" and got["Q:1"] == "added" and got["P:2"] == "old"
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    kept = {p for p, t in before.items() if after.get(p) == t}
    assert len({p.parent for p in before}) - len({p.parent for p in kept}) <= 2
    assert store.update_store(spark, path, new.limit(0), 16) == 0


def test_retries_keep_their_state_over_restarts(spark, tmp_path):
    """Two runs of one stream: what was found or gone through is done with, failures count on."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    schema = "reference_id string, usable boolean, error string"

    def batch(k, rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("reference_id", "usable", "error"), r, strict=True))) for r in rows))
        frame = stream.retries(spark.readStream.schema(schema).json(str(folder)), most=2)
        q = frame.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(seen)
        seen.clear()
        return got

    first = batch(1, [("A", False, "timeout"), ("A", True, None), ("B", False, "timeout"), ("C", False, None), ("D", False, "x"), (None, True, None)])
    assert first == [("A", 1, None, "found"), ("B", 1, "timeout", "retry"), ("C", 1, None, "none"), ("D", 1, "x", "retry")]
    second = batch(2, [("A", False, "again"), ("B", False, "down"), ("C", True, None), ("D", True, None), ("E", False, "y")])
    assert second == [("B", 2, "down", "given up"), ("D", 2, None, "found"), ("E", 1, "y", "retry")]


def test_missing_references_are_named_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    refs = spark.createDataFrame([("P:1",)], "reference_id string")
    for k, ids_ in enumerate([["P:1", "P:2", "p:2"], ["P:2", "P:3"]]):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"claim_id": n, "supporting_text": "x", "reference_id": i}) for n, i in enumerate(ids_)))
        frame = stream.missing_once(stream.read_claims(spark, str(folder)), refs)
        frame.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r.reference_id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [s for s in seen if s] == [["P:2"], ["P:3"]]


def test_schemas_with_imports_and_mixins(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("""
prefixes: {my: 'http://purl.org/dc/terms/', odd: {prefix_reference: 'http://odd/'}}
imports: [main]
slots:
  quote: {implements: ['oa:exact']}
  cited: {slot_uri: my:references}
classes:
  Quoted: {slots: [quote]}
  Evidence: {mixins: [Quoted], slots: [cited, note], slot_usage: {note: {implements: dcterms:title}}}
""")
    (tmp_path / "main.yaml").write_text("""
imports: [base, missing, odd:types]
slots:
  note: {range: string}
classes:
  Strong: {is_a: Evidence, attributes: {title: {}}, slot_usage: {quote: {range: string}}}
  Top: {attributes: {evidence: {range: Strong, multivalued: true}}}
""")
    got = schema.resolved(spark, tmp_path / "main.yaml")
    assert got["Top"] == {"roles": {}, "ranges": {"evidence": "Strong"}}
    assert got["Strong"]["roles"] == {"excerpt": ["quote"], "reference": ["cited"], "title": ["note", "title"]}
    docs = spark.createDataFrame([("a.yaml", "evidence:\n- {quote: q, cited: 'P:1', note: T}\n")], "file string, value string")
    claim = extract.nested_claims(docs, "Top", got).first()
    assert (claim.path, claim.supporting_text, claim.reference_id, claim.expected_title) == ("evidence[0].quote", "q", "P:1", "T")


TYPED = {"Top": {"ranges": {"e": "E"}}, "E": {"roles": {"excerpt": ["quote", "snippet"], "reference": ["cited", "reference"], "title": ["title", "name"]}}}


def test_title_claims_by_schema(spark):
    rows = [
        {"quote": "q", "cited": {"id": "P:1", "title": "B"}, "title": "A"},  # the slot's title before the reference's
        {"quote": "q", "snippet": ["r", ""], "cited": {"id": "P:2", "title": "B"}},
        {"title": "T", "cited": "P:3"},  # a title alone
        {"title": "", "name": "N", "reference": {"reference_id": "P:4"}},
        {"title": "T", "cited": {"note": "no id"}, "reference": "P:5"},  # the first reference has no id
        {"quote": "q", "title": "T", "cited": {"note": "no id"}, "reference": "P:6"},
        {"quote": "q", "title": "T"},
        {"quote": None, "title": 3, "cited": "P:7"},
    ]
    docs = spark.createDataFrame([("a.json", json.dumps({"e": rows})), ("bad.json", "{")], "file string, value string")
    got = [(r.path, r.supporting_text, r.reference_id, r.expected_title, r.kind) for r in extract.nested_claims(docs, "Top", TYPED).collect()]
    assert got == [
        ("e[0].quote", "q", "P:1", "A", "excerpt"), ("e[1].quote", "q", "P:2", "B", "excerpt"), ("e[1].snippet", "r", "P:2", "B", "excerpt"),
        ("e[2].title", None, "P:3", "T", "title"), ("e[3].name", None, "P:4", "N", "title"), ("e[5].quote", "q", "P:6", "T", "excerpt"), (None, None, None, None, None),
    ]


def test_validate_data_by_schema_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.yaml").write_text("""
classes:
  Top: {tree_root: true, attributes: {e: {range: E, multivalued: true}}}
  E: {attributes: {supporting_text: {}, title: {}, reference: {}}}
""")
    (tmp_path / "d.yaml").write_text("e:\n- {title: Wrong, reference: 'PMID:1'}\n- {title: A title, reference: 'PMID:1'}\n- {supporting_text: some text, reference: 'PMID:1'}\n- {supporting_text: some text, reference: 'PMID:1'}\n- {supporting_text: nowhere, reference: 'PMID:1'}\n")
    refs = str(tmp_path / "refs.parquet")
    spark.createDataFrame([("PMID:1", "A Title.", "some text", "summary")], "reference_id string, title string, content string, content_type string").write.parquet(refs)
    asked = ["--refs", refs, "validate-data", str(tmp_path / "d.yaml")]
    for more in (["--schema", str(tmp_path / "s.yaml")], ["--schema", str(tmp_path / "s.yaml"), "--target-class", "Top"]):
        assert main([*asked, *more], spark) == 1
        said = sorted(capsys.readouterr().out.splitlines())
        assert said == ["[ERROR] e[0].title: Title mismatch for PMID:1: expected 'Wrong' but got 'A Title.'", "[ERROR] e[4].supporting_text: Text part not found as substring: 'nowhere'"]
    for wrong in (["--target-class", "Top"], ["--schema", str(tmp_path / "s.yaml"), "--target-class", "No"]):
        with pytest.raises(SystemExit):
            main([*asked, *wrong], spark)


def test_what_is_an_error_in_acquisition(spark):
    """Only what may go better another time is retried."""
    schema = "reference_id string, provider string, text string, url string, format string, license string, oa_status string, error boolean"
    names = ["ok", "large", "status", "odd", "lost", "no_url", "given", "failed"]
    rows = [(n, "unpaywall", "t" if n == "given" else None, None if n == "no_url" else f"http://f/{n}", None, None, None, n == "failed") for n in names]
    page = b"<html><body><p>some words</p></body></html>"
    files = [("ok", page, 200), ("large", page + b" " * 500, 200), ("status", page, 404), ("odd", b"\x01\x02", None), ("failed", page, 200)]
    landed = spark.createDataFrame([(f"http://f/{n}", bytearray(b), "text/html" if n != "odd" else None, s) for n, b, s in files], "url string, content binary, content_type string, status int")
    got = {r.reference_id: (r.text, r.error) for r in fulltext.acquire(spark.createDataFrame(rows, schema), landed, max_bytes=200).collect()}
    assert {n for n, (_, e) in got.items() if e} == {"lost"}
    assert got["ok"][0] == "some words" and got["given"][0] == "t" and got["large"][0] is None and got["status"][0] is None


def test_full_text_chain(spark):
    rows = [("A", "pmc", "x" * 400 + " " * 300, False), ("A", "unpaywall", "u" * 600, False), ("A", "openalex", "o" * 900, False), ("B", "pmc", None, True), ("C", "pmc", "short", False)]
    cands = spark.createDataFrame([(r, p, t, "u", "xml", None, None, e) for r, p, t, e in rows], "reference_id string, provider string, text string, url string, format string, license string, oa_status string, error boolean")
    refs = spark.createDataFrame([(i, "abs", "abstract_only" if i != "D" else "full_text_xml") for i in "ABCDE"], "reference_id string, content string, content_type string")
    for c in ("full_text_provider", "full_text_url", "oa_status", "license"):
        refs = refs.withColumn(c, F.lit(None).cast("string"))
    out = fulltext.enrich(refs.withColumn("full_text_attempted", F.lit(False)), cands)
    got = {r.reference_id: (r.full_text_provider, r.content_type, r.full_text_attempted) for r in out.collect()}
    assert got == {"A": ("unpaywall", "full_text_xml", True), "B": (None, "abstract_only", False), "C": (None, "abstract_only", True), "D": (None, "full_text_xml", False), "E": (None, "abstract_only", True)}
    assert out.where("reference_id = 'A'").first().content == "abs\n\n" + "u" * 600
    assert [r[0] for r in fulltext.full_text_worklist(out).select("reference_id").collect()] == ["B"]
    files = spark.createDataFrame([("u", bytearray(b"<html><p>hello</p>"), None)], "url string, content binary, content_type string")
    landed = fulltext.acquire(cands.where("reference_id = 'B'"), files).first()
    assert (landed.text, landed.format, landed.error) == ("hello", "html", False)
    answer = body(spark, "", {"best_oa_location": {"url_for_pdf": None, "url": "http://x/p.pdf", "license": "cc"}, "oa_status": "gold"}).select("reference_id", F.lit("unpaywall").alias("provider"), "body")
    named = fulltext.provider_candidates(answer).first()
    assert (named.url, named.format, named.license, named.oa_status) == ("http://x/p.pdf", "pdf", "cc", "gold")


def test_pubmed_by_element():
    xml = """<PubmedArticle><MedlineCitation><Article><ArticleTitle>On <i>E. coli</i></ArticleTitle><Abstract><AbstractText Label="A">We use <i>E. coli</i> here.</AbstractText><AbstractText/></Abstract>
    <AuthorList><Author><LastName>Ada</LastName></Author><Author><LastName>Bo</LastName><Initials>BB</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"""
    r = payloads.pubmed_record(xml)
    assert (r["title"], r["content"], r["authors"], r["year"]) == ("On E. coli", "A: We use E. coli here.", ["Ada", "Bo BB", "G"], None)
    assert payloads.pubmed_record("<broken") is None and payloads.pubmed_record(None) is None


def test_pages_in_any_charset(spark):
    rows = [("a", bytearray("<html><title>é</title>".encode("latin-1")), "text/html; charset=latin-1"), ("b", bytearray(b"\xff x"), None), ("c", None, None), ("d", bytearray(b"y"), "text/plain; charset=nope")]
    got = {r.reference_id: (r.title, r.content) for r in payloads.from_urls(spark.createDataFrame(rows, "url string, content binary, content_type string")).collect()}
    assert got == {"url:a": ("é", "<html><title>é</title>"), "url:b": ("b", "\ufffd x"), "url:c": ("c", None), "url:d": ("d", "y")}


def test_pmc_pages():
    assert formats.pmc_html_text("<div class='tsec'><p>a</p></div><div class='z article-body'><div><p>b<p>c</div></div><p>d</p>") == "b\n\nc"
    assert formats.pmc_html_text("<div class='tsec'><p>a</p></div>") == "a" and formats.pmc_html_text("<p>a</p>") is None and formats.pmc_html_text(None) is None


def test_staging_needs_a_shared_folder(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError):
        stage.shared_dir(Session())


def test_containment(spark):
    docs = spark.createDataFrame([(1, "Alpha beta, gamma delta epsilon zeta eta theta."), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "ta gamma delta epsilon zeta et"), (2, "nothing OF"), (3, "beta gamma epsilon delta zeta eta"), (4, ""), (5, "pha beta gamma delta epsilon zeta eta the")], "quote_id long, text string")
    assert sorted(tuple(r) for r in passage_containment(quotes, docs).collect()) == [(1, 1), (2, 2), (5, 1)]


def test_data_files_end_to_end(spark, tmp_path, capsys):
    store = tmp_path / "refs"
    store.mkdir()
    (store / "PMID_1.md").write_text(MD)
    data = tmp_path / "d.yaml"
    data.write_text("evidence:\n- {reference: 'PMID:1', supporting_text: CO2 levels were measured}\n- {reference: 'PMID:1', supporting_text: More text of the paper}\n")
    made = lifecycle.validate_data(spark, str(data), cache.read_cache(spark, str(store)))
    assert made["report"].first().invalid_count == 1 and made["findings"].first().path == "evidence[0]" and made["files"].first().results == 1
    args = ["--refs", str(store)]
    assert main([*args, "validate-data", str(data)], spark) == 1
    assert main([*args, "repair-data", str(data), "--apply"], spark) == 0
    assert "CO₂ levels were measured" in data.read_text() and (tmp_path / "d.yaml.bak").exists()
    assert main([*args, "validate-data", str(data)], spark) == 0
    assert main([*args, "validate-text", "More text of the paper", "pmid:1"], spark) == 0
    assert main([*args, "validate-text", "unseen", "pmid:1"], spark) == 1
    assert main([*args, "repair-text", "CO2 levels were measured", "PMID:1"], spark) == 0
    assert main([*args, "lookup", "PMID:1", "--format", "text"], spark) == 0 and main([*args, "lookup", "PMID:9"], spark) == 1
    lines = tmp_path / "l.obo"
    lines.write_text('ex:supporting_text="More text[PMID:1]"\n')
    assert main([*args, "validate-text-file", str(lines)], spark) == 0
    assert main([*args, "cache", "pmid 1"], spark) == 0 and "PMID_1.md" in capsys.readouterr().out
    assert RepairConfig().dry_run


def test_stream_of_claims(spark, tmp_path):
    cache.parse_references(spark.createDataFrame([(MD,)], "value string")).write.parquet(str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    rows = [{"claim_id": 1, "supporting_text": "more text", "reference_id": "PMID:1"}, {"claim_id": 2, "supporting_text": "x", "reference_id": "PMID:77"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    paths = [str(tmp_path / p) for p in ("store", "results", "work", "check")]
    stream.start(stream.read_claims(spark, str(tmp_path / "in")), *paths).awaitTermination()
    assert {r.claim_id: r.is_valid for r in spark.read.parquet(paths[1]).collect()} == {1: True, 2: False}
    assert [(r.reference_id, r.source) for r in spark.read.parquet(paths[2]).collect()] == [("PMID:77", "PMID")]
    claims = stream.read_claims(spark, str(tmp_path / "in"))
    q = stream.validated(claims, spark.read.parquet(paths[0])).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
