"""Each stage on its own input, against what the operators' brute-force versions say."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from claimlens.llm import decontaminate as decon
from claimlens.llm import pii_bootstrap as pii
from claimlens.llm.mix_sources import mix_sources
from claimlens.llm.quality_classifier import fit, score

DATA = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[: len(docs.columns)] == docs.columns
        kept[name] = [r for r in out.collect()]
    bad = {r.doc_id for r in score(docs, fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept["quality"]} == set(rows) - bad and bad
    sets = {i: grams(r.text) for i, r in rows.items()}
    root = {i: i for i in rows}
    for a in sorted(rows):
        for b in rows:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert {r.doc_id for r in kept["dedup"]} == {i for i in rows if root[i] == i} != set(rows)
    items = [decon.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {i for i, r in rows.items() if any(x in decon.normal(r.text) for x in items)}
    assert {r.doc_id for r in kept["decontaminate"]} == set(rows) - leaks and leaks
    for r in kept["pii"]:
        assert not pii.base_spans(r.text)
        if not pii.base_spans(rows[r.doc_id].text):
            assert r.text == rows[r.doc_id].text or "[other]" in r.text or "[secret]" in r.text
    assert len(kept["pii"]) == len(rows)
    assert all((r.text, r.source) == (rows[r.doc_id].text, rows[r.doc_id].source) for r in kept["mix"])
    assert max(r.copy for r in kept["mix"]) <= 3


def test_stages_judge_rows_not_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = score(docs, fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).join(docs, "doc_id").orderBy("doc_id").collect()
    bad, good = (next(r.text for r in judged if r.predicted == p and len(r.text) > 300) for p in (0, 1))
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    far, clean = 10**9, "one two three four five six seven eight nine ten"

    def left(stage, *added):
        rows = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in added], docs.schema)
        return sorted((str(r.doc_id), r.text) for r in stage(spark, docs.unionByName(rows), DATA).where(f"doc_id is null or doc_id >= {far}").collect())

    assert left(pipeline.quality, (None, bad, "a"), (far, bad, "a"), (far, good, "a")) == [(str(far), good)]
    assert left(pipeline.decontaminate, (None, leak, "a"), (far, leak, "a"), (far, clean, "a")) == [(str(far), clean)]
    assert left(pipeline.dedup, (far, clean, "a"), (far + 1, clean, "a"), (far + 1, clean[::-1], "a")) == [(str(far), clean), (str(far + 1), clean[::-1])]
    masked = left(pipeline.pii, (None, "mail a@b.co", "a"), (far, "to c@d.org now", "a"), (far, clean, "a"))
    assert masked == sorted([("None", "mail [email]"), (str(far), "to [email] now"), (str(far), clean)])


def test_dedup_keeps_one_of_repeated_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(3)
    got = pipeline.dedup(spark, docs.unionByName(docs).unionByName(docs), DATA)
    assert sorted(got.collect()) == sorted(pipeline.dedup(spark, docs, DATA).collect())


def test_stages_keep_clashing_columns(spark):
    """One after another, written between, over tables whose columns differ in case only, or are
    called as what stages add."""
    clashing = ("Text", "copy", "copy_", "_row", "size", "doc_ID", "_0", "SOURCE")
    read = {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    docs = read["documents"].select("*", *[F.concat(F.lit("x"), "doc_id").alias(n) for n in clashing])
    labels, bench = (read[n].select("*", F.lit("x").alias("Text"), F.lit("x").alias("DOC_ID")) for n in ("labels", "benchmark"))
    docs = pipeline.cut_rows(pipeline.accepted(docs, pipeline.fit(docs, labels)))
    docs = pipeline.cut_rows(pipeline.dedup(spark, docs, DATA))
    docs = pipeline.cut_rows(pipeline.decontaminated(docs, bench))
    docs = pipeline.cut_rows(pipeline.pii(spark, docs, DATA))
    docs = pipeline.cut_rows(pipeline.mix(spark, docs, DATA))
    assert docs.columns == [*read["documents"].columns, *clashing, "copy__"]
    rows = docs.collect()
    assert rows and all(r[docs.columns.index("Text")] == f"x{r[0]}" for r in rows)


def test_decontaminate_in_several_passes(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    one, many = (sorted(r.doc_id for r in pipeline.decontaminated(docs, bench, block_chars=n).collect()) for n in (10**7, 1500))
    hit = {r.doc_id for r in decon.benchmark_hits(docs, bench).collect()}
    assert one == many == sorted(r.doc_id for r in docs.collect() if r.doc_id not in hit)


def test_mix_takes_each_row_by_itself(spark):
    rows = [(None if k % 2 else 5, f"w{k // 3} " * 9, "en", "ab"[k % 5 == 0], 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    want = mix_sources(docs).groupBy("source_size").sum("copies").collect()
    got = pipeline.mix(spark, docs, DATA)
    assert sorted(r[1] for r in want) == sorted(r[1] for r in got.groupBy("source").count().collect())


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, "x", None, 1), (1, "", "x", None, 1), (1, "", "x", None, 1), (2, "write to a@b.co", "y", "s", 1)], "doc_id long, text string, copies string, source string, `Text` int")
    docs = odd
    for name, stage in pipeline.STAGES:
        for empty in (False, True):
            out = stage(spark, docs.limit(0) if empty else docs, DATA)
            assert out.columns[:5] == odd.columns and (out.count() == 0 or not empty), name
        if name != "mix":
            rows = [tuple(r) for r in stage(spark, docs, DATA).collect()]
            assert (None, None, "x", None, 1) in rows


def test_run_applies_the_stages_in_turn(spark):
    """run() over a whole table: what the stages give one after another, each on all its predecessor kept."""
    got = pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in pipeline.STAGES:
        made = stage(spark, docs, DATA)
        docs = spark.createDataFrame(made.collect(), made.schema)
        kept.append(docs.count())
    assert got.columns == docs.columns == [*columns, "copy"]
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > 0
