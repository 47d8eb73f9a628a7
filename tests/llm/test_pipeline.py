"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
import pytest
from test_operators import docs, empty, messy, plain_components, plain_contamination, plain_fingerprint  # noqa: F401 (fixtures)

from histlake.llm import pii, toxicity
from histlake.llm.common import held_out


@pytest.fixture(scope="module")
def ran(spark, sf):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, docs, sf).persist()
        found[name] = given, docs
    return found


def test_columns(ran, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, (_, out) in list(ran.items())[:-1]:
        assert out.columns == columns, name


def test_toxicity_stage(ran, spark, sf):
    given, out = ran["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    grammar = toxicity.train(given.filter(~held_out(given.doc_id)), labels.filter(~held_out(labels.doc_id)))
    machine = toxicity.Machine(grammar)
    want = {r.doc_id for r in given.collect() if machine.score(machine.features(r.text)) < toxicity.THRESHOLD}
    assert {r.doc_id for r in out.collect()} == want


def test_near_dedup_stage(ran):
    given, out = ran["simhash_near_dedup"]
    rows = given.collect()
    label = plain_components([plain_fingerprint(r.text) for r in rows])
    least = {}
    for r, k in zip(rows, label):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())


def test_decontamination_stage(ran, spark, sf):
    given, out = ran["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k[0] for k in plain_contamination(given.collect(), items) if not k[5]}
    assert {r.doc_id for r in out.collect()} == clean
    assert out.count() < given.count()


def test_pii_stage(ran):
    given, out = ran["pii"]
    before = {r.doc_id: r.text for r in given.collect()}
    after = {r.doc_id: r.text for r in out.collect()}
    assert before.keys() == after.keys()
    assert not any(pii.find(t) for t in after.values())
    assert all(after[k] == t for k, t in before.items() if not pii.find(t))


def test_run_equals_the_stages(ran, spark, sf):
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(ran["packing"][1].collect())


def test_run_over_messy_and_empty_tables(spark, sf, messy, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with the stages' own names and a map go through all stages."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, 0), (99, None)], "doc_id long, toxic int")
    passage = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(901, passage), (902, None), (None, "gamma zeta")], "item_id long, text string")
    for name, docs in (("messy", messy.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))), ("empty", empty)):
        folder = f"file://{tmp_path}/{name}"
        for label, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            table.write.parquet(f"{folder}/{label}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            now = function(spark, now, folder)
            assert now.columns == docs.columns, stage
        left = sorted((r.doc_id or -1, r.text or "") for r in now.collect())
        rows = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert left == [] == rows
            continue
        # One row of each group of like fingerprints stays; of those, the ones with the benchmark's passage go.
        given = [(r.doc_id, r.text) for r in docs.collect()]
        label = plain_components([plain_fingerprint(t) for _, t in given])
        kept = {}
        for (d, t), k in zip(given, label):
            kept[k] = min(kept.get(k, (True, 0, "")), (d is None, d or -1, t or ""))
        assert left == sorted((d, t) for _, d, t in kept.values() if passage not in t)
        assert sum(r.start == 0 for r in rows) == len(left)
        assert sorted({(r.doc_id or -1) for r in rows}) == sorted({d for d, _ in left})


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries()) == 10
