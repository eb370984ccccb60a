import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docstat.llm import exact_dedup, pii, quality


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_their_contract(spark, corpus, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "PII", "packing"]
    extra = corpus.withColumns({"digest": F.lit(1), "spans": F.lit("x")})
    empty_row = spark.createDataFrame([(None, None, None, None, None)], corpus.schema)
    docs, kept = extra.unionByName(empty_row, allowMissingColumns=True), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
            assert step(spark, docs.limit(0), sf).count() == 0
        out.write.parquet(path := str(tmp_path / str(i)))
        kept.append(out := spark.read.parquet(path))
        docs = out
    graded, exact, near, masked, packed = kept
    texts = [r.text for r in exact.collect()]
    assert len({"".join((t or "").split()) for t in texts}) == len(texts) and exact.count() == graded.select(exact_dedup.digest(F.col("text"))).distinct().count()
    assert near.count() <= exact.count() and masked.count() == near.count()
    found = pii.digest_columns(pii.find(masked))
    assert found.agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert packed.select("doc_id").distinct().count() == masked.select("doc_id").distinct().count()


def test_clean_documents_stay_and_junk_goes(spark, corpus, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in quality.accept(docs, labels).select("doc_id").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    clean = [i for i, q in marks.items() if q == 1]
    junk = [i for i, q in marks.items() if q == 0]
    assert sum(i in kept for i in clean) > 0.97 * len(clean) and sum(i in kept for i in junk) < 0.2 * len(junk)


def test_masking_equals_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, "é " * rng.randint(0, 3) + rng.choice(["a@b.cd and 10.0.0.1", "call +1 (555) 555-1234 now", "4111 1111 1111 1111", "none"]) + " 😀") for i in range(40)]
    want = {"a@b.cd and 10.0.0.1": "<EMAIL> and <IP>", "call +1 (555) 555-1234 now": "call <PHONE> now", "4111 1111 1111 1111": "<CARD>", "none": "none"}
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        for a, b in want.items():
            t = t.replace(a, b)
        assert got[i] == t


def test_entry_lists_everything():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] if n.startswith("op") else n for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names


def test_a_run_deletes_what_it_wrote(spark, sf):
    from pathlib import Path

    from docstat.llm import common

    common.scratch(spark, "x")
    root = Path(common.shared_dir(spark)) / f"docstat-{spark.sparkContext.applicationId}"
    names = lambda: {p.name for p in root.glob("*")} if root.exists() else set()
    before = names()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {n.rsplit("-", 1)[0] for n in names() - before} == {"PII", "pieces", "open-pieces"}
