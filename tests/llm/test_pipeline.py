"""The pipeline on the smallest given data: every stage's decisions hold in what comes after."""

import numpy as np
from helpers import AWKWARD, table
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard, packing, toxicity
from tidemark.llm.text import read

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = read(spark, DATA, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            firsts = jaccard.join(before, words=5, percent=80).where("row_id = first_row")
            assert sorted(r.doc_id for r in firsts.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(read(spark, DATA, "documents"), read(spark, DATA, "labels")).collect()}
    assert sorted(r.doc_id for r in kept["toxicity"].collect()) == sorted(i for i, p in scored.items() if not p)
    assert decontaminate.find(kept["decontamination"], read(spark, DATA, "benchmark")).where("n_hit > 0").count() == 0
    mixed = kept["mixing"].collect()
    words = sum(len(r.text.encode().split()) for r in kept["decontamination"].collect())
    assert abs(sum(len(r.text.encode().split()) for r in mixed) - 1.5 * words) <= 20
    encode = packing.Encoder(packing.VOCABULARY)
    texts = sorted(encode.decode(np.frombuffer(r.ids, "<u2")) for r in packing.unpack(kept["packing"]).collect())
    assert texts == sorted(r.text for r in mixed if r.text)


def folder_of(spark, path, rows):
    """documents, labels and benchmark with the awkward rows, as the stages read them."""
    docs = table(spark, rows, path / "documents.parquet")
    clash = {c: F.lit("clash") for c in ("y", "row_id", "words", "gram")}
    spark.createDataFrame([(k, 1, int(k == 5)) for k in range(9)] + [(None, 0, 1)], "doc_id bigint, quality int, toxic int").withColumns(clash).write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, "one word more or less here"), (2, None), (None, "")], "item_id bigint, text string").withColumns(clash).write.parquet(str(path / "benchmark.parquet"))
    return docs


def stages(spark, path, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(path)).write.parquet(str(path / name))
        docs = spark.read.parquet(str(path / name))
        seen.append(docs)
    return seen


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    rows = [*AWKWARD, (30, "É ç ñ ß " * 40, None), (31, "plain words of one more text " * 9, "t")]
    docs = folder_of(spark, tmp_path, rows)
    *texts, packed = stages(spark, tmp_path, docs)
    assert all(t.columns == docs.columns for t in texts)
    left = [r.text for r in texts[2].collect()]
    assert "one word more or less here" not in left and len(left) == len(rows) - 3
    encode = packing.Encoder(packing.VOCABULARY)
    got = sorted(encode.decode(np.frombuffer(r.ids, "<u2")) for r in packing.unpack(packed).collect())
    assert got == sorted(r.text for r in texts[3].collect() if r.text)


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    docs = folder_of(spark, tmp_path, [])
    assert [t.count() for t in stages(spark, tmp_path, docs)] == [0] * 5
