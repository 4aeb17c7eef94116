"""One registered query per operator, with production parameters over whole tables, and their SQL."""

from pyspark.sql import functions as F

from tidemark.llm import centroids, decontaminate, jaccard, lines, merkle, mixing, packing, pii, quality, repeats, secrets, toxicity, warc
from tidemark.llm.text import read, span_digest
from tidemark.session import prepare, shared_path


def op1_toxicity(spark, sf_dir):
    prepare(spark)
    got = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    spans = F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return got.withColumn("offending", F.array_join(spans, ","))


def op2_quality_rules(spark, sf_dir):
    prepare(spark)
    got = quality.judge(read(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return got.select("doc_id", *base, "base_failed", "kept", F.round("probability", 6).alias("probability"))


def op3_decontamination(spark, sf_dir):
    prepare(spark)
    got = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_repeated_bytes(spark, sf_dir):
    prepare(spark)
    return repeats.report(read(spark, sf_dir, "documents"))


def op5_shingle_join(spark, sf_dir):
    prepare(spark)
    return jaccard.join(read(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_fuzzy_lines(spark, sf_dir):
    prepare(spark)
    return lines.report(read(spark, sf_dir, "documents"))


def _of_kind(kind_no):
    return lambda s: s["kind_no"] == kind_no


def op7_secret_scan(spark, sf_dir):
    """The store is scanned twice through one ledger: as it was when half of its documents were there, and as it is. The second time only unseen contents are."""
    prepare(spark)
    docs, ledger = read(spark, sf_dir, "documents"), shared_path(spark, "secrets-ledger")
    secrets.update(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    paths, _entries = secrets.update(docs, ledger)
    base = F.filter("found", lambda s: s["kind_no"] < secrets.BASE)
    counts = [F.size(F.filter("found", _of_kind(k))).cast("bigint").alias(f"n_{rule[0]}") for k, rule in enumerate(secrets.RULES[: secrets.BASE])]
    return paths.select("doc_id", *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("found")).alias("spans"))


def op8_source_mix(spark, sf_dir):
    prepare(spark)
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    prepare(spark)
    got = pii.redactions(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[: pii.BASE])]
    return got.select("doc_id", *counts, F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(F.col("found")).alias("spans"))


def op10_packed_rows(spark, sf_dir):
    prepare(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark, sf_dir):
    prepare(spark)
    return centroids.report(read(spark, sf_dir, "embeddings"))


def op12_warc_pages(spark, sf_dir):
    prepare(spark)
    return warc.report(read(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark, sf_dir):
    prepare(spark)
    return merkle.report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_repeated_bytes": op4_repeated_bytes,
    "op5_shingle_join": op5_shingle_join,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mix": op8_source_mix,
    "op9_pii": op9_pii,
    "op10_packed_rows": op10_packed_rows,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_warc_pages": op12_warc_pages,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op3_decontamination": decontaminate.ORACLE,
    "op7_secret_scan": secrets.ORACLE,
    "op8_source_mix": mixing.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op12_warc_pages": warc.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
