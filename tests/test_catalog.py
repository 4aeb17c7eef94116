import pytest
from models import rows
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.operators import catalog, estate

INV = "prefix_id bigint, bucket string, key string, size bigint, n bigint"


def backup(seg, off="00000028", root="db/"):
    return f"{root}basebackups_005/base_{seg}_{off}"


S1, S2, S3 = ("0000000100000000000000%02X" % n for n in (1, 2, 3))


@pytest.fixture(scope="module")
def classified(spark):
    data = [
        (1, "b", backup(S1) + "_backup_stop_sentinel.json", 10, 300),
        (1, "b", backup(S1) + "/tar_partitions/part_00000000.tar.lzo", 70, 290),
        (1, "b", backup(S1) + "/tar_partitions/notes.txt", 1, 290),
        (1, "b", backup(S2) + "_backup_stop_sentinel.json", 10, 300),
        (1, "b", backup(S2) + "/extended_version.txt", 5, 100),
        (1, "b", backup(S3) + "/extended_version.txt", 5, 100),
        (1, "b", backup(S3) + "/tar_partitions/part_00000000.tar.lzo", 50, 100),
    ]
    df = spark.createDataFrame(data, INV).withColumn("path_prefix", F.lit("db/")).withColumn("last_modified", F.timestamp_seconds("n"))
    return classify.classify_keys(df)


def test_complete_and_latest(classified):
    b = catalog.complete_backups(classified)
    assert sorted(r.wal_segment_backup_start for r in b.collect()) == [S1, S2]
    # Equal times: the last in key order is the latest.
    assert catalog.latest_backup(b).first().name == f"base_{S2}_00000028"


def test_no_backups_no_latest(classified):
    assert catalog.latest_backup(catalog.complete_backups(classified.where("false"))).count() == 0


def test_queries(spark, classified):
    b = catalog.complete_backups(classified)
    req = spark.createDataFrame(
        [(1, 1, f"base_{S1}_00000028"), (2, 1, "LATEST"), (3, 1, f"base_{S3}_00000028"), (4, 2, "LATEST")],
        "request_id bigint, prefix_id bigint, query string",
    )
    found = catalog.find_backups(b, req)
    assert {r.request_id: r.name for r in found.collect()} == {1: f"base_{S1}_00000028", 2: f"base_{S2}_00000028", 3: None, 4: None}
    assert {r.request_id: r.fetchable for r in catalog.match_counts(found).collect()} == {1: True, 2: True, 3: False, 4: False}
    with pytest.raises(Exception, match="invalid backup query"):
        catalog.find_backups(b, req.withColumn("query", F.lit("newest"))).collect()


def test_incomplete(classified):
    assert rows(catalog.incomplete_backups(classified)) == [(1, f"base_{S3}_00000028", 2, 55)]


def test_volumes(classified):
    got = {r.volume: r.expected for r in catalog.volumes_of(classified).where(F.col("backup_name").contains(S1)).collect()}
    assert got == {"part_00000000.tar.lzo": True, "notes.txt": False}


def test_detail_is_outer_and_optional(spark, classified):
    b = catalog.complete_backups(classified)
    body = '{"wal_segment_backup_stop": "%s", "wal_segment_offset_backup_stop": "00000100", "expanded_size_bytes": 700, ' \
           '"spec": {"base_prefix": "/pg", "tablespaces": ["17"], "17": {"loc": "/ts/", "link": "pg_tblspc/17"}}, "more": 1}' % S2
    s = spark.createDataFrame([(1, f"base_{S1}_00000028", body), (1, f"base_{S2}_00000028", "not json")], "prefix_id bigint, name string, body string")
    detail = catalog.parse_detail(s)
    listed = {r.name: r for r in catalog.backup_list(b, detail).collect()}
    assert listed[f"base_{S1}_00000028"].expanded_size_bytes == 700
    assert listed[f"base_{S2}_00000028"].expanded_size_bytes is None
    assert "Join" not in catalog.backup_list(b)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(catalog.tablespaces(s)) == [(1, f"base_{S1}_00000028", "17", "/ts/", "pg_tblspc/17")]
    assert detail.select(F.variant_get("extra", "$.more", "int").alias("m")).where("m is not null").first().m == 1
    ratio = catalog.compression(classified, detail).where("expanded_size_bytes is not null").first()
    assert (ratio.stored_bytes, ratio.volumes, round(ratio.ratio, 4)) == (71, 2, round(71 / 700, 4))


def test_footprint(classified):
    got = {(r.prefix_id, r.thing, r.level): (r.objects, r.bytes) for r in estate.footprint(classified).collect()}
    assert got[(None, None, 3)] == (7, 151) and got[(1, None, 1)] == (7, 151) and got[(1, "sentinel", 0)] == (2, 20)


def test_common_prefix(spark):
    data = [("a", "x/abc"), ("a", "x/abd"), ("b", "one"), ("c", "pq"), ("c", "pq/r"), ("d", "m"), ("d", "n"), ("e", ""), ("e", "z")]
    df = spark.createDataFrame(data, "g string, t string")
    got = {r.g: (r.common_prefix, r.common_dir) for r in estate.common_prefix(df, "g", "t").collect()}
    assert got == {"a": ("x/ab", "x"), "b": ("one", ""), "c": ("pq", ""), "d": ("", ""), "e": ("", "")}


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "prefix_id bigint, key string, size bigint")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 4), (1, "d", 5)], "prefix_id bigint, key string, size bigint")
    assert rows(estate.snapshot_changes(old, new)) == [(1, "a", "removed"), (1, "b", "kept"), (1, "c", "changed"), (1, "d", "added")]
    assert rows(estate.common_keys(old, new)) == [(1, "b", 2)]


def test_shared_prefixes(spark):
    df = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 3)], "path_prefix string, db bigint")
    assert rows(estate.shared_prefixes(df)) == [("p", 2, 3)]


def test_layout_join(spark):
    inv = spark.createDataFrame([(1, "/k"), (2, "k")], "prefix_id bigint, key string")
    pre = spark.createDataFrame([(1, "s3://st/a"), (2, "gs://other")], "prefix_id bigint, url string")
    got = {r.prefix_id: (r.scheme, r.store_name, r.path_prefix) for r in catalog.attach_layout(inv, pre).collect()}
    assert got == {1: ("s3", "st", "a/"), 2: ("gs", "other", "")}


def test_common_prefix_of_random_texts(spark):
    import os
    import random

    rng = random.Random(3)
    data = {g: ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))] for g in range(150)}
    data |= {g + 1000: [f"db{g}/" + t for t in texts] for g, texts in data.items()}
    data |= {5000: ["a/b/x1", "a/b/x2"], 5001: ["a/", "a/b/c"], 5002: ["a/bc/d", "a/bd/e"], 5003: ["a/b", "a/b/c"], 5004: ["only/one"]}
    df = spark.createDataFrame([(g, t) for g, texts in data.items() for t in texts] + [(9999, None)], "g bigint, t string")
    got = {r.g: r.common_prefix for r in estate.common_prefix(df, "g", "t").collect()}
    assert got == {g: os.path.commonprefix(texts) for g, texts in data.items()} | {9999: None}
