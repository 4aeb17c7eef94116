import collections

import models
import pytest
from models import rows
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import classify
from tidemark.operators import catalog, estate, retention


def inventory(spark, seed, **kw):
    data = models.random_inventory(seed, **kw)
    df = spark.createDataFrame(data, models.INVENTORY).withColumn("last_modified", F.timestamp_seconds("n"))
    return data, df


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    data, df = inventory(spark, seed)
    got = {(r.prefix_id, r.key): (r.thing, r.sn) for r in classify.classify_keys(df).collect()}
    want = {(p, k): models.classify(root, k) for p, _, k, _, root, _ in data}
    assert got == {k: v for k, v in want.items() if v}


def test_wal_patterns_exclude_each_other(spark):
    _, df = inventory(spark, 3)
    n = classify.wal_matches(F.substring_index("key", "/", -1))
    assert df.agg(F.max(n)).first()[0] == 1


@pytest.mark.parametrize("keep", [1, 3, 10_000])
def test_retain(spark, keep):
    data, df = inventory(spark, 4)
    c = classify.classify_keys(df)
    plan = retention.delete_retain(c, catalog.complete_backups(c), keep)
    assert {(r.prefix_id, r.key) for r in plan.collect()} == models.deleted(data, keep)


def test_retain_rejects_zero(spark):
    _, df = inventory(spark, 4)
    c = classify.classify_keys(df)
    with pytest.raises(ValueError):
        retention.retention_horizon(catalog.complete_backups(c), 0)


def test_large_keep_takes_the_salted_round(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("v"), F.col("id").cast("string").alias("key"))
    got = scale.top_n(df, ["g"], [F.desc("v")], 1500)
    assert sorted(r.v for r in got.collect()) == list(range(3500, 5000))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join_equals_broadcast(spark, how):
    big = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (3, "b"), (5, "c")], "k bigint, t string")
    assert rows(scale.join_small(big, small, "k", how)) == rows(scale.join_small(big, small, "k", how, max_rows=0))


def test_before_takes_backup_names_only(spark):
    ok = spark.createDataFrame([(1, "base_00000001000000020000000A_00000028")], "prefix_id bigint, name string")
    assert retention.horizons_of_names(ok).first().horizon_sn == "000000020000000A"
    bad = spark.createDataFrame([(1, "00000001000000020000000A")], "prefix_id bigint, name string")
    with pytest.raises(Exception, match="not a backup name"):
        retention.horizons_of_names(bad).collect()


def test_rerun_deletes_nothing(spark):
    _, df = inventory(spark, 5)
    c = classify.classify_keys(df)
    left = retention.after_deletion(df, retention.delete_retain(c, catalog.complete_backups(c), 2))
    again = classify.classify_keys(left)
    assert retention.delete_retain(again, catalog.complete_backups(again), 2).count() == 0


def test_messages(spark):
    def sentinel(p, n):
        return f"r/basebackups_005/base_00000001{0:08X}{n:08X}_00000028_backup_stop_sentinel.json"

    found = [(1, 10)] + [(2, i) for i in range(3)] + [(3, i) for i in range(9)]
    listed = spark.createDataFrame([(p, "b", sentinel(p, n), 1, "r/", 0) for p, n in found], models.INVENTORY).withColumn("last_modified", F.timestamp_seconds("n"))
    b = catalog.complete_backups(classify.classify_keys(listed))
    p = spark.createDataFrame([(0,), (1,), (2,), (3,)], "prefix_id bigint")
    got = {r.prefix_id: (r.message, r.detail, r.hint) for r in retention.retention_message(b, p, 5, F.lit("s3")).collect()}
    assert got == {
        0: ("Nothing to delete.", "The prefix has no complete backup.", None),
        1: ("The only backup stays.", None, f"Keys before s3://b/{sentinel(1, 10)} go."),
        2: ("All 3 backups stay.", None, f"Keys before s3://b/{sentinel(2, 0)} go."),
        3: ("4 older backups go.", "9 complete backups in all.", f"Keys before s3://b/{sentinel(3, 4)} go."),
    }


def test_pages_hold_every_key_once(spark):
    """20,001 keys of one bucket and a few of another."""
    plan = spark.range(20_001).select(F.lit("hot").alias("bucket"), F.lit(1).cast("bigint").alias("prefix_id"), F.concat(F.lit("test-key-"), "id").alias("key"))
    plan = plan.union(spark.range(3).select(F.lit("cold"), F.lit(2).cast("bigint"), F.col("id").cast("string")))
    got = retention.delete_pages(plan).collect()
    by_page = collections.Counter((r.bucket, r.page) for r in got)
    assert len(got) == 20_004 and len({(r.bucket, r.key) for r in got}) == 20_004
    assert sorted(by_page.values()) == [1, 3] + [1000] * 20
    assert sorted(r.key_number for r in got if r.bucket == "hot") == list(range(1, 20_002))
    checked = retention.page_check(retention.page_ids(retention.delete_pages(plan))).collect()
    assert len(checked) == 22 and all(r.one_bucket and r.keys <= 1000 for r in checked)
    mixed = spark.createDataFrame([(0, "a"), (0, "b")], "page_id bigint, bucket string")
    assert not retention.page_check(mixed).first().one_bucket


def test_between_is_the_difference_of_two_plans(spark):
    _, df = inventory(spark, 7)
    c = classify.classify_keys(df)
    b = catalog.complete_backups(c)
    want = retention.plan_difference(retention.delete_retain(c, b, 1), retention.delete_retain(c, b, 2))
    got = retention.delete_between(c, retention.retention_horizon(b, 2), retention.retention_horizon(b, 1))
    assert rows(got.select("prefix_id", "key")) == rows(want.select("prefix_id", "key"))


def test_everything_and_report(spark):
    data, df = inventory(spark, 6)
    c = classify.classify_keys(df)
    plan = retention.delete_everything(c)
    want = {(p, k) for p, _, k, _, root, _ in data if models.classify(root, k)}
    assert {(r.prefix_id, r.key) for r in plan.collect()} == want
    r = retention.delete_report(plan, F.lit("s3")).where("prefix_id = 0").first()
    assert r.url == f"s3://bucket0/{r.key}" and r.hint.startswith("This is only a dry run")
    assert r.msg in ("deleting part of a base backup", "deleting part of wal logs")


def test_old_versions(spark):
    df = spark.createDataFrame(
        [(1, "db/wal_004/x", "db/"), (1, "db/basebackups_000/y", "db/"), (1, "db/wal_005/z", "db/"), (1, "db/wal_006/z", "db/"), (1, "dbx/wal_004/x", "db/")],
        "prefix_id bigint, key string, path_prefix string",
    )
    assert {r.key for r in retention.delete_old_versions(df).collect()} == {"db/wal_004/x", "db/basebackups_000/y"}


def model_emptied(keys, gone):
    """The rule, followed on directories: a directory goes if it was emptied and had no sub-directory."""
    def parent(k):
        return k.rpartition("/")[0]

    import os

    common = os.path.commonprefix(sorted(gone)).rpartition("/")[0]
    dirs = collections.defaultdict(set)
    for k in keys:
        while k:
            dirs[parent(k)].add(k)
            k = parent(k)
    out = set()
    for d in {parent(k) for k in gone}:
        if d != common and all(c in gone for c in dirs[d]):
            out.add(d)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_emptied_dirs(spark, seed):
    import random

    rng = random.Random(seed)
    keys = {"p/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) + f"/f{i}" for i in range(40)}
    gone = {k for k in keys if rng.random() < 0.8}
    df = spark.createDataFrame([(1, k) for k in keys], "prefix_id bigint, key string")
    plan = spark.createDataFrame([(1, k) for k in gone], "prefix_id bigint, key string")
    got = {r.dir for r in estate.emptied_dirs(estate.mark_deleted(df, plan)).collect()}
    assert got == model_emptied(keys, gone)


def test_common_dir_stays(spark):
    df = spark.createDataFrame([(1, "a/b/x", True), (1, "a/b/y", True), (2, "s1/f", True), (2, "s2/f", True)], "prefix_id bigint, key string, deleted boolean")
    assert rows(estate.emptied_dirs(df).select("prefix_id", "dir")) == [(2, "s1"), (2, "s2")]
