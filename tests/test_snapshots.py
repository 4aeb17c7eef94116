"""Prefixes inside one another, exports with a manifest, digests, maintained footprints, sketches."""

import json
import random

import pytest
from models import INVENTORY, random_inventory, rows
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import classify
from tidemark.operators import catalog, digests, estate, placement, sketches
from tidemark.plans import registry
from tidemark.sinks import archive as sink
from tidemark.sources import archive as source
from tidemark.sources import inventory as export


# ---- prefixes ------------------------------------------------------------------------------

def slow_prefix(path, homes):
    inside = [(len(h.rstrip("/")), -i) for i, h in homes if path.startswith(h.rstrip("/") + "/")]
    return -max(inside)[1] if inside else None


@pytest.mark.parametrize("limit", [scale.BROADCAST_ROWS, 0])
def test_longest_prefix(spark, limit):
    rng = random.Random(4)
    homes = [(0, "s3://b/a/"), (1, "s3://b/a/b"), (2, "s3://b/a/b/c"), (3, "s3://b/ab"), (4, "s3://b"), (5, "s3://c/x/y/z"), (7, "s3://b/a/b"), (8, "gs://b/a")]
    paths = ["s3://" + "/".join(rng.choice(["b", "c", "a", "ab", "x", "y", "z"]) for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["s3://b/a/b/f"] * 200 + ["gs://b/a/k", "/", "", None]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(paths)], "n bigint, url string")
    got = placement.longest_prefix(df, spark.createDataFrame(homes, "prefix_id bigint, home string"), max_rows=limit)
    assert got.columns == ["n", "url", "prefix_id"]
    assert {r.n: r.prefix_id for r in got.collect()} == {n: slow_prefix(p, homes) if p is not None else None for n, p in enumerate(paths)}


def test_longest_prefix_without_homes(spark):
    df = spark.createDataFrame([("a/b",)], "url string")
    none = spark.createDataFrame([], "prefix_id bigint, home string")
    assert placement.longest_prefix(df, none).collect()[0].prefix_id is None


def test_small_prefixes_do_not_shuffle_the_paths(spark):
    homes = spark.createDataFrame([(0, "a"), (1, "a/b")], "prefix_id bigint, home string")
    got = placement.longest_prefix(spark.range(10).select(F.concat(F.lit("a/b/"), F.col("id").cast("string")).alias("url")), homes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_sentinel_files_in_nested_prefixes(spark, tmp_path):
    name = "base_0000000100000000000000{:02X}_00000028"
    found = [(p, name.format(p * 16 + k), json.dumps({"expanded_size_bytes": p * 100 + k})) for p in range(3) for k in range(4)]
    homes = spark.createDataFrame([(0, ""), (1, "in"), (2, "in/deep")], "prefix_id bigint, home string")
    assert sink.write_sentinel_files(spark.createDataFrame(found, "prefix_id bigint, name string, body string"), homes, str(tmp_path)) == 12
    (tmp_path / "in" / "basebackups_005" / "base_x_backup_stop_sentinel.json").write_text("{}")
    urls = homes.withColumn("home", F.concat_ws("/", F.lit(f"file://{tmp_path}"), F.nullif(F.col("home"), F.lit(""))))
    detail = catalog.parse_detail(source.placed_sentinels(spark, str(tmp_path), urls))
    assert sorted((r.prefix_id, r.name, r.expanded_size_bytes) for r in detail.collect()) == [(p, n, json.loads(b)["expanded_size_bytes"]) for p, n, b in found]


# ---- exports -------------------------------------------------------------------------------

LISTED = "prefix_id bigint, bucket string, key string, size bigint, last_modified timestamp"


def listed(spark, n=500):
    return spark.range(n).select(
        (F.col("id") % 5).alias("prefix_id"), F.lit("b").alias("bucket"), F.concat(F.lit("db/k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.col("id").alias("size"), F.timestamp_seconds("id").alias("last_modified")
    )


def test_export_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "e")
    export.write_export(listed(spark), path, rows_per_file=40)
    files = export.read_manifest(spark, f"{path}/manifest")
    assert files.count() >= 13 and files.agg(F.sum("rows")).first()[0] == 500
    assert rows(export.read_export(spark, path, checksums=True)) == rows(listed(spark))
    one = export.read_export(spark, path, of_prefix=3)
    assert rows(one) == rows(listed(spark).where("prefix_id = 3"))
    assert export.pruned(files, prefix_id=3).count() <= 5
    some = export.read_export(spark, path, key_prefix="db/k0000")
    assert rows(some) == rows(listed(spark).where("startswith(key, 'db/k0000')"))
    assert export.pruned(files, key_prefix="zz").count() == 0 and export.read_export(spark, path, key_prefix="zz").count() == 0
    assert export.pruned(files.withColumn("lowKey", F.lit(None).cast("string")), key_prefix="zz").count() == files.count()


def test_incomplete_or_changed_exports_raise(spark, tmp_path):
    path = tmp_path / "e"
    export.write_export(listed(spark, 50), str(path))
    stated = json.loads(next((path / "manifest").glob("part-*")).read_text())

    def manifest(name, **changed):
        stated["files"][0] |= changed
        (tmp_path / name).write_text(json.dumps(stated))
        return str(tmp_path / name)

    right = dict(stated["files"][0])
    assert export.read_export(spark, str(path), manifest("same.json"), checksums=True).count() == 50
    wrong = manifest("sum.json", MD5checksum="0" * 32)
    assert export.read_export(spark, str(path), wrong).count() == 50
    with pytest.raises(ValueError, match="differ from its manifest"):
        export.read_export(spark, str(path), wrong, checksums=True)
    with pytest.raises(ValueError, match="differ from its manifest"):
        export.read_export(spark, str(path), manifest("size.json", **{**right, "size": right["size"] + 1}))
    with pytest.raises(FileNotFoundError):
        export.read_export(spark, str(path), manifest("name.json", **{**right, "key": "data/part-lost.parquet"}))


def test_foreign_csv_export(spark, tmp_path):
    (tmp_path / "d").mkdir()
    text = '"b","db/a%20b","5","2024-01-02T03:04:05.000Z"\n"b","db/c","6","2024-01-02T03:04:06.000Z"\n'
    (tmp_path / "d" / "x.csv").write_text(text)
    manifest = {"sourceBucket": "b", "fileFormat": "CSV", "fileSchema": "Bucket, Key, Size, LastModifiedDate", "files": [{"key": "d/x.csv", "size": len(text), "MD5checksum": None}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    got = export.read_export(spark, str(tmp_path), manifest=str(tmp_path / "manifest.json"), bucket="Bucket", key="Key", size="Size", last_modified="LastModifiedDate", prefix_id=F.lit(1))
    assert [(r.bucket, r.key, r.size, str(r.last_modified)) for r in got.orderBy("key").collect()] == [("b", "db/a b", 5, "2024-01-02 03:04:05"), ("b", "db/c", 6, "2024-01-02 03:04:06")]


# ---- digests -------------------------------------------------------------------------------

def snapshots(spark, seed):
    rng = random.Random(seed)
    data = random_inventory(seed, keys=600) + [(9, "b", k, 1, "db9/", 5) for k in ("top", "/lead/x", "a//b", "deep/er/and/deeper/k")]
    left = [r for r in data if rng.random() > 0.05]
    new = [(*r[:3], r[3] + 1, *r[4:]) if rng.random() < 0.05 else r for r in left]
    new += [(0, "b", f"db0/wal_005/{n:024X}.lzo", 3, "db0/", 10_000 + n) for n in range(20)] + [(77, "b", "only/new", 1, "db77/", 3)]
    old = data + [(78, "b", "only/old", 1, "db78/", 3)]
    return [spark.createDataFrame(d, INVENTORY).withColumn("last_modified", F.timestamp_seconds("n")) for d in (old, new)]


def opened(spark, old, new, tmp_path, compare):
    for name, df in (("old", old), ("new", new)):
        digests.write_digests(df, str(tmp_path / name), compare)
    return digests.open_leaves(*[digests.read_digests(spark, str(tmp_path / n)) for n in ("old", "new")])


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_the_full_join(spark, tmp_path, seed):
    old, new = snapshots(spark, seed)
    leaves = opened(spark, old, new, tmp_path, ("size",))
    got = digests.changes(old, new, leaves, ("size",))
    assert rows(got.select("prefix_id", "key", "status")) == rows(estate.snapshot_changes(old, new))
    # Only keys of leaves that differ are joined; the rest is kept without.
    inside = digests.leaf_of(old).join(leaves, digests.LEAF, "left_semi").count()
    assert 0 < inside < old.count() / 2
    differing = digests.leaf_of(old.unionByName(new)).join(got.where("status <> 'kept'").select("prefix_id", "key"), ["prefix_id", "key"], "left_semi")
    assert differing.join(leaves, digests.LEAF, "left_anti").count() == 0


def test_equal_listings_open_nothing(spark, tmp_path):
    old, _ = snapshots(spark, 3)
    leaves = opened(spark, old, old.repartition(7), tmp_path, digests.COMPARE)
    assert leaves.count() == 0
    assert digests.changes(old, old, leaves).where("status <> 'kept'").count() == 0
    none = old.limit(0)
    assert opened(spark, none, none, tmp_path / "none", digests.COMPARE).count() == 0
    assert digests.changes(none, old, opened(spark, none, old, tmp_path / "half", digests.COMPARE)).where("status <> 'added'").count() == 0


def test_null_sizes_and_times_count_as_values(spark, tmp_path):
    old = spark.createDataFrame([(1, "d/a", None, None), (1, "d/b", 2, None), (1, "d/c", None, 5), (1, "d/e", None, None)], "prefix_id bigint, key string, size bigint, t bigint").withColumn("last_modified", F.timestamp_seconds("t"))
    new = spark.createDataFrame([(1, "d/a", None, None), (1, "d/b", None, 2), (1, "d/c", 5, None)], "prefix_id bigint, key string, size bigint, t bigint").withColumn("last_modified", F.timestamp_seconds("t"))
    got = digests.changes(old, new, opened(spark, old, new, tmp_path, digests.COMPARE))
    assert {r.key: r.status for r in got.collect()} == {"d/a": "kept", "d/b": "changed", "d/c": "changed", "d/e": "removed"}


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_footprint_equals_a_full_run(spark, tmp_path, seed):
    old, new = snapshots(spark, seed)
    moved = digests.changes(old, new, opened(spark, old, new, tmp_path, digests.COMPARE), carry=("path_prefix",)).where("status <> 'kept'")
    moved = moved.withColumn("path_prefix", F.coalesce("new_path_prefix", "old_path_prefix")).withColumn("bucket", F.lit("b"))

    def full(df):
        return estate.footprint(classify.classify_keys(df)).where("level = 0").drop("level")

    classed = classify.classify_keys(moved)
    got = digests.maintained_footprint(full(old), classed, classify.classify_keys(new))
    assert rows(got.select("prefix_id", "thing", "objects", "bytes", "oldest", "newest")) == rows(full(new).select("prefix_id", "thing", "objects", "bytes", "oldest", "newest"))


def test_the_listing_is_made_once(spark, tmp_path, monkeypatch):
    """Comparing two listings and carrying a footprint on reads what was derived once."""
    made = spark.sparkContext.accumulator(0)

    def seen(size):
        made.add(1)
        return size

    key = F.concat(F.lit("db/wal_005/0000000100000000"), F.lpad(F.hex(F.col("size") % 250), 8, "0"), F.lit(".lzo"))
    rows_in = listed(spark).withColumn("key", key).withColumn("size", F.udf(seen, "bigint")("size")).withColumn("path_prefix", F.lit("db/"))
    monkeypatch.setattr(registry.d, "inv_wal", lambda _spark, _sf: rows_in)
    got = registry.QUERIES["footprint_maintained"][1](spark, str(tmp_path)).collect()
    assert sum(r.objects for r in got) == 500 and made.value == 500


# ---- sketches ------------------------------------------------------------------------------

def test_distinct_keys_of_any_days_within_the_stated_error(spark, tmp_path):
    """One prefix holds most keys; keys written on several days count once."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(2).cast("bigint").alias("prefix_id"), F.concat(F.lit("k"), (F.col("id") % 120_000).cast("string")).alias("key"),
        F.timestamp_seconds((F.col("id") % 11) * 86_400).alias("last_modified"),
    )
    sketches.distinct_sketches(df).write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    ranges = spark.createDataFrame([("1970-01-01", "1970-01-01"), ("1970-01-02", "1970-01-05"), ("1970-01-01", "1970-01-11"), ("1980-01-01", "1980-01-02")], "a string, b string").select(
        F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day")
    )
    got = {(r.prefix_id, str(r.first_day), str(r.last_day)): r.keys_estimate for r in sketches.distinct_between(kept, ranges).collect()}
    exact = df.join(ranges, F.to_date("last_modified").between(F.col("first_day"), F.col("last_day"))).groupBy("prefix_id", "first_day", "last_day").agg(F.countDistinct("key").alias("n")).collect()
    assert len(got) == len(exact) == 6
    for r in exact:
        assert abs(got[r.prefix_id, str(r.first_day), str(r.last_day)] - r.n) <= 4 * sketches.distinct_error() * r.n + 1


def test_rate_quantiles_of_merged_hours_within_the_rank_error(spark, tmp_path):
    rng = random.Random(9)
    data = [(rng.choice("aaab"), rng.lognormvariate(3, 2), n % 97) for n in range(20_000)]
    df = spark.createDataFrame(data, "prefix string, rate double, h int").select("prefix", "rate", F.timestamp_seconds(F.col("h") * 3600).alias("time"), F.lit("push-wal").alias("action"), F.lit("complete").alias("state"))
    other = df.limit(50).withColumn("state", F.lit("skip")).unionByName(df.limit(50).withColumn("rate", F.lit(None).cast("double")))
    sketches.rate_sketches(df.unionByName(other)).write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    for by, where in ((("prefix",), "true"), ((), "hour >= '1970-01-02'")):
        for r in sketches.rate_quantiles(kept.where(where), by, (0.1, 0.5, 0.95)).collect():
            values = [v for p, v, h in data if (not by or p == r.prefix) and (where == "true" or h >= 24)]
            assert r.uploads == len(values)
            for q in (0.1, 0.5, 0.95):
                assert abs(sum(v <= r[f"p{round(q * 100)}"] for v in values) / len(values) - q) <= 2 * sketches.RANK_ERROR
