import gzip
import os
import re
import subprocess

import pytest
from models import rows
from pyspark.sql import functions as F

from tidemark import scale, session
from tidemark.functions import classify
from tidemark.operators import catalog, packing, retention
from tidemark.sinks import archive as sink
from tidemark.sources import archive as source
from tidemark.sources import listing

SEG = "000000010000000000000001"


def test_listing_of_a_tree(spark, tmp_path):
    (tmp_path / "subdir").mkdir()
    (tmp_path / "subdirfile.txt").write_text("abc")
    (tmp_path / "subdir" / "file.txt").write_text("content")
    df = listing.list_tree(spark, str(tmp_path))
    root = str(tmp_path).lstrip("/")
    assert {r.key: r.size for r in df.collect()} == {f"{root}/subdirfile.txt": 3, f"{root}/subdir/file.txt": 7}
    assert df.where("last_modified is null").count() == 0
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan
    assert {bytes(r.content) for r in listing.read_content(spark, str(tmp_path), "file*").collect()} == {b"content"}


def test_inventory_export_is_pruned_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "inv")
    base = f"db/basebackups_005/base_{SEG}_00000028"
    data = [(1, "b", f"/{base}_backup_stop_sentinel.json", 5, 100), (1, "b", f"db/wal_005/{SEG}.lzo", 6, 100)]
    spark.createDataFrame(data, "id bigint, store string, name string, len bigint, t bigint").select(
        "*", F.timestamp_seconds("t").alias("updated"), F.lit(None).cast("timestamp").alias("modified"), F.lit("x").alias("unused")
    ).write.parquet(path)
    inv = listing.read_inventory(
        spark, path, prefix_id="id", bucket="store", key="name", size="len", last_modified=["modified", "updated"]
    )
    c = classify.classify_keys(inv.withColumn("path_prefix", F.lit("db/")))
    assert sorted(r.thing for r in c.collect()) == ["segment", "sentinel"]
    assert c.where("last_modified is null").count() == 0
    plain = str(tmp_path / "plain")
    inv.withColumn("unused", F.lit("y")).write.parquet(plain)
    c = classify.classify_keys(spark.read.parquet(plain).withColumn("path_prefix", F.lit("db/")))
    plan = retention.retention_horizon(catalog.complete_backups(c), 3)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "StringContains(key,_backup_stop_sentinel.json)" in scan
    assert "unused" not in scan and "size" not in scan
    assert plan.count("WindowGroupLimit") == 2


def test_sweep_is_broadcast_and_does_not_shuffle_the_listing(spark, tmp_path):
    path = str(tmp_path / "inv")
    spark.createDataFrame([(1, "b", f"db/wal_005/{SEG}.lzo", 6)], "prefix_id bigint, bucket string, key string, size bigint").write.parquet(path)
    c = classify.classify_keys(spark.read.parquet(path).withColumn("path_prefix", F.lit("db/")))
    h = spark.createDataFrame([(1, "0000000000000002")], "prefix_id bigint, horizon_sn string")
    plan = retention.delete_before(c, h)
    assert plan.count() == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_sentinel_files(spark, tmp_path):
    d = tmp_path / "db" / "basebackups_005"
    d.mkdir(parents=True)
    (d / f"base_{SEG}_00000028_backup_stop_sentinel.json").write_text('{"expanded_size_bytes": 9,\n "spec": {}}')
    (d / "other.json").write_text("{}")
    got = source.read_sentinels(spark, str(tmp_path)).collect()
    assert [(r.name, r.wal_segment_backup_start) for r in got] == [(f"base_{SEG}_00000028", SEG)]
    s = source.read_sentinels(spark, str(tmp_path)).select(F.lit(1).alias("prefix_id"), "name", "body")
    assert catalog.parse_detail(s).first().expanded_size_bytes == 9


def test_sentinel_files_are_listed_by_tasks(spark, tmp_path):
    """As Spark's own reader finds them, but no plan holds their names."""
    name = f"base_{SEG}_{{:08X}}_backup_stop_sentinel.json"
    for k, home in enumerate(["a", "a/b c%20", "x/ü", "_hidden", "x/.tmp", "x/part=1"]):
        d = tmp_path / home / "basebackups_005"
        d.mkdir(parents=True)
        for n in range(3):
            (d / name.format(16 * k + n)).write_bytes(b'{"n":\r\n\xff %d}' % n)
        (d / (name.format(16 * k + 3) + ".gz")).write_bytes(gzip.compress(b"{}"))
        (d / name.format(16 * k + 4)).write_bytes(b"")
        (d / name.format(5).lower()).write_text("{}")

    def plain(path):
        r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "base_*_backup_stop_sentinel.json*").text(path, wholetext=True)
        return sorted((re.sub("^file:/+", "file:///", r.u), bytes(r.b)) for r in r.select(F.col("_metadata.file_path").alias("u"), F.col("value").cast("binary").alias("b")).collect() if SEG in r.u)

    for path in (f"{tmp_path}", f"file:{tmp_path}/*/*", f"{tmp_path}/{{a,x}}/[!a]*/base*", f"{tmp_path}/a/basebackups_005/{name.format(1)}"):
        got = source.read_sentinels(spark, path)
        found = sorted((re.sub("^file:/+", "file:///", r.url), bytes(r.b)) for r in got.select("url", F.col("body").cast("binary").alias("b")).collect())
        assert found == plain(path) and found
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    for path in (f"{tmp_path}/none", f"{tmp_path}/none*"):
        with pytest.raises(Exception, match="none"):
            source.read_sentinels(spark, path).count()


def test_sentinel_only_when_all_went_well(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True)], "upload_good boolean, stop_good boolean").select(
        F.lit(1).alias("prefix_id"), F.lit("n").alias("name"), F.lit("w").alias("wal_segment_backup_stop"),
        F.lit("o").alias("wal_segment_offset_backup_stop"), F.lit(1).alias("expanded_size_bytes"), F.lit("s").alias("spec"), "upload_good", "stop_good",
    )
    assert sink.sentinel_bodies(df).count() == 1


def test_backup_list_text(spark, tmp_path):
    df = spark.createDataFrame([("base_x", 0, None, "s", "o", None, "z")], "name string, t bigint, expanded_size_bytes bigint, wal_segment_backup_start string, "
                               "wal_segment_offset_backup_start string, wal_segment_backup_stop string, wal_segment_offset_backup_stop string")
    path = str(tmp_path / "list")
    sink.write_backup_list(df.withColumn("last_modified", F.timestamp_seconds("t")).coalesce(1), path)
    (part,) = [f for f in os.listdir(path) if f.startswith("part-")]
    text = open(os.path.join(path, part), newline="").read()
    assert text.split("\r\n")[0].split("\t")[:3] == ["name", "last_modified", "expanded_size_bytes"]
    assert text.split("\r\n")[1] == "base_x\t1970-01-01T00:00:00\t\ts\to\t\tz"


def test_volume_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("c", f"f{i}", 10, i) for i in range(25)], "cluster_id string, path string, size bigint, ord bigint")
    files = m.select("cluster_id", "path", F.concat(F.lit("data"), "path").alias("content"))
    path = str(tmp_path / "vol")
    sink.write_volumes(files, packing.pack(m, 100, 100), path)
    assert sorted(os.listdir(path + "/cluster_id=c")) == ["volume=0", "volume=1", "volume=2"]
    assert all(len([f for f in os.listdir(f"{path}/cluster_id=c/volume={v}") if f.endswith(".parquet")]) == 1 for v in range(3))
    back = sink.read_volumes(spark, path)
    assert rows(back.select("cluster_id", "path", "content")) == rows(files)


def test_manifest_and_status_inputs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("cluster_id,path,ftype,size,link_target,ord\nc,x,file,5,,0\n")
    r = source.read_manifest(spark, str(tmp_path / "m"), "csv").first()
    assert (r.path, r.size, r.link_target) == ("x", 5, None)
    path = str(tmp_path / "s")
    spark.createDataFrame([(1, SEG + ".ready")], "cluster_id bigint, file_name string").write.parquet(path)
    assert source.read_status(spark, path).first().file_name == SEG + ".ready"


def test_shared_folder(spark):
    assert session.shared_folder(spark) == session.shared_folder(spark)
    assert scale.pin(spark.range(3)).count() == 3


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("v"))
    got = scale.numbered(df, ["k"], ["v"], "v", pieces=16).collect()
    assert sorted((r.k, r.number) for r in got) == [(k, n) for k in (0, 1) for n in range(1, 501)]


@pytest.mark.parametrize("word", ["localCheckpoint", "crossJoin", "toPandas"])
def test_words_kept_out_of_the_library(word):
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tidemark")
    assert subprocess.run(["grep", "-rl", word, root, "--include=*.py"], capture_output=True, text=True).stdout == ""


def test_volumes_keep_ids_of_digits(spark, tmp_path):
    m = spark.createDataFrame([(c, "f", 10, 0) for c in ("007", "010", "7")], "cluster_id string, path string, size bigint, ord bigint")
    files = m.select("cluster_id", "path", F.lit("data").alias("content"))
    path = str(tmp_path / "digits")
    sink.write_volumes(files, packing.pack(m, 100, 100), path)
    assert sorted(r.cluster_id for r in sink.read_volumes(spark, path).collect()) == ["007", "010", "7"]


def test_the_written_delete_plan_says_what_it_would_delete(spark, tmp_path):
    root = f"db/basebackups_005/base_{SEG[:-1]}"
    keys = [f"{root}{n}_00000028_backup_stop_sentinel.json" for n in (1, 2, 3)] + [f"db/wal_005/{SEG[:-1]}{n}.lzo" for n in (1, 2, 3)] + ["db/wal_005/odd"]
    listed = spark.createDataFrame([(1, "b", k, n, "db/") for n, k in enumerate(keys)], "prefix_id bigint, bucket string, key string, size bigint, path_prefix string")
    c = classify.classify_keys(listed.withColumn("last_modified", F.timestamp_seconds("size")))
    report = retention.delete_report(retention.delete_retain(c, catalog.complete_backups(c), 2), F.lit("s3"))
    sink.write_delete_plan(report, str(tmp_path / "plan"))
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "plan")).collect()}
    assert set(got) == {keys[0], keys[3]} and all(r.dry_run and r.url == f"s3://b/{k}" for k, r in got.items())
    assert got[keys[3]].thing == "a wal file" and got[keys[3]].hint == "This is only a dry run -- no actual data is being deleted"
