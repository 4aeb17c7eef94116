from models import rows
from pyspark.sql import functions as F

from tidemark.operators import pending, volumes

M = "cluster_id string, path string, ftype string, size bigint, link_target string, ord bigint"

TREE = {
    # path: (type, taken)
    "PG_VERSION": ("file", True),
    "postgresql.conf": ("file", False),
    "postmaster.pid": ("file", False),
    "promote": ("dir", True),
    "base": ("dir", True),
    "base/postgresql.conf": ("file", True),
    "base/pgsql_tmp": ("dir", True),
    "base/pgsql_tmp/t1": ("file", False),
    "pg_wal": ("dirlink", True),
    "pg_xlog": ("dir", True),
    "pg_xlog/000": ("file", False),
    "base/pg_xlog": ("dir", True),
    "base/pg_xlog/f": ("file", True),
    "pg_stat_tmp": ("dir", True),
    "pg_stat_tmp/g": ("file", False),
    "lost+found": ("dir", False),
    "lost+found/x": ("file", False),
    "base/lost+found": ("file", True),
    "base/elsewhere": ("dirlink", False),
    "base/dangling": ("link", True),
    "pg_tblspc": ("dir", True),
    "pg_tblspc/7": ("dirlink", False),
    "pg_tblspc/7/PG_10": ("dir", True),
    "pg_tblspc/7/PG_10/5": ("dir", False),
    "pg_tblspc/7/PG_10/5/rel": ("file", True),
    "pg_tblspc/7/PG_10/6": ("dir", True),
    "pg_tblspc/7/pgsql_tmp": ("dir", True),
    "pg_tblspc/7/pgsql_tmp/x": ("file", False),
    "pg_tblspc/7/pg_stat_tmp": ("dir", False),
    "pg_tblspc/7/pg_stat_tmp/x": ("file", True),
    "pg_tblspc/7/lost+found": ("dir", True),
    "pg_tblspc/8": ("dir", True),
    "pg_tblspc/8/f": ("file", True),
    "pg_tblspc/8/lost+found": ("dir", False),
}


def tree(spark):
    return spark.createDataFrame([("c", p, t, 1, "/ts" if "link" in t else None, i) for i, (p, (t, _)) in enumerate(TREE.items())], M)


def test_members(spark):
    got = {r.path for r in volumes.select_members(tree(spark)).collect()}
    assert got == {p for p, (_, taken) in TREE.items() if taken}


def test_repeated_space_dirs_are_taken_once(spark):
    df = tree(spark)
    twice = df.unionByName(df.where("path = 'pg_tblspc/7/PG_10/6'"))
    assert volumes.select_members(twice).where("path = 'pg_tblspc/7/PG_10/6'").count() == 1


def test_tablespace_spec(spark):
    df = tree(spark).withColumn("path", F.concat(F.lit("/pg/"), "path"))
    spaces = volumes.tablespace_spec(df, F.lit("/pg/"))
    assert rows(spaces) == [("c", "7", "/ts/", "pg_tblspc/7")]
    spec = volumes.spec_of(spaces, "/pg/").first()
    assert spec.tablespaces == ["7"] and spec.spaces["7"].asDict() == {"loc": "/ts/", "link": "pg_tblspc/7"}


def test_unlinked(spark):
    df = tree(spark)
    present = df.where("path <> 'PG_VERSION'")
    assert [r.path for r in volumes.unlinked(df, present).collect()] == ["PG_VERSION"]
    assert volumes.still_there(df, present).count() == len(TREE) - 1


def seg(n):
    return str(n) * 24


def test_ready_markers(spark):
    names = [seg(0) + ".ready", seg(1) + ".ready", seg(2) + ".ready", "F" * 24 + ".done", "FFFFFFFF.history.ready"]
    df = spark.createDataFrame([(1, n) for n in names], "cluster_id bigint, file_name string")
    assert [r.segment for r in pending.ready_markers(df).orderBy("segment").collect()] == [seg(0), seg(1), seg(2)]
    first = pending.oldest_pending(df, 2).collect()
    assert sorted((r.rn, r.segment, r.backlog) for r in first) == [(1, seg(0), 3), (2, seg(1), 3)]


def test_push_batch(spark):
    df = spark.createDataFrame([(1, seg(n) + ".ready") for n in range(4)] + [(2, seg(5) + ".ready")], "cluster_id bigint, file_name string")
    named = spark.createDataFrame([(1, seg(1))], "cluster_id bigint, segment string")
    got = sorted((r.slot, r.segment, r.explicit) for r in pending.push_batch(df, named, 3).collect())
    assert got == [(1, seg(1), True), (2, seg(0), False), (3, seg(2), False)]
    assert pending.push_batch(df, named, 1).count() == 1


def test_reconcile(spark):
    df = spark.createDataFrame(
        [(1, seg(0) + ".ready"), (1, seg(1) + ".ready"), (1, seg(2) + ".done"), (1, seg(3) + ".done"), (1, "FFFFFFFF.history.done")],
        "cluster_id bigint, file_name string",
    )
    arch = spark.createDataFrame([(1, seg(0)), (1, seg(2)), (1, seg(4)), (1, seg(4))], "cluster_id bigint, segment string")
    assert {r.segment[0]: r.state for r in pending.reconcile(df, arch).collect()} == {
        "0": "ready-archived", "1": "ready-missing", "2": "done-archived", "3": "done-missing", "4": "archived-unmarked"
    }


def test_push_states(spark):
    """Three segments, the second has a marker but no file; the named one must not be skipped silently."""
    s = [f"{1:08d}{1:08d}{n:08d}" for n in (1, 2, 3)]
    ready = spark.createDataFrame([(1, x, False) for x in s], "cluster_id bigint, segment string, explicit boolean")
    files = spark.createDataFrame([(1, s[0]), (1, s[2])], "cluster_id bigint, segment string")
    assert rows(pending.push_states(ready, files)) == [(1, s[1], "skip")]
    assert rows(pending.push_states(ready.withColumn("explicit", F.lit(True)), files)) == [(1, s[1], "error")]


def test_dangling_tablespace_link_stays(spark):
    df = spark.createDataFrame([("c", "pg_tblspc/7", "link", 0, "/gone", 0), ("c", "pg_tblspc/8", "dirlink", 0, "/ts", 1)], M)
    assert [r.path for r in volumes.select_members(df).collect()] == ["pg_tblspc/7"]
    assert [r.tablespace for r in volumes.tablespace_spec(df, F.lit("")).collect()] == ["8"]


def test_work_dirs_are_kept_but_not_entered(spark):
    df = spark.createDataFrame([("c", ".work", "dir", 0, None, 0), ("c", ".work/x", "file", 1, None, 1)], M)
    assert {r.path for r in volumes.select_members(df).collect()} == {".work", ".work/x"}
    assert {r.path for r in volumes.select_members(df, [".work"]).collect()} == {".work"}
