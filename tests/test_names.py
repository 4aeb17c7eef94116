import pytest
from models import rows
from pyspark.sql import functions as F

from tidemark.functions import names, sqlface


def one(spark, *cols, data=None):
    df = spark.createDataFrame(*data) if data else spark.range(1)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_hex8(spark):
    got = one(spark, names.hex8("n"), data=([(0,), (255,), (0xFFFFFFFF,)], "n bigint"))
    assert got == [("00000000",), ("000000FF",), ("FFFFFFFF",)]
    with pytest.raises(Exception, match="eight hex digits"):
        one(spark, names.hex8("n"), data=([(1 << 32,)], "n bigint"))


SEGMENTS = [
    ("00000001", "00000000", "00000000"),
    ("00000001", "00000000", "000000FF"),
    ("00000001", "0000000A", "00000000"),
    ("00000001", "FFFFFFFF", "000000FE"),
    ("0000000C", "7FFFFFFF", "000000FF"),
]


def model_next(log, seg):
    s, lg = int(seg, 16), int(log, 16)
    return (f"{lg + 1:08X}", "00000000") if s == 0xFF else (log, f"{s + 1:08X}")


def model_prev(log, seg):
    s, lg = int(seg, 16), int(log, 16)
    if s == 0:
        return (f"{lg - 1:08X}", "000000FF") if lg else None
    return log, f"{s - 1:08X}"


def test_successors(spark):
    df = spark.createDataFrame(SEGMENTS, "tli string, log string, seg string")
    for r in df.select("log", "seg", names.next_segment("log", "seg").alias("n"), names.try_previous_segment("log", "seg").alias("p")).collect():
        assert tuple(r.n) == model_next(r.log, r.seg)
        assert (tuple(r.p) if r.p else None) == model_prev(r.log, r.seg)


@pytest.mark.parametrize("fn,log,seg", [
    (names.next_segment, "FFFFFFFF", "000000FF"),
    (names.previous_segment, "00000000", "00000000"),
    (names.next_segment, "00000000", "00000100"),
])
def test_successor_errors(spark, fn, log, seg):
    df = spark.createDataFrame([(log, seg)], "log string, seg string")
    with pytest.raises(Exception, match="no segment"):
        df.select(fn("log", "seg")).collect()
    safe = names.try_next_segment if fn is names.next_segment else names.try_previous_segment
    assert df.select(safe("log", "seg").alias("x")).first().x is None


def test_segment_number_is_unsigned(spark):
    df = spark.createDataFrame([("FFFFFFFF", "FFFFFFFF")], "log string, seg string")
    assert int(df.select(names.segment_number("log", "seg")).first()[0]) == 2**64 - 1


def test_parsing(spark):
    df = spark.createDataFrame(
        [("00000001000000020000000A",), ("00000002.history",), ("base_00000001000000020000000A_00000028xyz",), ("LATEST",)],
        "t string",
    )
    got = df.select(names.parse_segment("t").alias("s"), names.parse_backup_name("t").alias("b")).collect()
    assert tuple(got[0].s) == ("00000001", "00000002", "0000000A") and got[0].b is None
    assert got[1].s is None and got[1].b is None
    assert tuple(got[2].b) == ("00000001", "00000002", "0000000A", "00000028")
    assert got[3].b is None


@pytest.mark.parametrize("url,expect", [
    ("s3://foo/bar", ("s3", "foo", "bar/")),
    ("s3://foo/bar/", ("s3", "foo", "bar/")),
    ("wabs://foo/bar", ("wabs", "foo", "bar/")),
    ("swift://foo//bar/baz", ("swift", "foo", "bar/baz/")),
    ("s3://foo_bar", ("s3", "foo_bar", "")),
    ("file://localhost/tmp", ("file", "localhost", "tmp/")),
])
def test_prefix_url(spark, url, expect):
    df = spark.createDataFrame([(url,)], "u string")
    assert tuple(df.select(names.parse_url("u").alias("p")).first().p) == expect
    assert df.select(names.scheme_supported(names.parse_url("u")["scheme"]).alias("ok")).first().ok


def test_unsupported_scheme(spark):
    df = spark.createDataFrame([("notfile://localhost/tmp",)], "u string")
    assert not df.select(names.scheme_supported(names.parse_url("u")["scheme"]).alias("ok")).first().ok


def test_layout(spark):
    seg, off, p = F.lit("000000010000000200000003"), F.lit("00000028"), F.lit("bar/")
    got = one(spark, names.backups_dir(p), names.sentinel_path(p, seg, off), names.volume_path(p, seg, off, names.volume_name(F.lit(7))), names.wal_path(p, seg))
    base = "bar/basebackups_005/base_000000010000000200000003_00000028"
    assert got == [(
        "bar/basebackups_005/",
        base + "_backup_stop_sentinel.json",
        base + "/tar_partitions/part_00000007.tar.lzo",
        "bar/wal_005/000000010000000200000003.lzo",
    )]


def test_path_parts(spark):
    paths = ["a/b/c", "a", "", "/x", "a/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(names.base_name("p"), names.dir_name("p"), names.depth("p")).collect()]
    assert got == [("c", "a/b", 3), ("a", "", 1), ("", "", 1), ("x", "", 2), ("", "a", 2)]


def test_member_name(spark):
    df = spark.createDataFrame([("/pg/data/base/1",)], "p string")
    assert df.select(names.member_name("p", F.lit("/pg/data/"))).first()[0] == "base/1"
    with pytest.raises(Exception, match="not under the root"):
        df.select(names.member_name("p", F.lit("/other/"))).collect()


def test_rates(spark):
    cases = [(1024 * 25, 2.0), (1024, 3.0), (1024 * 2_000_000, 1.0), (10, 7.0), (0, 1.0), (1024 * 123456, 1.0), (1, 1000.0)]
    df = spark.createDataFrame(cases, "b bigint, s double")
    want = ["{0:02g}".format((b / 1024) / s) for b, s in cases]
    assert [r[0] for r in df.select(names.kib_text("b", "s")).collect()] == want
    assert one(spark, names.kib_text(F.lit(5), F.lit(0.0))) == [("NaN",)]


def test_versions(spark):
    df = spark.createDataFrame([("a/wal_005/x",), ("a/basebackups_003/y",), ("a/wal_x/z",)], "k string")
    v = names.layout_version("k")
    assert rows(df.select(v, names.version_state(v))) == rows(
        spark.createDataFrame([("005", "current"), ("003", "obsolete"), (None, "unknown")], "v string, s string")
    )


def test_sql_functions_agree(spark):
    sqlface.register(spark)
    df = spark.createDataFrame([(t + lg + s,) for t, lg, s in SEGMENTS] + [("x.history",)], "name string")
    df.createOrReplaceTempView("n")
    by_sql = spark.sql("SELECT name, segment_tli(name), CAST(sn_number(segment_sn(name)) AS STRING), sn_position(segment_sn(name)) FROM n")
    p = names.parse_segment("name")
    by_columns = df.select(
        "name", p["tli"], names.segment_number(p["log"], p["seg"]).cast("string"), names.position(p["log"], p["seg"])
    )
    assert rows(by_sql) == rows(by_columns)
    after = spark.sql("SELECT segment FROM segments_after('00000001', '00000000000000FE', 3)")
    assert [r[0] for r in after.collect()] == [
        "0000000100000000000000FF", "000000010000000100000000", "000000010000000100000001"
    ]
