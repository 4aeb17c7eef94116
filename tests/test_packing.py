import random

import models
import pytest
from pyspark.sql import functions as F

from tidemark.operators import packing

MANIFEST = "cluster_id string, path string, size bigint, ord bigint"


def packed(spark, clusters, max_bytes, max_members, **kw):
    data = [(c, f"{c}/{o}", s, o) for c, members in clusters.items() for o, s in members]
    df = spark.createDataFrame(data, MANIFEST)
    got = {(r.cluster_id, r.ord): r.volume for r in packing.pack(df, max_bytes, max_members, **kw).collect()}
    want = {}
    for c, members in clusters.items():
        ordered = sorted(members)
        for (o, _), v in zip(ordered, models.next_fit([s for _, s in ordered], max_bytes, max_members)):
            want[(c, o)] = v
    return got, want


@pytest.mark.parametrize("seed", range(4))
def test_random_clusters_over_many_small_blocks(spark, seed):
    rng = random.Random(seed)
    clusters = {"hot": [], "small": [], "zero": [], "one": [(7, 100)]}
    for o in rng.sample(range(3000), 900):
        clusters["hot"].append((o, rng.choice([0, 1, 3, 10, 50, 99, 100])))
    for o in range(10):
        clusters["small"].append((o, rng.randrange(40)))
        clusters["zero"].append((o * 1000, 0))
    got, want = packed(spark, clusters, 100, rng.choice([3, 5, 8]), block=8, fan=rng.choice([2, 3]))
    assert got == want


def test_exact_size_leaves_an_empty_first_volume(spark):
    got, want = packed(spark, {"a": [(0, 10), (1, 1)], "b": [(0, 9), (1, 1), (2, 10), (3, 0)]}, 10, 4, block=4, fan=2)
    assert got == want
    assert got[("a", 0)] == 1 and got[("a", 1)] == 2


def test_default_blocks(spark):
    rng = random.Random(9)
    got, want = packed(spark, {"a": [(o, rng.randrange(1000)) for o in range(2000)]}, 5000, 24)
    assert got == want


def test_too_big(spark):
    df = spark.createDataFrame([("a", "x", 11, 0), ("a", "y", 10, 1)], MANIFEST)
    assert [r.path for r in packing.too_big(df, 10).collect()] == ["x"]
    assert "larger than 10 bytes" in packing.too_big(df, 10).first().hint
    with pytest.raises(Exception, match="member too big"):
        packing.pack(df, 10, 4).collect()


def test_sizes(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 6), ("a", 1, 7), ("b", 0, 1)], "cluster_id string, volume bigint, size bigint")
    got = {(r.cluster_id, r.volume): (r.bytes, r.members) for r in packing.backup_sizes(df).collect()}
    assert got == {("a", 0): (11, 2), ("a", 1): (7, 1), ("a", None): (18, 3), ("b", 0): (1, 1), ("b", None): (1, 1)}


def test_extra_columns_survive(spark):
    df = spark.createDataFrame([("a", "x", 1, 0)], MANIFEST).withColumn("ftype", F.lit("dir"))
    assert set(packing.pack(df, 10, 4).columns) == {"cluster_id", "path", "size", "ord", "ftype", "volume"}


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere, with the package on the driver's path only."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from tidemark.session import build_session\n"
        "from tidemark.operators import packing\n"
        "s = build_session('x', 'local[2]', 2, spark__ui__enabled='false')\n"
        f"m = s.createDataFrame([('a', str(i), 5, i) for i in range(9)], {MANIFEST!r})\n"
        "print('volumes', packing.pack(m, 12, 4).select('volume').distinct().count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "volumes 5" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("ords, text", [([0, 1, None], "without ord"), ([0, 1, 1], "repeated")])
def test_ord_must_be_whole_and_distinct(spark, ords, text):
    m = spark.createDataFrame([("c", f"f{i}", 1, o) for i, o in enumerate(ords)], "cluster_id string, path string, size bigint, ord bigint")
    with pytest.raises(Exception, match=text):
        packing.pack(m, 10, 10).collect()
