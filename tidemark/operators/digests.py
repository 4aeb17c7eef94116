"""Comparing two listings by digests, so that only what differs is joined key by key.

Every key falls into a leaf: its folder and one of SLOTS hash slots (folders of segments are flat and huge). A leaf holds the number of its keys and two
64-bit digests that do not depend on order. Folders hold the same of everything below them. Two listings are compared from the top: folders whose
digests agree are not opened. Only keys in leaves that differ reach the join by key; the rest is known to be kept.

Digests are a table of their own (`write_digests`), a few rows per folder, so a listing is hashed once
and compared with many others. Two different leaves agree by chance once in 2^128.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import names
from tidemark.operators.estate import ancestors

SLOTS = 256
LEAF = ["prefix_id", "dir", "slot"]
FACTS = ("keys", "one", "two")
COMPARE = ("size", "last_modified")


def leaf_of(inventory: DataFrame) -> DataFrame:
    """`inventory` with the folder and slot of each key."""
    return inventory.withColumn("dir", names.dir_name("key")).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int"))


def leaf_digests(inventory: DataFrame, compare=COMPARE) -> DataFrame:
    """prefix_id, dir, slot, keys, one, two. The listing is reduced on the map side."""
    facts = [F.col("key")] + [x for c in compare for x in (F.col(c), F.col(c).isNull())]
    rows = leaf_of(inventory).select(*LEAF, F.xxhash64(*facts).alias("h1"), F.xxhash64(F.lit(11), *reversed(facts)).alias("h2"))
    return rows.groupBy(*LEAF).agg(F.count(F.lit(1)).alias("keys"), F.bit_xor("h1").alias("one"), F.bit_xor("h2").alias("two"))


def folder_digests(leaves: DataFrame) -> DataFrame:
    """prefix_id, depth, dir, and keys, one, two of all below; depth 0 is the whole prefix."""
    own = leaves.groupBy("prefix_id", "dir").agg(*_merged())
    # Folder names never end in a slash, and '' is the top, whatever lies in it directly.
    above = F.when(F.col("dir").contains("/"), ancestors("dir")).otherwise(F.array().cast("array<string>"))
    up = F.array_distinct(F.concat(F.array(F.lit("")), above, F.array(F.col("dir"))))
    told = own.select("prefix_id", F.explode(up).alias("dir"), *FACTS)
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return told.groupBy("prefix_id", "dir").agg(*_merged()).withColumn("depth", depth)


def _merged():
    return [F.sum("keys").alias("keys"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two")]


def write_digests(inventory: DataFrame, path: str, compare=COMPARE) -> None:
    spark = inventory.sparkSession
    leaf_digests(inventory, compare).write.parquet(f"{path}/leaves")
    folder_digests(spark.read.parquet(f"{path}/leaves")).write.parquet(f"{path}/folders")


def read_digests(spark, path: str):
    """(leaves, folders)"""
    return spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/folders")


def _differing(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Keys whose facts are not the same on both sides, or that one side lacks."""
    o = old.select(*keys, F.struct(*FACTS).alias("o"))
    n = new.select(*keys, F.struct(*FACTS).alias("n"))
    return o.join(n, keys, "full").where(~F.col("o").eqNullSafe(F.col("n"))).select(*keys)


def open_leaves(old, new) -> DataFrame:
    """prefix_id, dir, slot of the leaves that differ, from the (leaves, folders) of two listings; folders that agree are not opened."""
    deepest = max(f.agg(F.max("depth")).first()[0] or 0 for _, f in (old, new))
    opened, parents = None, None
    for depth in range(deepest + 1):
        sides = [f.where(F.col("depth") == depth).select("prefix_id", "dir", *FACTS) for _, f in (old, new)]
        if parents is not None:
            above = F.when(F.col("dir").contains("/"), names.dir_name("dir")).otherwise("")
            sides = [scale.join_small(s.withColumn("up", above), parents, ["prefix_id", "up"], "left_semi").drop("up") for s in sides]
        found = scale.pin(_differing(*sides, ["prefix_id", "dir"]))
        opened = found if opened is None else opened.unionByName(found)
        # A key with a leading slash has its parent two levels up, so all opened folders may be parents.
        parents = opened.select("prefix_id", F.col("dir").alias("up"))
        if depth == 0 and found.isEmpty():
            break
    if opened is None:
        opened = old[1].select("prefix_id", "dir").limit(0)
    sides = [scale.join_small(leaves, opened, ["prefix_id", "dir"], "left_semi") for leaves, _ in (old, new)]
    return scale.pin(_differing(*sides, LEAF))


def changes(old: DataFrame, new: DataFrame, opened: DataFrame, compare=COMPARE, carry=()) -> DataFrame:
    """prefix_id, key, status (kept, changed, removed, added), and per compared or carried column its `old_` and `new_` value (kept: of the old listing).

    `opened` are the leaves that differ. Other keys are kept without a join; a key's slot follows from its name, so both listings agree on it.
    """
    shown = [*compare, *(c for c in carry if c not in compare)]

    def side(rows, mark):
        inside = scale.join_small(leaf_of(rows), opened, LEAF, "left_semi")
        return inside.select("prefix_id", "key", F.lit(True).alias(f"in_{mark}"), *[F.col(c).alias(f"{mark}_{c}") for c in shown])

    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "kept").otherwise("changed")
    values = [f"{m}_{c}" for c in shown for m in ("old", "new")]
    joined = side(old, "old").join(side(new, "new"), ["prefix_id", "key"], "full").select("prefix_id", "key", status.alias("status"), *values)
    closed = scale.join_small(leaf_of(old), opened, LEAF, "left_anti")
    rest = closed.select("prefix_id", "key", F.lit("kept").alias("status"), *[F.col(c).alias(f"{m}_{c}") for c in shown for m in ("old", "new")])
    return joined.unionByName(rest)


def maintained_footprint(base: DataFrame, moved: DataFrame, new: DataFrame) -> DataFrame:
    """The footprint per (prefix_id, thing) after `moved`, from the one before (`base`: objects, bytes, oldest, newest).

    `moved` are changes with `thing`, old and new size and last_modified; kept rows may be left out. Counts and sums take the difference. The oldest and newest
    time stand unless a row that carried one has left; only such groups are read again from the new listing (classified).
    """
    gone, come = F.col("status").isin("removed", "changed"), F.col("status").isin("added", "changed")
    none = F.lit(0).cast("bigint")
    delta = moved.groupBy("prefix_id", "thing").agg(
        F.sum(come.cast("int") - gone.cast("int")).alias("dn"),
        (F.coalesce(F.sum(F.when(come, F.col("new_size"))), none) - F.coalesce(F.sum(F.when(gone, F.col("old_size"))), none)).alias("db"),
        F.min(F.when(gone, F.col("old_last_modified"))).alias("left_lo"), F.max(F.when(gone, F.col("old_last_modified"))).alias("left_hi"),
        F.min(F.when(come, F.col("new_last_modified"))).alias("come_lo"), F.max(F.when(come, F.col("new_last_modified"))).alias("come_hi"),
    )
    both = scale.pin(base.join(delta, ["prefix_id", "thing"], "full"))
    stale = (F.col("left_lo") <= F.col("oldest")) | (F.col("left_hi") >= F.col("newest"))
    total = both.select(
        "prefix_id", "thing",
        (F.coalesce("objects", F.lit(0)) + F.coalesce("dn", F.lit(0))).cast("bigint").alias("objects"),
        (F.coalesce("bytes", F.lit(0)) + F.coalesce("db", F.lit(0))).cast("bigint").alias("bytes"),
        F.least("oldest", "come_lo").alias("oldest"), F.greatest("newest", "come_hi").alias("newest"),
        F.coalesce(stale, F.lit(False)).alias("stale"),
    ).where("objects > 0")
    again = total.where("stale").select("prefix_id", "thing")
    seen = scale.join_small(new, again, ["prefix_id", "thing"], "left_semi").groupBy("prefix_id", "thing").agg(F.min("last_modified").alias("lo"), F.max("last_modified").alias("hi"))
    return total.join(seen, ["prefix_id", "thing"], "left").select(
        "prefix_id", "thing", "objects", "bytes", F.when(F.col("stale"), F.col("lo")).otherwise(F.col("oldest")).alias("oldest"), F.when(F.col("stale"), F.col("hi")).otherwise(F.col("newest")).alias("newest")
    )
