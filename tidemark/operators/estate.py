"""The fleet as a whole: footprint, shared prefixes, snapshots, empty directories."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import names


def footprint(classified: DataFrame) -> DataFrame:
    """Bytes, objects and age by prefix and class, with subtotals.

    `level` is 0 for (prefix, class), 1 for a prefix, 3 for the fleet. The detail
    level is aggregated first, so the rollup only expands its few rows.
    """
    detail = classified.groupBy("prefix_id", "thing").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("b"),
        F.min("last_modified").alias("lo"),
        F.max("last_modified").alias("hi"),
    )
    return detail.rollup("prefix_id", "thing").agg(
        F.sum("n").alias("objects"),
        F.sum("b").alias("bytes"),
        F.min("lo").alias("oldest"),
        F.max("hi").alias("newest"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def shared_prefixes(writers: DataFrame) -> DataFrame:
    """Prefixes to which more than one database writes (columns path_prefix, db)."""
    pairs = writers.groupBy("path_prefix", "db").agg(F.count(F.lit(1)).alias("objects"))
    return (
        pairs.groupBy("path_prefix")
        .agg(F.count(F.lit(1)).alias("writers"), F.sum("objects").alias("objects"))
        .where("writers > 1")
    )


def distinct_estimate(inventory: DataFrame, rsd=0.02) -> DataFrame:
    """Approximate number of distinct objects per prefix, in one pass with fixed memory."""
    return inventory.groupBy("prefix_id").agg(F.approx_count_distinct("key", rsd).alias("keys_estimate"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of two listings with kept / changed / removed / added."""
    o = old.select("prefix_id", "key", F.col("size").alias("old_size"))
    n = new.select("prefix_id", "key", F.col("size").alias("new_size"))
    status = (
        F.when(F.col("old_size").isNull(), "added")
        .when(F.col("new_size").isNull(), "removed")
        .when(F.col("old_size") == F.col("new_size"), "kept")
        .otherwise("changed")
    )
    return o.join(n, ["prefix_id", "key"], "full").select("prefix_id", "key", status.alias("status"))


def common_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("prefix_id", "key", "size").intersect(new.select("prefix_id", "key", "size"))


def _shared_start(ends: DataFrame) -> DataFrame:
    """Add `shared`, the longest common start of `_lo` and `_hi`."""
    n = F.least(F.length("_lo"), F.length("_hi"))
    differs = F.expr(
        "filter(sequence(1, greatest(least(length(_lo), length(_hi)), 1)), i -> substring(_lo, i, 1) <> substring(_hi, i, 1))"
    )
    return ends.withColumn("shared", F.col("_lo").substr(F.lit(1), F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)))


def common_prefix(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Longest common prefix of all texts of a group, char by char, and its directory.

    It equals the common prefix of the smallest and the largest text, so the
    group itself is never gathered. Texts are first reduced to their folders (a hash aggregate); only the folders are
    ordered. That settles every group unless texts lie directly in the common folder: of those groups alone the texts are ordered.
    """
    t = F.col(text)
    folder = t.substr(F.lit(1), F.length(t) - F.length(F.substring_index(t, "/", -1)))
    folders = scale.pin(texts.select(key, folder.alias("_in")).distinct())
    top = _shared_start(folders.groupBy(key).agg(F.min("_in").alias("_lo"), F.max("_in").alias("_hi"))).select(key, "shared")
    top = scale.pin(top)
    open_ = scale.join_small(folders, top, key).where("_in = shared").select(key).distinct()
    direct = scale.join_small(texts.select(key, text), open_, key, "left_semi")
    ends = direct.groupBy(key).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi"))
    exact = _shared_start(ends).select(key, F.col("shared").alias("_exact"))
    both = scale.join_small(top, exact, key, "left")
    return both.select(key, F.coalesce("_exact", "shared").alias("common_prefix")).withColumn("common_dir", names.dir_name("common_prefix"))


def ancestors(path) -> Column:
    """All directories above a path, nearest last ('a/b/c' gives 'a', 'a/b')."""
    parts = F.split(names.col(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def mark_deleted(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """The listing with a `deleted` flag, for a plan that is only known as a table of keys."""
    gone = plan.select("prefix_id", "key", F.lit(True).alias("_gone"))
    joined = inventory.select("prefix_id", "key").join(gone, ["prefix_id", "key"], "left")
    return joined.select("prefix_id", "key", F.col("_gone").isNotNull().alias("deleted"))


def emptied_dirs(marked: DataFrame) -> DataFrame:
    """Directories that a plan leaves empty, one level deep, per prefix.

    `marked` is the listing with a `deleted` flag. A parent of deleted keys goes
    if no surviving key lies below it and no other deleted key lay in a deeper
    directory of it. The common directory of the deleted keys itself stays; it can
    only qualify where it is the sole parent of deleted keys in its prefix.

    Keys are reduced to directories first. Each directory then tells itself and
    those above it what it holds, and one more aggregate brings that together.
    """
    dirs = marked.groupBy("prefix_id", names.dir_name("key").alias("dir")).agg(
        F.count_if("deleted").alias("gone"), F.count_if(~F.col("deleted")).alias("left")
    )
    here = F.struct(F.col("dir"), F.col("gone"), F.lit(False).alias("below"), F.lit(0).alias("parents"))
    above = F.transform(
        F.when(F.col("dir").contains("/"), ancestors("dir")).otherwise(F.array().cast("array<string>")),
        lambda a: F.struct(a.alias("dir"), F.lit(0).cast("bigint").alias("gone"), (F.col("gone") > 0).alias("below"), F.lit(0).alias("parents")),
    )
    whole = F.struct(
        F.lit(None).cast("string").alias("dir"),
        F.lit(0).cast("bigint").alias("gone"),
        F.lit(False).alias("below"),
        (F.col("gone") > 0).cast("int").alias("parents"),
    )
    told = dirs.select("prefix_id", (F.col("left") > 0).alias("alive"), F.explode(F.concat(F.array(here, whole), above)).alias("d"))
    known = (
        told.groupBy("prefix_id", F.col("d.dir").alias("dir"))
        .agg(
            F.sum("d.gone").alias("deleted_keys"),
            F.max("alive").alias("alive"),
            F.max("d.below").alias("below"),
            F.sum("d.parents").alias("parents"),
        )
        .where("(dir is null and parents = 1) or (deleted_keys > 0 and not alive and not below)")
        .select("prefix_id", "dir", "deleted_keys")
    )
    known = scale.pin(known)
    sole = known.where("dir is null").select("prefix_id")
    return scale.join_small(known.where("dir is not null"), sole, "prefix_id", "left_anti")


def touched_dirs(paths: DataFrame, keys) -> DataFrame:
    """Distinct directories of a set of paths."""
    return paths.select(*keys, names.dir_name("path").alias("dir")).distinct()
