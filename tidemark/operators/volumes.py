"""Which files of a cluster belong into a backup, under which name, and their round trip through volumes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed, names


def select_members(manifest: DataFrame, work_dirs=()) -> DataFrame:
    """Keep the entries a backup takes. `path` is relative to the cluster directory.

    Some directories are kept as entries but not entered, some are dropped
    wholly, and a few top-level files are never taken. `ftype` is file, dir, link
    or dirlink (a link to a directory, which is only taken where it stands for a
    directory that is not entered). Behind a tablespace link only its own
    temporary directory is not entered, a directory is an entry of its own only if
    it holds no file, and the link itself is replaced by what lies behind it. A
    dangling link stays as an entry. `work_dirs` names directories of the
    archiver itself; like temporary ones they are kept, but not entered.
    """
    parts = F.split("path", "/")
    below = F.col("path").startswith(fixed.TABLESPACE_DIR + "/")
    space = F.when(below, F.get(parts, F.lit(1)))
    links = (
        manifest.where(below & (F.col("ftype") == "dirlink") & (F.size(parts) == 2))
        .select("cluster_id", space.alias("_space"), F.lit(True).alias("_linked"))
        .distinct()
    )
    marked = scale.join_small(manifest.withColumn("_space", space), links, ["cluster_id", "_space"], "left")
    linked = F.coalesce("_linked", F.lit(False))
    ruled = marked.where(F.when(linked, space_rule("path", "ftype")).otherwise(walk_rule("path", "ftype", work_dirs)))
    space_dir = linked & (F.col("ftype") == "dir") & (names.base_name("path") != fixed.TABLESPACE_DIR_NOT_ENTERED)
    holds = (
        ruled.where(linked & (F.col("ftype") != "dir")).select("cluster_id", names.dir_name("path").alias("path")).distinct()
    )
    dirs = (
        ruled.where(space_dir)
        .select(*manifest.columns)
        .dropDuplicates(["cluster_id", "path"])
        .join(holds, ["cluster_id", "path"], "left_anti")
    )
    return ruled.where(~space_dir).select(*manifest.columns).unionByName(dirs.select(*manifest.columns))


def walk_rule(path, ftype, work_dirs=()) -> Column:
    """Is an entry of the main walk taken?"""
    p, kind = names.col(path), names.col(ftype)
    parts = F.split(p, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    top = F.size(parts) == 1
    not_entered = (*fixed.DIRS_NOT_ENTERED, *work_dirs)
    last = F.element_at(parts, -1)
    in_top = F.get(parts, F.lit(0)).isin(*fixed.TOP_DIRS_NOT_ENTERED) & ~top
    in_any = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in not_entered]))
    lost = F.array_contains(dirs, fixed.DIR_DROPPED) | ((last == fixed.DIR_DROPPED) & (kind == "dir"))
    named = top & last.isin(*fixed.TOP_FILES_DROPPED) & (kind != "dir")
    stands_for_dir = last.isin(*not_entered) | (top & last.isin(*fixed.TOP_DIRS_NOT_ENTERED))
    return ~in_top & ~in_any & ~lost & ~named & ((kind != "dirlink") | stands_for_dir)


def space_rule(path, ftype) -> Column:
    """Is an entry at or behind a tablespace link taken?"""
    p, kind = names.col(path), names.col(ftype)
    parts = F.split(p, "/")
    n = F.size(parts)
    inner = F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0)))
    not_entered = fixed.TABLESPACE_DIR_NOT_ENTERED
    named = F.element_at(parts, -1) == not_entered
    return (n > 2) & ~F.array_contains(inner, not_entered) & ((kind != "dirlink") | named)


def tablespace_spec(manifest: DataFrame, base_prefix) -> DataFrame:
    """Links to directories under the tablespace directory as (tablespace, loc, link); loc ends in a slash.

    `path` is absolute here; the link is relative to the base prefix.
    """
    rel = names.member_name("path", base_prefix)
    loc = F.when(F.col("link_target").endswith("/"), F.col("link_target")).otherwise(F.concat("link_target", F.lit("/")))
    return (
        manifest.where(F.col("ftype") == "dirlink")
        .withColumn("link", rel)
        .where(F.col("link").rlike("^" + fixed.TABLESPACE_DIR + "/[^/]+$"))
        .select("cluster_id", names.base_name("path").alias("tablespace"), loc.alias("loc"), "link")
        .distinct()
    )


def spec_of(spaces: DataFrame, base_prefix: str) -> DataFrame:
    """One spec per cluster: base prefix, tablespace list and the map of locations."""
    entry = F.struct("tablespace", F.struct("loc", "link").alias("place"))
    return spaces.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        "cluster_id",
        F.lit(base_prefix).alias("base_prefix"),
        F.transform("e", lambda x: x["tablespace"]).alias("tablespaces"),
        F.map_from_arrays(
            F.transform("e", lambda x: x["tablespace"]), F.transform("e", lambda x: x["place"])
        ).alias("spaces"),
    )


def outside_root(manifest: DataFrame, root: str) -> DataFrame:
    """Entries that do not lie under the root; must be empty before packing."""
    return manifest.where(~F.col("path").startswith(root))


def presence(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Every entry with `there`: is it still there? One join serves the report of vanished entries and the archive of the others."""
    found = present.select("cluster_id", "path").distinct().withColumn("_there", F.lit(True))
    return manifest.join(found, ["cluster_id", "path"], "left").withColumn("there", F.coalesce("_there", F.lit(False))).drop("_there")


def unlinked(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Entries that vanished since the listing, as a report."""
    return manifest.join(present.select("cluster_id", "path"), ["cluster_id", "path"], "left_anti")


def still_there(manifest: DataFrame, present: DataFrame) -> DataFrame:
    return manifest.join(present.select("cluster_id", "path"), ["cluster_id", "path"], "left_semi")


def manifest_lines(packed: DataFrame) -> DataFrame:
    """name<TAB>size per member."""
    return packed.select("cluster_id", "volume", F.concat_ws("\t", "path", F.col("size").cast("string")).alias("line"))


def missing_after_restore(manifest: DataFrame, restored: DataFrame) -> DataFrame:
    """Manifest entries that the volumes do not give back."""
    return manifest.join(restored.select("cluster_id", "path"), ["cluster_id", "path"], "left_anti")
