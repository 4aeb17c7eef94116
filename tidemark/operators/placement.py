"""Which prefix an object belongs to, when prefixes lie inside one another: the longest one above it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale

MOST_DEPTHS = 64


def _depth(c):
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path="url", max_rows=scale.BROADCAST_ROWS, max_bytes=scale.BROADCAST_BYTES) -> DataFrame:
    """`rows` with the `prefix_id` of the deepest `home` (prefixes: prefix_id, home) that is a folder above `path`; null where none is.

    Folder names must match whole: `a/b` is not above `a/bc`. Of equal homes the least id wins. Paths and homes are compared as they are, but for
    trailing slashes of homes.

    The folders above a path that can be a home are those at the depths homes have. While the prefixes are small, each depth is one broadcast
    look-up and the rows are not shuffled. Beyond that the folders are unfolded and matched in one salted join, and the deepest match wins.
    """
    homes = prefixes.select("prefix_id", F.rtrim(F.col("home"), F.lit("/")).alias("home")).groupBy("home").agg(F.min("prefix_id").alias("prefix_id"))
    homes = scale.pin(homes.withColumn("depth", _depth(F.col("home"))))
    depths = sorted(r["depth"] for r in homes.select("depth").distinct().limit(MOST_DEPTHS + 1).collect())
    if len(depths) > MOST_DEPTHS:
        raise ValueError(f"prefixes lie at more than {MOST_DEPTHS} depths")
    below = _depth(F.col(path))

    def folder(depth):
        return F.when(below > depth, F.substring_index(F.col(path), "/", depth + 1))

    count, size = scale._size(homes)
    if count <= max_rows and size <= max_bytes:
        found = rows
        for d in depths:
            at = homes.where(F.col("depth") == d).select(F.col("home").alias(f"_home{d}"), F.col("prefix_id").alias(f"_id{d}"))
            found = found.join(F.broadcast(at), folder(d) == F.col(f"_home{d}"), "left")
        ids = [F.col(f"_id{d}") for d in reversed(depths)] or [F.lit(None).cast("bigint")]
        return found.select(*rows.columns, F.coalesce(*ids).alias("prefix_id"))
    paths = rows.select(path).distinct()
    unfolded = paths.select(path, F.explode(F.array_compact(F.array(*[folder(d) for d in depths]))).alias("home"))
    matched = scale.salted_join(unfolded, homes.select("home", "depth"), ["home"])
    deepest = matched.groupBy(path).agg(F.max("depth").alias("_depth"))
    placed = rows.join(deepest, path, "left").withColumn("home", F.when(F.col("_depth").isNotNull(), F.call_function("substring_index", F.col(path), F.lit("/"), F.col("_depth") + 1)))
    return scale.salted_join(placed, homes.select("home", "prefix_id"), ["home"], "left").select(*rows.columns, "prefix_id")
