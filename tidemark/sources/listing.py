"""Object listings: a live tree, or an inventory export of a store."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a path of any file system Spark reaches (s3a, gs, abfss, file): key, size, last_modified.

    The content is never read: the column is pruned.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("url"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
        .withColumn("key", names.parse_file_key("url"))
    )


def read_content(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Objects with their content as bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.col("path").alias("url"), F.col("length").alias("size"), "content")


def read_inventory(spark: SparkSession, path: str, fmt="parquet", **columns) -> DataFrame:
    """An inventory export; `columns` maps our names to those of the export.

    Keys are normalised, and the first of several candidate time columns wins.
    """
    return placed_columns(spark.read.format(fmt).load(path), **columns)


def placed_columns(raw: DataFrame, **columns) -> DataFrame:
    """The columns of a listing out of those of an export; `columns` names the export's, several candidates, or an expression."""

    def pick(name):
        source = columns.get(name, name)
        if isinstance(source, Column):
            return source
        return names.modified(*source) if isinstance(source, (list, tuple)) else F.col(source)

    return raw.select(
        pick("prefix_id").cast("bigint").alias("prefix_id"),
        pick("bucket").cast("string").alias("bucket"),
        names.normal_key(pick("key")).alias("key"),
        pick("size").cast("bigint").alias("size"),
        pick("last_modified").cast("timestamp").alias("last_modified"),
    )


def volumes_in_backup(inventory: DataFrame, path_prefix: str, segment: str, offset: str) -> DataFrame:
    """Listing of one backup's volume directory; the prefix test reaches the file scan."""
    root = f"{path_prefix}basebackups_005/base_{segment}_{offset}/tar_partitions/"
    return inventory.where(F.col("key").startswith(root))
