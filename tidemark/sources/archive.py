"""Readers for sentinels, manifests, status markers and archive logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import placement
from tidemark.schema import ARCHIVE_STATUS, FILE_MANIFEST
from tidemark.sources import tree


def read_sentinels(spark: SparkSession, path_glob: str) -> DataFrame:
    """Sentinel files below a path as (url, name, start segment, body), one row per file; no other file is opened.

    Listed and read by tasks: the driver knows none of the files.
    """
    p = names.parse_sentinel_key("url")
    files = tree.list_files(spark, path_glob, "base_*_backup_stop_sentinel.json*").where(p.isNotNull())
    return tree.read_files(files).select("url", p["name"].alias("name"), p["wal_segment_backup_start"].alias("wal_segment_backup_start"), "body")


def _one_form(url):
    """Local files are named file:/ or file:/// by different readers."""
    return F.regexp_replace(F.regexp_replace(F.col(url), "^/+", "file:///"), "^file:/+", "file:///")


def placed_sentinels(spark: SparkSession, path_glob: str, homes: DataFrame) -> DataFrame:
    """Sentinel files with the prefix each belongs to (homes: prefix_id and the URL of its folder), as detail is parsed from.

    Prefixes may lie inside one another. A sentinel outside of all homes has no prefix and is left out.
    """
    found = read_sentinels(spark, path_glob).withColumn("url", _one_form("url"))
    return placement.longest_prefix(found, homes.select("prefix_id", _one_form("home").alias("home"))).where("prefix_id is not null").select(
        "prefix_id", "name", "wal_segment_backup_start", "body", "url"
    )


def read_manifest(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    """File manifests of clusters. Directories and links cannot be listed by Spark, so the manifest is an input."""
    r = spark.read.format(fmt).schema(FILE_MANIFEST)
    return (r.option("header", "true") if fmt == "csv" else r).load(path)


def read_status(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    """Archive-status markers (cluster_id, file_name)."""
    r = spark.read.format(fmt).schema(ARCHIVE_STATUS)
    return (r.option("header", "true") if fmt == "csv" else r).load(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Archive log lines as a batch (column `value`)."""
    return spark.read.text(path)


def stream_log(spark: SparkSession, path: str, files_per_batch=None) -> DataFrame:
    """Archive log lines as a stream over a folder of text files."""
    r = spark.readStream.format("text")
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", str(files_per_batch))
    return r.load(path)
