"""Inventory exports described by a manifest: which files belong to the export, how long they are, their checksums and what keys they hold.

The manifest is the export's word on what is complete. Nothing is listed: the files are those that the manifest names, checked against
it before they are read, and left out if their key range rules a prefix out. The manifest is written last, so an
export that stopped early has none.
"""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import listing

#: A row per file of an export reaches the driver, which names the files to read.
MOST_FILES = 200_000
ROWS_PER_FILE = 1_000_000
COLUMNS = ("prefix_id", "bucket", "key", "size", "last_modified")
FILES = "key string, size bigint, MD5checksum string, rows bigint, lowPrefix bigint, highPrefix bigint, lowKey string, highKey string"
MANIFEST = f"version string, fileFormat string, fileSchema string, files array<struct<{FILES.replace(' string', ': string').replace(' bigint', ': bigint')}>>"


def write_export(inventory: DataFrame, path: str, rows_per_file=ROWS_PER_FILE) -> None:
    """The listing as Parquet files ordered by prefix and key, and their manifest (`manifest`, one JSON text)."""
    spark = inventory.sparkSession
    ordered = inventory.select(*COLUMNS).repartitionByRange("prefix_id", "key").sortWithinPartitions("prefix_id", "key")
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    name = F.concat(F.lit("data/"), F.col("_metadata.file_name"))
    held = spark.read.parquet(f"{path}/data").groupBy(name.alias("key")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("prefix_id").alias("lowPrefix"), F.max("prefix_id").alias("highPrefix"), F.min("key").alias("lowKey"), F.max("key").alias("highKey")
    )
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select(
        F.concat(F.lit("data/"), F.element_at(F.split("path", "/"), -1)).alias("key"), F.col("length").alias("size"), F.md5("content").alias("MD5checksum")
    )
    files = stored.join(held, "key", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    listed = files.agg(F.sort_array(F.collect_list(F.struct(*[c.split()[0] for c in FILES.split(", ")]))).alias("files"))
    text = F.to_json(F.struct(F.lit("1").alias("version"), F.lit("Parquet").alias("fileFormat"), F.lit(", ".join(COLUMNS)).alias("fileSchema"), "files"))
    listed.select(text.alias("value")).coalesce(1).write.text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of an export: fileFormat, fileSchema, key, size, MD5checksum and, where the export states them, rows and key range."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    return text.select("m.fileFormat", "m.fileSchema", F.explode("m.files").alias("f")).select("fileFormat", "fileSchema", "f.*")


def pruned(files: DataFrame, prefix_id=None, key_prefix=None) -> DataFrame:
    """Files that may hold keys of the prefix; files without a stated range may hold any."""
    if prefix_id is not None:
        unknown = F.col("lowPrefix").isNull() | F.col("highPrefix").isNull()
        files = files.where(unknown | ((F.col("lowPrefix") <= prefix_id) & (F.col("highPrefix") >= prefix_id)))
    if key_prefix:
        unknown = F.col("lowKey").isNull() | F.col("highKey").isNull()
        files = files.where(unknown | ((F.substring("lowKey", 1, len(key_prefix)) <= F.lit(key_prefix)) & (F.col("highKey") >= key_prefix)))
    return files


def check(spark: SparkSession, files: list, root: str, checksums=False) -> None:
    """Raise unless every named file is there with the stated size (and checksum, which reads it all)."""
    paths = [f"{root}/{f['key']}" for f in files]
    if not paths:
        return
    try:
        stored = spark.read.format("binaryFile").load(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"the export is incomplete: {str(e).splitlines()[0]}") from None
        raise
    found = stored.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), (F.md5("content") if checksums else F.lit(None).cast("string")).alias("md5"))
    want = spark.createDataFrame([(f["key"].split("/")[-1], f["size"], f["MD5checksum"] if checksums else None) for f in files], "name string, want_size bigint, want_md5 string")
    both = want.join(found, "name", "left")
    wrong = both.where(~F.col("size").eqNullSafe(F.col("want_size")) | (F.col("want_md5").isNotNull() & ~F.col("md5").eqNullSafe(F.col("want_md5"))))
    first = wrong.limit(3).collect()
    if first:
        raise ValueError(f"files of the export differ from its manifest: {json.dumps([r['name'] for r in first])}")


def read_export(spark: SparkSession, root: str, manifest=None, of_prefix=None, key_prefix=None, checksums=False, **columns) -> DataFrame:
    """Listing rows of an export below `root` (its manifest: `root`/manifest), of one prefix or key range if asked.

    `columns` maps our names to those of the export, as for `read_inventory`. CSV files have the columns the manifest states and
    URL-encoded keys; other formats carry their schema.
    """
    table = read_manifest(spark, manifest or f"{root}/manifest")
    files = pruned(table, of_prefix, key_prefix).limit(MOST_FILES + 1).collect()
    if len(files) > MOST_FILES:
        raise ValueError(f"an export of more than {MOST_FILES} files; read it by prefix")
    check(spark, files, root, checksums)
    if not files:
        stated = table.limit(1).collect()
        if not stated:
            raise FileNotFoundError(f"no manifest with files below {root}")
        return spark.createDataFrame([], "prefix_id bigint, bucket string, key string, size bigint, last_modified timestamp")
    fmt, schema = files[0]["fileFormat"].lower(), [c.strip() for c in files[0]["fileSchema"].split(",")]
    paths = [f"{root}/{f['key']}" for f in files]
    if fmt == "csv":
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in schema)).csv(paths)
        key = columns.get("key", "key")
        raw = raw.withColumn(key, F.url_decode(F.col(key)))
    else:
        raw = spark.read.format(fmt).load(paths)
    rows = listing.placed_columns(raw, **columns)
    if of_prefix is not None:
        rows = rows.where(F.col("prefix_id") == of_prefix)
    return rows.where(F.col("key").startswith(key_prefix)) if key_prefix else rows
