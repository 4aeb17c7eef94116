"""Writers. All write in parallel, in as many files as there are tasks."""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import logtext, names
from tidemark.sources import stores
from tidemark.schema import BACKUP_FIELDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def backup_list_columns(backups: DataFrame) -> DataFrame:
    """The seven fields in their order, times as ISO text; null stays empty in the file."""
    return backups.select(
        *[(names.iso_seconds(c).alias(c) if c == "last_modified" else F.col(c)) for c in BACKUP_FIELDS]
    )


def write_backup_list(backups: DataFrame, path: str) -> None:
    """Tab-separated with header and CRLF line ends."""
    (
        backup_list_columns(backups)
        .write.option("sep", "\t")
        .option("header", "true")
        .option("lineSep", "\r\n")
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def sentinel_bodies(finished: DataFrame) -> DataFrame:
    """Sentinel JSON per backup, only where upload and stop both went well.

    `finished` has prefix_id, name, the three stop fields, spec, upload_good, stop_good.
    """
    return finished.where("upload_good and stop_good").select(
        "prefix_id",
        F.concat("name", F.lit("_backup_stop_sentinel.json")).alias("file"),
        F.to_json(
            F.struct(
                "wal_segment_backup_stop", "wal_segment_offset_backup_stop", "expanded_size_bytes", "spec"
            )
        ).alias("body"),
    )


def write_sentinels(finished: DataFrame, path: str) -> None:
    """The commit record of a batch of backups; call it last, after their volumes are written."""
    sentinel_bodies(finished).write.json(path)


def write_files(texts: DataFrame, root: str) -> int:
    """One file per row (path, below `root`, and text); returns how many. A repeated task writes the same files again.

    Files are opened by pyarrow's file systems (local, file:, hdfs:, s3:, gs:, abfs:) in the tasks.
    """

    def run(batches):
        fs, base = stores.open_store(root)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = f"{base.rstrip('/')}/{path}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at, compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return texts.select("path", "text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_sentinel_files(sentinels: DataFrame, homes: DataFrame, root: str) -> int:
    """A sentinel file per backup (prefix_id, name, body) in its prefix's home (prefix_id, home) below `root`."""
    placed = scale.join_small(sentinels, homes.select("prefix_id", "home"), "prefix_id")
    folder = F.concat_ws("/", F.nullif(F.col("home"), F.lit("")), F.concat(F.lit("basebackups_005/"), "name", F.lit("_backup_stop_sentinel.json")))
    return write_files(placed.select(folder.alias("path"), F.col("body").alias("text")), root)


def write_delete_plan(report: DataFrame, path: str) -> None:
    report.write.parquet(path)


def write_volumes(files: DataFrame, packed: DataFrame, path: str) -> None:
    """Consolidate many small files into their volumes.

    `files` has cluster_id, path, content. Rows are laid out by (cluster, volume)
    before writing, so that each volume becomes one file; a volume is bounded in
    bytes and members, and so is a task's output file. Contents are shuffled once, to their volumes, while the packing (a
    short row per file) fits a broadcast; beyond that they are shuffled to it first.
    """
    placed = scale.join_small(files, packed.select("cluster_id", "path", "volume", "ord"), ["cluster_id", "path"])
    (
        placed.repartition("cluster_id", "volume")
        .sortWithinPartitions("cluster_id", "volume", "ord")
        .write.partitionBy("cluster_id", "volume")
        .parquet(path)
    )


def read_volumes(spark: SparkSession, path: str, fields="path string, content string, ord bigint") -> DataFrame:
    """Members of all volumes; filters on cluster_id and volume prune folders.

    `fields` is the schema of the members. Cluster ids are always text, so that
    ids made of digits keep their leading zeros.
    """
    return spark.read.schema(f"{fields}, cluster_id string, volume bigint").parquet(path)


def log_lines(events: DataFrame) -> DataFrame:
    """Log records (time, pid, pairs, msg, detail, hint) as text, one line per line of the record."""
    record = logtext.render_record("msg", "detail", "hint", logtext.render_structured("time", "pid", "pairs"))
    return events.select(F.explode(F.split(record, "\n")).alias("value"))


def write_records(events: DataFrame, path: str, head="archive INFO     ") -> None:
    """Records as the archiver logs them: a header line, all other lines indented below it."""
    record = logtext.render_record("msg", "detail", "hint", logtext.render_structured("time", "pid", "pairs"))
    events.select(logtext.render_indented(record, head).alias("value")).write.text(path)


def write_log(events: DataFrame, path: str) -> None:
    record = logtext.render_record("msg", "detail", "hint", logtext.render_structured("time", "pid", "pairs"))
    events.select(record.alias("value")).write.text(path)
