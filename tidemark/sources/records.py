"""Whole records of the archive log: a header line and the lines indented below it, also where a file split cuts between them.

A task goes through the lines of a split in their order. Lines are joined to records by the batch, with Arrow. What a task cannot
know is whether its first lines belong to a record of the split before, and whether its last record goes on in the next split. So a split
gives its whole records and at most two pieces: `head` (lines before its first header) and `tail` (its last
record). All of it is written once. Only the pieces are shuffled, two rows per split, and joined in file order: a tail takes
the heads that follow it, over any number of splits without a header.

Defined cases: blank lines inside a record belong to it, other blank lines are no records; lines before a file's first header form a
record without a header; lines end with LF or CRLF; a record must fit into a task's memory, a file need not; the order of files does not matter.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- Fixed value: how continuation lines are marked --------------------------------------
INDENT = " " * 8

PIECES = "file string, block bigint, part string, at bigint, text string"


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Consecutive lines as one text per group; groups begin at `starts`."""
    offsets = pa.array(np.r_[starts, len(lines)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines.cast(pa.string())), "\n")


def pieces(lines: DataFrame) -> DataFrame:
    """file, block, part (whole, head, tail), at (order inside the split), text, from lines (file, block, value) as a text scan gives them."""

    def run(batches):
        where, held, headed, count = None, [], False, 0

        def row(part, text):
            return pa.RecordBatch.from_arrays(
                [pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([part]), pa.array([count], pa.int64()), pa.array([text], pa.string())],
                [c.split()[0] for c in PIECES.split(", ")],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file"), np.asarray(batch.column("block"))
            names = files.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                here = (files[a].as_py(), int(blocks[a]))
                if here != where:
                    if held:
                        yield row("tail" if headed else "head", "\n".join(held))
                    where, held, headed, count = here, [], False, 0
                value = pc.utf8_rtrim(batch.column("value").slice(a, b - a), "\r")
                goes_on = pc.or_(pc.starts_with(value, INDENT), pc.equal(pc.utf8_trim_whitespace(value), "")).to_numpy(zero_copy_only=False)
                headers = np.flatnonzero(~goes_on)
                if not len(headers):
                    held.extend(value.to_pylist())
                    continue
                first, last = int(headers[0]), int(headers[-1])
                held.extend(value.slice(0, first).to_pylist())
                if held:
                    yield row("whole" if headed else "head", "\n".join(held))
                    count += 1
                if len(headers) > 1:
                    texts = _joined(value.slice(first, last - first), headers[:-1] - first)
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([where[0]] * n), pa.array([where[1]] * n, pa.int64()), pa.array(["whole"] * n), pa.array(range(count, count + n), pa.int64()), texts],
                        [c.split()[0] for c in PIECES.split(", ")],
                    )
                    count += n
                held, headed = value.slice(last).to_pylist(), True
        if held:
            yield row("tail" if headed else "head", "\n".join(held))

    return lines.select("file", "block", "value").mapInArrow(run, PIECES)


def stitched(found: DataFrame) -> DataFrame:
    """file, text: each tail with the heads that follow it in its file."""
    ends = found.where("part <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", "at")
    numbered = ends.withColumn("record", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(order))
    lines = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    return numbered.groupBy("file", "record").agg(lines.alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def assemble(lines: DataFrame, table: str | None = None) -> DataFrame:
    """file, record: one row per record of the lines (file, block, value). The pieces are written to `table` (a new one in the shared folder)."""
    spark = lines.sparkSession
    table = table or shared_path(spark, "log-pieces")
    pieces(lines).write.parquet(table)
    found = spark.read.schema(PIECES).parquet(table)
    both = found.where("part = 'whole'").select("file", "text").unionByName(stitched(found))
    text = F.regexp_replace(F.regexp_replace("text", r"\s+$", ""), "(^|\n)" + INDENT, "$1")
    return both.select("file", text.alias("record")).where("record <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: the lines of text files below a path, with the split each came from."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return assemble(read_lines(spark, path))
