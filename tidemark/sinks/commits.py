"""Backups written from a stream, exactly once: members first, the sentinel last.

Rows are members of a backup (prefix_id, name, path, content) and, once upload and stop have both ended well, its stop (`body`, the sentinel's
JSON; path null). Each micro-batch writes its members into a folder of its own number, and after that its sentinels into another. A batch
that is run again overwrites the same two folders. A batch that stops in between has left members without a sentinel, and
readers go by sentinels: such a backup is not there yet.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scale

MEMBERS = "prefix_id bigint, name string, path string, content string"
SENTINELS = "prefix_id bigint, name string, body string"


def write_members(rows: DataFrame, batch: int, root: str) -> None:
    members = rows.where("path is not null").select("prefix_id", "name", "path", "content")
    members.write.mode("overwrite").parquet(f"{root}/members/batch={batch}")


def write_sentinels(rows: DataFrame, batch: int, root: str) -> None:
    stops = rows.where("path is null and body is not null").groupBy("prefix_id", "name").agg(F.max("body").alias("body"))
    stops.write.mode("overwrite").parquet(f"{root}/sentinels/batch={batch}")


def write_batch(rows: DataFrame, batch: int, root: str) -> None:
    """Both folders of a batch, in the order that makes the sentinel the commit."""
    write_members(rows, batch, root)
    write_sentinels(rows, batch, root)


def commit_available(stream: DataFrame, root: str, write=write_batch):
    """Drive a stream of rows into `root` over what is available now; its progress lies there too."""
    query = (
        stream.writeStream.foreachBatch(lambda df, batch: write(df, batch, root))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def committed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(sentinels, members of backups that have one); what a batch left without its sentinel is not seen.

    A member may lie in an earlier batch than its sentinel.
    """
    sentinels = spark.read.schema(SENTINELS + ", batch bigint").parquet(f"{root}/sentinels").drop("batch").dropDuplicates(["prefix_id", "name"])
    members = spark.read.schema(MEMBERS + ", batch bigint").parquet(f"{root}/members")
    return sentinels, scale.join_small(members, sentinels.select("prefix_id", "name"), ["prefix_id", "name"], "left_semi")
