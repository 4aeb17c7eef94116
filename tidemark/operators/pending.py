"""Archive-status markers of a fleet: what is pending, skipped, missing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed, names


def ready_markers(status: DataFrame) -> DataFrame:
    """Markers of segments waiting to be archived; history files and finished ones are left out."""
    return status.where(F.col("file_name").rlike(fixed.RX_SEGMENT_READY)).select(
        "cluster_id", F.substring("file_name", 1, 24).alias("segment")
    )


def oldest_pending(status: DataFrame, how_many: int) -> DataFrame:
    """First `how_many` pending segments of each cluster in name order, with the cluster's backlog.

    The backlog is a plain count joined afterwards: counting over a window would
    bring all markers of a cluster into one task.
    """
    ready = ready_markers(status)
    first = scale.top_n(ready, ["cluster_id"], ["segment"], how_many, spread="segment")
    backlog = ready.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("backlog"))
    return first.join(backlog, "cluster_id").select("cluster_id", "rn", "segment", "backlog")


def push_batch(status: DataFrame, explicit: DataFrame, concurrency: int) -> DataFrame:
    """What one push would start: the named segment first, then the oldest other ones up to `concurrency`."""
    named = explicit.select("cluster_id", "segment")
    others = ready_markers(status).join(named, ["cluster_id", "segment"], "left_anti")
    rest = (
        scale.top_n(others, ["cluster_id"], ["segment"], max(concurrency - 1, 0), spread="segment")
        .join(named.select("cluster_id"), "cluster_id", "left_semi")
        .select("cluster_id", "segment", (F.col("rn") + 1).alias("slot"), F.lit(False).alias("explicit"))
    )
    return named.select("cluster_id", "segment", F.lit(1).alias("slot"), F.lit(True).alias("explicit")).unionByName(rest)


def reconcile(status: DataFrame, archived: DataFrame) -> DataFrame:
    """Markers against archived segments, one row per (cluster_id, segment).

    `archived` has cluster_id and segment. Keys are single segments, so the join is balanced.
    """
    seg = names.extract("file_name", fixed.RX_SEGMENT + r"\.(ready|done)", 4)
    marks = (
        status.withColumn("mark", seg)
        .where("mark is not null")
        .groupBy("cluster_id", F.substring("file_name", 1, 24).alias("segment"))
        .agg(F.max(F.col("mark") == "ready").alias("ready"))
    )
    there = archived.select("cluster_id", "segment").distinct().withColumn("archived", F.lit(True))
    state = (
        F.when(F.col("ready").isNull(), "archived-unmarked")
        .when(F.col("ready") & F.col("archived").isNotNull(), "ready-archived")
        .when(F.col("ready"), "ready-missing")
        .when(F.col("archived").isNotNull(), "done-archived")
        .otherwise("done-missing")
    )
    return marks.join(there, ["cluster_id", "segment"], "full").select("cluster_id", "segment", state.alias("state"))


def push_states(ready: DataFrame, files: DataFrame) -> DataFrame:
    """Markers whose segment file is gone: skipped, or an error for the explicitly named one."""
    gone = ready.join(files.select("cluster_id", "segment"), ["cluster_id", "segment"], "left_anti")
    explicit = F.col("explicit") if "explicit" in ready.columns else F.lit(False)
    return gone.select("cluster_id", "segment", F.when(explicit, "error").otherwise("skip").alias("state"))
