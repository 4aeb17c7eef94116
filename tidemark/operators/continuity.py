"""Continuity of the segment sequence: gaps, islands, cover of backups, restore points.

Sequences are cut into chunks of CHUNK_SEGMENTS positions. A chunk of one
timeline of one prefix holds at most that many distinct segments, so no task
ever sees a whole prefix; prefixes meet again in tables with a few rows per chunk.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import names

LINE = ["prefix_id", "tli"]


def archived_positions(classified: DataFrame, chunk_segments=scale.CHUNK_SEGMENTS) -> DataFrame:
    """Distinct archived segments as (prefix_id, tli, chunk, pos).

    Names with a segment part above FF have no place in the sequence and are
    left out here. The explicit repartition serves the distinct, the windows and
    the aggregates that follow.
    """
    return (
        classified.where("thing = 'segment'")
        .select(*LINE, names.position_of_sn("sn").alias("pos"))
        .where("pos is not null")
        .withColumn("chunk", scale.chunk_of("pos", chunk_segments))
        .repartition(*LINE, "chunk")
        .dropDuplicates([*LINE, "chunk", "pos"])
    )


def gaps(positions: DataFrame, skip_ff=False) -> DataFrame:
    """Missing ranges between archived segments of one timeline.

    `skip_ff` tolerates a lone missing ..FF, which old servers never write.
    """
    p = scale.previous_row(positions, LINE, ["pos"], "chunk", ["pos"], spread=False)
    prev = F.col("prev.pos")
    found = p.where(prev.isNotNull() & (F.col("pos") > prev + 1)).select(
        *LINE, (prev + 1).alias("gap_from"), (F.col("pos") - 1).alias("gap_to")
    )
    if skip_ff:
        found = found.where(~((F.col("gap_from") == F.col("gap_to")) & (F.col("gap_from") % names.SEGS == 255)))
    return found.withColumn("missing", F.col("gap_to") - F.col("gap_from") + 1)


def partial_islands(positions: DataFrame) -> DataFrame:
    """Unbroken runs, cut at chunk borders."""
    w = Window.partitionBy(*LINE, "chunk").orderBy("pos")
    return (
        positions.withColumn("_run", F.col("pos") - F.row_number().over(w))
        .groupBy(*LINE, "chunk", "_run")
        .agg(F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), F.count(F.lit(1)).alias("segments"))
        .drop("_run")
    )


def islands(positions: DataFrame, chunk_segments=scale.CHUNK_SEGMENTS) -> DataFrame:
    """Unbroken runs (from, to, count) per prefix and timeline.

    Only runs that touch a chunk border, at most two per chunk, are merged
    across chunks; all others are final as they are.
    """
    part = partial_islands(positions)
    touches = (F.col("from_pos") % chunk_segments == 0) | ((F.col("to_pos") + 1) % chunk_segments == 0)
    inner = part.where(~touches).select(*LINE, "from_pos", "to_pos", "segments")
    w = Window.partitionBy(*LINE).orderBy("from_pos")
    starts = F.when(F.col("from_pos") == F.lag("to_pos").over(w) + 1, 0).otherwise(1)
    merged = (
        part.where(touches)
        .withColumn("_new", starts)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*LINE, "_run")
        .agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"), F.sum("segments").alias("segments"))
        .drop("_run")
    )
    return inner.unionByName(merged)


def restarts(classified: DataFrame, chunk_segments=scale.CHUNK_SEGMENTS) -> DataFrame:
    """Segments at which the sequence of a prefix starts anew: first, after a gap, or on another timeline.

    Here timelines are followed in segment order, so a switch shows as a change
    of `tli` between neighbours.
    """
    p = (
        classified.where("thing = 'segment'")
        .select(*LINE, names.position_of_sn("sn").alias("pos"))
        .where("pos is not null")
        .withColumn("chunk", scale.chunk_of("pos", chunk_segments))
        .repartition("prefix_id", "chunk")
        .dropDuplicates(["prefix_id", "chunk", "pos", "tli"])
    )
    r = scale.previous_row(p, ["prefix_id"], ["pos", "tli"], "chunk", ["pos", "tli"], spread=False)
    kind = (
        F.when(F.col("prev").isNull(), "first")
        .when(F.col("prev.tli") != F.col("tli"), "timeline")
        .when(F.col("pos") > F.col("prev.pos") + 1, "gap")
    )
    return r.select("prefix_id", "tli", "pos", kind.alias("kind")).where("kind is not null")


def segments_after(points: DataFrame, how_many: int) -> DataFrame:
    """The next `how_many` segments after each point (columns tli, log, seg), as name and position.

    Stops at the last possible segment.
    """
    if how_many < 0:
        raise ValueError("how_many must not be negative")
    start = names.position("log", "seg")
    last = 0xFFFFFFFF * names.SEGS + names.SEGS - 1
    steps = F.sequence(F.lit(1), F.lit(how_many)) if how_many else F.array().cast("array<int>")
    return (
        points.withColumn("step", F.explode(steps))
        .withColumn("pos", start + F.col("step"))
        .where(F.col("pos") <= last)
        .withColumn("segment", F.concat("tli", names.sn_of_position("pos")))
    )


def missing_of(expected: DataFrame, positions: DataFrame) -> DataFrame:
    """Expected segments (prefix_id, tli, pos) that are not archived."""
    return expected.join(positions.select(*LINE, "pos"), [*LINE, "pos"], "left_anti")


def gap_segments(found: DataFrame, step=4096) -> DataFrame:
    """Each missing segment of each gap; long gaps are cut in steps, so that no array is longer than `step` + 1."""
    return scale.unfold(found, "gap_from", "gap_to", "pos", step).select(
        *LINE, "pos", F.concat("tli", names.sn_of_position("pos")).alias("segment")
    )


def backup_cover(ranges: DataFrame, positions: DataFrame, chunk_segments=scale.CHUNK_SEGMENTS) -> DataFrame:
    """Is every segment from start to stop of a backup archived on the backup's timeline?

    `ranges` has prefix_id, tli, name, start_pos, stop_pos; a range that ends before
    it starts, or without a stop, is not covered. Each distinct start looks up the run that begins at or
    before it and reaches as far as that run goes, so a range costs one row however
    long it is, and a chunk of the time line never holds more rows than twice its segments.
    """
    starts = ranges.where("start_pos <= stop_pos").select(*LINE, F.col("start_pos").alias("at")).distinct()
    looking = starts.select(*LINE, "at", F.lit(1).alias("is_start"), F.lit(None).cast("bigint").alias("run_to"))
    runs = islands(positions, chunk_segments).select(
        *LINE, F.col("from_pos").alias("at"), F.lit(0).alias("is_start"), F.col("to_pos").alias("run_to")
    )
    both = runs.unionByName(looking).withColumn("chunk", scale.chunk_of("at", chunk_segments))
    filled = scale.latest_value(both, LINE, ["at", "is_start"], "chunk", "run_to", "reach")
    reached = filled.where("is_start = 1").select(*LINE, F.col("at").alias("start_pos"), "reach")
    return ranges.join(reached, [*LINE, "start_pos"], "left").select(
        "prefix_id",
        "tli",
        "name",
        "start_pos",
        "stop_pos",
        (F.col("stop_pos") - F.col("start_pos") + 1).alias("expected"),
        F.coalesce(F.col("reach") >= F.col("stop_pos"), F.lit(False)).alias("covered"),
    )


def backup_ranges(backups: DataFrame, detail: DataFrame) -> DataFrame:
    """Start and stop position of every complete backup that has its detail."""
    d = detail.select("prefix_id", "name", "wal_segment_backup_stop")
    stop = F.substring("wal_segment_backup_stop", 9, 16)
    return backups.join(d, ["prefix_id", "name"]).select(
        "prefix_id",
        "tli",
        "name",
        names.position_of_sn("sn").alias("start_pos"),
        names.position_of_sn(stop).alias("stop_pos"),
    )


def restore_points(backups: DataFrame, targets: DataFrame) -> DataFrame:
    """As-of: for each target (request_id, prefix_id, target) the newest backup finished by then.

    Backups and targets are merged on the time axis, cut into ranges with equal numbers of rows, and filled forward inside
    ranges; these hand on their last backup. It does not matter how the times lie: all may be of one second.
    """
    b = backups.select(
        "prefix_id",
        F.col("last_modified").alias("at"),
        F.lit(0).alias("kind"),
        F.col("key").alias("tie"),
        F.struct("name", "last_modified").alias("backup"),
        F.lit(None).cast("bigint").alias("request_id"),
    )
    t = targets.select(
        "prefix_id",
        F.col("target").alias("at"),
        F.lit(1).alias("kind"),
        F.col("request_id").cast("string").alias("tie"),
        F.lit(None).cast(b.schema["backup"].dataType).alias("backup"),
        F.col("request_id").cast("bigint").alias("request_id"),
    )
    both = scale.range_chunks(b.unionByName(t), ["prefix_id"], ["at", "kind", "tie"])
    filled = scale.latest_value(both, ["prefix_id"], ["at", "kind", "tie"], "chunk", "backup", "usable")
    return filled.where("kind = 1").select(
        "request_id",
        "prefix_id",
        F.col("at").alias("target"),
        F.col("usable.name").alias("name"),
        F.col("usable.last_modified").alias("last_modified"),
    )


def backup_cadence(backups: DataFrame, chunk_segments=scale.CHUNK_SEGMENTS) -> DataFrame:
    """Time and WAL distance of each complete backup from the one before it in segment order."""
    p = backups.select(
        "prefix_id", "name", "sn", "last_modified", names.position_of_sn("sn").alias("pos")
    ).where("pos is not null").withColumn("chunk", scale.chunk_of("pos", chunk_segments))
    r = scale.previous_row(p, ["prefix_id"], ["pos", "name"], "chunk", ["pos", "name", "last_modified"])
    return r.select(
        "prefix_id",
        "name",
        F.col("prev.name").alias("previous_name"),
        (F.col("pos") - F.col("prev.pos")).alias("segments_between"),
        (
            F.unix_timestamp(F.col("last_modified").cast("timestamp"))
            - F.unix_timestamp(F.col("prev.last_modified").cast("timestamp"))
        ).alias("seconds_between"),
    )
