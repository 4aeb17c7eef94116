"""Estimates kept as mergeable sketches: distinct keys per prefix and day, rate quantiles per prefix and hour.

A sketch table is written once per day or hour. Any range of days, any set of prefixes, is answered by merging
sketches of a few kilobytes; the listing or the log is not read again. Building is one pass with partial sketches on the map side, so a
prefix that holds a third of all rows sends one sketch per task.

Bounds. An HLL sketch of 2^k registers has a relative standard error of about 1.04 / sqrt(2^k) (`distinct_error`, 0.8 % for the default). A KLL
sketch with parameter k = 200 places a quantile within 1.65 % of its rank (`RANK_ERROR`) at 99 % confidence; merging keeps both.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed

REGISTERS = 14
RANK_ERROR = 0.0165


def distinct_error(registers=REGISTERS) -> float:
    return 1.04 / 2 ** (registers / 2)


def distinct_sketches(inventory: DataFrame, registers=REGISTERS) -> DataFrame:
    """prefix_id, day, sketch of the keys last written that day."""
    return inventory.groupBy("prefix_id", F.to_date("last_modified").alias("day")).agg(F.hll_sketch_agg("key", registers).alias("sketch"))


def distinct_between(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """prefix_id, first_day, last_day and the estimated number of distinct keys, for each range of days (a small table; both ends count)."""
    joined = sketches.join(F.broadcast(ranges.limit(MOST_RANGES)), F.col("day").between(F.col("first_day"), F.col("last_day")))
    return joined.groupBy("prefix_id", "first_day", "last_day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("keys_estimate"))


#: Ranges asked for at once: a report, not data.
MOST_RANGES = 10_000


def rate_sketches(events: DataFrame) -> DataFrame:
    """prefix, hour, finished uploads with a rate, and a sketch of their rates."""
    done = events.where((F.col("action") == fixed.ACTION_PUSH) & (F.col("state") == "complete") & F.col("rate").isNotNull())
    return done.groupBy("prefix", F.date_trunc("hour", "time").alias("hour")).agg(F.count(F.lit(1)).alias("uploads"), F.kll_sketch_agg_double("rate").alias("sketch"))


def rate_quantiles(sketches: DataFrame, by=("prefix",), quantiles=(0.5, 0.95)) -> DataFrame:
    """Uploads and rate quantiles per `by` (any columns of the sketch table), from sketches alone."""
    merged = sketches.groupBy(*by).agg(F.sum("uploads").alias("uploads"), F.kll_merge_agg_double("sketch").alias("sketch"))
    shown = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles]
    return merged.select(*by, "uploads", *shown)
