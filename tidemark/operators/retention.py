"""Deletion plans. Nothing is ever deleted: the result is a table of keys."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import classify, fixed, names

QUARANTINE_HINT = "No rule of the archive layout names this key, so it is left alone. Look where it comes from."


def retention_horizon(backups: DataFrame, keep: int) -> DataFrame:
    """Oldest of the `keep` newest complete backups of each prefix (of all, if there are fewer).

    Order is by segment number, timelines ignored. Only `keep` rows per prefix
    and map task reach the shuffle.
    """
    if keep < 1:
        raise ValueError("keep at least one backup")
    newest = scale.top_n(
        backups.select("prefix_id", "sn", "key"), ["prefix_id"], [F.desc("sn"), F.asc("key")], keep
    )
    return newest.groupBy("prefix_id").agg(
        F.min("sn").alias("horizon_sn"), F.max_by("key", "rn").alias("horizon_key"), F.count(F.lit(1)).alias("retained")
    )


def retention_message(backups: DataFrame, prefixes: DataFrame, keep: int, scheme="scheme") -> DataFrame:
    """What `retain` would say for each prefix, including those without any backup.

    The hint names the horizon backup; `scheme` is a column of the backups or a literal.
    """
    url = names.render_url(names.col(scheme), F.col("bucket"), F.col("key"))
    placed = scale.join_small(
        backups.select("prefix_id", F.col("key"), url.alias("_url")), retention_horizon(backups, keep), "prefix_id"
    )
    found = placed.groupBy("prefix_id").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.when(F.col("key") == F.col("horizon_key"), F.col("_url")), True).alias("_url")
    )
    total = scale.join_small(prefixes.select("prefix_id"), found, "prefix_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    n = F.col("n")
    return total.select(
        "prefix_id",
        n.alias("backups"),
        F.greatest(n - keep, F.lit(0)).alias("deleting"),
        F.when(n == 0, fixed.RETAIN_NONE)
        .when(n > keep, F.format_string(fixed.RETAIN_SOME, n - keep))
        .when(n == 1, fixed.RETAIN_ONE)
        .otherwise(F.format_string(fixed.RETAIN_ALL, n))
        .alias("message"),
        F.when(n == 0, fixed.RETAIN_NONE_DETAIL).when(n > keep, F.format_string(fixed.RETAIN_SOME_DETAIL, n)).alias("detail"),
        F.when(n > 0, F.format_string(fixed.RETAIN_HINT, "_url")).alias("hint"),
    )


def delete_before(classified: DataFrame, horizons: DataFrame) -> DataFrame:
    """Every key strictly before its prefix's horizon: backup data and WAL in one pass.

    Incomplete backups are swept too; equal segments, history files and
    unexpected keys stay. A prefix without a horizon keeps everything.
    """
    placed = classified.where(F.col("thing").isin(*classify.DELETABLE))
    return (
        scale.join_small(placed, horizons.select("prefix_id", "horizon_sn"), "prefix_id")
        .where(F.col("sn") < F.col("horizon_sn"))
        .drop("horizon_sn")
    )


def mark_before(classified: DataFrame, horizons: DataFrame) -> DataFrame:
    """Every listed key with a `deleted` flag; prefixes without a horizon keep all."""
    joined = scale.join_small(classified, horizons.select("prefix_id", "horizon_sn"), "prefix_id", "left")
    return joined.withColumn("deleted", F.coalesce(F.col("sn") < F.col("horizon_sn"), F.lit(False))).drop("horizon_sn")


def delete_retain(classified: DataFrame, backups: DataFrame, keep: int) -> DataFrame:
    return delete_before(classified, retention_horizon(backups, keep))


def horizons_of_names(requests: DataFrame) -> DataFrame:
    """Horizons out of backup names; anything else is an error. The lowest wins per prefix."""
    p = names.parse_backup_name("name")
    sn = F.when(p.isNotNull(), F.concat(p["log"], p["seg"])).otherwise(
        F.raise_error(F.concat(F.lit("not a backup name: "), "name")).cast("string")
    )
    return requests.groupBy("prefix_id").agg(F.min(sn).alias("horizon_sn"))


def delete_everything(classified: DataFrame) -> DataFrame:
    """All keys in both areas, whatever they look like."""
    what = F.when(F.col("area") == "base", fixed.EVERYTHING_TEXT["base"]).otherwise(fixed.EVERYTHING_TEXT["wal"])
    return classified.where("area in ('base', 'wal')").withColumn("what", what)


def delete_old_versions(inventory: DataFrame, path_prefix="path_prefix") -> DataFrame:
    """Keys under the areas of obsolete format versions."""
    k = F.col("key")
    rel = k.substr(F.length(path_prefix) + 1, F.length(k))
    area = F.regexp_extract(rel, "^(basebackups|wal)_([0-9]{3})/", 1)
    version = F.regexp_extract(rel, "^(basebackups|wal)_([0-9]{3})/", 2)
    return (
        inventory.where(k.startswith(F.col(path_prefix)))
        .withColumn("version", version)
        .where(F.col("version").isin(*fixed.OBSOLETE_VERSIONS))
        .withColumn("area", F.when(area == "wal", "wal").otherwise("base"))
    )


def delete_report(plan: DataFrame, scheme="scheme", dry_run=True) -> DataFrame:
    """One record per key: the type of thing, its URL and, in a dry run, the hint."""
    texts = F.create_map(*[F.lit(x) for kv in fixed.THING_TEXT.items() for x in kv])
    what = F.col("what") if "what" in plan.columns else F.try_element_at(texts, F.col("thing"))
    url = names.render_url(names.col(scheme), F.col("bucket"), F.col("key"))
    return plan.select(
        "prefix_id",
        "key",
        url.alias("url"),
        what.alias("thing"),
        F.concat(F.lit("deleting "), what).alias("msg"),
        F.concat(F.lit("The key being deleted is "), url, F.lit(".")).alias("detail"),
        (F.lit(fixed.DRY_RUN_HINT) if dry_run else F.lit(None).cast("string")).alias("hint"),
        F.lit(dry_run).alias("dry_run"),
    )


def delete_pages(plan: DataFrame, page_keys=fixed.DELETE_PAGE_KEYS) -> DataFrame:
    """Cut the keys of each bucket into pages of at most `page_keys`.

    Every key gets exactly one page, and only the last page of a bucket can be
    short. The order of keys in pages is free, so a hot bucket is numbered in hash
    pieces and shuffled once.
    """
    rank = scale.numbered(plan, ["bucket"], ["key", "prefix_id"], "key", out="key_number")
    return rank.withColumn("page", F.floor((F.col("key_number") - 1) / page_keys).cast("bigint"))


def page_ids(pages: DataFrame) -> DataFrame:
    """Add `page_id`, the number of a page over all buckets; the offsets are one row per bucket."""
    counts = pages.groupBy("bucket").agg((F.max("page") + 1).alias("_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return scale.join_small(pages, first, "bucket").withColumn("page_id", F.col("_first") + F.col("page")).drop("_first")


def page_check(pages: DataFrame) -> DataFrame:
    """Pages by size; a page, known by its id alone, may only hold keys of one bucket."""
    return pages.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("keys"),
        (F.min("bucket") == F.max("bucket")).alias("one_bucket"),
    )


def mixed_pages(batches: DataFrame) -> DataFrame:
    """For page tables made elsewhere (page, bucket): how many buckets each page mixes."""
    return batches.groupBy("page").agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_distinct("bucket").alias("buckets"),
        (F.count_distinct("bucket") == 1).alias("homogeneous"),
    )


def delete_between(classified: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """Keys that the horizons `high` delete and the horizons `low` do not: one sweep, no shuffle of keys.

    A prefix without a horizon in `low` deletes nothing there.
    """
    both = high.select("prefix_id", F.col("horizon_sn").alias("_high")).join(
        low.select("prefix_id", F.col("horizon_sn").alias("_low")), "prefix_id", "left"
    )
    placed = classified.where(F.col("thing").isin(*classify.DELETABLE))
    return (
        scale.join_small(placed, both, "prefix_id")
        .where((F.col("sn") < F.col("_high")) & (F.col("_low").isNull() | (F.col("sn") >= F.col("_low"))))
        .drop("_high", "_low")
    )


def plan_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Keys of the first plan that the second does not have."""
    return first.join(second.select("prefix_id", "key"), ["prefix_id", "key"], "left_anti")


def after_deletion(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """The listing as it would be once the plan is carried out."""
    return inventory.join(plan.select("prefix_id", "key"), ["prefix_id", "key"], "left_anti")


def quarantine(classified: DataFrame, scheme="scheme") -> DataFrame:
    """Unexpected keys with the reason and the warning: message, detail and a hint in our own words."""
    url = names.render_url(names.col(scheme), F.col("bucket"), F.col("key"))
    return classified.where("thing = 'unexpected'").select(
        "prefix_id",
        "key",
        "area",
        "reason",
        F.lit(fixed.UNEXPECTED_MSG).alias("msg"),
        F.format_string(fixed.UNEXPECTED_DETAIL, url, classify.reason_detail("reason")).alias("detail"),
        F.lit(QUARANTINE_HINT).alias("hint"),
    )
