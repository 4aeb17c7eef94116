"""Backups: which are complete, their detail, the latest, the one asked for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed, names
from tidemark.schema import BACKUP_FIELDS, SENTINEL_BODY


def attach_layout(inventory: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add scheme, store_name and path_prefix to each listed key."""
    parsed = prefixes.select("prefix_id", names.parse_url("url").alias("u")).select(
        "prefix_id", "u.scheme", "u.store_name", "u.path_prefix"
    )
    return scale.join_small(inventory, parsed, "prefix_id")


def complete_backups(classified: DataFrame) -> DataFrame:
    """One row per complete backup, i.e. per sentinel; detail fields are still empty.

    The substring test repeats what the class says; it is there because it can
    reach the file scan and prunes the listing to sentinels early.
    """
    s = classified.where(F.col("key").contains(fixed.SENTINEL_SUFFIX)).where("thing = 'sentinel'")
    p = names.parse_sentinel_key("key")
    return s.select(
        "prefix_id",
        "bucket",
        "key",
        p["name"].alias("name"),
        "last_modified",
        p["wal_segment_backup_start"].alias("wal_segment_backup_start"),
        p["wal_segment_offset_backup_start"].alias("wal_segment_offset_backup_start"),
        "tli",
        "sn",
    )


def parse_detail(sentinels: DataFrame) -> DataFrame:
    """Known keys of the sentinel JSON as columns, every other key as a variant (`extra`)."""
    b = F.from_json("body", SENTINEL_BODY)
    return sentinels.select(
        "prefix_id",
        "name",
        b["expanded_size_bytes"].alias("expanded_size_bytes"),
        b["wal_segment_backup_stop"].alias("wal_segment_backup_stop"),
        b["wal_segment_offset_backup_stop"].alias("wal_segment_offset_backup_stop"),
        b["spec"].alias("spec"),
        F.try_parse_json("body").alias("extra"),
    )


def tablespaces(sentinels: DataFrame) -> DataFrame:
    """One row per tablespace with its location and link, taken from the dynamic keys of the spec."""
    spec = parse_detail(sentinels).select("prefix_id", "name", "spec", F.variant_get("extra", "$.spec", "variant").alias("v"))
    one = spec.select("prefix_id", "name", F.explode("spec.tablespaces").alias("tablespace"), "v")
    where = F.from_json(F.to_json("v"), "map<string,string>")
    place = F.from_json(F.try_element_at(where, F.col("tablespace")), "loc string, link string")
    return one.select("prefix_id", "name", "tablespace", place["loc"].alias("loc"), place["link"].alias("link"))


def backup_list(backups: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """The seven listing fields. Without `detail` no join is planned and those fields are null."""
    if detail is None:
        return backups.select(
            "prefix_id",
            "name",
            "last_modified",
            F.lit(None).cast("bigint").alias("expanded_size_bytes"),
            "wal_segment_backup_start",
            "wal_segment_offset_backup_start",
            F.lit(None).cast("string").alias("wal_segment_backup_stop"),
            F.lit(None).cast("string").alias("wal_segment_offset_backup_stop"),
        )
    d = detail.select(
        "prefix_id", "name", "expanded_size_bytes", "wal_segment_backup_stop", "wal_segment_offset_backup_stop"
    )
    return backups.join(d, ["prefix_id", "name"], "left").select("prefix_id", *BACKUP_FIELDS)


def latest_backup(backups: DataFrame) -> DataFrame:
    """Newest complete backup of each prefix by modification time; equal times: last in key order."""
    return scale.latest_rows(backups, ["prefix_id"], "last_modified", ["key"])


def find_backups(backups: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve requests (request_id, prefix_id, query): a backup name, or LATEST.

    Any other text is an error. Requests with no match keep a null name, so that
    `match_counts` can report them.
    """
    checked = requests.withColumn(
        "query",
        F.when((F.col("query") == "LATEST") | F.col("query").rlike(fixed.RX_BACKUP), F.col("query")).otherwise(
            F.raise_error(F.concat(F.lit("invalid backup query: "), "query")).cast("string")
        ),
    )
    named = checked.where("query <> 'LATEST'").join(
        backups.select("prefix_id", F.col("name").alias("query"), "name", "last_modified"), ["prefix_id", "query"], "left"
    )
    named = named.select("request_id", "prefix_id", "query", "name", "last_modified")
    newest = latest_backup(backups).select("prefix_id", "name", "last_modified")
    latest = scale.join_small(checked.where("query = 'LATEST'"), newest, "prefix_id", "left").select(
        "request_id", "prefix_id", "query", "name", "last_modified"
    )
    return named.unionByName(latest)


def match_counts(found: DataFrame) -> DataFrame:
    """Requests with the number of backups found; a fetch needs exactly one."""
    return found.groupBy("request_id", "prefix_id", "query").agg(
        F.count("name").alias("matches"), (F.count("name") == 1).alias("fetchable")
    )


def requested_backups(backups: DataFrame, requests: DataFrame) -> DataFrame:
    """Backups named in a request set."""
    return backups.join(requests.select("prefix_id", "name"), ["prefix_id", "name"], "left_semi")


def incomplete_backups(classified: DataFrame) -> DataFrame:
    """Backup directories without a sentinel, with what they still occupy."""
    inside = classified.where(F.col("thing").isin("version", "volume"))
    dirs = inside.groupBy("prefix_id", "backup_name").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")
    )
    done = classified.where(F.col("key").contains(fixed.SENTINEL_SUFFIX)).where("thing = 'sentinel'")
    return dirs.join(done.select("prefix_id", "backup_name"), ["prefix_id", "backup_name"], "left_anti")


def volumes_of(classified: DataFrame) -> DataFrame:
    """Restorable volumes; `expected` is false for keys that do not look like a volume."""
    last = names.base_name("key")
    return classified.where("thing = 'volume'").select(
        "prefix_id",
        "backup_name",
        "key",
        "size",
        last.alias("volume"),
        last.rlike(fixed.RX_VOLUME).alias("expected"),
    )


def compression(classified: DataFrame, detail: DataFrame) -> DataFrame:
    """Stored bytes over expanded bytes for each complete backup."""
    stored = (
        classified.where("thing = 'volume'")
        .groupBy("prefix_id", F.col("backup_name").alias("name"))
        .agg(F.sum("size").alias("stored_bytes"), F.count(F.lit(1)).alias("volumes"))
    )
    return stored.join(detail.select("prefix_id", "name", "expanded_size_bytes"), ["prefix_id", "name"]).select(
        "prefix_id",
        "name",
        "volumes",
        "stored_bytes",
        "expanded_size_bytes",
        F.try_divide(F.col("stored_bytes").cast("double"), F.col("expanded_size_bytes").cast("double")).alias("ratio"),
    )
