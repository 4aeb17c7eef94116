"""Registered queries: name -> (survey rows it covers, function of a session and a data folder)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify, fixed, logtext, names, sqlface
from tidemark.operators import catalog, continuity, digests, estate, events, packing, pending, retention, sketches, volumes
from tidemark.plans import derived as d
from tidemark.session import prepare, shared_path
from tidemark.sinks import archive as sink
from tidemark.sinks import commits
from tidemark.sources import archive as source
from tidemark.sources import inventory, listing, records
from tidemark.streaming import frontier, log_stream, sessions, uploads

KEEP = 5
PENDING = 10
AHEAD = 8

QUERIES: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {}


def query(name: str, covers: str):
    def add(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = (covers, run)
        return fn

    return add


def iso(c, alias=None):
    return names.iso_seconds(c).alias(alias or c)


# ---- listing and classes -----------------------------------------------------------------

@query("list_objects_classified", "P9 P11 P12 P13 M1 M3 M4")
def _(spark, sf):
    return d.classified(spark, sf).select(
        "prefix_id", "key", "size", iso("last_modified"), names.depth("key").alias("depth"), "area", "thing", "tli", "sn"
    )


@query("quarantine", "P10 P18")
def _(spark, sf):
    return retention.quarantine(d.classified(spark, sf), F.lit("s3"))


@query("classifier_exclusive", "A11")
def _(spark, sf):
    wal = d.classified_wal(spark, sf)
    n = classify.wal_matches(names.base_name("key"))
    return wal.groupBy("prefix_id").agg(F.max(n).cast("bigint").alias("most_matches"), (F.max(n) <= 1).alias("exclusive"))


@query("volume_listing", "SC11")
def _(spark, sf):
    return catalog.volumes_of(d.classified_base(spark, sf)).drop("size")


@query("footprint", "A12")
def _(spark, sf):
    f = estate.footprint(d.classified(spark, sf))
    return f.select("prefix_id", "thing", "objects", "bytes", iso("oldest"), iso("newest"), "level")


@query("distinct_estimate", "A17")
def _(spark, sf):
    """Keys of a listing are distinct, so the estimate must come close to the plain count."""
    inv = d.inventory(spark, sf)
    exact = inv.groupBy("prefix_id").agg(F.count(F.lit(1)).alias("objects"))
    both = estate.distinct_estimate(inv).join(exact, "prefix_id")
    near = F.abs(F.col("keys_estimate") - F.col("objects")) <= F.col("objects") * 0.1
    return both.select("prefix_id", "objects", near.alias("estimate_near"))


# ---- backups -----------------------------------------------------------------------------

def _backups(spark, sf):
    return catalog.complete_backups(d.classified_base(spark, sf))


def _detail(spark, sf):
    return catalog.parse_detail(d.sentinel_json(spark, sf))


@query("backup_list", "P3 FL2 T2 M5")
def _(spark, sf):
    b = catalog.backup_list(_backups(spark, sf))
    return b.withColumn("last_modified", names.iso_seconds("last_modified"))


@query("backup_list_detail", "J1 F15 M6")
def _(spark, sf):
    b = catalog.backup_list(_backups(spark, sf), _detail(spark, sf))
    return b.withColumn("last_modified", names.iso_seconds("last_modified"))


@query("latest_backup", "A3 T3")
def _(spark, sf):
    return catalog.latest_backup(_backups(spark, sf)).select("prefix_id", "name", iso("last_modified"))


def _requests(spark, sf):
    b = d._order_backups(spark, sf)
    return b.select(
        F.col("o_orderkey").alias("request_id"),
        "prefix_id",
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "LATEST").otherwise(F.col("name")).alias("query"),
    )


@query("find_backup", "FL3 A4")
def _(spark, sf):
    found = catalog.find_backups(_backups(spark, sf), _requests(spark, sf))
    return catalog.match_counts(found)


@query("requested_backups", "J3")
def _(spark, sf):
    asked = d._order_backups(spark, sf).where("o_orderstatus = 'O'").select("prefix_id", "name")
    return catalog.requested_backups(_backups(spark, sf), asked).select("prefix_id", "name", iso("last_modified"))


@query("incomplete_backups", "J11")
def _(spark, sf):
    return catalog.incomplete_backups(d.classified_base(spark, sf))


@query("compression_ratio", "J14")
def _(spark, sf):
    c = catalog.compression(d.classified_base(spark, sf), _detail(spark, sf))
    return c.withColumn("ratio", F.round("ratio", 6))


@query("tablespaces", "F19 M7")
def _(spark, sf):
    return catalog.tablespaces(d.sentinel_json(spark, sf))


@query("backup_cadence", "W9")
def _(spark, sf):
    return continuity.backup_cadence(_backups(spark, sf))


@query("restore_point", "J13")
def _(spark, sf):
    targets = (
        d._order_backups(spark, sf)
        .where("o_orderpriority = '3-MEDIUM'")
        .select(F.col("o_orderkey").alias("request_id"), "prefix_id", F.col("last_modified").alias("target"))
    )
    r = continuity.restore_points(_backups(spark, sf), targets)
    return r.select("request_id", "prefix_id", iso("target"), "name", iso("last_modified"))


# ---- deletion ----------------------------------------------------------------------------

def _retain(spark, sf):
    """One scan of the listing feeds the sweep; the horizon reads the backup part of it once more."""
    return retention.delete_retain(d.classified(spark, sf), _backups(spark, sf), KEEP)


@query("delete_retain", "W1 U3 FL1 J2")
def _(spark, sf):
    return _retain(spark, sf).select("prefix_id", "key", "size", "thing", "sn")


@query("delete_retain_summary", "W1 U3 A12")
def _(spark, sf):
    return (
        _retain(spark, sf)
        .groupBy("prefix_id", "thing")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), F.max("last_modified").alias("newest"))
        .withColumn("newest", names.iso_seconds("newest"))
    )


@query("retention_horizon", "W1")
def _(spark, sf):
    return retention.retention_horizon(_backups(spark, sf), KEEP)


@query("retention_message", "A2")
def _(spark, sf):
    return retention.retention_message(_backups(spark, sf), d.fleet_prefixes(spark, sf), KEEP, F.lit("s3"))


@query("delete_before", "J2 U2 P2 FL1")
def _(spark, sf):
    asked = catalog.latest_backup(_backups(spark, sf)).select("prefix_id", "name")
    plan = retention.delete_before(d.classified(spark, sf), retention.horizons_of_names(asked))
    return plan.select("prefix_id", "key", "size", "thing", "sn")


@query("delete_everything", "U1")
def _(spark, sf):
    return retention.delete_everything(d.classified(spark, sf)).select("prefix_id", "key", "size", "what")


@query("delete_report", "SK3 P10")
def _(spark, sf):
    """The report is written as a table and read back."""
    path = shared_path(spark, "delete-plan")
    sink.write_delete_plan(retention.delete_report(_retain(spark, sf), F.lit("s3")), path)
    return spark.read.parquet(path)


def _old_keys(spark, sf):
    version = F.concat(F.lit("_00"), (F.col("size") % 6).cast("string"), F.lit("/"))
    return d.inventory(spark, sf).withColumn("key", F.replace("key", F.lit("_005/"), version))


@query("delete_old_versions", "U4 FL17")
def _(spark, sf):
    return retention.delete_old_versions(_old_keys(spark, sf)).select("prefix_id", "key", "version", "area")


@query("version_check", "FL17")
def _(spark, sf):
    v = names.layout_version("key")
    return (
        _old_keys(spark, sf)
        .groupBy("prefix_id", v.alias("version"))
        .agg(F.count(F.lit(1)).alias("objects"))
        .withColumn("state", names.version_state("version"))
    )


@query("delete_pages", "W2")
def _(spark, sf):
    plan = _retain(spark, sf).select("prefix_id", "bucket", "key")
    return retention.delete_pages(plan).select("bucket", "prefix_id", "key", "key_number", "page")


@query("delete_page_sizes", "W2 A7")
def _(spark, sf):
    pages = retention.delete_pages(_retain(spark, sf).select("prefix_id", "bucket", "key"))
    return retention.page_check(retention.page_ids(pages))


@query("mixed_pages", "A7")
def _(spark, sf):
    batches = d.table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).alias("page"),
        F.concat(F.lit("bucket"), F.floor(F.col("l_orderkey") / 1500).cast("string")).alias("bucket"),
    )
    return retention.mixed_pages(batches)


@query("plan_rerun", "U5")
def _(spark, sf):
    """What the same retention would still delete after its first plan was carried out: nothing."""
    inv = d.inventory(spark, sf)
    left = retention.after_deletion(inv, _retain(spark, sf))
    again = classify.classify_keys(left)
    plan = retention.delete_retain(again, catalog.complete_backups(again), KEEP)
    counts = plan.agg(F.count(F.lit(1)).alias("still_deleted"))
    return counts


@query("plan_difference", "U5")
def _(spark, sf):
    """Keys that keeping 5 backups would delete and keeping 20 would not."""
    b = _backups(spark, sf)
    fewer, more = retention.retention_horizon(b, KEEP), retention.retention_horizon(b, 4 * KEEP)
    return retention.delete_between(d.classified(spark, sf), more, fewer).select("prefix_id", "key", "thing")


@query("empty_dirs", "A16 A8")
def _(spark, sf):
    horizons = retention.retention_horizon(_backups(spark, sf), KEEP)
    return estate.emptied_dirs(retention.mark_before(d.classified(spark, sf), horizons))


# ---- segments ----------------------------------------------------------------------------

def _segment_names(spark, sf):
    return d.inv_wal(spark, sf).select("prefix_id", names.base_name("key").alias("name"))


@query("segment_parse", "P1 P4")
def _(spark, sf):
    s = names.parse_segment("name")
    return _segment_names(spark, sf).select(
        "prefix_id",
        "name",
        s["tli"].alias("tli"),
        s["log"].alias("log"),
        s["seg"].alias("seg"),
        names.segment_number(s["log"], s["seg"]).cast("bigint").alias("number"),
    )


def _numbered(spark, sf):
    """Segment names with the edges (seg 00 and FF) well represented: one per order key."""
    k = F.col("o_orderkey")
    return d.table(spark, sf, "orders").select(
        k.alias("k"), names.hex8(F.floor(k / 256)).alias("log"), names.hex8(k % 256).alias("seg")
    )


@query("segment_next", "P5")
def _(spark, sf):
    n = names.next_segment("log", "seg")
    return _numbered(spark, sf).select("k", n["log"].alias("next_log"), n["seg"].alias("next_seg"))


@query("segment_prev", "P6")
def _(spark, sf):
    n = names.try_previous_segment("log", "seg")
    return _numbered(spark, sf).select("k", n["log"].alias("prev_log"), n["seg"].alias("prev_seg"))


def _positions(spark, sf):
    return continuity.archived_positions(d.classified_wal(spark, sf))


@query("wal_gaps", "W5")
def _(spark, sf):
    return continuity.gaps(_positions(spark, sf))


@query("wal_gaps_skip_ff", "W5")
def _(spark, sf):
    return continuity.gaps(_positions(spark, sf), skip_ff=True)


@query("wal_islands", "W7")
def _(spark, sf):
    return continuity.islands(_positions(spark, sf))


@query("wal_restarts", "W6")
def _(spark, sf):
    """Orders put every other segment on a second timeline of the same prefix."""
    two = d.classified_wal(spark, sf).withColumn(
        "tli", F.when(F.col("size") > 25600, "00000009").otherwise(F.col("tli"))
    )
    return continuity.restarts(two)


@query("segments_after", "W8 T4 M12")
def _(spark, sf):
    points = _backups(spark, sf).select(
        "prefix_id", "name", "tli", F.substring("sn", 1, 8).alias("log"), F.substring("sn", 9, 8).alias("seg")
    )
    return continuity.segments_after(points, AHEAD).select("prefix_id", "name", F.col("step").cast("bigint").alias("step"), "segment")


@query("missing_segments", "J4")
def _(spark, sf):
    return continuity.gap_segments(continuity.gaps(_positions(spark, sf)))


@query("missing_next_segments", "J4 W8")
def _(spark, sf):
    points = _backups(spark, sf).select(
        "prefix_id", "tli", F.substring("sn", 1, 8).alias("log"), F.substring("sn", 9, 8).alias("seg")
    )
    expected = continuity.segments_after(points, AHEAD).select("prefix_id", "tli", "pos", "segment").distinct()
    return continuity.missing_of(expected, _positions(spark, sf)).select("prefix_id", "segment")


@query("backup_covered", "J12")
def _(spark, sf):
    ranges = continuity.backup_ranges(_backups(spark, sf), _detail(spark, sf))
    return continuity.backup_cover(ranges, _positions(spark, sf))


# ---- volumes -----------------------------------------------------------------------------

def _packed(spark, sf):
    return packing.pack(d.file_manifest(spark, sf), d.MANIFEST_MAX_BYTES, d.MANIFEST_MAX_MEMBERS)


@query("volume_pack", "W4 X3 M8 M9")
def _(spark, sf):
    return _packed(spark, sf).select("cluster_id", "path", "size", "volume")


@query("volume_sizes", "A1 A10")
def _(spark, sf):
    return packing.backup_sizes(_packed(spark, sf))


@query("volume_too_big", "FL10")
def _(spark, sf):
    return packing.too_big(d.file_manifest(spark, sf), 10_000)


@query("manifest_lines", "F21 F2")
def _(spark, sf):
    lines = volumes.manifest_lines(_packed(spark, sf))
    return lines.select("cluster_id", names.volume_name("volume").alias("volume_name"), "line")


@query("manifest_filter", "FL4 FL5 FL6 FL7 FL8 SC4")
def _(spark, sf):
    return volumes.select_members(d.cluster_tree(spark, sf)).select("cluster_id", "path", "ftype")


@query("tablespace_spec", "P15 A9")
def _(spark, sf):
    root = F.concat(F.lit("/pg/"), "cluster_id", F.lit("/"))
    absolute = d.cluster_tree(spark, sf).withColumn("path", F.concat(root, "path"))
    return volumes.tablespace_spec(absolute, root)


@query("member_names", "P14 FL9 F7")
def _(spark, sf):
    root = F.concat(F.lit("/pg/"), "cluster_id", F.lit("/"))
    absolute = d.file_manifest(spark, sf).withColumn("path", F.concat(root, "path"))
    return absolute.select(
        "cluster_id",
        names.member_name("path", root).alias("member"),
        names.base_name("path").alias("base_name"),
        names.dir_name("path").alias("dir_name"),
    )


@query("outside_root", "FL9")
def _(spark, sf):
    return volumes.outside_root(d.file_manifest(spark, sf), "en/").select("cluster_id", "path")


@query("unlinked_members", "J10")
def _(spark, sf):
    """Documents with a label stand for files still there."""
    m = d.file_manifest(spark, sf)
    there = d.table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    present = m.join(there, "ord", "left_semi").select("cluster_id", "path")
    return volumes.presence(m, present).select("cluster_id", "path", F.when(F.col("there"), "archive").otherwise("skip").alias("state"))


@query("common_prefix", "A8")
def _(spark, sf):
    return estate.common_prefix(d.classified(spark, sf).where("tli is not null"), "prefix_id", "key")


@query("touched_dirs", "A9")
def _(spark, sf):
    return estate.touched_dirs(d.file_manifest(spark, sf), ["cluster_id"])


@query("volume_round_trip", "SK5 SK6 SC5 J10")
def _(spark, sf):
    """Documents are written into volumes, read back and compared with what went in."""
    m = d.file_manifest(spark, sf)
    content = d.table(spark, sf, "documents").select(
        F.col("source").alias("cluster_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
    )
    path = shared_path(spark, "volumes")
    sink.write_volumes(content, _packed(spark, sf), path)
    back = sink.read_volumes(spark, path)
    joined = m.select("cluster_id", "path").join(
        back.select("cluster_id", "path", "volume", "content"), ["cluster_id", "path"], "left"
    )
    return joined.select(
        "cluster_id", "path", F.col("volume").cast("bigint").alias("volume"), F.md5("content").alias("content_md5")
    )


# ---- markers -----------------------------------------------------------------------------

@query("ready_markers", "SC3 T1 M10")
def _(spark, sf):
    return pending.ready_markers(d.archive_status(spark, sf))


@query("pending_oldest", "W3 T1 T5")
def _(spark, sf):
    return pending.oldest_pending(d.archive_status(spark, sf), PENDING).withColumn("rn", F.col("rn").cast("bigint"))


@query("push_batch", "W3 T5")
def _(spark, sf):
    """The newest pending segment of each cluster is the one the server names."""
    status = d.archive_status(spark, sf)
    named = pending.ready_markers(status).groupBy("cluster_id").agg(F.max("segment").alias("segment"))
    return pending.push_batch(status, named, PENDING).withColumn("slot", F.col("slot").cast("bigint"))


@query("status_reconcile", "J8")
def _(spark, sf):
    return pending.reconcile(d.archive_status(spark, sf), d.archived_segments(spark, sf))


@query("skipped_markers", "J9")
def _(spark, sf):
    return pending.push_states(pending.ready_markers(d.archive_status(spark, sf)), d.segment_files(spark, sf))


# ---- the fleet ---------------------------------------------------------------------------

@query("shared_prefix", "A13")
def _(spark, sf):
    writers = d.table(spark, sf, "lineitem").select(
        F.concat(F.lit("store"), F.floor(F.col("l_suppkey") / 2).cast("string")).alias("path_prefix"),
        F.col("l_suppkey").alias("db"),
    )
    return estate.shared_prefixes(writers)


def _snapshots(spark, sf, kept=False):
    """Two listings of the same prefixes: shipped line items by return flag overlap in part. `kept`: out of a table written once."""
    inv = d.inv_wal(spark, sf)
    if kept:
        path = shared_path(spark, "listing")
        inv.write.parquet(path)
        inv = spark.read.schema(inv.schema).parquet(path)
    old = inv.where("not endswith(key, '.partial')")
    new = inv.where("not endswith(key, '.tmp')").withColumn(
        "size", F.when(F.col("size") > 40960, F.col("size") + 1).otherwise(F.col("size"))
    )
    return old, new


@query("inventory_diff", "U6")
def _(spark, sf):
    return estate.snapshot_changes(*_snapshots(spark, sf))


@query("inventory_common", "U6")
def _(spark, sf):
    return estate.common_keys(*_snapshots(spark, sf))


def _digests(spark, listed, name):
    path = shared_path(spark, f"digests-{name}")
    digests.write_digests(listed, path, compare=("size",))
    return digests.read_digests(spark, path)


def _moved(spark, sf, carry=()):
    old, new = _snapshots(spark, sf, kept=True)
    opened = digests.open_leaves(_digests(spark, old, "old"), _digests(spark, new, "new"))
    return old, new, digests.changes(old, new, opened, compare=("size",), carry=carry)


@query("inventory_changes", "U6")
def _(spark, sf):
    """The same as inventory_diff, by digests: only keys in leaves that differ are joined."""
    return _moved(spark, sf)[2].select("prefix_id", "key", "status")


@query("footprint_maintained", "A12 U6")
def _(spark, sf):
    """The footprint of the older listing, carried on to the newer one by what changed."""
    old, new, moved = _moved(spark, sf, carry=("last_modified", "path_prefix"))
    rows = moved.where("status <> 'kept'").withColumn("path_prefix", F.coalesce("new_path_prefix", "old_path_prefix"))
    rows = rows.select("prefix_id", F.lit("").alias("bucket"), "key", "path_prefix", "status", "old_size", "new_size", "old_last_modified", "new_last_modified")
    things = classify.classify_keys(rows)
    base = estate.footprint(classify.classify_keys(old)).where("level = 0").select("prefix_id", "thing", "objects", "bytes", "oldest", "newest")
    f = digests.maintained_footprint(base, things, classify.classify_keys(new))
    return f.select("prefix_id", "thing", "objects", "bytes", iso("oldest"), iso("newest"))


def _day_ranges(spark, sf):
    """Every month of the listing, and every year."""
    days = d.inventory(spark, sf).select(F.to_date("last_modified").alias("d"))
    spans = [days.select(F.trunc("d", unit).alias("first_day"), F.date_sub(F.add_months(F.trunc("d", unit), n), 1).alias("last_day")).distinct() for unit, n in (("month", 1), ("year", 12))]
    return spans[0].unionByName(spans[1])


def _day_estimates(spark, sf):
    path = shared_path(spark, "distinct")
    sketches.distinct_sketches(d.inventory(spark, sf)).write.parquet(path)
    return sketches.distinct_between(spark.read.parquet(path), _day_ranges(spark, sf))


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query("distinct_of_days", "A17")
def _(spark, sf):
    """Distinct keys of every month and year from daily sketches, held against the exact count."""
    exact = d.inventory(spark, sf).join(F.broadcast(_day_ranges(spark, sf)), F.to_date("last_modified").between(F.col("first_day"), F.col("last_day")))
    exact = exact.groupBy("prefix_id", "first_day", "last_day").agg(F.count(F.lit(1)).alias("objects"))
    both = exact.join(_day_estimates(spark, sf), ["prefix_id", "first_day", "last_day"])
    near = F.abs(F.col("keys_estimate") - F.col("objects")) <= 4 * sketches.distinct_error() * F.col("objects") + 1
    return both.select("prefix_id", _day("first_day"), _day("last_day"), "objects", near.alias("within_stated_error"))


@query("distinct_estimates", "A17")
def _(spark, sf):
    """The estimates themselves, and their stated relative standard error."""
    e = _day_estimates(spark, sf)
    return e.select("prefix_id", _day("first_day"), _day("last_day"), "keys_estimate", F.lit(sketches.distinct_error()).alias("stated_error"))


@query("rate_quantiles", "A14")
def _(spark, sf):
    """Rate quantiles per prefix and day, merged from hourly sketches."""
    path = shared_path(spark, "rates")
    sketches.rate_sketches(_events(spark, sf, "time", "action", "prefix", "state", "rate")).write.parquet(path)
    by_day = spark.read.parquet(path).withColumn("day", F.to_date("hour"))
    return sketches.rate_quantiles(by_day, ("prefix", "day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("inventory_export", "SC1")
def _(spark, sf):
    """The listing is exported with a manifest and read back by it."""
    path = shared_path(spark, "export")
    inventory.write_export(d.inventory(spark, sf), path)
    return inventory.read_export(spark, path, checksums=True).select("prefix_id", "bucket", "key", "size", iso("last_modified"))


@query("prefix_parse", "P7 FL11 M2")
def _(spark, sf):
    u = names.parse_url("url")
    return d.prefixes(spark, sf).select(
        "prefix_id",
        u["scheme"].alias("scheme"),
        u["store_name"].alias("store_name"),
        u["path_prefix"].alias("path_prefix"),
        names.scheme_supported(u["scheme"]).alias("supported"),
    )


@query("layout_paths", "P8 F1 F2 F3 P10")
def _(spark, sf):
    b = d._order_backups(spark, sf)
    root, seg, off = F.lit("some/where/"), F.substring("name", 6, 24), F.substring("name", 31, 8)
    url = F.lit("s3://store/some/where/")
    vol = names.volume_name(F.col("o_orderkey") % 1000)
    return b.select(
        "prefix_id",
        "name",
        names.backups_dir(root).alias("backups_dir"),
        names.backup_dir(root, seg, off).alias("backup_dir"),
        names.sentinel_path(root, seg, off).alias("sentinel"),
        names.volume_dir(root, seg, off).alias("volume_dir"),
        names.volume_path(root, seg, off, vol).alias("volume"),
        names.wal_dir(root).alias("wal_dir"),
        names.wal_path(root, seg).alias("wal"),
        names.backup_url_prefix(url, seg, off).alias("backup_url"),
        names.wal_url(url, seg).alias("wal_url"),
    )


@query("layout_join", "M2 P7 P10 SC1")
def _(spark, sf):
    """Suppliers' line items as objects of their nation's prefix, with rendered URLs."""
    inv = (
        d.table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.count(F.lit(1)).alias("objects"))
        .join(d.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").cast("bigint").alias("prefix_id"), F.concat(F.lit("/obj"), F.col("l_suppkey").cast("string")).alias("key"), "objects")
    )
    placed = catalog.attach_layout(inv, d.prefixes(spark, sf))
    key = F.concat("path_prefix", names.normal_key("key"))
    return placed.select("prefix_id", names.render_url(F.col("scheme"), F.col("store_name"), key).alias("url"), "objects")


@query("scalar_times_and_rates", "F9 F10 F11")
def _(spark, sf):
    e = d.table(spark, sf, "events")
    secs = F.floor("value").cast("bigint") % 7
    return e.select(
        "event_id",
        names.epoch_iso(F.col("event_id") * 1000).alias("iso"),
        names.log_time(F.col("ts").cast("timestamp")).alias("log_time"),
        F.round(names.kib_per_second(F.col("event_id") * 1024, secs), 6).alias("kib_per_second"),
        (names.kib_text(F.col("event_id") * 1024, secs) == "NaN").alias("no_rate"),
    )


# ---- logs --------------------------------------------------------------------------------

@query("log_render", "F17 T6 M11 SK7")
def _(spark, sf):
    return d.log_lines(spark, sf)


@query("log_parse", "F18 SC10 ST1")
def _(spark, sf):
    e = events.typed_events(d.log_lines(spark, sf))
    return e.withColumn("time", names.log_time("time"))


@query("log_pairs", "F18")
def _(spark, sf):
    p = events.event_pairs(d.log_lines(spark, sf)).select(F.explode("pairs").alias("key", "value"))
    return p.groupBy("key", "value").agg(F.count(F.lit(1)).alias("lines"))


@query("log_round_trip", "SK7 SC10 F17 F18")
def _(spark, sf):
    """Records are written as text files of several lines, read back and typed."""
    logged = d.log_columns(spark, sf).select(
        "time", "pid", "pairs", F.col("kind").alias("msg"), F.lit(None).cast("string").alias("detail"),
        F.when(F.col("kind") == "error", "try again").alias("hint"),
    )
    path = shared_path(spark, "log")
    sink.write_log(logged, path)
    e = events.typed_events(source.read_log(spark, path))
    return e.groupBy("prefix", "action", "state").agg(F.count(F.lit(1)).alias("records"), F.sum("rate").cast("bigint").alias("rate_sum"))


@query("log_records", "ST1 SC10 F17 F18")
def _(spark, sf):
    """Records of several lines are written as the archiver logs them and read back whole: one event per record."""
    path = shared_path(spark, "records")
    sink.write_records(d.log_records(spark, sf), path)
    e = events.typed_records(records.read_records(spark, path))
    return e.select(_micros("time"), "pid", "action", "prefix", "state", "rate", "msg", "detail", "hint")


def _events(spark, sf, *fields):
    return events.typed_events(d.log_lines(spark, sf), fields=fields or events.FIELDS)


@query("upload_stats", "A14")
def _(spark, sf):
    s = events.upload_stats(_events(spark, sf, "action", "prefix", "state", "rate"))
    return s.withColumn("mean_rate", F.round("mean_rate", 6))


@query("retry_attempts", "A15")
def _(spark, sf):
    r = events.retry_attempts(d.log_lines(spark, sf))
    return r.withColumn("attempts", F.col("attempts").cast("bigint"))


@query("log_latest_state", "W10")
def _(spark, sf):
    return events.latest_states(_events(spark, sf, "time", "pid", "key", "prefix", "state")).withColumn("time", names.log_time("time"))


# ---- round trips through files -----------------------------------------------------------

@query("sentinel_round_trip", "SK2 SC2 F15")
def _(spark, sf):
    """Sentinels of finished backups are written as JSON, listed, read back and parsed."""
    b = d._order_backups(spark, sf).where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    detail = F.col("price") * 3
    finished = b.select(
        "prefix_id",
        "name",
        F.substring("name", 6, 24).alias("wal_segment_backup_stop"),
        F.substring("name", 31, 8).alias("wal_segment_offset_backup_stop"),
        detail.alias("expanded_size_bytes"),
        F.struct(F.lit("/pg").alias("base_prefix"), F.array().cast("array<string>").alias("tablespaces")).alias("spec"),
        (F.col("o_orderpriority") == "1-URGENT").alias("upload_good"),
        (F.col("o_orderstatus") != "P").alias("stop_good"),
    )
    path = shared_path(spark, "sentinels")
    sink.write_sentinels(finished, path)
    back = spark.read.schema("prefix_id bigint, file string, body string").json(path)
    named = back.select("prefix_id", names.parse_sentinel_key("file")["name"].alias("name"), "body")
    return catalog.parse_detail(named).select(
        "prefix_id", "name", "expanded_size_bytes", "wal_segment_backup_stop", "wal_segment_offset_backup_stop",
        F.col("spec.base_prefix").alias("base_prefix"),
    )


@query("sentinel_files", "SC2 SK2 J1")
def _(spark, sf):
    """Sentinels lie as files in prefixes inside one another; read, placed by the longest prefix, and joined to the listing."""
    root = shared_path(spark, "store")
    homes = d.nested_homes(spark)
    sink.write_sentinel_files(d.sentinel_json(spark, sf), homes, root)
    found = source.placed_sentinels(spark, root, homes.withColumn("home", F.concat_ws("/", F.lit(root), F.nullif(F.col("home"), F.lit("")))))
    b = catalog.backup_list(_backups(spark, sf), catalog.parse_detail(found))
    return b.withColumn("last_modified", names.iso_seconds("last_modified"))


@query("backup_list_file", "SK1")
def _(spark, sf):
    """The TSV listing is written and its lines are read back as they are."""
    path = shared_path(spark, "backup-list")
    sink.write_backup_list(catalog.backup_list(_backups(spark, sf), _detail(spark, sf)), path)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.where(~F.col("value").startswith("name\t")).select(F.col("value").alias("line"))


@query("object_tree", "SC1 SC5")
def _(spark, sf):
    """Keys of every prefix are written as a tree of objects, which is then listed and read."""
    path = shared_path(spark, "tree")
    d.inv_wal(spark, sf).select("prefix_id", F.col("key").alias("value")).write.partitionBy("prefix_id").text(path)
    home = names.extract("url", "/prefix_id=([0-9]+)/", 1).cast("bigint")
    sizes = listing.list_tree(spark, path).where(F.col("url").contains("/part-")).groupBy(home.alias("prefix_id")).agg(
        F.sum("size").alias("bytes"), F.min(F.col("last_modified").isNotNull()).alias("dated")
    )
    content = (
        listing.read_content(spark, path, "part-*")
        .groupBy(home.alias("prefix_id"))
        .agg(F.sum(F.octet_length("content")).cast("bigint").alias("content_bytes"))
    )
    return sizes.join(content, "prefix_id")


# ---- SQL face ----------------------------------------------------------------------------

@query("sql_functions", "X1")
def _(spark, sf):
    sqlface.register(spark)
    _segment_names(spark, sf).createOrReplaceTempView("tidemark_names")
    return spark.sql(
        "SELECT prefix_id, name, segment_tli(name) AS tli, CAST(sn_number(segment_sn(name)) AS BIGINT) AS number, "
        "sn_position(segment_sn(name)) AS pos, CAST(key_depth(name) AS BIGINT) AS depth FROM tidemark_names"
    )


@query("sql_segments_after", "X2 W8")
def _(spark, sf):
    sqlface.register(spark)
    _backups(spark, sf).createOrReplaceTempView("tidemark_backups")
    return spark.sql(
        "SELECT b.prefix_id, b.name, CAST(s.step AS BIGINT) AS step, s.segment "
        f"FROM tidemark_backups b, LATERAL segments_after(b.tli, b.sn, {AHEAD}) s"
    )


# ---- streams -----------------------------------------------------------------------------

def _stream(spark, sf):
    return events.typed_events(d.stream_log_lines(spark, sf))


def _micros(c, alias=None):
    return names.log_time(c).alias(alias or c)


@query("stream_typed_events", "ST1 SC10")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.with_event_time(_stream(spark, sf)), "typed")
    return out.withColumn("time", names.log_time("time"))


@query("stream_paired_uploads", "ST2")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.paired_uploads(_stream(spark, sf)), "paired")
    return out.withColumn("begin_time", names.log_time("begin_time"))


@query("stream_upload_outcomes", "ST2")
def _(spark, sf):
    """One row per begin, with the first end that answers it."""
    out, _q = log_stream.run_available(uploads.outcomes(_stream(spark, sf)), "outcomes", wanted=frontier.SETTINGS)
    return out.withColumn("begin_time", names.log_time("begin_time"))


@query("stream_stuck_uploads", "ST3")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.stuck_uploads(_stream(spark, sf)), "stuck")
    return out.withColumn("begin_time", names.log_time("begin_time"))


@query("stream_throughput", "ST4")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.throughput(_stream(spark, sf)), "tumbling")
    return out.select(iso("window_start"), iso("window_end"), "prefix", "uploads", "rate_sum", "rate_max")


@query("stream_throughput_sliding", "ST4")
def _(spark, sf):
    sliding = log_stream.throughput(_stream(spark, sf), width="5 minutes", slide="1 minute")
    out, _q = log_stream.run_available(sliding, "sliding")
    return out.select(iso("window_start"), iso("window_end"), "prefix", "uploads", "rate_sum", "rate_max")


@query("stream_missing_successors", "ST5")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.missing_successors(_stream(spark, sf)), "successors")
    return out.select("prefix", "tli", "seg", _micros("low_time"), "missing")


@query("stream_gap_alarms", "ST5 W5")
def _(spark, sf):
    """Every gap once, as soon as the run above it is due."""
    out, _q = log_stream.run_available(frontier.gap_alarms(_stream(spark, sf)), "frontier", wanted=frontier.SETTINGS)
    return out.select("prefix", "tli", "gap_from", "gap_to", "missing", _micros("due"))


@query("stream_first_pushes", "ST6")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.first_pushes(_stream(spark, sf)), "first")
    return out.select("prefix", "seg")


@query("stream_late_rows", "ST8")
def _(spark, sf):
    """Skipped uploads arrive after the finished ones were processed; those behind the watermark are dropped."""
    typed = _events(spark, sf).where("action = 'push-wal' and state in ('complete', 'skip')")
    arrivals, folder = shared_path(spark, "arrivals"), shared_path(spark, "late")
    for state in ("complete", "skip"):
        typed.where(F.col("state") == state).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(typed.schema).parquet(arrivals).withWatermark("time", "10 minutes")
        once = stream.dropDuplicatesWithinWatermark(["prefix", "pid", "seg", "state", "time"])
        kept, _q = log_stream.run_available(once, "late", folder=folder)
    arrived = typed.groupBy("prefix").agg(F.count(F.lit(1)).alias("arrived"))
    kept = kept.groupBy("prefix").agg(F.count(F.lit(1)).alias("kept"))
    return arrived.join(kept, "prefix").select("prefix", "arrived", "kept", (F.col("arrived") - F.col("kept")).alias("late"))


@query("stream_sessions_of_ticks", "ST7 ST4")
def _(spark, sf):
    """The same sessions, out of ticks: a busy prefix sends one row per task and tick."""
    out, _q = log_stream.run_available(sessions.restore_sessions(_stream(spark, sf)), "ticks", wanted=frontier.SETTINGS)
    return out.select("prefix", _micros("session_start"), _micros("session_end"), "fetches")


@query("stream_commit", "SK2 SK3 SC2")
def _(spark, sf):
    """Members and stops of backups stream into an archive; only backups whose sentinel was committed are seen."""
    arrivals, root = shared_path(spark, "arriving"), shared_path(spark, "committed")
    rows = d.backup_members(spark, sf)
    rows.repartition(4).write.parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "2").parquet(arrivals)
    commits.commit_available(stream, root)
    sentinels, members = commits.committed(spark, root)
    held = members.groupBy("prefix_id", "name").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))
    stop = F.get_json_object("body", "$.wal_segment_backup_stop")
    return sentinels.select("prefix_id", "name", stop.alias("stop")).join(held, ["prefix_id", "name"])


@query("stream_restore_sessions", "ST7")
def _(spark, sf):
    out, _q = log_stream.run_available(log_stream.restore_sessions(_stream(spark, sf)), "sessions", wanted=log_stream.SESSION_SETTINGS)
    return out.select("prefix", _micros("session_start"), _micros("session_end"), "fetches")
