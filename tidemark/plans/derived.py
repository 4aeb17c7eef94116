"""Archive tables derived from the given tables.

The given data holds no archive listing, so each archive table is a projection
of a given table: line items stand for WAL objects, orders for base backups and
status markers, documents for cluster files, events for log records, nations for
prefixes. The same derivation is written in SQL in `oracle.py`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import classify, logtext, names

PREFIXES = 4
#: Volume limits of the queries: no given document is longer, and each of the two closes some volumes.
MANIFEST_MAX_BYTES = 250_000
MANIFEST_MAX_MEMBERS = 100


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per application, not anew for each use in a query."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def _root(p):
    return F.concat(F.lit("db"), names.col(p).cast("string"), F.lit("/"))


def inv_wal(spark, sf_dir) -> DataFrame:
    p = F.col("l_suppkey") % PREFIXES
    tli = _hx(1 + p % 2)
    number = F.concat(tli, _hx(F.floor(F.col("l_orderkey") / 256)), _hx(F.col("l_orderkey") % 256))
    suffix = (
        F.when(F.col("l_returnflag").isin("N", "A"), ".lzo")
        .when(F.col("l_linestatus") == "F", ".0000A000.backup.lzo")
        .when(F.col("l_linenumber") % 2 == 0, ".lzo.tmp")
        .otherwise(".partial")
    )
    history = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)
    key = F.concat(
        _root(p),
        F.lit("wal_005/"),
        F.when(F.col("l_linenumber") == 7, "sub/").otherwise(""),
        F.when(history, F.concat(tli, F.lit(".history.lzo"))).otherwise(F.concat(number, suffix)),
    )
    rows = scale.once(table(spark, sf_dir, "lineitem"), key.alias("key")).select(
        p.alias("prefix_id"),
        "key",
        (F.col("l_quantity") * 1024).cast("bigint").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    return _listing(
        rows.groupBy("prefix_id", "key").agg(F.max("size").alias("size"), F.max("ts").alias("last_modified"))
    )


def _listing(rows: DataFrame) -> DataFrame:
    return rows.select(
        "prefix_id",
        F.concat(F.lit("bucket"), (F.col("prefix_id") % 2).cast("string")).alias("bucket"),
        "key",
        "size",
        "last_modified",
        _root("prefix_id").alias("path_prefix"),
    )


def _hx(number):
    """As `names.hex8`, for numbers known to fit."""
    return F.lpad(F.hex(number), 8, "0")


def _order_backups(spark, sf_dir) -> DataFrame:
    p = F.col("o_custkey") % PREFIXES
    k = F.col("o_orderkey")
    name = F.concat(F.lit("base_"), _hx(1 + p % 2), _hx(F.floor(k / 256)), _hx(k % 256), F.lit("_"), _hx(F.col("o_custkey")))
    return scale.once(table(spark, sf_dir, "orders"), name.alias("name")).select(
        "*",
        p.alias("prefix_id"),
        F.floor("o_totalprice").cast("bigint").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("last_modified"),
    )


def inv_base(spark, sf_dir) -> DataFrame:
    """Keys of backup directories: one pass over orders, each order unfolding to its own few keys.

    Step 0 to 2 are volumes, 3 the version file, 4 the sentinel, 5 a stray key.
    """
    b = _order_backups(spark, sf_dir)
    steps = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(3), F.lit(4)))
        .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit(3)))
        .when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit(5)))
    )
    volumes = F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))
    )
    none = F.array().cast("array<int>")
    unfolded = b.withColumn("step", F.explode(F.concat(F.coalesce(steps, none), F.coalesce(volumes, none))))
    step = F.col("step")
    below = (
        F.when(step == 3, F.concat("name", F.lit("/extended_version.txt")))
        .when(step == 4, F.concat("name", F.lit("_backup_stop_sentinel.json")))
        .when(step < 3, F.concat("name", F.lit("/tar_partitions/part_"), _hx(step.cast("bigint")), F.lit(".tar.lzo")))
        .when(F.col("o_orderkey") % 2 == 0, F.concat("name", F.lit("_partial.json")))
        .otherwise(F.concat(F.lit("a/b/c/d"), F.col("o_orderkey").cast("string")))
    )
    size = F.when(step == 3, 64).when(step == 4, 120).when(step == 5, 1).otherwise(F.floor(F.col("price") / (step + 1)))
    key = F.concat(_root("prefix_id"), F.lit("basebackups_005/"), below)
    return _listing(
        scale.once(unfolded, key.alias("key")).select("prefix_id", "key", size.cast("bigint").alias("size"), "last_modified")
    )


def inventory(spark, sf_dir) -> DataFrame:
    return inv_base(spark, sf_dir).unionByName(inv_wal(spark, sf_dir))


def classified(spark, sf_dir) -> DataFrame:
    return classify.classify_keys(inventory(spark, sf_dir))


def classified_base(spark, sf_dir) -> DataFrame:
    return classify.classify_keys(inv_base(spark, sf_dir))


def classified_wal(spark, sf_dir) -> DataFrame:
    return classify.classify_keys(inv_wal(spark, sf_dir))


def sentinel_json(spark, sf_dir) -> DataFrame:
    """Sentinel bodies, with 0 to 2 tablespaces as dynamic keys of the spec."""
    b = _order_backups(spark, sf_dir).where("o_orderpriority = '1-URGENT'")
    stop = F.col("o_orderkey") + F.col("o_orderkey") % 5
    segment = F.concat(
        names.hex8(1 + F.col("prefix_id") % 2), names.hex8(F.floor(stop / 256)), names.hex8(stop % 256)
    )
    n = F.col("o_orderkey") % 3

    def space(i):
        oid = (F.col("o_orderkey") * 10 + i).cast("string")
        return oid, F.concat(F.lit('"'), oid, F.lit('": {"loc": "/data/ts'), oid, F.lit('/", "link": "pg_tblspc/'), oid, F.lit('"}'))

    (o1, s1), (o2, s2) = space(1), space(2)
    listed = F.when(n == 0, "").when(n == 1, F.concat(F.lit('"'), o1, F.lit('"'))).otherwise(
        F.concat(F.lit('"'), o1, F.lit('", "'), o2, F.lit('"'))
    )
    places = F.when(n == 0, "").when(n == 1, F.concat(F.lit(", "), s1)).otherwise(F.concat(F.lit(", "), s1, F.lit(", "), s2))
    body = F.concat(
        F.lit('{"wal_segment_backup_stop": "'),
        segment,
        F.lit('", "wal_segment_offset_backup_stop": "'),
        names.hex8("o_custkey"),
        F.lit('", "expanded_size_bytes": '),
        (F.col("price") * 3).cast("string"),
        F.lit(', "spec": {"base_prefix": "/pg/db'),
        F.col("prefix_id").cast("string"),
        F.lit('", "tablespaces": ['),
        listed,
        F.lit("]"),
        places,
        F.lit("}}"),
    )
    return b.select("prefix_id", "name", body.alias("body"))


def file_manifest(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("cluster_id"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit("file").alias("ftype"),
        F.col("n_chars").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("link_target"),
        F.col("doc_id").alias("ord"),
    )


TREE_DIRS = (
    "",
    "base/1/",
    "base/1/pgsql_tmp/",
    "pg_wal/",
    "base/lost+found/",
    "pg_tblspc/7/PG/",
    "pg_tblspc/7/pgsql_tmp/",
    "pg_stat_tmp/",
)
TREE_NAMES = ("postgresql.conf", "postmaster.pid", "PG_VERSION", "pgsql_tmp")


def cluster_tree(spark, sf_dir) -> DataFrame:
    """A cluster per customer; each order is an entry whose folder and kind follow from its columns.

    Each has a tablespace link; that of every seventh customer leads nowhere.
    """
    k = F.col("o_orderkey")
    where = F.get(F.array(*[F.lit(d) for d in TREE_DIRS]), (k % len(TREE_DIRS)).cast("int"))
    plain = F.concat(F.lit("f"), k.cast("string"))
    special = F.get(F.array(*[F.lit(d) for d in TREE_NAMES]), (k % len(TREE_NAMES)).cast("int"))
    last = F.when(F.col("o_orderstatus") == "P", special).otherwise(plain)
    kind = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), "dir").otherwise("file")
    cluster = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    entries = (
        table(spark, sf_dir, "orders")
        .select(cluster.alias("cluster_id"), F.concat(where, last).alias("path"), kind.alias("ftype"), F.col("o_orderkey").alias("n"))
        .groupBy("cluster_id", "path")
        .agg(F.min("ftype").alias("ftype"), F.min("n").alias("ord"))
    )
    links = (
        table(spark, sf_dir, "orders")
        .select(cluster.alias("cluster_id"), F.when(F.col("o_custkey") % 7 == 0, "link").otherwise("dirlink").alias("ftype"))
        .distinct()
        .select("cluster_id", F.lit("pg_tblspc/7").alias("path"), "ftype", F.lit(-1).cast("bigint").alias("ord"))
    )
    return entries.unionByName(links).select(
        "cluster_id",
        "path",
        "ftype",
        F.when(F.col("ftype") == "file", F.col("ord") * 3).otherwise(0).cast("bigint").alias("size"),
        F.when(F.col("ftype").isin("link", "dirlink"), F.concat(F.lit("/data/"), "cluster_id")).alias("link_target"),
        "ord",
    )


def _segment_of(cluster, number):
    return F.concat(names.hex8(1 + cluster % 2), names.hex8(F.floor(number / 256)), names.hex8(number % 256))


def archive_status(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey") % PREFIXES
    segment = _segment_of(c, F.col("o_orderkey"))
    name = (
        F.when(F.col("o_orderstatus") == "O", F.concat(segment, F.lit(".ready")))
        .when(F.col("o_orderstatus") == "F", F.concat(segment, F.lit(".done")))
        .otherwise(F.concat(names.hex8(F.col("o_orderkey") + 1), F.lit(".history.ready")))
    )
    return table(spark, sf_dir, "orders").select(c.alias("cluster_id"), name.alias("file_name"))


def segment_files(spark, sf_dir) -> DataFrame:
    """Segment files still on the database hosts: those of high-priority orders are gone."""
    c = F.col("o_custkey") % PREFIXES
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderpriority <> '2-HIGH'")
        .select(c.alias("cluster_id"), _segment_of(c, F.col("o_orderkey")).alias("segment"))
    )


def archived_segments(spark, sf_dir) -> DataFrame:
    return (
        classified_wal(spark, sf_dir)
        .where("thing = 'segment'")
        .select(F.col("prefix_id").alias("cluster_id"), F.concat("tli", "sn").alias("segment"))
    )


def _log_columns(events: DataFrame) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    state = (
        F.when(kind == "purchase", "complete").when(kind == "signup", "skip").when(kind.isin("view", "click"), "begin")
    )
    number = F.floor(F.col("event_id") / 5).cast("bigint")
    pairs = F.map_filter(
        F.create_map(
            F.lit("action"),
            F.when(kind == "click", "wal-fetch").otherwise("push-wal"),
            F.lit("key"),
            F.concat(F.lit("s3://store/wal-"), user.cast("string"), F.lit(".lzo")),
            F.lit("prefix"),
            F.concat(F.lit("db"), (user % PREFIXES).cast("string"), F.lit("/")),
            F.lit("rate"),
            F.when(kind == "purchase", F.floor("value").cast("bigint").cast("string")),
            F.lit("seg"),
            F.concat(F.lit("00000001"), names.hex8(F.floor(number / 256)), names.hex8(number % 256)),
            F.lit("state"),
            state,
        ),
        lambda _k, v: v.isNotNull(),
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        user.alias("pid"),
        kind.alias("kind"),
        "event_id",
        pairs.alias("pairs"),
    )


def _log_lines(events: DataFrame) -> DataFrame:
    e = _log_columns(events)
    retry = F.concat(
        F.lit("DETAIL: The socket error's message is 'reset'.  There have been "),
        (1 + F.col("event_id") % 5).cast("string"),
        F.lit(" attempts to send the volume "),
        (F.col("pid") % 50).cast("string"),
        F.lit(" so far."),
    )
    text = F.concat(F.lit("STRUCTURED: "), logtext.render_structured("time", "pid", "pairs"))
    return scale.once(e, F.when(F.col("kind") == "error", retry).otherwise(text).alias("value")).select("value")


def log_lines(spark, sf_dir) -> DataFrame:
    """One log line per event: structured records, and retry messages for errors."""
    return _log_lines(table(spark, sf_dir, "events"))


def stream_log_lines(spark, sf_dir) -> DataFrame:
    """The same lines as a stream over the events file."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _log_lines(raw)


def log_columns(spark, sf_dir) -> DataFrame:
    return _log_columns(table(spark, sf_dir, "events"))


def log_records(spark, sf_dir) -> DataFrame:
    """Records with a message, for uploads a detail of two lines, and a hint for errors."""
    sent = F.concat(F.lit("Sent object "), F.col("event_id").cast("string"), F.lit(".\nIt took "), (F.col("event_id") % 7).cast("string"), F.lit(" parts."))
    return log_columns(spark, sf_dir).select(
        "time",
        "pid",
        "pairs",
        F.concat(F.lit("saw a "), "kind").alias("msg"),
        F.when(F.col("kind") == "purchase", sent).alias("detail"),
        F.when(F.col("kind") == "error", "Try again.\nThen ask.").alias("hint"),
    )


def prefixes(spark, sf_dir) -> DataFrame:
    """A prefix URL per nation; every sixth has a scheme that no store has."""
    scheme = F.get(
        F.array(*[F.lit(s) for s in ("s3", "wabs", "swift", "gs", "file", "ftp")]), (F.col("n_nationkey") % 6).cast("int")
    )
    url = F.concat(
        scheme,
        F.lit("://"),
        F.lower("n_name"),
        F.lit("/region"),
        F.col("n_regionkey").cast("string"),
        F.when(F.col("n_nationkey") % 3 == 0, "/").otherwise(""),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("prefix_id"), url.alias("url"))


def backup_members(spark, sf_dir) -> DataFrame:
    """Members of backups, with their size as content, and the stops of those that ended well."""
    b = _order_backups(spark, sf_dir).where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("prefix_id", "name", "o_orderkey", "o_orderpriority", "price")
    none = F.lit(None).cast("string")
    members = b.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")))).select(
        "prefix_id", "name", F.concat(F.lit("part_"), F.col("part").cast("string")).alias("path"), F.floor(F.col("price") / (F.col("part") + 1)).cast("string").alias("content"), none.alias("body")
    )
    stop = F.to_json(F.struct(F.substring("name", 6, 24).alias("wal_segment_backup_stop")))
    stops = b.where("o_orderpriority = '1-URGENT'").select("prefix_id", "name", none.alias("path"), none.alias("content"), stop.alias("body"))
    return members.unionByName(stops)


def nested_homes(spark) -> DataFrame:
    """Folders of the PREFIXES prefixes, each inside the one before but for the last, whose name only begins like another."""
    homes = ["fleet", "fleet/a", "fleet/a/b", "fleet/ab"]
    return spark.createDataFrame(list(enumerate(homes)), "prefix_id bigint, home string")


def fleet_prefixes(spark, sf_dir) -> DataFrame:
    """The prefixes that occur among customers."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % PREFIXES).alias("prefix_id")).distinct()
