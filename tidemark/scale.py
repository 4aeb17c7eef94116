"""Building blocks that keep plans balanced when one prefix holds a third of all rows.

Three ideas are used throughout:

* a side is broadcast only after its size was measured; beyond the limit the join is salted;
* an ordered window over a whole prefix is replaced by windows over bounded chunks of it plus
  one window over a table with one row per chunk;
* top-k per prefix filters a row_number, which Spark limits on the map side already.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
CHUNK_SEGMENTS = 4096
GROUP_LIMIT_ROWS = 1000


def once(df: DataFrame, *columns) -> DataFrame:
    """Add computed columns that later filters and expressions refer to by name.

    They are produced by a one-row generator, so the optimizer does not copy the
    expressions into every place that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def pin(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from there.

    Reliable checkpoints survive the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _size(df: DataFrame):
    """(rows, bytes) of a pinned table, by one aggregate over it."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    text_bytes = F.sum(sum(texts, F.lit(0))) if texts else F.lit(0)
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(text_bytes, F.lit(0))).first()
    return n, b + n * (16 + 8 * len(df.columns))


def join_small(big: DataFrame, small: DataFrame, on, how="inner", max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES):
    """Join a large table with one that should be small (one row per prefix, say).

    The small side is pinned and measured first. Within the limits it is
    broadcast, so the large side is not shuffled at all. Beyond them both sides
    are shuffled with a salt, so that a hot key is spread over many tasks.
    Supports inner, left and left_semi / left_anti with the large side left.
    """
    on = [on] if isinstance(on, str) else list(on)
    small = pin(small)
    rows, size = _size(small)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)


def salts_of(spark) -> int:
    """Salts that spread one key over a good part of the session's tasks: an eighth of the shuffle partitions, SALTS at least, eight times SALTS at most."""
    return min(8 * SALTS, max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def salted_join(big: DataFrame, small: DataFrame, on, how="inner", salts=None) -> DataFrame:
    """Equi join with the hot keys of `big` spread over `salts` tasks; `small` is repeated per salt."""
    salts = salts or salts_of(big.sparkSession)
    rest = [c for c in big.columns if c not in on] or on
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(big, rest)), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, columns):
    by_name = {f.name: f.dataType for f in df.schema.fields}
    return [F.col(c) for c in columns if not isinstance(by_name[c], (T.MapType, T.VariantType))] or [F.lit(0)]


def top_n(df: DataFrame, keys, order, n: int, spread="key") -> DataFrame:
    """First n rows per group, with their `rn`.

    Up to GROUP_LIMIT_ROWS Spark itself keeps only n rows per group and map
    task before the shuffle. For larger n a salted first round does the same.
    """
    if n > GROUP_LIMIT_ROWS:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts_of(df.sparkSession))).cast("int"))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def latest_rows(df: DataFrame, keys, time: str, order) -> DataFrame:
    """The row of each group with the greatest `time`; equal times: the greatest by `order`. A null time is the least.

    The greatest time is a hash aggregate of numbers with a partial sum on the map side. Only rows that carry it, ties
    that is, go through an aggregate of whole rows, which Spark sorts.
    """
    newest = df.groupBy(*keys).agg(F.max(time).alias("_newest"))
    first = join_small(df, newest, keys).where(F.col(time).eqNullSafe(F.col("_newest"))).drop("_newest")
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)) if len(order) < len(rest) else F.max(F.struct(*order))
    return first.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def range_chunks(df: DataFrame, keys, order, out="chunk") -> DataFrame:
    """`df` with a chunk number that never decreases along `order` within a group and holds about as many rows as any other.

    Rows are dealt by ranges of (keys, order), however unevenly the values lie; the table is pinned, so that the numbers stay what they are.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*keys, *order, "_tie").withColumn(out, F.spark_partition_id().cast("bigint"))
    return pin(ranged.drop("_tie"))


def previous_row(df: DataFrame, keys, order, chunk: str, values, spread=True) -> DataFrame:
    """Add `prev`, a struct of `values` of the preceding row in the group's order.

    `chunk` is a column that never decreases along the order and cuts each group
    into bounded pieces. The lag runs inside the pieces; only the last row of
    each piece travels to the next one. Pass `spread=False` for a table that is
    laid out by (keys, chunk) already.
    """
    spread = df.repartition(*keys, chunk) if spread else df
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    value = F.struct(*values)
    lagged = spread.withColumn("_prev", F.lag(value).over(inside))
    plain = list(values) == list(order) and len(order) == 1
    final = F.struct(F.max(order[0]).alias(order[0])) if plain else F.max_by(value, F.struct(*order))
    last = spread.groupBy(*keys, chunk).agg(final.alias("_last"))
    across = Window.partitionBy(*keys).orderBy(chunk)
    carried = last.select(*keys, chunk, F.lag("_last").over(across).alias("_carried"))
    return (
        lagged.join(carried, [*keys, chunk])
        .withColumn("prev", F.coalesce("_prev", "_carried"))
        .drop("_prev", "_carried")
    )


def latest_value(df: DataFrame, keys, order, chunk: str, value: str, out: str) -> DataFrame:
    """As-of fill: `out` is the last non-null `value` at or before each row of its group."""
    spread = df.repartition(*keys, chunk)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = spread.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    last = spread.groupBy(*keys, chunk).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, chunk, F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    return filled.join(carried, [*keys, chunk]).withColumn(out, F.coalesce("_in", "_carried")).drop("_in", "_carried")


def _count_reading(columns) -> Column:
    """count(*) that reads the given columns.

    The condition always holds. It keeps the columns from being pruned in one of
    two branches over the same shuffle, so that Spark runs that shuffle once.
    """
    return F.sum(F.when(F.hash(*columns) >= F.lit(-2147483648), F.lit(1)).otherwise(F.lit(0)))


def running_totals(df: DataFrame, keys, order, chunk: str, value: str, index="idx", total="upto") -> DataFrame:
    """Per group: 1-based `index` and inclusive running sum `total` of `value`, over bounded chunks."""
    # Never null, so that the join below adds no null test to one branch only.
    spread = df.withColumn(chunk, F.coalesce(chunk, F.lit(0))).repartition(*keys, chunk)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    local = spread.withColumn("_i", F.row_number().over(inside)).withColumn(
        "_s", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    sums = spread.groupBy(*keys, chunk).agg(_count_reading(df.columns).alias("_n"), F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        chunk,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
    )
    return (
        local.join(offsets, [*keys, chunk])
        .withColumn(index, (F.col("_i") + F.col("_n0")).cast("bigint"))
        .withColumn(total, (F.col("_s") + F.col("_t0")).cast("bigint"))
        .drop("_i", "_s", "_n0", "_t0")
    )


def numbered(df: DataFrame, keys, order, spread_on: str, out="number", pieces=4096) -> DataFrame:
    """Number the rows of each group 1..n without bringing a group together.

    Rows are spread over `pieces` hash pieces per group and numbered inside them in
    `order`; the row counts of the pieces, one row per piece, give the offsets.
    Numbers are dense and repeatable; they follow (piece, order), not `order` alone.
    """
    piece = F.conv(F.substring(F.md5(spread_on), 1, 4), 16, 10).cast("bigint") % pieces
    # Never null, so that the join below adds no null test to one branch only.
    spread = df.select("*", F.coalesce(piece, F.lit(0)).alias("_piece")).repartition(*keys, "_piece")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    counts = spread.groupBy(*keys, "_piece").agg(_count_reading(df.columns).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_piece", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    return (
        spread.withColumn("_n", F.row_number().over(inside))
        .join(starts, [*keys, "_piece"])
        .withColumn(out, (F.col("_n") + F.col("_start")).cast("bigint"))
        .drop("_piece", "_n", "_start")
    )


def unfold(df: DataFrame, low: str, high: str, out: str, step=4096) -> DataFrame:
    """One row per whole number from `low` to `high`, both included; no array is longer than `step` + 1.

    Ranges are cut four times by powers of `step`, which covers spans below step ** 4.
    """
    df = df.withColumn("_lo", F.col(low).cast("bigint")).withColumn("_hi", F.col(high).cast("bigint")).where("_lo <= _hi")
    for width in (step**3, step**2, step, 1):
        cut = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_hi") - F.col("_lo")) / width))
        df = df.withColumn("_lo", F.explode(F.transform(cut, lambda i: F.col("_lo") + i * width))).withColumn(
            "_hi", F.least(F.col("_hi"), F.col("_lo") + (width - 1))
        )
    return df.withColumn(out, F.col("_lo")).drop("_lo", "_hi")


def chunk_of(position, size=CHUNK_SEGMENTS) -> Column:
    """Chunk number of a dense position; at most `size` distinct positions share one."""
    p = F.col(position) if isinstance(position, str) else position
    return F.floor(p / F.lit(size)).cast("bigint")
