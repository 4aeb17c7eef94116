"""Next-fit packing of a cluster's files into bounded volumes, exact and without a sequential pass.

Next-fit keeps one open volume: a member that would bring it to the byte limit or
above, or that comes when it is full of members, closes it and opens the next one.
With running sums, the member at which a volume begun at member i ends is

    next(i) = the first j > i with  upto(j) - upto(i) + size(i) >= max_bytes  or  j - i >= max_members

so the volumes of a cluster are the chain 1, next(1), next(next(1)), ... A chain
looks sequential, but it need not be followed member by member:

1. running sums come from `scale.running_totals` over bounded chunks of the listing;
2. the listing is cut into blocks of `block` members. Since next(i) <= i + max_members,
   the chain enters a block within its first max_members members. For each of those
   possible entries a block tells where the chain leaves it and how many volumes began;
3. these tables are combined for `fan` blocks at a time, and again over the few
   groups of a cluster; the true entry then flows back down;
4. each block marks the members at which volumes begin; a running count of the marks,
   in the JVM, numbers the volumes.

Python only sees (member number, running sum) of one block at a time.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed

BLOCK = 1 << 18
FAN = 256

# The few functions below that run in tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _next_start(upto, size, max_bytes, max_members):
    """For members 0..n-1 of a slice: slice index at which a volume begun there ends (n or more: beyond it)."""
    n = len(upto)
    here = np.arange(n)
    by_bytes = np.searchsorted(upto, max_bytes + upto - size, side="left")
    return np.minimum(np.maximum(by_bytes, here + 1), here + max_members)


def _leaps(nxt, inside):
    """Follow all chains until they leave the first `inside` members: (exit index, volumes begun)."""
    n = len(nxt)
    jump = np.minimum(nxt, n)
    jump = np.append(jump, n)
    hops = np.ones(n + 1, dtype=np.int64)
    out = np.arange(n + 1) >= inside
    jump[out] = np.arange(n + 1)[out]
    hops[out] = 0
    while (jump[:inside] < inside).any():
        hops = hops + hops[jump]
        jump = jump[jump]
    return jump, hops


def _blocks(items: DataFrame, block: int, max_members: int) -> DataFrame:
    """Each block's members, followed by the members a volume begun in it may reach."""
    b = F.floor((F.col("idx") - 1) / block).cast("bigint")
    ahead = (F.col("idx") - 1) % block < max_members
    return (
        items.select("cluster_id", "idx", "upto", "size")
        .withColumn("blk", F.explode(F.when(ahead & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))))
        .repartition("cluster_id", "blk")
    )


def pack(
    manifest: DataFrame,
    max_bytes=fixed.VOLUME_MAX_BYTES,
    max_members=fixed.VOLUME_MAX_MEMBERS,
    block=BLOCK,
    fan=FAN,
) -> DataFrame:
    """Add `volume` (from 0) to a manifest, per cluster in `ord` order.

    `ord` is the listing number: a null or repeated one within a cluster is an error. A member above
    `max_bytes` is an error (see `too_big` for the list of them). Directories and
    links count as members of size 0. A first member of exactly `max_bytes` leaves
    volume 0 empty, as the rule says.
    """
    block = max(block, max_members)
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    slim = manifest.select(
        "cluster_id",
        "ord",
        F.when(size > max_bytes, F.raise_error(F.concat(F.lit("member too big: "), "path")).cast("bigint"))
        .otherwise(size)
        .alias("size"),
        F.floor(F.when(F.col("ord").isNull(), F.raise_error("member without ord").cast("bigint")).otherwise(F.col("ord")) / block).alias("_chunk"),
    )
    summed = scale.running_totals(slim, ["cluster_id"], ["ord"], "_chunk", "size")
    before = F.lag("ord").over(Window.partitionBy("cluster_id", "_chunk").orderBy("ord"))
    once = F.when(before == F.col("ord"), F.raise_error("ord repeated in a cluster").cast("bigint")).otherwise(F.col("size"))
    items = summed.withColumn("size", once).drop("_chunk")
    blocks = _blocks(items, block, max_members)
    tables = (
        blocks.groupBy("cluster_id", "blk")
        .applyInPandas(
            lambda key, pdf: _block_table(key, pdf, block, max_bytes, max_members),
            "cluster_id string, blk bigint, full int, leave array<int>, begun array<bigint>",
        )
        .withColumn("grp", F.floor(F.col("blk") / fan).cast("bigint"))
    )
    grouped = tables.groupBy("cluster_id", "grp").applyInPandas(
        _combine, "cluster_id string, grp bigint, full int, leave array<int>, begun array<bigint>"
    )
    group_entry = grouped.groupBy("cluster_id").applyInPandas(
        _enter_groups, "cluster_id string, grp bigint, entry int, volumes bigint"
    )
    block_entry = (
        tables.groupBy("cluster_id", "grp")
        .cogroup(group_entry.groupBy("cluster_id", "grp"))
        .applyInPandas(_enter_blocks, "cluster_id string, blk bigint, entry int, volumes bigint")
    )
    starts = (
        blocks.groupBy("cluster_id", "blk")
        .cogroup(block_entry.groupBy("cluster_id", "blk"))
        .applyInPandas(
            lambda left, right: _mark_starts(left, right, block, max_bytes, max_members),
            "cluster_id string, blk bigint, idx bigint, volume bigint",
        )
    )
    # Every member of a block lies in the last volume begun at or before it; members ahead of the
    # block's first start lie in the volume that was open on entry (idx 0 of the block's marks).
    placed = items.withColumn("blk", F.floor((F.col("idx") - 1) / block).cast("bigint"))
    marks = starts.select("cluster_id", "blk", "idx", F.col("volume").alias("_mark"), F.lit(None).cast("bigint").alias("ord"))
    rows = placed.select("cluster_id", "blk", "idx", F.lit(None).cast("bigint").alias("_mark"), "ord")
    upto_here = (
        Window.partitionBy("cluster_id", "blk")
        .orderBy("idx", F.col("_mark").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = (
        marks.unionByName(rows)
        .withColumn("volume", F.last("_mark", ignorenulls=True).over(upto_here))
        .where("ord is not null")
        .select("cluster_id", "ord", "volume")
    )
    return manifest.withColumn("size", size).join(numbered, ["cluster_id", "ord"])


def _block_table(key, pdf, block, max_bytes, max_members):
    cluster, blk = key
    pdf = pdf.sort_values("idx", kind="stable")
    upto, size = pdf["upto"].to_numpy(), pdf["size"].to_numpy()
    inside = int((pdf["idx"].to_numpy() <= (blk + 1) * block).sum())
    leave, begun = _leaps(_next_start(upto, size, max_bytes, max_members), inside)
    entries = min(inside, max_members)
    # Where the listing ends inside the block, every chain ends there as well (-1).
    off = leave[:entries] - inside
    off = np.where(leave[:entries] >= len(upto), -1, off)
    return pd.DataFrame(
        {
            "cluster_id": [cluster],
            "blk": [blk],
            "full": [int(size[0] >= max_bytes)],
            "leave": [off.astype(np.int32)],
            "begun": [begun[:entries].astype(np.int64)],
        }
    )


def _combine(key, pdf):
    cluster, grp = key
    pdf = pdf.sort_values("blk")
    leave = begun = None
    for row in pdf.itertuples(index=False):
        l, b = np.asarray(row.leave), np.asarray(row.begun)
        if leave is None:
            leave, begun = l.copy(), b.copy()
        else:
            on = leave >= 0
            begun[on] += b[leave[on]]
            leave[on] = l[leave[on]]
    full = pdf["full"].iloc[0]
    return pd.DataFrame({"cluster_id": [cluster], "grp": [grp], "full": [full], "leave": [leave], "begun": [begun]})


def _walk(pdf, label, entry, volumes):
    rows = []
    for row in pdf.sort_values(label).itertuples(index=False):
        rows.append((row.cluster_id, getattr(row, label), entry, volumes))
        if entry >= 0:
            volumes += int(row.begun[entry])
            entry = int(row.leave[entry])
    return pd.DataFrame(rows, columns=["cluster_id", label, "entry", "volumes"])


def _enter_groups(pdf):
    # A first member of the full size closes volume 0 while that is still empty.
    pdf = pdf.sort_values("grp")
    return _walk(pdf, "grp", 0, int(pdf["full"].iloc[0]))


def _enter_blocks(left, right):
    if left.empty:
        return pd.DataFrame({"cluster_id": [], "blk": [], "entry": [], "volumes": []})
    return _walk(left, "blk", int(right["entry"].iloc[0]), int(right["volumes"].iloc[0]))


def _mark_starts(left, right, block, max_bytes, max_members):
    """Marks (idx, volume) of one block; idx 0 stands for the volume open on entry."""
    cluster, blk = left["cluster_id"].iloc[0], int(left["blk"].iloc[0])
    left = left.sort_values("idx", kind="stable")
    idx, size = left["idx"].to_numpy(), left["size"].to_numpy()
    nxt = _next_start(left["upto"].to_numpy(), size, max_bytes, max_members)
    inside = int((idx <= (blk + 1) * block).sum())
    at, volume = int(right["entry"].iloc[0]), int(right["volumes"].iloc[0])
    found = []
    while 0 <= at < inside:
        found.append(at)
        at = int(nxt[at])
    marks = np.concatenate([[0], idx[np.asarray(found, dtype=np.int64)]])
    return pd.DataFrame(
        {"cluster_id": cluster, "blk": blk, "idx": marks, "volume": np.arange(volume - 1, volume + len(found))}
    )


def too_big(manifest: DataFrame, max_bytes=fixed.VOLUME_MAX_BYTES) -> DataFrame:
    """Members above the volume limit, with the text of the refusal."""
    return manifest.where(F.col("size") > max_bytes).select(
        "cluster_id",
        "path",
        "size",
        F.format_string(
            fixed.TOO_BIG_HINT,
            F.lit(max_bytes),
            "path",
            "size",
        ).alias("hint"),
    )


def volume_sizes(packed: DataFrame) -> DataFrame:
    """Bytes and members per volume."""
    return packed.groupBy("cluster_id", "volume").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))


def backup_sizes(packed: DataFrame) -> DataFrame:
    """Expanded size and members by volume and by cluster (`volume` null), subtotals over the pre-aggregated volumes."""
    return (
        volume_sizes(packed)
        .rollup("cluster_id", "volume")
        .agg(F.sum("bytes").alias("bytes"), F.sum("members").alias("members"))
        .where("cluster_id is not null")
    )
