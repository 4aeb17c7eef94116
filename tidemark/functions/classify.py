"""Key classes: what a listed object is, judged by its depth and name alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed, names

BACKUP_THINGS = ("sentinel", "version", "volume")
WAL_THINGS = ("segment", "label")
DELETABLE = BACKUP_THINGS + WAL_THINGS

# One pattern per class over the key below its path prefix. The fixed name patterns are anchored at the
# start of a path part only, so any further text up to the next slash is accepted.
_BASE = "^" + fixed.BASE_AREA + fixed.CURRENT_VERSION + "/"
_WAL = "^" + fixed.WAL_AREA + fixed.CURRENT_VERSION + "/"
_END = "[^/]*\\z"


def _below(area: str, name: str) -> str:
    return area + name.removeprefix("^")


CLASS_PATTERNS = {
    "segment": _below(_WAL, fixed.RX_WAL_SEGMENT) + _END,
    "label": _below(_WAL, fixed.RX_WAL_LABEL.replace("[^\\n]", "[^\\n/]")) + _END,
    "history": _below(_WAL, fixed.RX_WAL_HISTORY) + _END,
    "volume": _below(_BASE, fixed.RX_BACKUP) + "[^/]*/" + fixed.VOLUME_DIR + "/" + _END,
    "version": _below(_BASE, fixed.RX_BACKUP) + "[^/]*/" + fixed.VERSION_FILE.replace(".", "\\.") + "\\z",
    "sentinel": _below(_BASE, fixed.RX_SENTINEL) + _END,
}
_BASE_NAME_AT = len(fixed.BASE_AREA + fixed.CURRENT_VERSION) + 2
_WAL_NAME_AT = len(fixed.WAL_AREA + fixed.CURRENT_VERSION) + 2


def _first_match(things) -> Column:
    """The class whose pattern matches; patterns exclude each other, so the common class is tried first."""
    found = F.lit("unexpected")
    for thing in reversed(things):
        found = F.when(F.col("_rest").rlike(CLASS_PATTERNS[thing]), thing).otherwise(found)
    return found


def classify_keys(inventory: DataFrame, path_prefix="path_prefix") -> DataFrame:
    """Add area, thing, reason, tli, sn and backup_name to a listing; one pass, no shuffle.

    `thing` is sentinel / version / volume, segment / label / history or
    unexpected (with the reason). Keys outside both areas drop out, as they are
    never listed.
    """
    p = names.col(path_prefix)
    rest = F.when(F.col("key").startswith(p), F.col("key").substr(F.length(p) + 1, F.length("key")))
    placed = scale.once(inventory, rest.alias("_rest"))
    area = F.when(F.col("_rest").startswith(_BASE[1:]), "base").when(F.col("_rest").startswith(_WAL[1:]), "wal")
    thing = F.when(F.col("_rest").startswith(_WAL[1:]), _first_match(("segment", "label", "history"))).otherwise(
        _first_match(("volume", "version", "sentinel"))
    )
    seen = scale.once(placed, area.alias("area"), thing.alias("thing")).where("area is not null")
    base = F.col("thing").isin(*BACKUP_THINGS)
    wal = F.col("thing").isin(*WAL_THINGS)
    slashes = F.size(F.split("_rest", "/")) - 1
    reason = F.when(
        F.col("thing") == "unexpected",
        F.when(slashes > F.when(F.col("area") == "base", 3).otherwise(1), "depth")
        .when(F.col("area") == "wal", "wal name")
        .when(slashes == 1, "sentinel name")
        .when(slashes == 2, "version name")
        .otherwise("volume name"),
    )
    return (
        seen.withColumn("reason", reason)
        .withColumn(
            "tli",
            F.when(base, F.substring("_rest", _BASE_NAME_AT + 5, 8)).when(wal, F.substring("_rest", _WAL_NAME_AT, 8)),
        )
        .withColumn(
            "sn",
            F.when(base, F.substring("_rest", _BASE_NAME_AT + 13, 16)).when(wal, F.substring("_rest", _WAL_NAME_AT + 8, 16)),
        )
        .withColumn("backup_name", F.when(base, F.substring("_rest", _BASE_NAME_AT, 38)))
        .drop("_rest")
    )


def wal_matches(name) -> Column:
    """How many WAL name patterns match: 0 or 1, never more."""
    c = names.col(name)
    return sum(
        (c.rlike(p).cast("int") for p in (fixed.RX_WAL_SEGMENT, fixed.RX_WAL_LABEL, fixed.RX_WAL_HISTORY)), F.lit(0)
    )


def reason_detail(reason) -> Column:
    pairs = [F.lit(x) for kv in fixed.REASON_DETAIL.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), names.col(reason))
