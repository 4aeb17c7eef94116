"""Names, numbers and paths as native column expressions.

Nothing here needs Python workers: every function returns a Column built from
built-in functions, so it fuses into the scan stage.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

SEGS = fixed.SEGMENTS_PER_LOG


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(text, pattern: str, group: int) -> Column:
    """Regexp group, null (not '') where the pattern does not match."""
    return F.when(col(text).rlike(pattern), F.regexp_extract(col(text), pattern, group))


# ---- numbers -----------------------------------------------------------------------------

def hex8(number) -> Column:
    """Integer to eight upper-case hex digits; more digits are an error, not a truncation."""
    n = col(number).cast("bigint")
    return F.when(
        (n < 0) | (n > 0xFFFFFFFF), F.raise_error(F.lit("number does not fit eight hex digits")).cast("string")
    ).otherwise(F.lpad(F.hex(n), 8, "0"))


def from_hex(text) -> Column:
    return F.conv(col(text), 16, 10).cast("bigint")


def segment_number(log, seg) -> Column:
    """(log, seg) as one unsigned 64-bit number."""
    return F.conv(F.concat(col(log), col(seg)), 16, 10).cast("decimal(20,0)")


def sn(log, seg) -> Column:
    """The same order as `segment_number`, as 16 characters that file statistics can prune."""
    return F.concat(col(log), col(seg))


def position(log, seg) -> Column:
    """Dense position in the segment sequence (log * 256 + seg); null where seg is above FF."""
    return F.when(from_hex(seg) < SEGS, from_hex(log) * SEGS + from_hex(seg))


def position_of_sn(text) -> Column:
    return position(F.substring(col(text), 1, 8), F.substring(col(text), 9, 8))


def sn_of_position(pos) -> Column:
    p = col(pos)
    return F.concat(hex8(F.floor(p / SEGS)), hex8(p % SEGS))


# ---- successors --------------------------------------------------------------------------

def next_segment(log, seg) -> Column:
    """struct(log, seg) of the successor; seg FF carries, the last log has none (error)."""
    log, seg = col(log), col(seg)
    s = from_hex(seg)
    last = (s == SEGS - 1) & (log == "FFFFFFFF")
    bad = F.raise_error(F.lit("no segment after the last one")).cast("struct<log:string,seg:string>")
    return (
        F.when(last | (s >= SEGS), bad)
        .when(s == SEGS - 1, F.struct(F.lpad(F.hex(from_hex(log) + 1), 8, "0").alias("log"), F.lit("0" * 8).alias("seg")))
        .otherwise(F.struct(log.alias("log"), F.lpad(F.hex(s + 1), 8, "0").alias("seg")))
    )


def previous_segment(log, seg) -> Column:
    """struct(log, seg) of the predecessor; seg 0 borrows, 0/0 has none (error)."""
    log, seg = col(log), col(seg)
    s, lg = from_hex(seg), from_hex(log)
    bad = F.raise_error(F.lit("no segment before the first one")).cast("struct<log:string,seg:string>")
    return (
        F.when((s >= SEGS) | ((s == 0) & (lg == 0)), bad)
        .when(s == 0, F.struct(F.lpad(F.hex(lg - 1), 8, "0").alias("log"), F.lit("000000FF").alias("seg")))
        .otherwise(F.struct(log.alias("log"), F.lpad(F.hex(s - 1), 8, "0").alias("seg")))
    )


def try_next_segment(log, seg) -> Column:
    """As `next_segment`, null in place of the error."""
    ok = (from_hex(seg) < SEGS) & ~((from_hex(seg) == SEGS - 1) & (col(log) == "FFFFFFFF"))
    return F.when(ok, next_segment(log, seg))


def try_previous_segment(log, seg) -> Column:
    ok = (from_hex(seg) < SEGS) & ~((from_hex(seg) == 0) & (from_hex(log) == 0))
    return F.when(ok, previous_segment(log, seg))


# ---- parsing -----------------------------------------------------------------------------

def parse_segment(name) -> Column:
    """struct(tli, log, seg); null for names that are no segment, e.g. history files."""
    n = col(name)
    return F.when(
        n.rlike(fixed.RX_SEGMENT),
        F.struct(
            F.substring(n, 1, 8).alias("tli"), F.substring(n, 9, 8).alias("log"), F.substring(n, 17, 8).alias("seg")
        ),
    )


def parse_backup_name(name) -> Column:
    """struct(tli, log, seg, offset); null where the text does not start with a backup name."""
    n = col(name)
    return F.when(
        n.rlike(fixed.RX_BACKUP),
        F.struct(
            F.substring(n, 6, 8).alias("tli"),
            F.substring(n, 14, 8).alias("log"),
            F.substring(n, 22, 8).alias("seg"),
            F.substring(n, 31, 8).alias("offset"),
        ),
    )


def parse_sentinel_key(key) -> Column:
    """struct(name, start segment, start offset); null for keys that are no sentinel."""
    last = base_name(key)
    return F.when(
        last.rlike(fixed.RX_SENTINEL),
        F.struct(
            F.substring(last, 1, 38).alias("name"),
            F.substring(last, 6, 24).alias("wal_segment_backup_start"),
            F.substring(last, 31, 8).alias("wal_segment_offset_backup_start"),
        ),
    )


def parse_url(url) -> Column:
    """struct(scheme, store_name, path_prefix): no leading slash, one trailing slash unless empty."""
    pattern = "^([^:/?#]+)://([^/?#]*)([^?#]*)"
    path = F.ltrim(F.regexp_extract(col(url), pattern, 3), F.lit("/"))
    path = F.when((path == "") | path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.struct(
        F.lower(F.regexp_extract(col(url), pattern, 1)).alias("scheme"),
        F.regexp_extract(col(url), pattern, 2).alias("store_name"),
        path.alias("path_prefix"),
    )


def scheme_supported(scheme) -> Column:
    return col(scheme).isin(*fixed.SCHEMES)


# ---- paths -------------------------------------------------------------------------------

def backups_dir(path_prefix, version=fixed.CURRENT_VERSION) -> Column:
    return F.concat(col(path_prefix), F.lit(fixed.BASE_AREA), _text(version), F.lit("/"))


def backup_dir(path_prefix, segment, offset) -> Column:
    return F.concat(backups_dir(path_prefix), F.lit("base_"), col(segment), F.lit("_"), col(offset), F.lit("/"))


def sentinel_path(path_prefix, segment, offset) -> Column:
    return F.concat(F.rtrim(backup_dir(path_prefix, segment, offset), F.lit("/")), F.lit(fixed.SENTINEL_SUFFIX))


def volume_dir(path_prefix, segment, offset) -> Column:
    return F.concat(backup_dir(path_prefix, segment, offset), F.lit(fixed.VOLUME_DIR + "/"))


def volume_path(path_prefix, segment, offset, volume_name) -> Column:
    return F.concat(volume_dir(path_prefix, segment, offset), col(volume_name))


def wal_dir(path_prefix, version=fixed.CURRENT_VERSION) -> Column:
    return F.concat(col(path_prefix), F.lit(fixed.WAL_AREA), _text(version), F.lit("/"))


def wal_path(path_prefix, name) -> Column:
    return F.concat(wal_dir(path_prefix), col(name), F.lit(".lzo"))


def volume_name(number) -> Column:
    return F.format_string("part_%08d.tar.lzo", col(number))


def backup_url_prefix(url, segment, offset) -> Column:
    return F.concat(
        F.rtrim(col(url), F.lit("/")), F.lit("/basebackups_005/base_"), col(segment), F.lit("_"), col(offset)
    )


def wal_url(url, name) -> Column:
    return F.concat(F.rtrim(col(url), F.lit("/")), F.lit("/wal_005/"), col(name), F.lit(".lzo"))


def render_url(scheme, container, key) -> Column:
    return F.concat(_text_or_col(scheme), F.lit("://"), _text_or_col(container), F.lit("/"), col(key))


def normal_key(key) -> Column:
    """Key without leading slashes: some stores list with them, some without."""
    return F.ltrim(col(key), F.lit("/"))


def modified(*candidates) -> Column:
    """Stores name the modification time differently; take the first that is there."""
    return F.coalesce(*[col(c) for c in candidates])


def depth(key) -> Column:
    return F.size(F.split(col(key), "/"))


def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def dir_name(path) -> Column:
    """Text before the last slash, '' where there is none."""
    p = col(path)
    return p.substr(F.lit(1), F.greatest(F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1, F.lit(0)))


def member_name(path, root) -> Column:
    """Path relative to `root` (which ends in a slash); a path outside of it is an error."""
    p, r = col(path), col(root)
    return F.when(p.startswith(r), p.substr(F.length(r) + 1, F.length(p))).otherwise(
        F.raise_error(F.concat(F.lit("path is not under the root: "), p)).cast("string")
    )


def iso_seconds(ts) -> Column:
    """Timestamp to ISO-8601 text without zone."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def epoch_iso(seconds) -> Column:
    return iso_seconds(F.timestamp_seconds(col(seconds)))


def log_time(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-00'")


def parse_log_time(text) -> Column:
    t = col(text)
    bare = F.when(t.endswith("-00"), t.substr(F.lit(1), F.length(t) - 3)).otherwise(t)
    return F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def kib_per_second(size_bytes, seconds) -> Column:
    """Rate as a double, null where no time passed (`kib_text` renders that as NaN)."""
    return F.try_divide(col(size_bytes) / F.lit(1024.0), col(seconds).cast("double"))


def kib_text(size_bytes, seconds) -> Column:
    """The rate with six significant digits, no trailing zeros, at least two characters."""
    rate = kib_per_second(size_bytes, seconds)
    digits = F.regexp_replace(F.format_string("%.6g", rate), "([.][0-9]*?)0+(e|$)", "$1$2")
    text = F.regexp_replace(digits, "[.](e|$)", "$1")
    return F.when(rate.isNull(), "NaN").when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def layout_version(key) -> Column:
    """Format version out of the area directory, null outside of any area."""
    return extract(key, "(?:^|/)(?:basebackups|wal)_([0-9]{3})/", 1)


def version_state(version) -> Column:
    v = col(version)
    return F.when(v == fixed.CURRENT_VERSION, "current").when(v.isin(*fixed.OBSOLETE_VERSIONS), "obsolete").otherwise(
        "unknown"
    )


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _text_or_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def parse_file_key(url) -> Column:
    """Key of a listed file: its URL without scheme, host and leading slashes."""
    return normal_key(F.regexp_replace(col(url), "^[^:/?#]+:(//[^/]*)?", ""))
