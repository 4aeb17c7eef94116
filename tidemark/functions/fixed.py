"""Fixed values of the archive format. They must be exactly these for results to be right."""

# ---- Fixed values: format versions -------------------------------------------------------
CURRENT_VERSION = "005"
OBSOLETE_VERSIONS = ("000", "001", "002", "003", "004")

# ---- Fixed values: store schemes ---------------------------------------------------------
SCHEMES = ("s3", "wabs", "swift", "gs", "file")

# ---- Fixed values: name patterns, anchored at the start only -----------------------------
SEGMENT = "([0-9A-F]{8})([0-9A-F]{8})([0-9A-F]{8})"
RX_SEGMENT = "^" + SEGMENT
RX_SEGMENT_READY = "^" + SEGMENT + r"\.ready"
RX_BACKUP = "^base_" + SEGMENT + "_([0-9A-F]{8})"
RX_SENTINEL = "^base_" + SEGMENT + r"_([0-9A-F]{8})_backup_stop_sentinel\.json"
RX_VOLUME = r"^part_([0-9]+)\.tar\.lzo"
RX_WAL_SEGMENT = "^" + SEGMENT + r"\.lzo"
RX_WAL_LABEL = "^" + SEGMENT + r"\.[A-F0-9]{8}[^\n]backup[^\n]lzo"
RX_WAL_HISTORY = r"^[A-F0-9]{8}\.history"

# ---- Fixed values: parts of key names ----------------------------------------------------
BASE_AREA = "basebackups_"
WAL_AREA = "wal_"
SENTINEL_SUFFIX = "_backup_stop_sentinel.json"
VERSION_FILE = "extended_version.txt"
VOLUME_DIR = "tar_partitions"

# ---- Fixed values: limits ----------------------------------------------------------------
SEGMENTS_PER_LOG = 256
DELETE_PAGE_KEYS = 1000
VOLUME_MAX_BYTES = 1610612736
VOLUME_MAX_MEMBERS = 6144

# ---- Fixed values: cluster files ---------------------------------------------------------
TOP_DIRS_NOT_ENTERED = ("pg_xlog", "pg_log", "pg_replslot", "pg_wal")
DIRS_NOT_ENTERED = ("pgsql_tmp", "pg_stat_tmp")
DIR_DROPPED = "lost+found"
TOP_FILES_DROPPED = (
    "postmaster.pid",
    "postmaster.opts",
    "postgresql.conf",
    "pg_hba.conf",
    "recovery.conf",
    "recovery.done",
    "pg_ident.conf",
    "promote",
)
TABLESPACE_DIR = "pg_tblspc"
TABLESPACE_DIR_NOT_ENTERED = "pgsql_tmp"

# ---- Fixed values: texts of the delete report --------------------------------------------
THING_TEXT = {
    "sentinel": "a base backup sentinel file",
    "version": "a extended version metadata file",
    "volume": "a base backup volume",
    "segment": "a wal file",
    "label": "a backup history file",
}
EVERYTHING_TEXT = {"base": "part of a base backup", "wal": "part of wal logs"}
DRY_RUN_HINT = "This is only a dry run -- no actual data is being deleted"

# ---- Our own words about unexpected keys --------------------------------------------------
UNEXPECTED_MSG = "key left out of the plan"
UNEXPECTED_DETAIL = "%s has no place in the layout: %s"
REASON_DETAIL = {
    "depth": "nothing is kept this many folders deep",
    "sentinel name": "a file here must be a backup sentinel",
    "version name": "a file here must be the version file of a backup",
    "volume name": "a file here must be a volume of a backup",
    "wal name": "a file here must be a segment, a label or a history file",
}

# ---- Our own words about retention --------------------------------------------------------
RETAIN_NONE = "Nothing to delete."
RETAIN_NONE_DETAIL = "The prefix has no complete backup."
RETAIN_ONE = "The only backup stays."
RETAIN_ALL = "All %d backups stay."
RETAIN_SOME = "%d older backups go."
RETAIN_SOME_DETAIL = "%d complete backups in all."
RETAIN_HINT = "Keys before %s go."

# ---- Fixed values: text of the volume limit ----------------------------------------------
TOO_BIG_HINT = (
    "There is a file in the postgres database directory that is larger than %d bytes. If no such file exists, "
    "please report this as a bug. In particular, check %s, which appears to be %d bytes."
)

# ---- Fixed values: action and state words of the archive log -----------------------------
ACTION_PUSH = "push-wal"
ACTION_FETCH = "wal-fetch"
STATES = ("begin", "complete", "skip")
