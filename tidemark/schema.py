"""Table schemas."""

from pyspark.sql import types as T

OBJECT_INVENTORY = "prefix_id bigint, bucket string, key string, size bigint, last_modified timestamp"
PREFIXES = "prefix_id bigint, url string"
SENTINEL_JSON = "prefix_id bigint, name string, body string"
SENTINEL_BODY = (
    "wal_segment_backup_stop string, wal_segment_offset_backup_stop string, expanded_size_bytes bigint, "
    "spec struct<base_prefix: string, tablespaces: array<string>>"
)
FILE_MANIFEST = "cluster_id string, path string, ftype string, size bigint, link_target string, ord bigint"
ARCHIVE_STATUS = "cluster_id bigint, file_name string"
TABLESPACE = "struct<loc: string, link: string>"

BACKUP_FIELDS = [
    "name",
    "last_modified",
    "expanded_size_bytes",
    "wal_segment_backup_start",
    "wal_segment_offset_backup_start",
    "wal_segment_backup_stop",
    "wal_segment_offset_backup_stop",
]


def empty(spark, ddl: str):
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))
