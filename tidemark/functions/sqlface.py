"""The same functions for SQL users: temporary functions, and one table function.

All of them are SQL-bodied, so Spark inlines them into the query.
"""

from pyspark.sql import SparkSession

SCALAR = {
    "hex8": "(n BIGINT) RETURNS STRING RETURN lpad(hex(n), 8, '0')",
    "segment_tli": "(name STRING) RETURNS STRING RETURN nullif(regexp_extract(name, '^([0-9A-F]{8})[0-9A-F]{16}', 1), '')",
    "segment_sn": "(name STRING) RETURNS STRING RETURN nullif(regexp_extract(name, '^[0-9A-F]{8}([0-9A-F]{16})', 1), '')",
    "sn_number": "(sn STRING) RETURNS DECIMAL(20,0) RETURN CAST(conv(sn, 16, 10) AS DECIMAL(20,0))",
    "sn_position": (
        "(sn STRING) RETURNS BIGINT RETURN CASE WHEN CAST(conv(substr(sn, 9, 8), 16, 10) AS BIGINT) < 256 THEN "
        "CAST(conv(substr(sn, 1, 8), 16, 10) AS BIGINT) * 256 + CAST(conv(substr(sn, 9, 8), 16, 10) AS BIGINT) END"
    ),
    "position_sn": "(p BIGINT) RETURNS STRING RETURN concat(lpad(hex(p div 256), 8, '0'), lpad(hex(p % 256), 8, '0'))",
    "backup_sn": (
        "(name STRING) RETURNS STRING RETURN nullif(regexp_extract(name, "
        "'^base_[0-9A-F]{8}([0-9A-F]{16})_[0-9A-F]{8}', 1), '')"
    ),
    "volume_file": "(v BIGINT) RETURNS STRING RETURN format_string('part_%08d.tar.lzo', v)",
    "base_name": "(path STRING) RETURNS STRING RETURN substring_index(path, '/', -1)",
    "key_depth": "(key STRING) RETURNS INT RETURN size(split(key, '/'))",
    "key_version": (
        "(key STRING) RETURNS STRING RETURN nullif(regexp_extract(key, '(?:^|/)(?:basebackups|wal)_([0-9]{3})/', 1), '')"
    ),
}

TABLE = {
    "segments_after": (
        "(tli STRING, sn STRING, n INT) RETURNS TABLE (step INT, segment STRING) RETURN "
        "SELECT s.step, concat(tli, position_sn(sn_position(sn) + s.step)) FROM "
        "(SELECT explode(sequence(1, n)) AS step) s WHERE sn_position(sn) + s.step < 1099511627776"
    ),
}


def register(spark: SparkSession) -> None:
    for name, body in {**SCALAR, **TABLE}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
