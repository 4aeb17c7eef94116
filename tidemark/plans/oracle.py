"""SQL counterparts of the registered queries, for any ANSI engine with the given tables.

`VIEWS` derives the archive tables as in `derived.py`; each query names the views it
needs and they are put in front of it as common table expressions.
"""

import re

X = "[0-9A-F]"

VIEWS = {
    "w0": """
        SELECT l_suppkey % 4 AS prefix_id, printf('%08X', 1 + (l_suppkey % 4) % 2) AS t,
               l_orderkey AS k, l_linenumber AS n, l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q, l_shipdate AS ts
        FROM lineitem""",
    "w1": """
        SELECT prefix_id, 'db' || prefix_id || '/wal_005/' || CASE WHEN n = 7 THEN 'sub/' ELSE '' END ||
               CASE WHEN rf = 'R' AND ls = 'F' AND n % 3 = 0 THEN t || '.history.lzo'
                    ELSE t || printf('%08X', k // 256) || printf('%08X', k % 256) ||
                         CASE WHEN rf IN ('N', 'A') THEN '.lzo' WHEN ls = 'F' THEN '.0000A000.backup.lzo'
                              WHEN n % 2 = 0 THEN '.lzo.tmp' ELSE '.partial' END END AS key,
               CAST(q * 1024 AS BIGINT) AS size, ts
        FROM w0""",
    "inv_wal": """
        SELECT prefix_id, 'bucket' || prefix_id % 2 AS bucket, key, max(size) AS size, max(ts) AS ts,
               'db' || prefix_id || '/' AS path_prefix
        FROM w1 GROUP BY prefix_id, key""",
    "b": """
        SELECT *, o_custkey % 4 AS prefix_id, CAST(floor(o_totalprice) AS BIGINT) AS price,
               'base_' || printf('%08X', 1 + (o_custkey % 4) % 2) || printf('%08X', o_orderkey // 256) ||
               printf('%08X', o_orderkey % 256) || '_' || printf('%08X', o_custkey) AS name
        FROM orders""",
    "b1": "SELECT *, 'db' || prefix_id || '/basebackups_005/' || name AS dir FROM b",
    "b2": """
        SELECT prefix_id, dir || '_backup_stop_sentinel.json' AS key, CAST(120 AS BIGINT) AS size, o_orderdate AS ts
        FROM b1 WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT prefix_id, dir || '/extended_version.txt', 64, o_orderdate
        FROM b1 WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL SELECT prefix_id, dir || '/tar_partitions/part_' || printf('%08X', v) || '.tar.lzo', price // (v + 1), o_orderdate
        FROM b1, (VALUES (0), (1), (2)) t(v) WHERE v <= o_orderkey % 3 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL SELECT prefix_id, CASE WHEN o_orderkey % 2 = 0 THEN dir || '_partial.json'
               ELSE 'db' || prefix_id || '/basebackups_005/a/b/c/d' || o_orderkey END, 1, o_orderdate
        FROM b1 WHERE o_orderpriority = '5-LOW'""",
    "inv_base": """
        SELECT prefix_id, 'bucket' || prefix_id % 2 AS bucket, key, size, ts, 'db' || prefix_id || '/' AS path_prefix FROM b2""",
    "inv": "SELECT * FROM inv_base UNION ALL SELECT * FROM inv_wal",
    "c0": """
        SELECT *, CASE WHEN starts_with(key, path_prefix || 'basebackups_005/') THEN 'base'
                       WHEN starts_with(key, path_prefix || 'wal_005/') THEN 'wal' END AS area FROM inv""",
    "c1": """
        SELECT *, string_split(substr(key, length(path_prefix) + CASE area WHEN 'base' THEN 17 ELSE 9 END), '/') AS parts
        FROM c0 WHERE area IS NOT NULL""",
    "c2": f"""
        SELECT *, CASE
            WHEN area = 'base' AND len(parts) = 1 AND regexp_matches(parts[1], '^base_{X}{{24}}_{X}{{8}}_backup_stop_sentinel\\.json') THEN 'sentinel'
            WHEN area = 'base' AND len(parts) = 2 AND regexp_matches(parts[1], '^base_{X}{{24}}_{X}{{8}}') AND parts[2] = 'extended_version.txt' THEN 'version'
            WHEN area = 'base' AND len(parts) = 3 AND regexp_matches(parts[1], '^base_{X}{{24}}_{X}{{8}}') AND parts[2] = 'tar_partitions' THEN 'volume'
            WHEN area = 'wal' AND len(parts) = 1 AND regexp_matches(parts[1], '^{X}{{24}}\\.lzo') THEN 'segment'
            WHEN area = 'wal' AND len(parts) = 1 AND regexp_matches(parts[1], '^{X}{{24}}\\.{X}{{8}}.backup.lzo') THEN 'label'
            WHEN area = 'wal' AND len(parts) = 1 AND regexp_matches(parts[1], '^{X}{{8}}\\.history') THEN 'history'
            ELSE 'unexpected' END AS thing FROM c1""",
    "classified": """
        SELECT *, CASE WHEN thing IN ('sentinel', 'version', 'volume') THEN substr(parts[1], 6, 24)
                       WHEN thing IN ('segment', 'label') THEN substr(parts[1], 1, 24) END AS start24,
               CASE WHEN thing IN ('sentinel', 'version', 'volume') THEN substr(parts[1], 1, 38) END AS backup_name,
               CASE WHEN thing <> 'unexpected' THEN NULL
                    WHEN area = 'base' AND len(parts) > 3 OR area = 'wal' AND len(parts) > 1 THEN 'depth'
                    WHEN area = 'wal' THEN 'wal name' WHEN len(parts) = 1 THEN 'sentinel name'
                    WHEN len(parts) = 2 THEN 'version name' ELSE 'volume name' END AS reason
        FROM c2""",
    "cl": "SELECT *, substr(start24, 1, 8) AS tli, substr(start24, 9, 16) AS sn FROM classified",
    "backups": """
        SELECT prefix_id, key, backup_name AS name, ts, start24 AS start, substr(backup_name, 31, 8) AS start_offset, tli, sn
        FROM cl WHERE thing = 'sentinel'""",
    "sj": """
        SELECT prefix_id, name,
               '{"wal_segment_backup_stop": "' || printf('%08X', 1 + prefix_id % 2) || printf('%08X', (o_orderkey + o_orderkey % 5) // 256) ||
               printf('%08X', (o_orderkey + o_orderkey % 5) % 256) || '", "wal_segment_offset_backup_stop": "' || printf('%08X', o_custkey) ||
               '", "expanded_size_bytes": ' || price * 3 || ', "spec": {"base_prefix": "/pg/db' || prefix_id || '", "tablespaces": [' ||
               CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '"' || (o_orderkey * 10 + 1) || '"'
                    ELSE '"' || (o_orderkey * 10 + 1) || '", "' || (o_orderkey * 10 + 2) || '"' END || ']' ||
               CASE WHEN o_orderkey % 3 >= 1 THEN ', "' || (o_orderkey * 10 + 1) || '": {"loc": "/data/ts' || (o_orderkey * 10 + 1) ||
                    '/", "link": "pg_tblspc/' || (o_orderkey * 10 + 1) || '"}' ELSE '' END ||
               CASE WHEN o_orderkey % 3 >= 2 THEN ', "' || (o_orderkey * 10 + 2) || '": {"loc": "/data/ts' || (o_orderkey * 10 + 2) ||
                    '/", "link": "pg_tblspc/' || (o_orderkey * 10 + 2) || '"}' ELSE '' END || '}}' AS body
        FROM b WHERE o_orderpriority = '1-URGENT'""",
    "detail": """
        SELECT prefix_id, name, CAST(json_extract_string(body, '$.expanded_size_bytes') AS BIGINT) AS expanded_size_bytes,
               json_extract_string(body, '$.wal_segment_backup_stop') AS stop,
               json_extract_string(body, '$.wal_segment_offset_backup_stop') AS stop_offset FROM sj""",
    "ranked_backups": """
        SELECT *, row_number() OVER (PARTITION BY prefix_id ORDER BY sn DESC, key) AS rn,
               count(*) OVER (PARTITION BY prefix_id) AS n FROM backups""",
    "horizon": "SELECT prefix_id, sn AS horizon_sn, key AS horizon_key, least(n, 5) AS retained FROM ranked_backups WHERE rn = least(n, 5)",
    "retain": """
        SELECT c.* FROM cl c JOIN horizon h USING (prefix_id) WHERE c.sn IS NOT NULL AND c.sn < h.horizon_sn""",
    "remaining": """
        SELECT c.prefix_id, c.key, c.thing, c.sn FROM cl c LEFT JOIN retain r ON r.prefix_id = c.prefix_id AND r.key = c.key WHERE r.key IS NULL""",
    "pages": """
        SELECT bucket, prefix_id, key, row_number() OVER (PARTITION BY bucket
            ORDER BY CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) % 4096, key, prefix_id) AS key_number FROM retain""",
    "pos": """
        SELECT DISTINCT prefix_id, tli, CAST('0x' || substr(sn, 1, 8) AS BIGINT) * 256 + CAST('0x' || substr(sn, 9, 8) AS BIGINT) AS pos
        FROM cl WHERE thing = 'segment'""",
    "pos_lag": "SELECT *, lag(pos) OVER (PARTITION BY prefix_id, tli ORDER BY pos) AS prev FROM pos",
    "gaps": """
        SELECT prefix_id, tli, prev + 1 AS gap_from, pos - 1 AS gap_to, pos - prev - 1 AS missing FROM pos_lag WHERE pos > prev + 1""",
    "runs": """
        SELECT prefix_id, tli, min(pos) AS from_pos, max(pos) AS to_pos, count(*) AS segments FROM (
            SELECT *, pos - row_number() OVER (PARTITION BY prefix_id, tli ORDER BY pos) AS g FROM pos)
        GROUP BY prefix_id, tli, g""",
    "manifest": """
        SELECT source AS cluster_id, lang || '/' || doc_id AS path, n_chars AS size, doc_id AS ord FROM documents""",
    "fit": """
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) AS i FROM manifest""",
    "fold": """
        SELECT cluster_id, path, size, ord, i, CASE WHEN size >= 250000 THEN 1 ELSE 0 END AS volume, size AS bytes, 1 AS members
        FROM fit WHERE i = 1
        UNION ALL
        SELECT f.cluster_id, f.path, f.size, f.ord, f.i,
               CASE WHEN p.bytes + f.size >= 250000 OR p.members >= 100 THEN p.volume + 1 ELSE p.volume END,
               CASE WHEN p.bytes + f.size >= 250000 OR p.members >= 100 THEN f.size ELSE p.bytes + f.size END,
               CASE WHEN p.bytes + f.size >= 250000 OR p.members >= 100 THEN 1 ELSE p.members + 1 END
        FROM fold p JOIN fit f ON f.cluster_id = p.cluster_id AND f.i = p.i + 1""",
    "t0": """
        SELECT 'c' || o_custkey AS cluster_id,
               (['', 'base/1/', 'base/1/pgsql_tmp/', 'pg_wal/', 'base/lost+found/', 'pg_tblspc/7/PG/', 'pg_tblspc/7/pgsql_tmp/', 'pg_stat_tmp/'])[o_orderkey % 8 + 1] ||
               CASE WHEN o_orderstatus = 'P' THEN (['postgresql.conf', 'postmaster.pid', 'PG_VERSION', 'pgsql_tmp'])[o_orderkey % 4 + 1]
                    ELSE 'f' || o_orderkey END AS path,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'dir' ELSE 'file' END AS ftype
        FROM orders""",
    "tree": """
        SELECT cluster_id, path, min(ftype) AS ftype, string_split(path, '/') AS parts FROM t0 GROUP BY cluster_id, path
        UNION ALL SELECT DISTINCT 'c' || o_custkey, 'pg_tblspc/7', CASE WHEN o_custkey % 7 = 0 THEN 'link' ELSE 'dirlink' END, ['pg_tblspc', '7'] FROM orders""",
    "status": """
        SELECT o_custkey % 4 AS cluster_id,
               printf('%08X', 1 + (o_custkey % 4) % 2) || printf('%08X', o_orderkey // 256) || printf('%08X', o_orderkey % 256) AS segment,
               o_orderstatus AS s, o_orderpriority AS pr FROM orders""",
    "ready": "SELECT cluster_id, segment FROM status WHERE s = 'O'",
    "archived": "SELECT DISTINCT prefix_id AS cluster_id, start24 AS segment FROM classified WHERE thing = 'segment'",
    "ev": """
        SELECT event_id, ts, user_id AS pid, event_type AS kind,
               CASE event_type WHEN 'click' THEN 'wal-fetch' ELSE 'push-wal' END AS action,
               's3://store/wal-' || user_id || '.lzo' AS key, 'db' || user_id % 4 || '/' AS prefix,
               CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS rate,
               '00000001' || printf('%08X', event_id // 5 // 256) || printf('%08X', event_id // 5 % 256) AS seg, event_id // 5 AS pos,
               CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'skip' WHEN 'view' THEN 'begin' WHEN 'click' THEN 'begin' END AS state,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS tt
        FROM events""",
    "lines": """
        SELECT CASE WHEN kind = 'error' THEN 'DETAIL: The socket error''s message is ''reset''.  There have been ' || (1 + event_id % 5) ||
                 ' attempts to send the volume ' || pid % 50 || ' so far.'
               ELSE 'STRUCTURED: time=' || tt || ' pid=' || pid || ' action=' || action || ' key=' || key || ' prefix=' || prefix ||
                 CASE WHEN rate IS NOT NULL THEN ' rate=' || rate ELSE '' END || ' seg=' || seg ||
                 CASE WHEN state IS NOT NULL THEN ' state=' || state ELSE '' END END AS value
        FROM ev""",
    "typed": "SELECT ts, pid, action, key, seg, prefix, state, CAST(rate AS DOUBLE) AS rate, tt, pos FROM ev WHERE kind <> 'error'",
    "snap": "SELECT * FROM inv_wal",
    "snap_old": "SELECT prefix_id, key, size FROM inv_wal WHERE NOT ends_with(key, '.partial')",
    "snap_new": """
        SELECT prefix_id, key, CASE WHEN size > 40960 THEN size + 1 ELSE size END AS size FROM inv_wal WHERE NOT ends_with(key, '.tmp')""",
    "old_keys": "SELECT *, replace(key, '_005/', '_00' || size % 6 || '/') AS vkey FROM inv",
    "pu": """
        SELECT prefix, pid, key, ts, state FROM typed WHERE action = 'push-wal'""",
    "pairs": """
        SELECT l.prefix, l.pid, l.key, l.ts AS begin_ts, r.state AS outcome, epoch_us(r.ts) - epoch_us(l.ts) AS duration_us
        FROM pu l LEFT JOIN pu r ON l.prefix = r.prefix AND l.pid = r.pid AND l.key = r.key AND r.state IN ('complete', 'skip')
             AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 10 MINUTE
        WHERE l.state = 'begin'""",
    "pair_mark": """
        SELECT least(date_trunc('millisecond', (SELECT max(ts) FROM pu WHERE state = 'begin')),
                     date_trunc('millisecond', (SELECT max(ts) FROM pu WHERE state IN ('complete', 'skip')))) - INTERVAL 1 HOUR AS mark""",
    "paired": """
        SELECT p.* FROM pairs p CROSS JOIN pair_mark m
        WHERE outcome IS NOT NULL OR begin_ts <= m.mark - INTERVAL 10 MINUTE""",
    "begun": """
        SELECT *, lead(b) OVER (PARTITION BY prefix, pid, key ORDER BY b) AS next_b FROM (SELECT DISTINCT prefix, pid, key, ts AS b FROM pu WHERE state = 'begin')""",
    "arrived": "SELECT prefix, '00000001' AS tli, pos, ts, seg FROM typed WHERE action = 'push-wal' AND state IN ('complete', 'skip')",
    "first_ticks": """
        SELECT prefix, tli, pos, min(time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE) AS tick FROM arrived GROUP BY prefix, tli, pos""",
    "due_first": """
        SELECT *, min(tick + INTERVAL 1 HOUR) OVER (PARTITION BY prefix, tli ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS passed
        FROM first_ticks""",
    "arrived_states": "SELECT prefix, state, ts FROM typed WHERE action = 'push-wal' AND state IN ('complete', 'skip')",
    "sess0": "SELECT prefix, ts, lag(ts) OVER (PARTITION BY prefix ORDER BY ts) AS prev FROM typed WHERE action = 'wal-fetch'",
    "sess1": """
        SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 10 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY prefix ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM sess0""",
}

ISO = "'%Y-%m-%dT%H:%M:%S'"


def _names_in(sql):
    return [v for v in VIEWS if re.search(rf"(?<![\w.'])(?:FROM|JOIN)\s+{v}\b", sql)]


def _with(sql: str) -> str:
    """Put the views a query needs in front of it, each after those it needs itself."""
    order: list[str] = []

    def need(text):
        for v in _names_in(text):
            if v not in order:
                if v != "fold":
                    need(VIEWS[v])
                else:
                    need(VIEWS["fold"].replace("FROM fold", ""))
                if v not in order:
                    order.append(v)

    need(sql)
    if not order:
        return sql.strip()
    recursive = "RECURSIVE " if "fold" in order else ""
    return f"WITH {recursive}" + ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in order) + "\n" + sql.strip()


_THING_TEXT = """CASE thing WHEN 'sentinel' THEN 'a base backup sentinel file' WHEN 'version' THEN 'a extended version metadata file'
    WHEN 'volume' THEN 'a base backup volume' WHEN 'segment' THEN 'a wal file' WHEN 'label' THEN 'a backup history file' END"""
_DETAIL = """CASE reason WHEN 'depth' THEN 'nothing is kept this many folders deep'
    WHEN 'sentinel name' THEN 'a file here must be a backup sentinel'
    WHEN 'version name' THEN 'a file here must be the version file of a backup'
    WHEN 'volume name' THEN 'a file here must be a volume of a backup'
    ELSE 'a file here must be a segment, a label or a history file' END"""


def _sn(expr):
    return f"printf('%08X', ({expr}) // 256) || printf('%08X', ({expr}) % 256)"


def _num(text):
    return f"CAST('0x' || {text} AS BIGINT)"


def _windows(slide_minutes):
    starts = "time_bucket(INTERVAL 5 MINUTE, ts)"
    if slide_minutes:
        starts = "unnest([time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(m) for m in range(5)])"
    return f"""
        SELECT strftime(ws, {ISO}) AS window_start, strftime(ws + INTERVAL 5 MINUTE, {ISO}) AS window_end, prefix,
               count(*) AS uploads, sum(rate) AS rate_sum, max(rate) AS rate_max
        FROM (SELECT prefix, rate, {starts} AS ws FROM typed WHERE action = 'push-wal' AND state = 'complete')
        GROUP BY ws, prefix
        HAVING ws + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE
                                          FROM typed WHERE action = 'push-wal' AND state = 'complete')"""


_SEG = "regexp_extract(key, '[^/]*$')"

_SQL = {
    "list_objects_classified": f"""
        SELECT prefix_id, key, size, strftime(ts, {ISO}) AS last_modified, CAST(len(string_split(key, '/')) AS INTEGER) AS depth,
               area, thing, tli, sn FROM cl""",
    "quarantine": f"""
        SELECT prefix_id, key, area, reason, 'key left out of the plan' AS msg,
               's3://' || bucket || '/' || key || ' has no place in the layout: ' || {_DETAIL} AS detail,
               'No rule of the archive layout names this key, so it is left alone. Look where it comes from.' AS hint
        FROM classified WHERE thing = 'unexpected'""",
    "classifier_exclusive": f"""
        SELECT prefix_id, max(m) AS most_matches, max(m) <= 1 AS exclusive FROM (
            SELECT prefix_id, CAST(regexp_matches(n, '^{X}{{24}}\\.lzo') AS BIGINT) + CAST(regexp_matches(n, '^{X}{{24}}\\.{X}{{8}}.backup.lzo') AS BIGINT)
                   + CAST(regexp_matches(n, '^{X}{{8}}\\.history') AS BIGINT) AS m
            FROM (SELECT prefix_id, {_SEG} AS n FROM inv_wal)) GROUP BY prefix_id""",
    "volume_listing": f"""
        SELECT prefix_id, backup_name, key, parts[3] AS volume, regexp_matches(parts[3], '^part_[0-9]+\\.tar\\.lzo') AS expected
        FROM classified WHERE thing = 'volume'""",
    "footprint": f"""
        SELECT prefix_id, thing, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, strftime(min(ts), {ISO}) AS oldest,
               strftime(max(ts), {ISO}) AS newest, grouping(prefix_id, thing) AS level FROM classified GROUP BY ROLLUP (prefix_id, thing)""",
    "distinct_estimate": "SELECT prefix_id, count(DISTINCT key) AS objects, true AS estimate_near FROM inv GROUP BY prefix_id",
    "backup_list": f"""
        SELECT prefix_id, name, strftime(ts, {ISO}) AS last_modified, CAST(NULL AS BIGINT) AS expanded_size_bytes,
               start AS wal_segment_backup_start, start_offset AS wal_segment_offset_backup_start,
               CAST(NULL AS VARCHAR) AS wal_segment_backup_stop, CAST(NULL AS VARCHAR) AS wal_segment_offset_backup_stop FROM backups""",
    "backup_list_detail": f"""
        SELECT prefix_id, name, strftime(ts, {ISO}) AS last_modified, expanded_size_bytes,
               start AS wal_segment_backup_start, start_offset AS wal_segment_offset_backup_start,
               stop AS wal_segment_backup_stop, stop_offset AS wal_segment_offset_backup_stop
        FROM backups LEFT JOIN detail USING (prefix_id, name)""",
    "latest_backup": f"""
        SELECT prefix_id, name, strftime(ts, {ISO}) AS last_modified FROM (
            SELECT *, row_number() OVER (PARTITION BY prefix_id ORDER BY ts DESC, key DESC) AS r FROM backups) WHERE r = 1""",
    "find_backup": """
        SELECT r.request_id, r.prefix_id, r.query, count(k.name) AS matches, count(k.name) = 1 AS fetchable
        FROM (SELECT o_orderkey AS request_id, prefix_id, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'LATEST' ELSE name END AS query FROM b) r
        LEFT JOIN (SELECT prefix_id, name, name AS q FROM backups
                   UNION ALL SELECT prefix_id, max_by(name, (ts, key)), 'LATEST' FROM backups GROUP BY prefix_id) k
          ON k.prefix_id = r.prefix_id AND k.q = r.query
        GROUP BY r.request_id, r.prefix_id, r.query""",
    "requested_backups": f"""
        SELECT prefix_id, name, strftime(ts, {ISO}) AS last_modified FROM backups
        WHERE (prefix_id, name) IN (SELECT (prefix_id, name) FROM b WHERE o_orderstatus = 'O')""",
    "incomplete_backups": """
        SELECT prefix_id, backup_name, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM classified c
        WHERE thing IN ('version', 'volume') AND NOT EXISTS (
            SELECT 1 FROM backups k WHERE k.prefix_id = c.prefix_id AND k.name = c.backup_name)
        GROUP BY prefix_id, backup_name""",
    "compression_ratio": """
        SELECT prefix_id, name, volumes, stored_bytes, expanded_size_bytes, round(stored_bytes / CAST(expanded_size_bytes AS DOUBLE), 6) AS ratio
        FROM (SELECT prefix_id, backup_name AS name, count(*) AS volumes, CAST(sum(size) AS BIGINT) AS stored_bytes
              FROM classified WHERE thing = 'volume' GROUP BY 1, 2) JOIN detail USING (prefix_id, name)""",
    "tablespaces": """
        SELECT prefix_id, name, ts AS tablespace, json_extract_string(body, '$.spec."' || ts || '".loc') AS loc,
               json_extract_string(body, '$.spec."' || ts || '".link') AS link
        FROM (SELECT prefix_id, name, body, unnest(CAST(json_extract(body, '$.spec.tablespaces') AS VARCHAR[])) AS ts FROM sj)""",
    "backup_cadence": f"""
        SELECT prefix_id, name, lag(name) OVER w AS previous_name, pos - lag(pos) OVER w AS segments_between,
               CAST(epoch(ts) AS BIGINT) - lag(CAST(epoch(ts) AS BIGINT)) OVER w AS seconds_between
        FROM (SELECT *, {_num("substr(sn, 1, 8)")} * 256 + {_num("substr(sn, 9, 8)")} AS pos FROM backups)
        WINDOW w AS (PARTITION BY prefix_id ORDER BY pos, name)""",
    "restore_point": f"""
        SELECT request_id, prefix_id, strftime(target, {ISO}) AS target, name, strftime(bts, {ISO}) AS last_modified FROM (
            SELECT r.o_orderkey AS request_id, r.prefix_id, r.o_orderdate AS target, max_by(k.name, (k.ts, k.key)) AS name, max(k.ts) AS bts
            FROM b r LEFT JOIN backups k ON k.prefix_id = r.prefix_id AND k.ts <= r.o_orderdate
            WHERE r.o_orderpriority = '3-MEDIUM' GROUP BY ALL)""",
    "delete_retain": "SELECT prefix_id, key, size, thing, sn FROM retain",
    "delete_retain_summary": """
        SELECT prefix_id, thing, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS newest FROM retain GROUP BY prefix_id, thing""",
    "retention_horizon": "SELECT prefix_id, horizon_sn, horizon_key, retained FROM horizon",
    "retention_message": """
        SELECT prefix_id, n AS backups, greatest(n - 5, 0) AS deleting,
               CASE WHEN n = 0 THEN 'Nothing to delete.' WHEN n > 5 THEN n - 5 || ' older backups go.'
                    WHEN n = 1 THEN 'The only backup stays.' ELSE 'All ' || n || ' backups stay.' END AS message,
               CASE WHEN n = 0 THEN 'The prefix has no complete backup.' WHEN n > 5 THEN n || ' complete backups in all.' END AS detail,
               CASE WHEN n > 0 THEN 'Keys before s3://bucket' || prefix_id % 2 || '/' || horizon_key || ' go.' END AS hint
        FROM (SELECT p.prefix_id, count(k.name) AS n FROM (SELECT DISTINCT c_custkey % 4 AS prefix_id FROM customer) p
              LEFT JOIN backups k USING (prefix_id) GROUP BY p.prefix_id) LEFT JOIN horizon USING (prefix_id)""",
    "delete_before": """
        SELECT c.prefix_id, c.key, c.size, c.thing, c.sn FROM cl c
        JOIN (SELECT prefix_id, max_by(sn, (ts, key)) AS h FROM backups GROUP BY prefix_id) l USING (prefix_id)
        WHERE c.sn < l.h""",
    "delete_everything": """
        SELECT prefix_id, key, size, CASE area WHEN 'base' THEN 'part of a base backup' ELSE 'part of wal logs' END AS what FROM classified""",
    "delete_report": f"""
        SELECT prefix_id, key, 's3://' || bucket || '/' || key AS url, {_THING_TEXT} AS thing, 'deleting ' || {_THING_TEXT} AS msg,
               'The key being deleted is s3://' || bucket || '/' || key || '.' AS detail,
               'This is only a dry run -- no actual data is being deleted' AS hint, true AS dry_run FROM retain""",
    "delete_old_versions": """
        SELECT prefix_id, vkey AS key, '00' || size % 6 AS version,
               CASE WHEN starts_with(substr(vkey, length(path_prefix) + 1), 'wal_') THEN 'wal' ELSE 'base' END AS area
        FROM old_keys WHERE size % 6 < 5""",
    "version_check": """
        SELECT prefix_id, '00' || size % 6 AS version, count(*) AS objects, CASE WHEN size % 6 = 5 THEN 'current' ELSE 'obsolete' END AS state
        FROM old_keys GROUP BY ALL""",
    "delete_pages": "SELECT bucket, prefix_id, key, key_number, (key_number - 1) // 1000 AS page FROM pages",
    "delete_page_sizes": """
        SELECT first_page + (key_number - 1) // 1000 AS page_id, count(*) AS keys, count(DISTINCT bucket) = 1 AS one_bucket
        FROM pages JOIN (SELECT bucket, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page
                         FROM (SELECT bucket, (max(key_number) - 1) // 1000 + 1 AS n FROM pages GROUP BY bucket)) USING (bucket)
        GROUP BY 1""",
    "mixed_pages": """
        SELECT l_orderkey // 1000 AS page, count(*) AS keys, count(DISTINCT l_orderkey // 1500) AS buckets,
               count(DISTINCT l_orderkey // 1500) = 1 AS homogeneous FROM lineitem GROUP BY 1""",
    "plan_rerun": """
        SELECT count(*) AS still_deleted FROM remaining JOIN (
            SELECT prefix_id, min(sn) AS again FROM (
                SELECT prefix_id, sn, row_number() OVER (PARTITION BY prefix_id ORDER BY sn DESC, key) AS rn FROM remaining WHERE thing = 'sentinel')
            WHERE rn <= 5 GROUP BY prefix_id) USING (prefix_id)
        WHERE sn < again""",
    "plan_difference": """
        SELECT r.prefix_id, r.key, r.thing FROM retain r
        JOIN (SELECT prefix_id, min(sn) AS h FROM ranked_backups WHERE rn <= 20 GROUP BY prefix_id) h20 USING (prefix_id)
        WHERE NOT r.sn < h20.h""",
    "empty_dirs": """
        SELECT prefix_id, dir, count(*) AS deleted_keys
        FROM (SELECT prefix_id, regexp_replace(key, '/[^/]*$', '') AS dir FROM retain) d
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT i.prefix_id, i.key FROM inv i LEFT JOIN retain r ON r.prefix_id = i.prefix_id AND r.key = i.key
                                         WHERE r.key IS NULL) s
                          WHERE s.prefix_id = d.prefix_id AND starts_with(s.key, d.dir || '/'))
          AND (prefix_id, dir) NOT IN (SELECT (prefix_id, list_aggregate(list_slice(string_split(regexp_replace(key, '/[^/]*$', ''), '/'), 1, k), 'string_agg', '/'))
                                       FROM retain, range(1, 6) t(k) WHERE k < len(string_split(regexp_replace(key, '/[^/]*$', ''), '/')))
          AND dir <> 'db' || prefix_id
        GROUP BY prefix_id, dir""",
    "segment_parse": f"""
        SELECT prefix_id, n AS name, CASE WHEN ok THEN substr(n, 1, 8) END AS tli, CASE WHEN ok THEN substr(n, 9, 8) END AS log,
               CASE WHEN ok THEN substr(n, 17, 8) END AS seg, CASE WHEN ok THEN {_num("substr(n, 9, 16)")} END AS number
        FROM (SELECT prefix_id, {_SEG} AS n, regexp_matches({_SEG}, '^{X}{{24}}') AS ok FROM inv_wal)""",
    "segment_next": """
        SELECT o_orderkey AS k, printf('%08X', (o_orderkey + 1) // 256) AS next_log, printf('%08X', (o_orderkey + 1) % 256) AS next_seg FROM orders""",
    "segment_prev": """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey > 0 THEN printf('%08X', greatest(o_orderkey - 1, 0) // 256) END AS prev_log,
               CASE WHEN o_orderkey > 0 THEN printf('%08X', greatest(o_orderkey - 1, 0) % 256) END AS prev_seg FROM orders""",
    "wal_gaps": "SELECT prefix_id, tli, gap_from, gap_to, missing FROM gaps",
    "wal_gaps_skip_ff": """
        SELECT prefix_id, tli, gap_from, gap_to, missing FROM gaps WHERE NOT (missing = 1 AND gap_from % 256 = 255)""",
    "wal_islands": "SELECT prefix_id, tli, from_pos, to_pos, segments FROM runs",
    "wal_restarts": f"""
        SELECT prefix_id, tli, pos, kind FROM (
            SELECT prefix_id, tli, pos, CASE WHEN lag(pos) OVER w IS NULL THEN 'first' WHEN lag(tli) OVER w <> tli THEN 'timeline'
                   WHEN pos > lag(pos) OVER w + 1 THEN 'gap' END AS kind
            FROM (SELECT DISTINCT prefix_id, CASE WHEN size > 25600 THEN '00000009' ELSE tli END AS tli,
                         {_num("substr(sn, 1, 8)")} * 256 + {_num("substr(sn, 9, 8)")} AS pos FROM cl WHERE thing = 'segment')
            WINDOW w AS (PARTITION BY prefix_id ORDER BY pos, tli)) WHERE kind IS NOT NULL""",
    "segments_after": f"""
        SELECT prefix_id, name, step, tli || {_sn("p + step")} AS segment
        FROM (SELECT *, {_num("substr(sn, 1, 8)")} * 256 + {_num("substr(sn, 9, 8)")} AS p FROM backups), range(1, 9) t(step)""",
    "missing_segments": f"""
        SELECT prefix_id, tli, pos, tli || {_sn("pos")} AS segment
        FROM (SELECT prefix_id, tli, unnest(range(gap_from, gap_to + 1)) AS pos FROM gaps)""",
    "missing_next_segments": f"""
        SELECT DISTINCT e.prefix_id, e.tli || {_sn("e.pos")} AS segment
        FROM (SELECT prefix_id, tli, {_num("substr(sn, 1, 8)")} * 256 + {_num("substr(sn, 9, 8)")} + step AS pos FROM backups, range(1, 9) t(step)) e
        LEFT JOIN pos a ON a.prefix_id = e.prefix_id AND a.tli = e.tli AND a.pos = e.pos WHERE a.pos IS NULL""",
    "backup_covered": f"""
        SELECT r.prefix_id, r.tli, r.name, r.a AS start_pos, r.z AS stop_pos, r.z - r.a + 1 AS expected,
               (SELECT count(*) FROM pos p WHERE p.prefix_id = r.prefix_id AND p.tli = r.tli AND p.pos BETWEEN r.a AND r.z) = r.z - r.a + 1 AS covered
        FROM (SELECT prefix_id, tli, name, {_num("substr(sn, 1, 8)")} * 256 + {_num("substr(sn, 9, 8)")} AS a,
                     {_num("substr(stop, 9, 8)")} * 256 + {_num("substr(stop, 17, 8)")} AS z
              FROM backups JOIN detail USING (prefix_id, name)) r""",
    "volume_pack": "SELECT cluster_id, path, size, CAST(volume AS BIGINT) AS volume FROM fold",
    "volume_sizes": """
        SELECT cluster_id, CAST(volume AS BIGINT) AS volume, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS members
        FROM fold GROUP BY GROUPING SETS ((cluster_id, volume), (cluster_id))""",
    "volume_too_big": """
        SELECT cluster_id, path, size, 'There is a file in the postgres database directory that is larger than 10000 bytes. If no such file exists, please report this as a bug. In particular, check ' || path || ', which appears to be ' || size || ' bytes.' AS hint
        FROM manifest WHERE size > 10000""",
    "manifest_lines": """
        SELECT cluster_id, printf('part_%08d.tar.lzo', volume) AS volume_name, path || chr(9) || size AS line FROM fold""",
    "manifest_filter": """
        SELECT t.cluster_id, t.path, t.ftype FROM tree t
        LEFT JOIN (SELECT cluster_id AS linked FROM tree WHERE ftype = 'dirlink') l ON t.cluster_id = l.linked
        WHERE CASE
            WHEN parts[1] = 'pg_tblspc' AND len(parts) = 2 THEN ftype <> 'dirlink'
            WHEN parts[1] = 'pg_tblspc' AND len(parts) > 2 AND linked IS NOT NULL THEN
                NOT list_contains(parts[3:len(parts) - 1], 'pgsql_tmp')
                AND (ftype <> 'dir' OR parts[-1] = 'pgsql_tmp' OR NOT EXISTS (
                    SELECT 1 FROM tree f WHERE f.cluster_id = t.cluster_id AND f.ftype <> 'dir'
                       AND regexp_replace(f.path, '/[^/]*$', '') = t.path))
            ELSE NOT (len(parts) > 1 AND parts[1] IN ('pg_xlog', 'pg_log', 'pg_replslot', 'pg_wal'))
                AND NOT list_has_any(parts[1:len(parts) - 1], ['pgsql_tmp', 'pg_stat_tmp'])
                AND NOT list_contains(parts[1:len(parts) - 1], 'lost+found') AND NOT (parts[-1] = 'lost+found' AND ftype = 'dir')
                AND NOT (len(parts) = 1 AND ftype <> 'dir' AND parts[1] IN ('postmaster.pid', 'postmaster.opts', 'postgresql.conf',
                         'pg_hba.conf', 'recovery.conf', 'recovery.done', 'pg_ident.conf', 'promote')) END""",
    "tablespace_spec": """
        SELECT DISTINCT 'c' || o_custkey AS cluster_id, '7' AS tablespace, '/data/c' || o_custkey || '/' AS loc, 'pg_tblspc/7' AS link FROM orders
        WHERE o_custkey % 7 <> 0""",
    "member_names": """
        SELECT cluster_id, path AS member, regexp_extract(path, '[^/]*$') AS base_name,
               '/pg/' || cluster_id || '/' || regexp_replace(path, '/[^/]*$', '') AS dir_name FROM manifest""",
    "outside_root": "SELECT cluster_id, path FROM manifest WHERE NOT starts_with(path, 'en/')",
    "unlinked_members": """
        SELECT cluster_id, path, CASE WHEN ord IN (SELECT doc_id FROM labels) THEN 'archive' ELSE 'skip' END AS state FROM manifest""",
    "common_prefix": """
        SELECT prefix_id, common_prefix, CASE WHEN contains(common_prefix, '/') THEN regexp_replace(common_prefix, '/[^/]*$', '') ELSE '' END AS common_dir
        FROM (SELECT prefix_id, substr(lo, 1, CAST((SELECT count(*) FROM range(1, 1 + least(length(lo), length(hi))) t(i)
                     WHERE substr(lo, 1, i) = substr(hi, 1, i)) AS BIGINT)) AS common_prefix
              FROM (SELECT prefix_id, min(key) AS lo, max(key) AS hi FROM cl WHERE tli IS NOT NULL GROUP BY prefix_id))""",
    "touched_dirs": "SELECT DISTINCT source AS cluster_id, lang AS dir FROM documents",
    "volume_round_trip": """
        SELECT m.cluster_id, m.path, CAST(f.volume AS BIGINT) AS volume, CASE WHEN f.volume IS NOT NULL THEN md5(d.text) END AS content_md5
        FROM manifest m JOIN documents d ON d.doc_id = m.ord LEFT JOIN fold f ON f.cluster_id = m.cluster_id AND f.ord = m.ord""",
    "ready_markers": "SELECT cluster_id, segment FROM ready",
    "pending_oldest": """
        SELECT cluster_id, rn, segment, backlog FROM (
            SELECT cluster_id, segment, row_number() OVER (PARTITION BY cluster_id ORDER BY segment) AS rn,
                   count(*) OVER (PARTITION BY cluster_id) AS backlog FROM ready) WHERE rn <= 10""",
    "push_batch": """
        SELECT cluster_id, segment, slot, explicit FROM (
            SELECT cluster_id, segment, explicit, row_number() OVER (PARTITION BY cluster_id ORDER BY explicit DESC, segment) AS slot
            FROM (SELECT cluster_id, segment, segment = max(segment) OVER (PARTITION BY cluster_id) AS explicit FROM ready)) WHERE slot <= 10""",
    "status_reconcile": """
        SELECT cluster_id, segment, CASE WHEN s IS NULL THEN 'archived-unmarked' WHEN s = 'O' AND a THEN 'ready-archived' WHEN s = 'O' THEN 'ready-missing'
               WHEN a THEN 'done-archived' ELSE 'done-missing' END AS state
        FROM (SELECT cluster_id, segment, s FROM status WHERE s IN ('O', 'F')) m
        FULL JOIN (SELECT cluster_id, segment, true AS a FROM archived) x USING (cluster_id, segment)""",
    "skipped_markers": """
        SELECT cluster_id, segment, 'skip' AS state FROM status WHERE s = 'O' AND pr = '2-HIGH'""",
    "shared_prefix": """
        SELECT 'store' || l_suppkey // 2 AS path_prefix, count(DISTINCT l_suppkey) AS writers, count(*) AS objects
        FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""",
    "inventory_diff": """
        SELECT prefix_id, key, CASE WHEN o.size IS NULL THEN 'added' WHEN n.size IS NULL THEN 'removed' WHEN o.size = n.size THEN 'kept' ELSE 'changed' END AS status
        FROM snap_old o FULL JOIN snap_new n USING (prefix_id, key)""",
    "inventory_common": "SELECT prefix_id, key, size FROM snap_old INTERSECT SELECT prefix_id, key, size FROM snap_new",
    "prefix_parse": """
        SELECT CAST(n_nationkey AS BIGINT) AS prefix_id, (['s3', 'wabs', 'swift', 'gs', 'file', 'ftp'])[n_nationkey % 6 + 1] AS scheme,
               lower(n_name) AS store_name, 'region' || n_regionkey || '/' AS path_prefix, n_nationkey % 6 < 5 AS supported FROM nation""",
    "layout_paths": """
        SELECT prefix_id, name, 'some/where/basebackups_005/' AS backups_dir, 'some/where/basebackups_005/' || name || '/' AS backup_dir,
               'some/where/basebackups_005/' || name || '_backup_stop_sentinel.json' AS sentinel,
               'some/where/basebackups_005/' || name || '/tar_partitions/' AS volume_dir,
               'some/where/basebackups_005/' || name || '/tar_partitions/' || printf('part_%08d.tar.lzo', o_orderkey % 1000) AS volume,
               'some/where/wal_005/' AS wal_dir, 'some/where/wal_005/' || substr(name, 6, 24) || '.lzo' AS wal,
               's3://store/some/where/basebackups_005/' || name AS backup_url,
               's3://store/some/where/wal_005/' || substr(name, 6, 24) || '.lzo' AS wal_url FROM b""",
    "layout_join": """
        SELECT s_nationkey::BIGINT AS prefix_id,
               (['s3', 'wabs', 'swift', 'gs', 'file', 'ftp'])[n_nationkey % 6 + 1] || '://' || lower(n_name) || '/region' || n_regionkey || '/obj' || s_suppkey AS url,
               count(*) AS objects
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
    "scalar_times_and_rates": f"""
        SELECT event_id, strftime(make_timestamp(event_id * 1000 * 1000000), {ISO}) AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS log_time,
               round(event_id / CAST(nullif(CAST(floor(value) AS BIGINT) % 7, 0) AS DOUBLE), 6) AS kib_per_second,
               CAST(floor(value) AS BIGINT) % 7 = 0 AS no_rate FROM events""",
    "log_render": "SELECT value FROM lines",
    "log_parse": "SELECT tt AS time, pid, action, key, seg, prefix, state, rate FROM typed",
    "log_pairs": """
        SELECT key, value, count(*) AS lines FROM (
            SELECT 'time' AS key, tt AS value FROM typed UNION ALL SELECT 'pid', CAST(pid AS VARCHAR) FROM typed UNION ALL SELECT 'action', action FROM typed
            UNION ALL SELECT 'key', key FROM typed UNION ALL SELECT 'prefix', prefix FROM typed UNION ALL SELECT 'seg', seg FROM typed
            UNION ALL SELECT 'state', state FROM typed UNION ALL SELECT 'rate', CAST(CAST(rate AS BIGINT) AS VARCHAR) FROM typed)
        WHERE value IS NOT NULL GROUP BY key, value""",
    "log_records": """
        SELECT tt AS time, pid, action, prefix, state, CAST(rate AS DOUBLE) AS rate, 'saw a ' || kind AS msg,
               CASE WHEN kind = 'purchase' THEN 'Sent object ' || event_id || '.' || chr(10) || 'It took ' || event_id % 7 || ' parts.' END AS detail,
               CASE WHEN kind = 'error' THEN 'Try again.' || chr(10) || 'Then ask.' END AS hint FROM ev""",
    "log_round_trip": """
        SELECT prefix, action, state, count(*) AS records, CAST(sum(rate) AS BIGINT) AS rate_sum FROM ev GROUP BY prefix, action, state""",
    "upload_stats": """
        SELECT prefix, count(*) FILTER (state = 'begin') AS begin, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'skip') AS skip,
               round(avg(rate), 6) AS mean_rate, quantile_disc(rate, 0.5) AS median_rate, quantile_disc(rate, 0.95) AS p95_rate
        FROM typed WHERE action = 'push-wal' GROUP BY prefix""",
    "retry_attempts": """
        SELECT 'send the volume' AS what, CAST(user_id % 50 AS VARCHAR) AS object, max(1 + event_id % 5) AS attempts, count(*) AS messages
        FROM events WHERE event_type = 'error' GROUP BY ALL""",
    "log_latest_state": """
        SELECT prefix, key, tt AS time, pid, state FROM (
            SELECT *, row_number() OVER (PARTITION BY prefix, key ORDER BY ts DESC, pid DESC, state DESC) AS r FROM typed WHERE state IS NOT NULL) WHERE r = 1""",
    "sentinel_round_trip": """
        SELECT prefix_id, name, price * 3 AS expanded_size_bytes, substr(name, 6, 24) AS wal_segment_backup_stop,
               substr(name, 31, 8) AS wal_segment_offset_backup_stop, '/pg' AS base_prefix
        FROM b WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""",
    "backup_list_file": f"""
        SELECT name || chr(9) || strftime(ts, {ISO}) || chr(9) || expanded_size_bytes || chr(9) || start || chr(9) || start_offset ||
               chr(9) || stop || chr(9) || stop_offset AS line FROM backups JOIN detail USING (prefix_id, name)""",
    "object_tree": """
        SELECT prefix_id, CAST(sum(length(key) + 1) AS BIGINT) AS bytes, true AS dated, CAST(sum(length(key) + 1) AS BIGINT) AS content_bytes
        FROM inv_wal GROUP BY prefix_id""",
    "sql_functions": f"""
        SELECT prefix_id, n AS name, CASE WHEN ok THEN substr(n, 1, 8) END AS tli, CASE WHEN ok THEN {_num("substr(n, 9, 16)")} END AS number,
               CASE WHEN ok THEN {_num("substr(n, 9, 8)")} * 256 + {_num("substr(n, 17, 8)")} END AS pos, CAST(1 AS BIGINT) AS depth
        FROM (SELECT prefix_id, {_SEG} AS n, regexp_matches({_SEG}, '^{X}{{24}}') AS ok FROM inv_wal)""",
    "stream_typed_events": "SELECT tt AS time, pid, action, key, seg, prefix, state, rate FROM typed",
    "stream_paired_uploads": """
        SELECT prefix, pid, key, strftime(begin_ts, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS begin_time, outcome, duration_us FROM paired""",
    "stream_stuck_uploads": """
        SELECT prefix, pid, key, strftime(begin_ts, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS begin_time FROM paired WHERE outcome IS NULL""",
    "stream_throughput": _windows(0),
    "stream_throughput_sliding": _windows(1),
    "stream_missing_successors": f"""
        SELECT l.prefix, l.tli, l.seg, strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS low_time, l.tli || {_sn("l.pos + 1")} AS missing
        FROM arrived l LEFT JOIN arrived h ON h.prefix = l.prefix AND h.tli = l.tli AND h.pos = l.pos + 1
             AND h.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR
        WHERE h.pos IS NULL AND l.ts <= (SELECT date_trunc('millisecond', max(ts)) FROM arrived) - INTERVAL 2 HOUR""",
    "stream_gap_alarms": """
        SELECT prefix, tli, below + 1 AS gap_from, pos - 1 AS gap_to, pos - 1 - below AS missing, strftime(passed, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS due
        FROM (SELECT p.prefix, p.tli, p.pos, p.passed, max(s.pos) AS below FROM due_first p
              JOIN due_first s ON s.prefix = p.prefix AND s.tli = p.tli AND s.pos < p.pos AND s.tick <= p.passed
              WHERE p.tick <= p.passed AND p.passed <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM arrived)
              GROUP BY ALL) WHERE below < pos - 1""",
    "stream_first_pushes": "SELECT DISTINCT prefix, seg FROM typed WHERE action = 'push-wal'",
    "stream_late_rows": """
        SELECT prefix, count(*) AS arrived, count(*) FILTER (state = 'complete' OR ts > mark) AS kept,
               count(*) FILTER (NOT (state = 'complete' OR ts > mark)) AS late
        FROM arrived_states CROSS JOIN (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM arrived_states WHERE state = 'complete')
        GROUP BY prefix""",
    "stream_restore_sessions": """
        SELECT prefix, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS session_start,
               strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS session_end, count(*) AS fetches
        FROM sess1 GROUP BY prefix, s
        HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM sess1)""",
}
_SQL["sql_segments_after"] = _SQL["segments_after"]

_SQL["stream_upload_outcomes"] = """
        SELECT prefix, pid, key, strftime(b, '%Y-%m-%dT%H:%M:%S.%f') || '-00' AS begin_time, min_by(state, (e, state)) AS outcome,
               epoch_us(min(e)) - epoch_us(b) AS duration_us
        FROM (SELECT b.prefix, b.pid, b.key, b.b, e.ts AS e, e.state FROM begun b LEFT JOIN pu e
              ON e.prefix = b.prefix AND e.pid = b.pid AND e.key = b.key AND e.state IN ('complete', 'skip')
              AND e.ts >= b.b AND e.ts <= b.b + INTERVAL 10 MINUTE AND (b.next_b IS NULL OR e.ts < b.next_b))
        WHERE b + INTERVAL 10 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM pu WHERE state IS NOT NULL)
        GROUP BY prefix, pid, key, b"""
_SQL["stream_commit"] = """
        SELECT prefix_id, name, substr(name, 6, 24) AS stop, count(*) AS members, sum(octet_length(encode(CAST(price // (v + 1) AS VARCHAR))))::BIGINT AS bytes
        FROM b, (VALUES (0), (1), (2)) t(v) WHERE v <= o_orderkey % 3 AND o_orderpriority = '1-URGENT' GROUP BY prefix_id, name"""
_SQL["distinct_of_days"] = """
        SELECT prefix_id, strftime(a, '%Y-%m-%d') AS first_day, strftime(z, '%Y-%m-%d') AS last_day, count(*) AS objects, true AS within_stated_error FROM (
            SELECT prefix_id, date_trunc('month', ts) AS a, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS z FROM inv
            UNION ALL SELECT prefix_id, date_trunc('year', ts), date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM inv) GROUP BY prefix_id, a, z"""
_SQL["rate_quantiles"] = """
        SELECT prefix, strftime(ts, '%Y-%m-%d') AS day, count(*) AS uploads, quantile_disc(rate, 0.5) AS p50, quantile_disc(rate, 0.95) AS p95
        FROM typed WHERE action = 'push-wal' AND state = 'complete' GROUP BY prefix, day"""
_SQL["stream_sessions_of_ticks"] = _SQL["stream_restore_sessions"]
_SQL["sentinel_files"] = _SQL["backup_list_detail"]
_SQL["inventory_changes"] = _SQL["inventory_diff"]
_SQL["footprint_maintained"] = f"""
        SELECT n.prefix_id, thing, count(*) AS objects, sum(n.size)::BIGINT AS bytes, strftime(min(ts), {ISO}) AS oldest, strftime(max(ts), {ISO}) AS newest
        FROM snap_new n JOIN cl c ON c.prefix_id = n.prefix_id AND c.key = n.key GROUP BY n.prefix_id, thing"""
_SQL["inventory_export"] = f"SELECT prefix_id, bucket, key, size, strftime(ts, {ISO}) AS last_modified FROM inv"

ORACLE: dict[str, str] = {name: _with(sql) for name, sql in _SQL.items()}
