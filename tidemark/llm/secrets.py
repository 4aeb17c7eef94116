"""Secret scanning over an incremental ledger of contents.

Every version of every path is addressed by its content (SHA-256). The ledger knows which rule
versions have seen which contents; only unseen pairs are scanned, one text per content, and the
findings are joined back to all paths that hold it. A rule is named kind@version; a changed
pattern is a new version and makes just that rule run again. `scan` returns the findings
and the entries to append to the ledger; `update` does so with a ledger kept as a table.

Texts are not shuffled as long as the contents to scan, one number each, are few enough to broadcast (measured);
beyond that they are shuffled once. A content held by a third of all paths is scanned once, and
the join back to its paths moves digests, which Spark splits when they are skewed.

Defined cases: a null text counts as empty; repeated rows and ids are paths of their own; very long
texts are scanned whole (all patterns run without nested backtracking); an empty table gives no rows;
other columns are ignored.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import join_rows, spans, stable_rows, tagged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind, version, pattern, and the test a match must pass. Bounds on the length stand in the pattern where they select the same matches.
RULES = (
    ("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    ("access", 1, r"AKIA[A-Z0-9]{12,}", None),
    ("hex", 1, r"[0-9a-f]{32,}", None),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", None),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", None),
    ("prefixed", 1, r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{20,}", None),
)
BASE = 3
#: What a text must contain for a rule to have a chance, where that is cheaper to test.
HINTS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "jwt": "eyJ"}
FOUND = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def rule_names(rules=RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, version, _p, _k in rules]


def _found(text: Column, todo: Column, no: int, rule) -> Column:
    kind, version, pattern, keep = rule
    run = F.array_contains(todo, f"{kind}@{version}")
    if kind in HINTS:
        run = run & F.contains(text, F.lit(HINTS[kind]))
    else:
        run = run & text.rlike(pattern)
    return F.when(run, tagged(spans(text, pattern, keep), no, kind).cast(FOUND)).otherwise(F.array().cast(FOUND))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, doc_id="doc_id", text="text"):
    """(paths, entries): row_id, doc_id, blob, found for every path; blob, rules, found to append to the ledger."""
    names = rule_names(rules)
    rows = stable_rows(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    paths = scale.pin(rows.select("row_id", "doc_id", F.unhex(F.sha2("text", 256)).alias("blob")))
    every = F.array(*[F.lit(n) for n in names])
    blobs = paths.groupBy("blob").agg(F.min("row_id").alias("row_id"))
    if ledger is None:
        todo = blobs.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = todo.where(F.size("todo") > 0).select("row_id", "todo")
    if ledger is None:
        due = join_rows(rows.select("row_id", "text"), todo.select("row_id")).select("text", every.alias("todo"))
    else:
        # The rules that are due travel as bits; the texts' side gets their names back.
        bits = sum((F.when(F.array_contains("todo", n), 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0)).cast("bigint")
        due = join_rows(rows.select("row_id", "text"), todo.select("row_id", bits.alias("bits")))
        due = due.select("text", F.filter(every, lambda _n, k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1)) == 1).alias("todo"))
    found = F.concat(*[_found(F.col("text"), F.col("todo"), no, rule) for no, rule in enumerate(rules)])
    entries = scale.pin(due.select(F.unhex(F.sha2("text", 256)).alias("blob"), F.col("todo").alias("rules"), found.alias("found")))
    known = entries if ledger is None else entries.unionByName(ledger.select("blob", "rules", "found"))
    listed = known.where(F.size("found") > 0).select("blob", "found")
    if ledger is not None:
        listed = listed.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    back = paths.join(listed.withColumn("found", F.array_sort("found")), "blob", "left")
    return back.select("row_id", "doc_id", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), entries


def update(docs: DataFrame, path: str, rules=RULES, doc_id="doc_id", text="text"):
    """`scan` against the ledger kept at `path` (none yet: everything is unseen), with the new entries appended to it.

    Entries are written before the findings are used, and an entry that is there twice says the same, so an update that stopped may be run again.
    """
    spark = docs.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    paths, entries = scan(docs, ledger, rules, doc_id, text)
    entries.write.mode("append").parquet(path)
    return paths, entries


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(no, kind, pat) AS (VALUES (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'pem', '-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----'),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}'), (5, 'prefixed', '(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{20,}')),
m AS (SELECT r, no, kind, pat, unnest(regexp_extract_all(t, pat, 0)) AS m, unnest(list_slice(string_split_regex(t, pat), 1, -2)) AS g,
        generate_subscripts(regexp_extract_all(t, pat, 0), 1) AS i FROM d, k),
p AS (SELECT r, no, kind, m, pat, (sum(length(g) + length(m)) OVER (PARTITION BY r, no ORDER BY i))::BIGINT AS e FROM m),
s AS (SELECT r, no, kind, e - length(m) AS s, e FROM p
      WHERE CASE no WHEN 0 THEN length(regexp_extract(m, pat, 2)) >= 8 WHEN 1 THEN length(m) >= 16 WHEN 2 THEN length(m) >= 32 ELSE true END),
a AS (SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans
      FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.r = a.r
"""
