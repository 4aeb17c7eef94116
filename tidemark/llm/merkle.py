"""A Merkle manifest of a table: a tree of digests per language, one above the languages, and proofs for every row.

Leaves of a tree are numbered in order; FANOUT consecutive nodes become the digest of their concatenation until one is
left. A step of the plan takes LEVELS levels at once. Its slot pivot spreads the FANOUT ** LEVELS nodes below one node over
as many columns, by conditional aggregates over (tree, number of the node above). Inside such a row
every level is a concatenation of FANOUT columns and a digest; what the columns before and after one's own slot hold are its siblings. So a
row leaves the step with all digests of its subtree and the proofs inside it; the next step
works on one row per subtree. On the way back, the proof of a subtree is joined to its row and the slots are unfolded.

Numbering. Rows are dealt by ranges of (tree, doc_id, leaf) and numbered inside the ranges, which a written
table remembers; one row per range and tree gives the offsets. A language that holds a third of all rows (or all) is many ranges. A slot
pivot groups at most FANOUT ** LEVELS rows. Texts are hashed where they are read and never shuffled.

Defined cases: null columns hash as `-` (a null language is a tree of its own, the first); ids may be null (first in their
tree, never tampered) or repeated (ordered by leaf digest; rows alike in all five columns are interchangeable); empty and very long texts
are hashed whole; a single row is its own subroot, and its tree's subroot the root if no other language exists; an empty table gives no rows; columns beyond the five are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.session import shared_path

FANOUT, LEVELS = 2, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a proof holds per level: the digests before and after one's own.
SIDES = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered=None, **names) -> DataFrame:
    """doc_id, tree (sorts like the language, null first), leaf, and `shown`: the leaf as it is found later.

    `tampered` maps the five columns to the changed ones; without it `shown` is the leaf.
    """
    given = {f: F.col(f"`{names.get(f, f)}`") for f in FIELDS}
    rows = docs.select(*[c.alias(f) for f, c in given.items()])
    own = {f: F.col(f) for f in FIELDS}
    whole = digest(F.concat(*[field(own[f]) for f in FIELDS]))
    condition, changed = tampered(own) if tampered else (F.lit(False), own)
    other = digest(F.concat(*[field(changed[f]) for f in FIELDS]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = rows.select("doc_id", tree.alias("tree"), whole.alias("leaf"), F.when(F.coalesce(condition, F.lit(False)), other).alias("shown"))
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


def add_a_char(own: dict):
    """Where 7 divides the checksum of the id, n_chars is one more (a null stays)."""
    hit = (F.crc32(own["doc_id"].cast("string").cast("binary")) % 7 == 0) & own["n_chars"].isNotNull()
    return hit, {**own, "n_chars": own["n_chars"] + 1}


def _table(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"merkle-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order) -> DataFrame:
    """`rows` with `pos`, 0, 1, ... along `order` within each tree, and `total`, the tree's number of rows."""
    # The row number splits long runs of rows that are alike.
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange("tree", *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = _table(ranged, "ranges")
    counts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("tree")).alias("total"))
    inside = Window.partitionBy("tree", "_range").orderBy(*order, "_tie")
    placed = ranged.withColumn("_i", F.row_number().over(inside) - 1)
    return scale.join_small(placed, starts, ["tree", "_range"]).withColumn("pos", F.col("_start") + F.col("_i")).drop("_tie", "_range", "_i", "_start")


def depth(total: Column, fanout=FANOUT) -> Column:
    """Levels above `total` leaves: how often they shrink by `fanout` until one is left."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    return sum((F.when(total > p, 1).otherwise(0) for p in powers), F.lit(0)).cast("int")


def step(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """From nodes (tree, pos, digest, left: levels still above, tag) one row per `fanout ** levels` of them:

    tree, pos and digest of the node above, left, and slots: array of struct(tag, digest, sides).
    """
    width = fanout**levels
    above = F.floor(F.col("pos") / width).cast("bigint")
    rows = nodes.select("tree", above.alias("pos"), (F.col("pos") % width).cast("int").alias("slot"), "left", F.struct("digest", "tag").alias("node"))
    wide = rows.groupBy("tree", "pos", "left").agg(*[F.max(F.when(F.col("slot") == s, F.col("node"))).alias(f"s{s}") for s in range(width)])
    wide = wide.select("*", *[F.col(f"s{s}.digest").alias(f"d0_{s}") for s in range(width)])
    for level in range(levels):
        groups = [range(g * fanout, (g + 1) * fanout) for g in range(fanout ** (levels - level - 1))]
        joined = [F.concat_ws("", *[F.col(f"d{level}_{s}") for s in g]) for g in groups]
        # A tree that has come to its single node passes it on in the first slot.
        up = [F.when(F.col("left") > level, F.when(joined[g] != "", digest(joined[g]))).otherwise(F.col(f"d{level}_{g}") if g == 0 else F.lit(None).cast("string")) for g in range(len(groups))]
        wide = wide.withColumns({f"d{level + 1}_{g}": c for g, c in enumerate(up)})

    def side(level, slot):
        own = slot // fanout**level
        first = own - own % fanout
        return F.when(F.col("left") > level, F.struct(
            F.concat_ws("", *[F.col(f"d{level}_{s}") for s in range(first, own)]).alias("before"),
            F.concat_ws("", *[F.col(f"d{level}_{s}") for s in range(own + 1, first + fanout)]).alias("after")))

    slots = [
        F.when(F.col(f"s{s}").isNotNull(), F.struct(F.col(f"s{s}.tag").alias("tag"), F.col(f"s{s}.digest").alias("digest"),
                                                     F.array_compact(F.array(*[side(level, s) for level in range(levels)])).cast(SIDES).alias("sides")))
        for s in range(width)
    ]
    return wide.select("tree", "pos", F.col(f"d{levels}_0").alias("digest"), F.greatest(F.col("left") - levels, F.lit(0)).alias("left"), F.array_compact(F.array(*slots)).alias("slots"))


def proofs(nodes: DataFrame, total_left: int, fanout=FANOUT, levels=LEVELS):
    """(per node: tag, digest, tree, root of its tree, sides from the node up; per tree: tree, digest).

    `nodes` has tree, pos, digest, left, tag; `total_left` is the greatest `left`.
    """
    tables, now = [], nodes
    for k in range(-(-max(total_left, 1) // levels)):
        table = _table(step(now, fanout, levels), f"step{k}")
        tables.append(table)
        now = table.select("tree", "pos", "digest", "left", F.struct(F.col("pos")).alias("tag"))
    roots = tables[-1].select("tree", F.col("digest").alias("root"))
    down = tables[-1].select("tree", "pos", F.col("digest").alias("root"), F.array().cast(SIDES).alias("upper"), "slots")
    for k in range(len(tables) - 1, -1, -1):
        found = down.select("tree", "root", "upper", F.explode("slots").alias("s")).select("tree", "root", "s.tag", "s.digest", F.concat("s.sides", "upper").alias("sides"))
        if k:
            below = tables[k - 1].select("tree", "pos", "slots")
            down = below.join(found.select("tree", F.col("tag.pos").alias("pos"), "root", F.col("sides").alias("upper")), ["tree", "pos"])
    return found, roots


def folded(leaf: Column, sides: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(sides, leaf, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def manifest(docs: DataFrame, tampered=None, fanout=FANOUT, levels=LEVELS, **names) -> DataFrame:
    """Per row: doc_id, leaf, shown, subroot, root, sides (the proof: per level the digests before and after one's own)."""
    rows = numbered(leaves(docs, tampered, **names), ["doc_id", "leaf"])
    nodes = rows.select("tree", "pos", F.col("leaf").alias("digest"), depth(F.col("total"), fanout).alias("left"), F.struct("doc_id", "shown").alias("tag"))
    nodes = _table(nodes, "leaves")
    deepest = nodes.agg(F.max("left")).first()[0]
    found, roots = proofs(nodes, deepest or 0, fanout, levels)
    roots = scale.pin(roots)
    tops = numbered(roots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("of")).alias("tag"), F.col("tree").alias("of")), ["of"])
    tops = scale.pin(tops.select("tree", "pos", "digest", depth(F.col("total"), fanout).alias("left"), "tag"))
    over, _ = proofs(tops, tops.agg(F.max("left")).first()[0] or 0, fanout, levels)
    over = over.select(F.col("tag.of").alias("tree"), F.col("root").alias("top"), F.col("sides").alias("outer"))
    return scale.join_small(found, over, "tree").select(
        F.col("tag.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("tag.shown").alias("shown"), F.col("root").alias("subroot"),
        F.col("top").alias("root"), F.concat("sides", "outer").alias("sides"))


def proof_text(sides: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(sides, lambda s: F.concat(s["before"], s["after"])), "")


def report(docs: DataFrame) -> DataFrame:
    """The manifest of `docs`, and what its proofs say of rows whose n_chars was changed for every seventh id."""
    rows = manifest(docs, add_a_char).withColumn("folded_root", folded(F.col("shown"), F.col("sides")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("sides"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(column, text=False):
    value = column if text else f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _crc_sql(text):
    """The unsigned CRC-32 of a short ASCII text, bit by bit, in plain arithmetic."""
    bytes_ = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    one = "(CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    eight = reduce(lambda acc, _: f"list_transform({acc}, lambda c: {one})", range(8), "[xor(a, b)]")
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: {eight}[1]), 4294967295)"


_LEAF_SQL = "sha256(" + " || ".join([_field_sql("doc_id"), _field_sql("source", True), _field_sql("lang", True), "{n}", _field_sql("text", True)]) + ")"

#: Level by level, for DuckDB; the fanout of the registered query.
ORACLE = f"""
WITH RECURSIVE
ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT t, {_crc_sql("t")} AS c FROM ids),
leaves AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF_SQL.format(n=_field_sql("n_chars"))} AS leaf,
           CASE WHEN c % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF_SQL.format(n=_field_sql("(n_chars + 1)"))} END AS other
    FROM documents LEFT JOIN crc ON t = CAST(doc_id AS VARCHAR)),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
    SELECT 0 AS level, tree, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT level + 1, tree, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 2),
known AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM known WHERE n = 1),
tops AS (
    SELECT 0 AS level, pos, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2),
above AS MATERIALIZED (SELECT * FROM tops),
walk AS (
    SELECT 0 AS level, tree, pos, pos AS leaf_pos, n, coalesce(other, leaf) AS acc, '' AS proof FROM placed
    UNION ALL
    SELECT w.level + 1, w.tree, w.pos // 2, w.leaf_pos, (w.n + 1) // 2,
           sha256(CASE WHEN w.pos % 2 = 0 THEN w.acc || coalesce(s.digest, '') ELSE coalesce(s.digest, '') || w.acc END), w.proof || coalesce(s.digest, '')
    FROM walk w LEFT JOIN known s ON s.level = w.level AND s.tree = w.tree AND s.pos = w.pos + 1 - 2 * (w.pos % 2) WHERE w.n > 1),
outer_walk AS (
    SELECT 0 AS level, w.tree, w.leaf_pos, r.pos, r.n, w.acc, w.proof FROM walk w JOIN subroots r USING (tree) WHERE w.n = 1
    UNION ALL
    SELECT w.level + 1, w.tree, w.leaf_pos, w.pos // 2, (w.n + 1) // 2,
           sha256(CASE WHEN w.pos % 2 = 0 THEN w.acc || coalesce(s.digest, '') ELSE coalesce(s.digest, '') || w.acc END), w.proof || coalesce(s.digest, '')
    FROM outer_walk w LEFT JOIN above s ON s.level = w.level AND s.pos = w.pos + 1 - 2 * (w.pos % 2) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = t.digest AS verified
FROM placed p JOIN outer_walk w ON w.tree = p.tree AND w.leaf_pos = p.pos AND w.n = 1 JOIN subroots r ON r.tree = p.tree CROSS JOIN (SELECT digest FROM above WHERE n = 1) t"""
