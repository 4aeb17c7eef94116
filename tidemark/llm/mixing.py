"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a fixed shuffled order, form a stream of words that is
cut into blocks of equal length. Slot j of the mix looks up the point of a golden
ratio sequence in the cumulative targets and so names a source; its rank among that
source's slots names the block. Any prefix of the schedule is thus close to the weights,
not only the whole. What the sequence leaves a source short of follows in slots at
the end, and what it gives too much is dropped, so every source ends at its target.

Only (row, source, size) rows are shuffled. A hot source is numbered in pieces
(hash pieces for documents, runs of slots for the schedule), never in one task.

Defined cases: null source is a source of its own, ordered last; null text has size
0; a document without words is never taken; an empty table gives no rows; rows with
the same id are separate rows, in an order fixed by id, size and position; a very long text is counted whole
and lies in as many slots as it has blocks; other columns are ignored.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import identified, stable_rows, unwrapped, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 1000
CELLS = 1024
STRETCH_SLOTS = 4096
PERIOD = 1 << 31
#: Nearest odd number to PERIOD / golden ratio, so that j * STEP mod PERIOD is a golden ratio sequence over all PERIOD points.
STEP = 1327217885


def sizes(docs: DataFrame, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """One narrow row per document: row_id, doc_id, source, size in words. Written once; all later steps read it."""
    rows = stable_rows(docs, doc_id, text, source=source)
    return scale.pin(rows.select("row_id", "doc_id", "source", word_count("text").alias("size")))


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """Target words per source: weights share `share` of all words, no source above `repeats` times its own.

    The sources that end at their cap are those with the least cap per weight. Going
    through them in that order, a source is capped while its cap per weight is not
    above the level that the remaining words give each remaining weight.
    The windows here run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("source_no", F.row_number().over(order)).select(
        "source",
        "source_size",
        "source_no",
        F.get(picks, (F.col("source_no") - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * float(repeats)).alias("cap"),
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = per.select(
        "*",
        (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.row_number().over(by_level).alias("nth"),
    ).withColumn("level", F.col("words_left") / F.col("weight_left"))
    free = F.col("cap") / F.col("weight") > F.col("level")
    final = F.min_by("level", F.when(free, F.col("nth"))).over(everything)
    return level.withColumn("final_level", final).select(
        "source",
        "source_no",
        "source_size",
        F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def schedule(target: DataFrame, block_words=BLOCK_WORDS) -> DataFrame:
    """The mix as slots: slot, source_no, block (0-based, of the source's own stream).

    `target` has source_no and target. The points are joined to the sources' intervals on
    cells of the unit interval, so this is an equi-join at any number of sources.
    """
    spark = target.sparkSession
    goals = target.select("source_no", F.floor("target").cast("bigint").alias("goal")).where("goal > 0")
    upto = F.sum("goal").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    parts = goals.select("source_no", F.ceil(F.col("goal") / F.lit(block_words)).cast("bigint").alias("blocks"), (upto - F.col("goal")).alias("lo"), upto.alias("hi"))
    n, total = parts.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("hi"), F.lit(1))).first()
    # Whole numbers throughout: a point lies in exactly one interval.
    cell = max(1, -(-total // CELLS))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    place = F.floor((F.col("slot") % PERIOD * STEP % PERIOD).cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)") / PERIOD).cast("bigint")
    slots = spark.range(n).select(F.col("id").alias("slot"), place.alias("place")).withColumn("cell", F.floor(F.col("place") / cell))
    named = slots.join(cells, "cell").where("place >= lo and place < hi").select("slot", "source_no", "blocks")
    ranked = scale.running_totals(
        named.select("*", F.floor(F.col("slot") / 4096).alias("run"), F.lit(1).alias("one")), ["source_no"], ["slot"], "run", "one"
    ).select("slot", "source_no", (F.col("idx") - 1).alias("block"), "blocks")
    ranked = scale.pin(ranked)
    had = parts.select("source_no", "blocks").join(
        ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("had")), "source_no", "left"
    )
    short = had.where("coalesce(had, 0) < blocks").select(
        "source_no", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("blocks") - 1)).alias("block")
    )
    late = short.select((F.lit(n) + F.col("block")).alias("slot"), "source_no", "block")
    return ranked.where("block < blocks").select("slot", "source_no", "block").unionByName(late)


def taken_ranges(sized: DataFrame, target: DataFrame, slots: DataFrame, repeats=REPEATS, block_words=BLOCK_WORDS) -> DataFrame:
    """What each slot takes: row_id, pass (0, 1, …), slot, first (word offset in the document), words."""
    facts = scale.pin(target.where("target > 0").select("source", "source_no", "source_size", F.floor("target").alias("goal")))
    # numbered sources, as a null source would be lost by the joins on it below
    keyed = sized.where("size > 0").join(facts, sized["source"].eqNullSafe(facts["source"])).select(
        "row_id", "size", "source_no", "goal", "source_size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled")
    ).withColumn("piece", F.conv(F.substring("shuffled", 1, 3), 16, 10).cast("bigint"))
    placed = scale.running_totals(keyed, ["source_no"], ["shuffled", "size", "row_id"], "piece", "size").select(
        "row_id", "size", "source_no", "goal", (F.col("upto") - F.col("size")).alias("start"), "source_size"
    )
    again = placed.select(
        "row_id", "size", "source_no", "goal", F.posexplode(F.sequence(F.col("start"), F.col("start") + (repeats - 1) * F.col("source_size"), F.col("source_size"))).alias("pass", "at")
    ).where("at < goal")
    end = F.least(F.col("at") + F.col("size"), F.col("goal"))
    cut = again.select("*", end.alias("end")).select(
        "*", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block")
    )
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return cut.join(slots, ["source_no", "block"]).select(
        "row_id", "pass", "slot", (first - F.col("at")).alias("first"), (last - first).alias("words")
    )


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, repeats=REPEATS, block_words=BLOCK_WORDS):
    """(sized, target, ranges): the narrow document table, the sources' targets, and what every slot takes."""
    sized = sizes(docs, doc_id, text, source)
    target = scale.pin(targets(sized, weights, share, repeats))
    return sized, target, taken_ranges(sized, target, schedule(target, block_words), repeats, block_words)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, the first slot that takes from it, and its part of the schedule.

    `slots_sha256` digests slot:first:words of all that the slots take from the document, by slot and first word, comma-joined. A
    document lies in as many slots as its length has blocks.
    """
    sized, target, ranges = mix(docs, **options)
    listed = F.array_sort(F.collect_list(F.struct("slot", "first", "words")))
    told = F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["slot"].cast("string"), r["first"].cast("string"), r["words"].cast("string"))), ",")
    got = ranges.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sha2(told, 256).alias("slots_sha256"))
    rows = sized.join(target.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left")
    return rows.join(got, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot",
        F.coalesce("slots_sha256", F.sha2(F.lit(""), 256)).alias("slots_sha256"),
    )


def mixed_documents(docs: DataFrame, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """The mix as documents: every column of `docs`, one row per document and pass, in place of the input rows.

    A document that the end of its source's share cuts is returned up to the last word taken. The rows follow the schedule: a
    partition holds whole stretches of STRETCH_SLOTS slots in the order of the slots that first take from each document.
    """
    whole = identified(docs)
    _sized, _target, ranges = mix(whole, doc_id, text, source, **options)
    got = ranges.groupBy("row_id", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"))
    body = F.col("doc").getField(text)
    n = F.col("words").cast("int")
    gaps = F.slice(F.split(body, r"[^\x20\x09-\x0D]+"), F.lit(1), n)
    words = F.slice(F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n)
    head = F.substring(body, F.lit(1), F.length(F.array_join(gaps, "")) + F.length(F.array_join(words, "")))
    cut = F.when(F.col("words") < word_count(body), head).otherwise(body)
    placed = whole.join(got, "row_id").withColumn("stretch", F.floor(F.col("first_slot") / STRETCH_SLOTS))
    return unwrapped(placed.repartition("stretch").sortWithinPartitions("first_slot"), **{text: cut})


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source),
w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS words_left,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS weight_left,
        row_number() OVER (ORDER BY cap / weight, source_no) AS nth FROM w),
f AS (SELECT words_left / weight_left AS final_level FROM l WHERE cap / weight > words_left / weight_left ORDER BY nth LIMIT 1),
t AS (SELECT source, source_no, source_size, least(cap, coalesce((SELECT final_level FROM f) * weight, cap)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, source_no, floor(t.target)::BIGINT AS goal,
        (sum(floor(t.target)::BIGINT) OVER (ORDER BY source_no ROWS UNBOUNDED PRECEDING))::BIGINT AS hi
      FROM t WHERE floor(t.target) > 0),
b AS (SELECT source, source_no, (goal + 999) // 1000 AS blocks, hi - goal AS lo, hi FROM g),
n AS (SELECT sum(blocks)::BIGINT AS n, max(hi)::BIGINT AS total FROM b),
j AS (SELECT slot, ((((slot % 2147483648 * 1327217885) % 2147483648)::HUGEINT * total) // 2147483648)::BIGINT AS place
      FROM (SELECT unnest(range(n)) AS slot, total FROM n)),
k AS (SELECT slot, source_no, blocks, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS block FROM j JOIN b ON place >= lo AND place < hi),
h AS (SELECT b.source_no, b.blocks, count(k.slot) AS had FROM b LEFT JOIN k ON k.source_no = b.source_no GROUP BY ALL),
q AS (SELECT slot, source_no, block FROM k WHERE block < blocks
      UNION ALL SELECT n + block, source_no, block FROM (SELECT source_no, unnest(range(had, blocks)) AS block FROM h WHERE had < blocks), n),
u AS (SELECT r, g.source_no, size, g.goal, (start + source_size * pass)::BIGINT AS a0 FROM p JOIN g ON g.source IS NOT DISTINCT FROM p.source, range(2) x(pass)
      WHERE size > 0 AND start + source_size * pass < g.goal),
e AS (SELECT r, source_no, a0, least(a0 + size, goal)::BIGINT AS z, unnest(range((a0 // 1000)::BIGINT, ((least(a0 + size, goal) - 1) // 1000 + 1)::BIGINT)) AS block FROM u),
y AS (SELECT r, slot, greatest(a0, e.block * 1000) - a0 AS w0, least(z, (e.block + 1) * 1000) - greatest(a0, e.block * 1000) AS words
      FROM e JOIN q ON q.source_no = e.source_no AND q.block = e.block),
z AS (SELECT r, min(slot)::BIGINT AS first_slot, string_agg(slot || ':' || w0::BIGINT || ':' || words::BIGINT, ',' ORDER BY slot, w0, words) AS told FROM y GROUP BY r)
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE
    greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) END)::BIGINT AS taken, first_slot, sha256(coalesce(told, '')) AS slots_sha256
FROM p LEFT JOIN z ON z.r = p.r
"""
