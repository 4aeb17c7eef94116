"""Benchmark decontamination by a broadcast set of test n-grams.

Texts become words (ASCII-lower-cased runs of digits, letters and anything beyond ASCII).
Each window of `n` words of a benchmark item is a gram; an item of fewer words is one
gram. Of each gram the longest word is its anchor. One scan of the documents looks every word up
in the broadcast anchors, cuts out the windows that the anchor stands for, and looks these up in
the broadcast grams by their whole text, which is the verification. Nothing but hits is shuffled.

The broadcast sets are measured. A benchmark beyond `max_bytes` is dealt out by anchor into
blocks that fit, and the documents are scanned once for each block.

Defined cases: null and empty texts have no words and no hits; a null or repeated item id is an id like any
other (null ids are not listed); rows with the same doc_id are judged each; a gram that is contained in
many items names all of them; an empty benchmark contaminates nothing; very long texts are
scanned whole; an empty table gives no rows; other columns are ignored or, in `clean`, kept.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import alnum_words, identified, join_rows, stable_rows, unwrapped

GRAM_WORDS = 10
MAX_BYTES = 64 << 20
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def grams(benchmark: DataFrame, n=GRAM_WORDS, item_id="item_id", text="text") -> DataFrame:
    """gram, anchor, cut struct<offset, len>, items: one row per distinct window of the benchmark."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), alnum_words(f"`{text}`").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    windows = items.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(n)).alias("w"))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("l"), (-i).alias("i"))))
    found = windows.select("item", "w", (-longest["i"]).alias("offset")).select(
        "item",
        F.array_join("w", " ").alias("gram"),
        F.get("w", F.col("offset")).alias("anchor"),
        F.struct("offset", F.size("w").alias("len")).alias("cut"),
    )
    return found.groupBy("gram", "anchor", "cut").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(words: DataFrame, block: DataFrame, marked: bool) -> DataFrame:
    """(row_id, start, len, items) of every window in `block`; with `marked`, also a row of length 0 per document.

    The mark is the empty word after the last one. It lets documents without hits through the same joins.
    """
    anchors = block.groupBy("anchor").agg(F.collect_set("cut").alias("cuts"))
    texts = block.select("gram", "items")
    if marked:
        spark = block.sparkSession
        anchors = anchors.unionByName(spark.range(1).select(F.lit("").alias("anchor"), F.array(F.struct(F.lit(0).alias("offset"), F.lit(0).alias("len"))).alias("cuts")))
        texts = texts.unionByName(spark.range(1).select(F.lit("").alias("gram"), F.array().cast("array<string>").alias("items")))
    at = words.select("row_id", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "anchor"))
    cut = at.join(F.broadcast(anchors), "anchor").select("row_id", "doc_id", "words", "pos", F.inline("cuts"))
    start = F.col("pos") - F.col("offset")
    inside = cut.select("row_id", "doc_id", "words", start.alias("start"), "len").where("start >= 0 and start + len <= size(words)")
    window = inside.select("row_id", "doc_id", F.size("words").alias("n_words"), "start", "len", F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ").alias("gram"))
    return window.join(F.broadcast(texts), "gram").drop("gram")


def find(docs: DataFrame, benchmark: DataFrame, n=GRAM_WORDS, doc_id="doc_id", text="text", max_bytes=MAX_BYTES) -> DataFrame:
    """One row per document: row_id, doc_id, n_words, n_hit, items (sorted as strings), hits array<struct<start, len>> in words."""
    gram = scale.pin(grams(benchmark, n))
    size = gram.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("anchor") + 64 + 24 * F.size("items")), F.lit(0))).first()[0]
    blocks = 1 + int(size // max_bytes)
    words = stable_rows(docs, doc_id, text).select("row_id", "doc_id", alnum_words("text").alias("words"))
    found = None
    for b in range(blocks):
        block = gram if blocks == 1 else gram.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b)
        part = _scan(words, block, marked=b == 0)
        found = part if found is None else found.unionByName(part)
    hit = F.when(F.col("len") > 0, F.struct("start", "len"))
    per = found.groupBy("row_id", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def cover(acc, h):
        end = h["start"] + h["len"]
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["total"] + F.greatest(end - F.greatest(h["start"], acc["end"]), F.lit(0))).alias("total"))

    n_hit = F.aggregate("hits", zero, cover, lambda acc: acc["total"])
    return per.select("row_id", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.cast("bigint").alias("n_hit"), "items", "hits")


def clean(docs: DataFrame, benchmark: DataFrame, mode="documents", text="text", doc_id="doc_id", **options) -> DataFrame:
    """`docs` with all columns, without contaminated documents (`documents`) or without the words hit in them (`spans`).

    Removing spans leaves the characters between words as they are.
    """
    whole = identified(docs)
    bad = find(whole, benchmark, doc_id=doc_id, text=text, **options).where("n_hit > 0")
    if mode == "documents":
        return unwrapped(join_rows(whole, bad.select("row_id"), "left_anti"))
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    marked = whole.join(bad.select("row_id", "hits"), "row_id", "left")
    body = F.col("doc").getField(text)
    found = F.regexp_extract_all(body, F.lit(ANY_CASE_WORD), F.lit(0))
    gaps = F.split(body, ANY_CASE_WORD, -1)
    hit_words = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    kept_words = F.transform(found, lambda w, i: F.when(F.array_contains(hit_words, i), F.lit("")).otherwise(w))
    rest = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(kept_words, F.slice(gaps, F.lit(2), F.greatest(F.size(found), F.lit(0))), lambda w, g: F.concat(w, g)), ""))
    cut = F.when(F.col("hits").isNotNull(), rest).otherwise(body)
    return unwrapped(marked, **{text: cut})


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS l, list_slice(w, i, i + 9) AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM g),
x AS (SELECT r, i, l, list_slice(w, i, i + l - 1) AS gram
      FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS MATERIALIZED (SELECT x.r, x.i, g.l, g.item FROM x JOIN g ON x.gram = g.gram),
n AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r),
m AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r
"""
