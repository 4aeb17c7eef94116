"""Column helpers shared by the text operators.

Row identity. Operators that bring results back to rows name them by `row_id`: the number of a row's file
among the sorted files, and its place in the file. It does not depend on how a scan is split, so a cluster may grow or lose executors
between two scans. Rows that are no Parquet scan are written first and numbered as they were written.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text) -> Column:
    """Lower case for A-Z alone. `lower` would change other letters too, so it serves pure ASCII texts only."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def word_count(text) -> Column:
    """Number of words `WORD` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def alnum_words(text) -> Column:
    """ASCII-lower-cased words of digits, letters and anything beyond ASCII; null gives no words."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), ALNUM_GAP), ""), F.array().cast("array<string>"))


#: A row per file is sent to the driver and to the tasks; rows per file stay below 2 ** ROW_BITS.
MOST_FILES, ROW_BITS = 1 << 21, 41


def identified(docs: DataFrame) -> DataFrame:
    """`row_id` and `doc`, a struct of all columns of `docs`; given such a table, that table."""
    from tidemark import scale

    if docs.columns == ["row_id", "doc"]:
        return docs
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select(meta["file_path"].alias("file"), meta["row_index"].alias("at"), doc)
    except AnalysisException:
        return scale.pin(docs.select(F.monotonically_increasing_id().alias("row_id"), doc))
    files = sorted(r["file"] for r in placed.select("file").distinct().limit(MOST_FILES + 1).collect())
    if len(files) > MOST_FILES:
        raise ValueError(f"a table of more than {MOST_FILES} files; write it in larger ones")
    if len(files) < 2:
        return placed.select(F.col("at").alias("row_id"), "doc")
    numbers = docs.sparkSession.createDataFrame([(f, n << ROW_BITS) for n, f in enumerate(files)], "file string, base bigint")
    return placed.join(F.broadcast(numbers), "file").select((F.col("base") + F.col("at")).alias("row_id"), "doc")


def stable_rows(docs: DataFrame, doc_id="doc_id", text="text", **more) -> DataFrame:
    """`row_id`, `doc_id`, `text` and the columns named in `more`, with a row_id that other scans of the same table give too."""
    columns = {"doc_id": doc_id, "text": text, **more}
    return identified(docs).select("row_id", *[F.col("doc").getField(c).alias(name) for name, c in columns.items()])


def unwrapped(whole: DataFrame, **replaced) -> DataFrame:
    """The columns of `doc` again, those in `replaced` by an expression."""
    names = whole.schema["doc"].dataType.names
    return whole.select(*[replaced[c].alias(c) if c in replaced else F.col("doc").getField(c).alias(c) for c in names])


def numbered_rows(docs: DataFrame, doc_id="doc_id", text="text", **more) -> DataFrame:
    """`row_id`, `doc_id`, `text` and the columns named in `more`, whatever else the table holds. The numbers hold within one scan."""
    extra = [F.col(f"`{c}`").alias(name) for name, c in more.items()]
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *extra
    )


def read(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"
CONTEXT = 24


def spans(text: Column, pattern: str, keep=None) -> Column:
    """Where `pattern` matches: array of start, end (code points, exclusive), match, and up to CONTEXT characters around.

    Matches are leftmost and do not overlap; the pattern must not match the empty string.
    `keep` maps a match to a condition; failing ones are dropped and not retried. Splitting the
    text at the pattern gives the gaps, so positions are running lengths: one pass, no window.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(2), F.size(found)).alias("g")), F.slice(gaps, F.lit(1), F.size(found)),
                       lambda x, g: F.struct(x["m"].alias("m"), x["g"].alias("after"), g.alias("before")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("match"),
            F.substring(x["before"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["after"], 1, CONTEXT).alias("after"),
        )).cast(SPAN)
        more = F.concat(acc["out"], one)
        out = more if keep is None else F.when(F.coalesce(keep(x["m"]), F.lit(False)), more).otherwise(acc["out"])
        return F.struct(end.cast("bigint").alias("at"), out.cast(SPAN).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def tagged(found: Column, kind_no: int, kind: str) -> Column:
    """Spans as array<struct<start, kind_no, end, kind>>, which sorts by start and then by kind as listed."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def span_digest(listed: Column) -> Column:
    """kind:start:end, comma-joined, of sorted tagged spans."""
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def join_rows(docs: DataFrame, chosen: DataFrame, how="inner", max_rows=500_000, max_bytes=32 << 20) -> DataFrame:
    """Join on `row_id`, unique in both; `chosen` is narrow. Broadcast only if its measured size is within the bounds, else shuffled."""
    from tidemark import scale

    chosen = scale.pin(chosen)
    rows, size = scale._size(chosen)
    return docs.join(F.broadcast(chosen) if rows <= max_rows and size <= max_bytes else chosen, "row_id", how)
