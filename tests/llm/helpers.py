"""Small tables with the awkward cases every text operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark, rows, folder, parts=3):
    """Documents (id, text[, source]) as a Parquet scan, as the operators get them."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(parts).write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))


def clashing(docs):
    """The same rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["row_id", "score", "kept", "class", "gid", "n", "found", "words", "size", "target", "slice", "hits", "doc"]
    return docs.withColumns({n: F.lit("clash") for n in names})


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "a row without an id"),
    (5, "one word more or less here"),
    (5, "one word more or less here"),
    (6, "one word more or less here"),
    (7, "É ç ñ ß 漢字 🙂 text beyond ascii, É ç ñ"),
    (8, "very long " * 30000),
]
