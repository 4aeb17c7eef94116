"""A corpus from raw documents to packed token ids: five stages, each the next one's input.

toxicity          documents predicted toxic go
near_duplicates   of each group of near copies (five-word shingles, similarity 0.8) one document stays
decontamination   documents with benchmark passages go
mixing            sources are taken to their target weights; documents may come twice, or up to the word where a share ends
packing           token ids in rows of 2048

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.llm import decontaminate, jaccard, mixing, packing, toxicity  # noqa: E402
from tidemark.llm.text import read  # noqa: E402
from tidemark.session import prepare, shared_path  # noqa: E402


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    return jaccard.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), mode="documents")


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack_rows(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_rows),
]

#: The learned stage and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; each result is written to the shared folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
