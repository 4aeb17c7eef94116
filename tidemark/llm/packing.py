"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are encoded with a given public vocabulary (byte-level BPE ranks; its path is a parameter).
Documents longer than a row are split without loss: full rows, and a rest that is
packed like a short document. Pieces are placed longest first into the row whose free space fits
most tightly; a segment tree over free capacities finds it in log(row length) steps.

Packing needs no order between documents, so each task packs what it reads, in pools of
bounded size (`pool_tokens`): no shuffle, no hot key, and memory does not grow with the
input. A pool's result depends on its own documents only, so a task that is lost is simply run
again.

A packed row has the ids, padded to the row length, the cumulative segment lengths (0 first), the
position of each token in its segment (reset to 0 at each start), and per segment the document and
the offset of its first token there. `unpack` gives every document's ids back.

Defined cases: null and empty texts have no tokens and take no row; ids may be null or repeated (segments
then also carry the row number); very long texts give many full rows; an empty table gives no rows; other
columns are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import numbered_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_TOKENS = 2048
POOL_TOKENS = 8 << 20
PAD = 50256

SCHEMA = (
    "n_tokens int, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, row_ids array<bigint>, offsets array<bigint>"
)


class Encoder:
    """16-bit ids of texts."""

    def __init__(self, path):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.encoding = tiktoken.Encoding("given", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    def decode(self, ids) -> str:
        return self.encoding.decode([int(i) for i in ids])


class Capacities:
    """Rows by free capacity: a segment tree over 0..size tells the least capacity of at least n that some row has."""

    def __init__(self, size):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows = [[] for _ in range(self.leaves)]

    def _add(self, capacity, by):
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity, row):
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need):
        """(capacity, row) of the tightest fit, removed; None if no row has room."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def fit(lengths, row_tokens) -> list[list[int]]:
    """Rows of piece numbers by best-fit decreasing; every length is at most `row_tokens`."""
    rows, free = [], Capacities(row_tokens)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[k])
        if found is None:
            found = row_tokens, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(k)
        if capacity > lengths[k]:
            free.put(capacity - lengths[k], row)
    return rows


def pack_pool(docs, row_tokens, pad=PAD):
    """Packed rows of [(doc_id, row_id, ids)]: dicts with the fields of SCHEMA."""
    pieces = [(d, at, min(row_tokens, len(ids) - at)) for d, (_i, _r, ids) in enumerate(docs) for at in range(0, len(ids), row_tokens)]
    for row in fit([p[2] for p in pieces], row_tokens):
        ids = np.full(row_tokens, pad, "<u2")
        position = np.zeros(row_tokens, "<u4")
        ends, at = [0], 0
        for k in row:
            d, offset, n = pieces[k]
            ids[at : at + n] = docs[d][2][offset : offset + n]
            position[at : at + n] = np.arange(n)
            at += n
            ends.append(at)
        yield {
            "n_tokens": at,
            "n_segments": len(row),
            "input_ids": ids.tobytes(),
            "position_ids": position.astype("<u2" if row_tokens <= 0x10000 else "<u4").tobytes(),
            "cu_seqlens": ends,
            "doc_ids": [docs[pieces[k][0]][0] for k in row],
            "row_ids": [docs[pieces[k][0]][1] for k in row],
            "offsets": [pieces[k][1] for k in row],
        }


def pack(docs: DataFrame, vocabulary=VOCABULARY, row_tokens=ROW_TOKENS, pool_tokens=POOL_TOKENS, doc_id="doc_id", text="text") -> DataFrame:
    """One row per packed row, with the fields of SCHEMA. Ids are 16 bit, little endian; so are positions up to 65,536 tokens a row."""
    rows = numbered_rows(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    arrow_id = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    fields = pa.schema(
        [("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
         ("doc_ids", pa.list_(arrow_id)), ("row_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))]
    )

    def out(pool):
        batch = []
        for row in pack_pool(pool, row_tokens):
            batch.append(row)
            if len(batch) == 256:
                yield pa.RecordBatch.from_pylist(batch, fields)
                batch = []
        if batch:
            yield pa.RecordBatch.from_pylist(batch, fields)

    def run(batches):
        encode, pool, held = Encoder(vocabulary), [], 0
        for batch in batches:
            columns = (batch.column("doc_id"), batch.column("row_id"), batch.column("text"))
            for i in range(batch.num_rows):
                doc, row, body = (c[i].as_py() for c in columns)
                if not body:
                    continue
                ids = encode(body)
                pool.append((doc, row, ids))
                held += len(ids)
                if held >= pool_tokens:
                    yield from out(pool)
                    pool, held = [], 0
        yield from out(pool)

    return rows.mapInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, row_id, ids (16 bit, little endian) of every document: the segments of a row number, in order, joined again."""
    s = F.explode(F.arrays_zip("doc_ids", "row_ids", "offsets", F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1).alias("lo"), F.slice("cu_seqlens", F.lit(2), F.size("cu_seqlens") - 1).alias("hi")))
    one = packed.select("input_ids", s.alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.row_ids").alias("row_id"),
        F.struct(F.col("s.offsets").alias("at"), F.substring("input_ids", F.col("s.lo") * 2 + 1, (F.col("s.hi") - F.col("s.lo")) * 2).alias("ids")).alias("part"),
    )
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("part")), lambda p: F.hex(p["ids"])))
    return one.groupBy("doc_id", "row_id").agg(F.unhex(joined).alias("ids"))


def write(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet below `folder`: id matrices as fixed-width binary, one line per row."""
    packed.write.mode("errorifexists").parquet(folder)
