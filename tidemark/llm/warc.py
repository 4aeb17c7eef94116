"""WARC archives as a PySpark Python data source, and deduplicated writing of pages.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Reading. Files of a folder are planned on the driver into partitions of about `partitionBytes` (a file is one piece: records
cannot be found in its middle without reading it). A task parses the header lines of a record first. Predicates on columns that come from the
headers are pushed down into that step (`enable_pushdown`); a record that fails them, or any record if the schema asked for
has no `payload`, is stepped over: in plain files by its Content-Length, in compressed ones by the skip-lengths
subfield `sl` of the gzip header, so its payload is neither inflated nor copied. Members without that
subfield are inflated in pieces that are thrown away. Payloads are held one at a time.

Writing. Each task writes files of about `fileBytes`, one gzip member per record with skip lengths, under names of their own. The commit publishes
a list of the files of successful tasks; readers follow the lists, so what lost or repeated attempts left behind is not read.
Folders without a list (archives from elsewhere) are read whole.

Paths may be local, file:, hdfs:, s3:, gs: or abfs:; files are opened by pyarrow's file systems in driver and tasks.

Deduplication (`with_revisits`): of records with equal payloads of at least LEAST bytes the one with the
smallest id is a response and the others are revisits of it: headers without a payload that name the response, the digest and the length.

Defined cases: a null payload is empty; null ids come last, and records without an id that share a payload with one that has an id revisit it (if
none has one, all are responses); records that repeat an id and a payload are equal and take the same type; ids are text or numbers without line breaks; a null url gives no WARC-Target-URI;
line breaks in header values are written as spaces; payloads of any length are kept whole; an empty table
gives a folder that is read as no rows; further columns are ignored.
"""

import json
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tidemark import scale
from tidemark.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shorter payloads are not worth a reference.
LEAST = 100
PARTITION_BYTES, FILE_BYTES = 128 << 20, 1 << 30
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
HEAD = 4096
LISTS = "_written-"

# ---- Fixed values: names of the WARC format ------------------------------------------------
VERSION = b"WARC/1.1"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Our own extension field: the length of the payload that a revisit leaves out.
PAYLOAD_LENGTH = "X-Payload-Length"

SCHEMA = ", ".join(f"{c} {'bigint' if c == 'content_length' else 'string'}" for c in HEADERS) + ", payload_length bigint, file string, payload binary"
#: Columns that come from the headers alone.
HEADER_COLUMNS = (*HEADERS, "payload_length")


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


# ---- records -------------------------------------------------------------------------------


def header_block(fields: dict) -> bytes:
    lines = [VERSION] + [f"{k}: {' '.join(str(v).split(chr(10))).replace(chr(13), ' ')}".encode() for k, v in fields.items() if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def member(record: bytes, level=6) -> bytes:
    """A gzip member that states its own lengths in the subfield `sl` (skip lengths), as the format's annex has it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    short = total < 1 << 32 and len(record) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, total, len(record)) if short else b"xx" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict:
    """Fields of a header block by lower-case name; folded lines are joined, a repeated field keeps its first value."""
    out, last = {}, None
    for line in block.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().decode("utf-8", "replace").lower()
            out.setdefault(last, value.strip().decode("utf-8", "replace"))
    return out


def columns_of(fields: dict) -> dict:
    row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    row["content_length"] = int(row["content_length"] or 0)
    length = fields.get(PAYLOAD_LENGTH.lower())
    row["payload_length"] = int(length) if length is not None else row["content_length"]
    return row


class _Plain:
    """Records of an uncompressed file; payloads that are not wanted are stepped over."""

    def __init__(self, stream):
        self.stream, self.size, self.inflated = stream, stream.size(), 0

    def records(self, wanted):
        at = 0
        while at < self.size:
            self.stream.seek(at)
            head = b""
            while b"\r\n\r\n" not in head:
                more = self.stream.read(HEAD)
                if not more:
                    if head.strip():
                        raise ValueError("a record is cut off in its headers")
                    return
                head += more
            skip = len(head) - len(head.lstrip(b"\r\n"))
            end = head.index(b"\r\n\r\n", skip) + 4
            row = columns_of(parse_headers(head[skip:end]))
            body = at + end
            if wanted(row):
                self.stream.seek(body)
                payload = self.stream.read(row["content_length"])
                if len(payload) < row["content_length"]:
                    raise ValueError("a record is cut off in its payload")
                yield row, payload
            else:
                yield row, None
            at = body + row["content_length"] + 4


class _Members:
    """Records of a file with one gzip member per record."""

    def __init__(self, stream):
        self.stream, self.size, self.inflated = stream, stream.size(), 0

    def _skip_length(self, start):
        """Length of the member at `start` if its header states it, else None."""
        self.stream.seek(start)
        fixed = self.stream.read(12)
        if fixed[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        if len(fixed) < 12 or not fixed[3] & 4:
            return None
        extra, at = self.stream.read(struct.unpack("<H", fixed[10:12])[0]), 0
        while at + 4 <= len(extra):
            size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if extra[at : at + 2] == b"sl" and size == 8:
                return struct.unpack("<I", extra[at + 4 : at + 8])[0]
            at += 4 + size
        return None

    def _pieces(self, start, state, piece=HEAD):
        """Inflated pieces of the member at `start`, bounded in size; `state['end']` is where it ended."""
        inflate, at = zlib.decompressobj(31), start
        while not inflate.eof:
            self.stream.seek(at)
            raw = inflate.unconsumed_tail or self.stream.read(piece)
            if not inflate.unconsumed_tail:
                at += len(raw)
            if not raw:
                raise ValueError("a gzip member is cut off")
            out = inflate.decompress(raw, 1 << 20)
            self.inflated += len(out)
            yield out
            piece = min(piece * 4, 1 << 20)
        state["end"] = at - len(inflate.unused_data)

    def records(self, wanted):
        at = 0
        while at < self.size:
            length, state, head = self._skip_length(at), {}, b""
            pieces = self._pieces(at, state)
            while b"\r\n\r\n" not in head:
                more = next(pieces, None)
                if more is None:
                    raise ValueError("a record is cut off in its headers")
                head += more
            end = head.index(b"\r\n\r\n") + 4
            row = columns_of(parse_headers(head[:end]))
            want = wanted(row)
            if want:
                body = [head[end:], *pieces]
                payload = b"".join(body)[: row["content_length"]]
                if len(payload) < row["content_length"]:
                    raise ValueError("a record is cut off in its payload")
                yield row, payload
            else:
                yield row, None
                if not length:
                    for _ in pieces:
                        pass
            at = state["end"] if "end" in state else at + length


def open_records(stream):
    start = stream.read(2)
    stream.seek(0)
    return (_Members if start == b"\x1f\x8b" else _Plain)(stream)


# ---- reading -------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: tuple


def _test(f):
    """The pushed filter as a test of a row, or None where it is left to Spark."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # A comparison with null is neither true nor false; only these two never are.
        return (lambda r: not inner(r)) if inner and isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) else None
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return None
    c = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda r: r[c] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[c] is not None
    v = f.value
    if isinstance(f, EqualNullSafe):
        return lambda r: r[c] == v
    compare = {
        EqualTo: lambda x: x == v, In: lambda x: x in v, GreaterThan: lambda x: x > v, GreaterThanOrEqual: lambda x: x >= v, LessThan: lambda x: x < v,
        LessThanOrEqual: lambda x: x <= v, StringStartsWith: lambda x: x.startswith(v), StringEndsWith: lambda x: x.endswith(v), StringContains: lambda x: v in x,
    }.get(type(f))
    # Texts are compared by their UTF-8 bytes in Spark; for equality, and for ASCII order, that is Python's order too.
    if compare is None or (isinstance(v, str) and type(f) in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
        return None
    return lambda r: r[c] is not None and compare(r[c])


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _files(self):
        """(path, size): those that the lists name, or all of a folder without lists."""
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            return [(self.path, fs.get_file_info(root).size)]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        lists = [i.path for i in found if i.base_name.startswith(LISTS)]
        sizes = {i.path: i.size for i in found if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))}
        if lists:
            named = []
            for at in lists:
                with fs.open_input_stream(at, compression=None) as s:
                    named += json.loads(s.read())
            missing = [n for n in named if f"{root.rstrip('/')}/{n}" not in sizes]
            if missing:
                raise FileNotFoundError(f"{missing[0]} was written but is not there")
            return [(f"{self.path.rstrip('/')}/{n}", sizes[f"{root.rstrip('/')}/{n}"]) for n in sorted(named)]
        return [(f"{self.path.rstrip('/')}/{p[len(root.rstrip('/')) + 1:]}", s) for p, s in sorted(sizes.items())]

    def partitions(self):
        out, held, total = [], [], 0
        for path, size in self._files():
            if held and total + size > self.partition_bytes:
                out.append(Files(tuple(held)))
                held, total = [], 0
            held.append(path)
            total += size
        return out + [Files(tuple(held))]

    def read(self, partition):
        names, tests = [f.name for f in self.schema.fields], self.tests
        with_payload = "payload" in names
        arrow = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
        kept, size = {n: [] for n in names}, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(kept[n], arrow.get(n, pa.string())) for n in names], names)

        for path in partition.paths:
            fs, at = _open(path)
            with fs.open_input_file(at) as stream:
                for row, payload in open_records(stream).records(lambda r: with_payload and all(t(r) for t in tests)):
                    if payload is None and not all(t(row) for t in tests):
                        continue
                    row["file"], row["payload"] = path, payload
                    for n in names:
                        kept[n].append(row[n])
                    size += len(payload or b"") + 500
                    if size >= BATCH_BYTES or len(kept[names[0]]) >= BATCH_ROWS:
                        yield batch()
                        kept, size = {n: [] for n in names}, 0
        if names and kept[names[0]]:
            yield batch()


# ---- writing -------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.compress = options["path"], options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        if overwrite:
            raise ValueError("archives are only added to; choose a new folder or append")
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)

    def write(self, iterator):
        fs, root = _open(self.path)
        files, stream, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                payload = row.get("payload") or b""
                fields = {h: row.get(c) for c, h in HEADERS.items() if c != "content_length"}
                if row.get("payload_length") is not None and row["payload_length"] != len(payload):
                    fields[PAYLOAD_LENGTH] = row["payload_length"]
                record = header_block({**fields, "Content-Length": len(payload)}) + payload + b"\r\n\r\n"
                data = member(record) if self.compress else record
                if stream is None or size + len(data) > self.file_bytes:
                    if stream is not None:
                        stream.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                    stream, size = fs.open_output_stream(f"{root.rstrip('/')}/{files[-1]}", compression=None), 0
                stream.write(data)
                size += len(data)
        if stream is not None:
            stream.close()
        return Written(files)

    def commit(self, messages):
        fs, root = _open(self.path)
        names = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{root.rstrip('/')}/{LISTS}{uuid.uuid4().hex}", compression=None) as s:
            s.write(json.dumps(names).encode())

    def abort(self, messages):
        """Files of a failed write are on no list and never read."""


class WarcSource(DataSource):
    """Options: path; reading: partitionBytes; writing: fileBytes, compression (gzip or none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def enable_pushdown(spark: SparkSession) -> None:
    """Register the source; Spark pushes filters into Python sources only where this setting allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages ---------------------------------------------------------------------------------


def with_revisits(records: DataFrame, least=LEAST, id_type="page_id") -> DataFrame:
    """`records` (page_id, target_uri, payload) as rows of an archive, repeated payloads as revisits."""
    told = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("bigint")}
    )
    # The smallest id per payload is a partial aggregate on the map side; only payloads that occur twice go on.
    first = (
        told.where(F.col("payload_length") >= least)
        .groupBy("payload_digest")
        .agg(F.min(id_type).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first_id is not null")
        .select("payload_digest", "first_id")
    )
    joined = scale.join_small(told, first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("payload_length") >= least) & ~F.col(id_type).eqNullSafe(F.col("first_id"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col(id_type)).alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(again, record_id(F.col("first_id"))).alias("refers_to"),
        F.when(again, REVISIT_PROFILE).alias("profile"),
        F.lit("text/html").alias("content_type"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def record_id(c):
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def page_id(c):
    """The id that `record_id` wrote, as text; null where there was none."""
    return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit(""))


def write_pages(pages: DataFrame, path: str, page="page_id", url="url", html="html", least=LEAST, **options) -> None:
    """Archives of pages below `path`, repeated payloads as revisits. Dates are not part of the input and left out."""
    records = pages.select(F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").alias("target_uri"), F.col(f"`{html}`").cast("binary").alias("payload"))
    enable_pushdown(pages.sparkSession)
    with_revisits(records, least).write.format("warc").options(**options).mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload=True, **options) -> DataFrame:
    """Records below `path`; without `payload` none is inflated."""
    enable_pushdown(spark)
    schema = SCHEMA if payload else SCHEMA.removesuffix(", payload binary")
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def report(pages: DataFrame) -> DataFrame:
    """Pages written and read back: responses by their payload, revisits by their headers alone."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    write_pages(pages, path)
    found = read_records(spark, path).where("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    again = read_records(spark, path, payload=False).where("record_type = 'revisit'").select(
        "record_id", F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    both = found.unionByName(again)
    return both.select(
        page_id(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).cast(kind).alias("refers_to")
    )


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= {LEAST} GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON f.h = d.h AND d.n >= {LEAST}"""
