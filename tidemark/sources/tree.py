"""Trees of very many small files: folders are listed by tasks, files are opened by tasks, and the driver sees neither.

Spark's own readers hold the status of every file on the driver. Here a round of tasks lists the folders of one depth, and what they find is kept as a
table; the folders in it are the next round. One folder is listed by one task, in which a local folder passes entry by entry.
"""

import fnmatch
import os
import re
import sys
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.sources import stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
FILES_PER_TASK = 10_000
ENTRY = "url string, folder boolean"
#: What a URI keeps as it is, besides letters, digits and all that is not ASCII.
PLAIN = "/;:@&=+$,!~*'()"
#: Codecs by the end of a file's name, as far as Arrow reads them as Hadoop writes them.
PACKED = (".gz", ".bz2", ".zst")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(fs, path: str):
    """(name, is a folder, size) of what lies in a folder."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(path) as found:
            for e in found:
                try:
                    yield e.name, e.is_dir(), e.stat().st_size
                except FileNotFoundError:
                    continue
    else:
        for i in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            yield i.base_name, i.type == pyarrow.fs.FileType.Directory, i.size


def _listing(names: str, pattern: str | None):
    """A task: folders (`url`) -> their files called `names` and their folders. While a path's pattern lasts, only what it matches counts."""
    only, allowed = re.compile(fnmatch.translate(names)), pattern and re.compile(pattern)

    def entries(url, known):
        fs, path = stores.open_in(url, known)
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(url)
        if info.type == pyarrow.fs.FileType.File:
            if not pattern and info.size and only.match(info.base_name) and not _hidden(info.base_name):
                yield url, False
            return
        for name, folder, size in _entries(fs, path):
            at = f"{url.rstrip('/')}/{name}"
            if allowed:
                # The files that a whole path names are looked at in the next round.
                if allowed.fullmatch(name):
                    yield at, True
            elif not _hidden(name) and (folder or (size and only.match(name))):
                yield at, folder

    def run(batches):
        rows, known = [], {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for row in entries(url, known):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield _table(rows)
                        rows = []
        if rows:
            yield _table(rows)

    return run


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["url", "folder"])


def _start(spark: SparkSession, path: str):
    """(folder to begin with, pattern per depth below it) of a path, which may hold wildcards as Spark's readers take them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    parts = whole.split("/")
    globs = [jvm.org.apache.hadoop.fs.GlobPattern(p) if re.search(r"[*?\[{\\]", p) else None for p in parts]
    first = next((k for k, g in enumerate(globs) if g), len(parts))
    return "/".join(parts[:first]), [g.compiled().pattern() if g else re.escape(p) for p, g in zip(parts[first:], globs[first:], strict=True)]


def list_files(spark: SparkSession, path: str, names="*") -> DataFrame:
    """`url` of all files below a path whose name matches `names` and that are not empty; hidden files and folders are passed over."""
    start, patterns = _start(spark, path)
    folders, found = spark.createDataFrame([(start,)], "url string"), None
    for pattern in [*patterns, None]:
        level = _round(folders, names, pattern)
        folders = level.where("folder").select("url")
        if pattern and folders.isEmpty():
            raise FileNotFoundError(path)
    while True:
        files = level.where("not folder").select("url")
        found = files if found is None else found.unionByName(files)
        if folders.isEmpty():
            return found
        level = _round(folders, names, None)
        folders = level.where("folder").select("url")


def _round(folders: DataFrame, names: str, pattern) -> DataFrame:
    """What lies in the folders, kept; every task gets about as many folders."""
    tasks = folders.sparkSession.sparkContext.defaultParallelism
    return scale.pin(folders.repartition(tasks).mapInArrow(_listing(names, pattern), ENTRY))


def read_files(files: DataFrame) -> DataFrame:
    """`url` (as a URI) and `body` (text) of files (`url`), each read by a task; packed files are unpacked by the end of their names."""

    def run(batches):
        rows, size, known = [], 0, {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                fs, path = stores.open_in(url, known)
                with fs.open_input_stream(path, compression="detect" if path.endswith(PACKED) else None) as f:
                    body = f.read()
                rows.append((as_uri(url), zlib.decompress(body) if path.endswith(".deflate") else body))
                size += len(rows[-1][1])
                if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                    yield _bodies(rows)
                    rows, size = [], 0
        if rows:
            yield _bodies(rows)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, "url").mapInArrow(run, "url string, body binary").select("url", F.col("body").cast("string").alias("body"))


def _bodies(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["url", "body"])


def as_uri(url: str) -> str:
    """A path as Spark names files: what a URI cannot hold is escaped."""
    return re.sub("[ -~\x00-\x1f\x7f]+", lambda m: quote(m[0], safe=PLAIN), url)
