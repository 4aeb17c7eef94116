"""Opening files of a store from a task."""

import sys

import pyarrow.fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_store(path: str):
    """(file system, path in it) of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


def open_in(url: str, known: dict):
    """The same for one of many files, as Hadoop names them; `known` keeps the stores already opened."""
    if url.startswith("file:") or ":" not in url.split("/")[0]:
        return open_store(url)
    scheme, _, rest = url.partition("://")
    store, _, path = rest.partition("/")
    if (scheme, store) not in known:
        known[scheme, store] = open_store(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{store}/")
    fs, base = known[scheme, store]
    return fs, f"{base.rstrip('/')}/{path}"
