"""Exact removal of repeated byte strings, by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts somewhere else. Sorting all
suffixes would move every byte hundreds of times, so only a sample of suffixes that loses nothing is sorted.

1. Anchors. Of the GRAM-byte strings inside a window of `length` bytes, the one with the least hash (the
   leftmost of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, and
   neighbouring windows share theirs, so an anchor stands for a run of windows: about one suffix in 50.
2. Only anchors whose string occurs twice matter. Occurrences are counted by hash, with partial counts.
3. Of those, each task sorts the suffixes that start at the anchors, writes them as runs (front-coded: the
   length of the prefix shared with the one before, and the rest; what precedes the anchor
   and where it occurs go along; equal ones once), and exchanges the runs by anchor.
4. Each receiver merges its runs with a loser tree that keeps, for every head, the prefix it shares with
   the last suffix put out; heads are compared from there on only. Suffixes of one anchor come out together.
   Equal neighbours are repeated as a whole; at the edges of repeats the windows of one anchor are compared offset by offset,
   on the bytes themselves.
5. Ranges go back to their documents, which are cut in one more pass.

Receivers get about PART_SUFFIXES suffixes each, whatever the input. An anchor with more than HOT occurrences
is exchanged by more bytes of its context as well, so that contexts that cannot share a window
part; copies of one context are merged before the exchange and again on receipt.

Defined cases: null and empty texts have no bytes; texts shorter than `length` keep all; ids may be null or repeated (each row is a
document, so two equal rows remove each other's long enough text); very long texts are read in pieces of PIECE bytes;
periodic text is covered by its own shifts; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm import hashing
from tidemark.llm.text import stable_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 96
PIECE = 1 << 18
HOT = 2000
PART_SUFFIXES = 100_000
RUN_SUFFIXES = 50_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = hashing.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_POSITION = np.uint64((1 << 24) - 1)


def _powers(base, n):
    return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


class Anchors:
    """Anchors of byte strings: `of(raw)` gives (position, first window, last window, hash) arrays."""

    def __init__(self, length=LENGTH, gram=GRAM):
        self.length, self.gram = length, gram
        n = PIECE + length + 1
        self.up = _powers(np.uint64(_BASE), n)
        self.down = _powers(np.uint64(pow(_BASE, -1, 1 << 64)), n)
        self.places = np.arange(n, dtype=np.uint64)

    def _piece(self, raw):
        k, span = self.gram, self.length - self.gram + 1
        n = len(raw)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[raw] * self.up[:n], out=sums[1:])
        hashes = hashing.mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        keys = (hashes & ~_POSITION) | self.places[: len(hashes)]
        width = 1
        while width * 2 <= span:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < span:
            keys = np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])
        at = (keys & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        return at[first], first, last, hashes[at[first]]

    def of(self, raw: np.ndarray):
        n, parts, start = len(raw) - self.length + 1, [], 0
        while start < n:
            end = min(start + PIECE, n)
            at, lo, hi, h = self._piece(raw[start : end + self.length - 1])
            at, lo, hi = at + start, lo + start, hi + start
            if parts and parts[-1][0][-1] == at[0]:
                lo[0] = parts[-1][1][-1]
                parts[-1] = tuple(x[:-1] for x in parts[-1])
                if not len(parts[-1][0]):
                    parts.pop()
            parts.append((at, lo, hi, h))
            start = end
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """anchor, row_id, at for every anchor of every document."""

    def run(batches):
        finder = Anchors(length)
        for batch in batches:
            out, held = [], 0
            ids, texts = batch.column("row_id").to_numpy(), batch.column("text")

            def flush(out):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)], ["anchor", "row_id", "at"])

            for k in range(batch.num_rows):
                raw = texts[k].as_buffer()
                if raw is None or raw.size < length:
                    continue
                at, _lo, _hi, h = finder.of(np.frombuffer(raw, np.uint8))
                out.append((h.view(np.int64), np.full(len(at), ids[k]), at.astype(np.int32)))
                held += len(at)
                if held >= 200_000:
                    yield flush(out)
                    out, held = [], 0
            if out:
                yield flush(out)

    return rows.mapInArrow(run, "anchor bigint, row_id bigint, at int")


def shared(a: bytes, b: bytes, start=0) -> int:
    """Length of the common prefix, known to be at least `start`."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x, y = int.from_bytes(a[start:n], "big"), int.from_bytes(b[start:n], "big")
    return n - ((x ^ y).bit_length() + 7) // 8


def _squeeze(data: bytes) -> bytes:
    """Compressed, with the length in front: runs travel through shuffle files."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def encode_run(entries) -> tuple:
    """Front-coded run of sorted (key, before, places): prefix lengths, rest lengths, rests, and the rest of each entry."""
    lcps, sizes, rests, last = [], [], [], b""
    for key, _before, _places in entries:
        p = shared(last, key)
        lcps.append(p)
        sizes.append(len(key) - p)
        rests.append(key[p:])
        last = key
    places = [p for e in entries for p in e[2]]
    rest, front = b"".join(rests), b"".join(e[1] for e in entries)
    return (
        np.array(lcps, "<u2").tobytes(), np.array(sizes, "<u2").tobytes(), _squeeze(rest),
        np.array([len(e[1]) for e in entries], "<u2").tobytes(), _squeeze(front),
        np.array([len(e[2]) for e in entries], "<u4").tobytes(), np.array([p[0] for p in places], "<i8").tobytes(), np.array([p[1] for p in places], "<i8").tobytes(),
    )


def decode_run(lcps, sizes, rests, befores, before, counts, ids, ats):
    """(prefix shared with the one before, key, before, places) in order."""
    key, r, b, p = b"", 0, 0, 0
    rests, before = _unsqueeze(rests), _unsqueeze(before)
    ids, ats = np.frombuffer(ids, "<i8").tolist(), np.frombuffer(ats, "<i8").tolist()
    for lcp, size, nb, np_ in zip(*(np.frombuffer(x, t).tolist() for x, t in ((lcps, "<u2"), (sizes, "<u2"), (befores, "<u2"), (counts, "<u4"))), strict=True):
        key = key[:lcp] + rests[r : r + size]
        yield lcp, key, before[b : b + nb], list(zip(ids[p : p + np_], ats[p : p + np_], strict=True))
        r, b, p = r + size, b + nb, p + np_


class LoserTree:
    """Merge of sorted runs. Each head carries the length of the prefix it shares with the last key put out.

    Of two heads the one that shares more is less, without a look at the bytes; heads that share
    equally much are compared from there on, and the loser remembers how far it agrees with the winner.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.head = [next(r, None) for r in self.runs] + [None] * (self.size - len(self.runs))
        self.lcp = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node):
        if node >= self.size:
            return node - self.size
        return self._play(self._build(2 * node), self._build(2 * node + 1), node)

    def _play(self, a, b, node):
        x, y = self.head[a], self.head[b]
        if x is None or (y is not None and self.lcp[b] > self.lcp[a]):
            a, b = b, a
        elif y is not None and self.lcp[a] == self.lcp[b]:
            n = shared(x[1], y[1], self.lcp[a])
            if x[1][n:] > y[1][n:]:
                a, b = b, a
            self.lcp[b] = n
        self.loser[node] = b
        return a

    def __iter__(self):
        last = 0
        while self.head[self.winner] is not None:
            w = self.winner
            _p, key, before, places = self.head[w]
            yield (self.lcp[w] if last else 0), key, before, places
            last = 1
            self.head[w] = nxt = next(self.runs[w], None)
            self.lcp[w] = nxt[0] if nxt is not None else 0
            node, a = (w + self.size) >> 1, w
            while node:
                a = self._play(a, self.loser[node], node)
                node >>= 1
            self.winner = a


def repeated_offsets(entries, length):
    """For entries (after, before reversed, places) of one anchor: per entry, the sorted offsets of windows that occur twice.

    The window of offset o is the last o bytes before the anchor and the first length - o after it. An entry has the
    windows from length - len(after) to len(before).
    """
    out = [None] * len(entries)
    whole = [range(length - len(a), len(b) + 1) for a, b, _p in entries]
    single = [k for k, e in enumerate(entries) if len(e[2]) == 1]
    for k, e in enumerate(entries):
        if len(e[2]) > 1:
            out[k] = whole[k]
    if not single or len(entries) == 1:
        return [x if x is not None else () for x in out]
    if len(entries) == 2:
        (a, b, _), (c, d, _) = entries
        lo, hi = max(length - shared(a, c), whole[0].start, whole[1].start), min(shared(b, d), whole[0].stop - 1, whole[1].stop - 1)
        both = range(lo, hi + 1)
        return [x if x is not None else both for x in out]
    needed = set().union(*(whole[k] for k in single))
    hits = [[] for _ in entries]
    for o in sorted(needed):
        seen = {}
        for k, (a, b, _p) in enumerate(entries):
            if o in whole[k]:
                seen.setdefault((b[:o], a[: length - o]), []).append(k)
        for ks in seen.values():
            if len(ks) > 1:
                for k in ks:
                    hits[k].append(o)
    return [x if x is not None else hits[k] for k, x in enumerate(out)]


def _ranges(offsets, length):
    """Maximal runs of sorted offsets as (greatest offset, bytes covered)."""
    if isinstance(offsets, range):
        if len(offsets):
            yield offsets[-1], len(offsets) - 1 + length
        return
    start = prev = None
    for o in offsets:
        if prev is not None and o == prev + 1:
            prev = o
            continue
        if prev is not None:
            yield prev, prev - start + length
        start = prev = o
    if prev is not None:
        yield prev, prev - start + length


RUN = "part int, lcps binary, sizes binary, rests binary, befores binary, before binary, counts binary, ids binary, ats binary"
NAMES = [x.split()[0] for x in RUN.split(", ")]


def suffix_runs(chosen: DataFrame, length: int, parts: int) -> DataFrame:
    """Sorted front-coded runs of the anchors in `ats` (a negative value, -1 - at, marks a hot anchor) of row_id, text."""

    def run(batches):
        finder = Anchors(length)
        held, size = {}, 0

        def put(key, before, row, at):
            nonlocal size
            slot = held.get((key, before))
            if slot is None:
                held[(key, before)] = [(row, at)]
                size += 1
            else:
                slot.append((row, at))
                size += 0.1

        def flush():
            by_part = {}
            for (key, before), places in held.items():
                by_part.setdefault(int.from_bytes(key[:8], "big") % parts, []).append((key, before, places))
            batch = []
            for part, entries in by_part.items():
                entries.sort()
                batch.append((part, *encode_run(entries)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in batch], pa.int32()), *[pa.array([x[k] for x in batch], pa.binary()) for k in range(1, 9)]], NAMES)

        for batch in batches:
            ids, texts, wanted = batch.column("row_id").to_pylist(), batch.column("text"), batch.column("ats")
            for k in range(batch.num_rows):
                body = texts[k].as_py()
                want = wanted.slice(k, 1).flatten().to_numpy()
                hot = set((-1 - want[want < 0]).tolist())
                at, lo, hi, h = finder.of(np.frombuffer(body, np.uint8))
                some = np.isin(at, np.where(want < 0, -1 - want, want))
                for p, first, last, name in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), h[some].byteswap().view("V8").tolist(), strict=True):
                    after, before = body[p : last + length], body[first:p][::-1]
                    if p not in hot:
                        put(bytes(name) + after, before, ids[k], p)
                        continue
                    # windows with offsets up to `middle` share length - middle bytes after the anchor, the others share middle bytes before it
                    middle = (length - finder.gram) // 2
                    if p - last <= middle:
                        part = hashlib.blake2b(b"a" + bytes(name) + after[: length - middle], digest_size=8).digest()
                        put(part + after, before[:middle], ids[k], p)
                    if p - first > middle:
                        part = hashlib.blake2b(b"b" + bytes(name) + before[: middle + 1], digest_size=8).digest()
                        put(part + after[: length - middle - 1], before, ids[k], p)
                if size >= RUN_SUFFIXES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return chosen.mapInArrow(run, RUN)


def merged_ranges(runs: DataFrame, length: int) -> DataFrame:
    """row_id, start, size: byte ranges to remove, from all runs of each part."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [[c[k].as_py() for c in (batch.column(n) for n in NAMES[1:])] for batch in batches for k in range(batch.num_rows)]
        out = ([], [], [])

        def settle(group):
            entries = [(a, b, p) for (a, b), p in group.items()]
            for (_a, _b, places), offsets in zip(entries, repeated_offsets(entries, length), strict=True):
                for most, size in _ranges(offsets, length):
                    for row, at in places:
                        out[0].append(row)
                        out[1].append(at - most)
                        out[2].append(size)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["row_id", "start", "size"])

        group = {}
        for lcp, key_bytes, before, places in LoserTree([decode_run(*r) for r in loaded]):
            if lcp < 8 and group:
                settle(group)
                group = {}
                if len(out[0]) > 100_000:
                    yield flush()
                    out = ([], [], [])
            group.setdefault((key_bytes[8:], before), []).extend(places)
        settle(group)
        yield flush()

    return runs.groupBy("part").applyInArrow(merge, "row_id bigint, start bigint, size int")


def removal(docs: DataFrame, length=LENGTH, doc_id="doc_id", text="text", hot=HOT):
    """(rows, ranges): row_id, doc_id, text as binary; and row_id with its ranges array<struct<start, size>>, overlapping as found.

    Both are laid out by row_id. Texts are exchanged once: the join that gives anchors to their texts and the join
    of the ranges with `rows` read the same exchange, so its columns are the same in both.
    """
    plain = stable_rows(docs, doc_id, text).select("row_id", "doc_id", F.col("text").cast("binary").alias("text"))
    anchors = anchor_rows(plain.where(F.length("text") >= length).select("row_id", "text"), length)
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = anchors.join(often, "anchor").select("row_id", F.when(F.col("n") > hot, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))
    per_row = scale.pin(marked.groupBy("row_id").agg(F.collect_list("at").alias("ats")))
    total = per_row.agg(F.coalesce(F.sum(F.size("ats")), F.lit(0))).first()[0]
    parts = max(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SUFFIXES))
    rows = plain.repartition("row_id")
    found = merged_ranges(suffix_runs(rows.join(per_row, "row_id"), length, parts), length)
    return rows, found.groupBy("row_id").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))


def _cover(ranges):
    """Sorted maximal (start, end) of (start, size) ranges; ranges that touch are one."""
    out = []
    for start, size in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return out


def _rest(body: bytes, spans):
    at = 0
    for a, b in spans:
        yield body[at:a]
        at = b
    yield body[at:]


def report(docs: DataFrame, length=LENGTH, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, ranges = removal(docs, length, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = []
            for body, found in zip(batch.column("text"), batch.column("ranges"), strict=True):
                body = body.as_py() or b""
                spans = _cover((r["start"], r["size"]) for r in found.as_py() or ())
                digest = hashlib.sha256()
                for piece in _rest(body, spans):
                    digest.update(piece)
                got.append((len(body), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            columns = list(zip(*got, strict=True)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(columns[k], pa.int64()) for k in range(3)], pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = rows.join(ranges, "row_id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, length=LENGTH, doc_id="doc_id", text="text") -> DataFrame:
    """row_id, doc_id, text without the repeated bytes; what is left of cut characters is dropped."""
    rows, ranges = removal(docs, length, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for body, found in zip(batch.column("text"), batch.column("ranges"), strict=True):
                body = body.as_py()
                spans = _cover((r["start"], r["size"]) for r in found.as_py() or ())
                out.append(None if body is None else b"".join(_rest(body, spans)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(out, pa.string())], ["row_id", "doc_id", "text"])

    return rows.join(ranges, "row_id", "left").mapInArrow(run, f"row_id bigint, doc_id {kind}, text string")
