"""Similarity join on word shingles, with signature trees.

Documents with the same set of shingles form a class; everything below works on classes.

1. Candidate groups. Of a set of n shingles, two sets of the wanted similarity share one of their first
   n - ceil(t n) + 1 shingles in any common order. The order puts rare shingles first; rarity comes
   from a sketch of fixed size (BUCKETS counters summed over all documents), so what is sent to the
   tasks does not grow. Any order gives the same links; a rough one only costs time. Classes that share a
   prefix shingle form a group, equal groups are merged.
2. Verification by signature trees. The sets of a group are put, by size, under nodes that hold the OR of
   their bitmaps and their range of sizes. Pairs of nodes are walked down together and dropped when the sizes
   or the greatest overlap that the bitmaps allow rule out a link, or when all below is connected
   already. Pairs of leaves are verified on the sets themselves.
   Every class is first compared in the largest of its groups; then only groups that still hold more than one
   component are taken up again. So a large set of near copies costs about one
   comparison per copy, while no link between components can be missed. Both times members are
   pruned twice, by short bitmaps of fixed length and then by long ones of FINE bits per shingle, before sets travel.
3. Components of the links that connect (a spanning forest per group) by distributed star operations.

Bounded work: a group is cut into blocks of BLOCK_CLASSES classes or BLOCK_TOKENS shingles, and
blocks of one group are paired with each other as separate tasks.

Class ids are 64-bit hashes; among n classes about n^2 / 2^65 may collide.

Defined cases: null texts and texts without words have an empty set, no links, and are components of their own; fewer words than
a shingle count as one shingle; ids may be null (never the least of a component with other ids) or
repeated (rows are judged each; of rows that share the least id the first by place stays); very long texts are taken whole, in groups of bounded
size; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm import hashing
from tidemark.llm.components import components
from tidemark.llm.text import identified, join_rows, stable_rows, unwrapped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, PERCENT = 5, 80
BUCKETS, SLICES = 1 << 20, 16
BLOCK_CLASSES, BLOCK_TOKENS = 2000, 2_000_000
BITS, FAN = 2048, 16
FINE = 8


def _sets(batches, words):
    """(row numbers in the batch, batch, sets) over groups of bounded size."""
    for batch in batches:
        texts = batch.column("text")
        sizes = ((k, texts[k].as_py() or b"") for k in range(batch.num_rows))
        for part in hashing.groups(sizes, lambda r: len(r[1])):
            yield batch, [k for k, _ in part], hashing.shingles_of([t for _, t in part], words)


def class_of(tokens: np.ndarray) -> int:
    """64-bit id of a sorted set."""
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


def described(rows: DataFrame, words: int) -> DataFrame:
    """row_id, doc_id, class, n, bits of every document, and in rows of their own (slice, counts) what each task adds to the sketch."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts, seen, doc_type = np.zeros(BUCKETS, np.uint32), set(), None
        names = ["row_id", "doc_id", "class", "n", "bits", "slice", "counts"]
        for batch, ks, sets in _sets(batches, words):
            ids = [class_of(s) for s in sets]
            for c, s in zip(ids, sets, strict=True):
                if c not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(c)
                    counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)] += 1
            doc_type = batch.column("doc_id").type
            n, take = len(ks), pa.array(ks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(take), batch.column("doc_id").take(take), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if doc_type is None or not counts.any():
            return
        part = BUCKETS // SLICES
        packed = [pack_counts(counts[k * part : (k + 1) * part]) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, doc_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()),
             pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(run, f"row_id bigint, doc_id {kind}, class bigint, n int, bits binary, slice int, counts binary")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counters, 65535 at most, as a plane of low and one of high bytes: most are small, so they take a few bits each."""
    return zlib.compress(np.minimum(counts, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1).astype(np.int64)
    return low + 256 * high


def rarity(sketch: DataFrame) -> np.ndarray:
    """Level of each of the BUCKETS counters, a byte each: quarter powers of two. SLICES rows of fixed size reach the driver."""
    part = BUCKETS // SLICES

    def add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += unpack_counts(counts.as_py())
        level = np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "level"])

    levels = np.zeros(BUCKETS, np.uint8)
    for r in sketch.groupBy("slice").applyInArrow(add_up, "slice int, level binary").collect():
        levels[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(r["level"], np.uint8)
    return levels


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def prefixes(rows: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """token, class, n for the prefix of every class, once per task."""
    packed = levels.tobytes()

    def run(batches):
        level, seen = np.frombuffer(packed, np.uint8), set()
        tokens, classes, sizes, held = [], [], [], 0

        def flush():
            c = np.repeat(np.array(classes, np.int64), [len(t) for t in tokens])
            n = np.repeat(np.array(sizes, np.int32), [len(t) for t in tokens])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(c), pa.array(n)], ["token", "class", "n"])

        for _batch, _ks, sets in _sets(batches, words):
            for s in sets:
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(c)
                p = prefix_length(len(s), percent)
                order = (level[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix_order(s) >> np.uint64(8))
                tokens.append(s[np.argpartition(order, p - 1)[:p]] if p < len(s) else s)
                classes.append(c)
                sizes.append(len(s))
                held += p
            if held >= 200_000:
                yield flush()
                tokens, classes, sizes, held = [], [], [], 0
        if tokens:
            yield flush()

    return rows.mapInArrow(run, "token bigint, class bigint, n int")


def mix_order(s):
    return hashing.mix(s ^ np.uint64(0x5851F42D4C957F2D))


def _runs(batches, key, single=True):
    """Complete runs of equal `key` in sorted batches: the key and its (batch, first row, end row). Without `single`, most runs of one row are left out at once."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[cuts[1:], len(keys)]
        if not single:
            # the first and the last run may go on in other batches
            some = ends - cuts > 1
            some[[0, -1]] = True
            cuts, ends = cuts[some], ends[some]
        for a, b in zip(cuts, ends, strict=True):
            if held and keys[a] != held_key:
                yield held_key, held
                held = []
            held_key = keys[a]
            held.append((batch, int(a), int(b)))
    if held:
        yield held_key, held


def _between(cuts, end, start=0):
    at = [start, *(int(c) for c in cuts), end]
    return list(zip(at[:-1], at[1:], strict=True))


def part_ids(members: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each of the classes `members` a number that names the set of all those of its part."""
    _, at, size = np.unique(part, return_inverse=True, return_counts=True)
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, at, hashing.mix(members.view(np.uint64)))
    return hashing.mix(total + size.astype(np.uint64)).view(np.int64)[at]


def candidate_groups(prefix: DataFrame, percent: int) -> DataFrame:
    """gid, token, block, class, n: the classes that share a prefix shingle, in blocks of bounded size; a gid names a set of members."""

    def run(batches):
        out = {k: [] for k in ("gid", "token", "block", "class", "n")}
        held = 0

        def add(token, block, members, n):
            for k, v in (("gid", part_ids(members, np.zeros(len(members), int))), ("token", np.full(len(members), token)), ("block", np.full(len(members), block, np.int32)), ("class", members), ("n", n)):
                out[k].append(v)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k])) for k in out], list(out))
            for k in out:
                out[k] = []
            return batch

        for token, parts in _runs(batches, "token", single=False):
            if len(parts) == 1 and parts[0][2] - parts[0][1] == 1:
                continue
            c = np.concatenate([p.column("class").to_numpy()[a:b] for p, a, b in parts])
            n = np.concatenate([p.column("n").to_numpy()[a:b] for p, a, b in parts])
            c, first = np.unique(c, return_index=True)
            n = n[first]
            if len(c) < 2:
                continue
            order = np.lexsort((c, n))
            c, n = c[order], n[order]
            # by size: no pair links across a step of more than the similarity
            for a, b in _between(np.flatnonzero(n[:-1].astype(np.int64) * 100 < n[1:].astype(np.int64) * percent) + 1, len(c)):
                if b - a < 2:
                    continue
                number = np.maximum(np.arange(b - a) // BLOCK_CLASSES, np.cumsum(n[a:b], dtype=np.int64) // BLOCK_TOKENS)
                blocks = _between(a + np.flatnonzero(number[1:] != number[:-1]) + 1, b, a)
                for block, (x, y) in enumerate(blocks):
                    add(token, -1 if len(blocks) == 1 else a + block, c[x:y], n[x:y])
                held += b - a
            if held >= 100_000:
                yield flush()
                held = 0
        if out["gid"]:
            yield flush()

    return prefix.repartition("token").sortWithinPartitions("token").mapInArrow(run, "gid bigint, token bigint, block int, class bigint, n int")


def least_overlap(a, b, percent):
    return -(-(a + b) * percent // (100 + percent))


class Tree:
    """Sets under nodes with the OR of their bitmaps and their range of sizes; level 0 holds the sets, ordered by size."""

    def __init__(self, size, bits, percent):
        self.size, self.bits, self.percent = size, bits, percent
        self.levels = [(bits, size, size)]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            below, low, high = self.levels[-1]
            at = np.arange(0, len(below), FAN)
            self.levels.append((np.bitwise_or.reduceat(below, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def below(self, level, k):
        return k * FAN**level, min((k + 1) * FAN**level, len(self.size))

    def may(self, level, u, v):
        """Can any set below u link to any below v? Each lacks at least the bits that no set below v has."""
        bits, low, high = self.levels[level]
        if high[u] * 100 < low[v] * self.percent or high[v] * 100 < low[u] * self.percent:
            return False
        a, b = self.below(level, u)
        missing = np.bitwise_count(self.bits[a:b] & ~bits[v]).sum(1, dtype=np.int64)
        return bool((self.size[a:b] - missing >= least_overlap(self.size[a:b], low[v], self.percent)).any())

    def leaves(self, done=lambda a, b, c, d: False):
        """(a, b, c, d): ranges of sets under two lowest nodes that may link, by dual descent; `done` drops pairs of nodes."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, u, v = stack.pop()
            (a, b), (c, d) = self.below(level, u), self.below(level, v)
            if done(a, b, c, d) or not (self.may(level, u, v) and self.may(level, v, u)):
                continue
            if level == 1:
                yield a, b, c, d
                continue
            width = len(self.levels[level - 1][0])
            us = range(u * FAN, min((u + 1) * FAN, width))
            vs = range(v * FAN, min((v + 1) * FAN, width))
            stack.extend(sorted(((level - 1, x, y) for x in us for y in vs if x <= y), key=lambda p: p[1] == p[2]))

    def open_pairs(self, i, js):
        """Of the sets js, those that the sizes and bitmaps let link to set i."""
        lacks = np.bitwise_count(self.bits[i] & ~self.bits[js]).sum(1, dtype=np.int64)
        extra = np.bitwise_count(self.bits[js] & ~self.bits[i]).sum(1, dtype=np.int64)
        most = np.minimum(self.size[i] - lacks, self.size[js] - extra)
        return js[most >= least_overlap(self.size[i], self.size[js], self.percent)]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens >> np.uint64(40)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def _merge(part, i, js):
    """`part` numbers what hangs together; i and the js do."""
    if part is not None and (part[js] != part[i]).any():
        part[np.isin(part, part[js])] = part[i]


def open_members(size, bits, label, percent, part=None) -> np.ndarray:
    """Which sets, ordered by size, have a partner of another label that sizes and bitmaps allow. In `part`, if given, partners get one number."""
    tree, found = Tree(size, bits, percent), np.zeros(len(size), bool)
    for a, b, c, d in tree.leaves(_alike(label)):
        for i in range(a, b):
            js = np.arange(max(c, i + 1), d)
            js = tree.open_pairs(i, js[label[js] != label[i]])
            found[js] = True
            found[i] |= len(js) > 0
            _merge(part, i, js)
    return found


def fine_bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap whose length, a power of two, grows with the set: FINE bits per shingle or more."""
    length = max(BITS, 1 << int(FINE * len(tokens) - 1).bit_length())
    bits = np.zeros(length, np.uint8)
    bits[(tokens >> np.uint64(20)).astype(np.int64) & (length - 1)] = 1
    return np.packbits(bits).tobytes()


def _folded(raw: bytes, length: int) -> np.ndarray:
    """A bitmap of `length` bytes from one that is as long or twice as long: places are hashes modulo the length."""
    bits = np.frombuffer(raw, np.uint8)
    return (bits if len(bits) == length else bits[:length] | bits[length:]).view(np.uint64)


def finely_open(size, raw, label, percent, part=None) -> np.ndarray:
    """As `open_members`, by bitmaps of each set's own length.

    Sets that can link differ little in size, so their lengths are equal or differ by a factor of two. Each length has a
    tree of its own, with the sets of twice the length folded down to it; pairs of the latter are left to their own tree.
    """
    found, length = np.zeros(len(size), bool), np.array([len(r) for r in raw])
    for wide in np.unique(length):
        near = np.flatnonzero((length == wide) | (length == 2 * wide))
        tree = Tree(size[near], np.stack([_folded(raw[k], wide) for k in near]), percent)
        mine, own = label[near], length[near] == wide
        for a, b, c, d in tree.leaves(_alike(mine)):
            for i in range(a, b):
                js = np.arange(max(c, i + 1), d)
                js = js[(mine[js] != mine[i]) & (own[js] | own[i])]
                js = tree.open_pairs(i, js) if len(js) else js
                found[near[js]] = True
                found[near[i]] |= len(js) > 0
                _merge(part, near[i], near[js])
    return found


def _alike(label):
    def test(a, b, c, d):
        one = label[a]
        return bool((label[a:b] == one).all() and (label[c:d] == one).all())

    return test


def tree_links(ids, sets, labels, percent):
    """Links that connect: [(id, id)], a spanning forest of the similarity graph, once sets of one label are taken as connected."""
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    root = np.unique([labels[k] for k in order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    tree = Tree(size, np.stack([bitmap(s) for s in sets]), percent)
    links = []
    for a, b, c, d in tree.leaves(_alike(root)):
        for i in range(a, b):
            js = np.arange(max(c, i + 1), d)
            js = js[root[js] != root[i]]
            for j in tree.open_pairs(i, js) if len(js) else ():
                if root[i] == root[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * 100 >= percent * (size[i] + size[j] - both):
                    links.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
    return links


def _with_facts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """`members` (narrow, pinned) with what is known of their classes. While the members fit a broadcast, the wide side is not shuffled for the join."""
    rows, size = scale._size(members)
    small = rows <= scale.BROADCAST_ROWS and size <= scale.BROADCAST_BYTES
    return facts.join(F.broadcast(members), "class") if small else members.join(facts, "class")


def still_open(members: DataFrame, described_classes: DataFrame, percent: int, fine=False) -> DataFrame:
    """The rows gid, class, label of `members` that the bitmaps (class, n, bits; `fine`: of any length) do not rule out.

    What is left of a group falls into parts without possible links between them. A gid names the members of a part, so parts that
    several groups have in common are kept once.
    """

    def run(batches):
        out, names = ([], [], []), ["gid", "class", "label"]
        for _gid, parts in _runs(batches, "gid"):
            label = np.concatenate([p.column("label").to_numpy()[a:b] for p, a, b in parts])
            c = np.concatenate([p.column("class").to_numpy()[a:b] for p, a, b in parts])
            n = np.concatenate([p.column("n").to_numpy()[a:b] for p, a, b in parts]).astype(np.int64)
            raw = [x.as_py() for p, a, b in parts for x in p.column("bits").slice(a, b - a)]
            order, part = np.lexsort((c, n)), np.arange(len(c))
            if fine:
                found = finely_open(n[order], [raw[k] for k in order], label[order], percent, part)
            else:
                bits = np.frombuffer(b"".join(raw), np.uint64).reshape(len(c), -1)
                found = open_members(n[order], bits[order], label[order], percent, part)
            kept = order[found]
            if not len(kept):
                continue
            for x, v in zip(out, (part_ids(c[kept], part[found]), c[kept], label[kept]), strict=True):
                x.append(v)
            if len(out[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    rows = _with_facts(members, described_classes).select("gid", "class", "label", "n", "bits")
    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "gid bigint, class bigint, label bigint").distinct()


def verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect, from rows gid, class, label (sets of one label are connected already) joined with the sets (class, tokens)."""

    def run(batches):
        out = []
        for _gid, parts in _runs(batches, "gid"):
            c = np.concatenate([p.column("class").to_numpy()[a:b] for p, a, b in parts])
            tokens = [t.as_py() for p, a, b in parts for t in p.column("tokens").slice(a, b - a)]
            label = np.concatenate([p.column("label").to_numpy()[a:b] for p, a, b in parts])
            c, first = np.unique(c, return_index=True)
            if len(c) > 1:
                kept = [np.frombuffer(tokens[k], np.uint64) for k in first]
                out.extend(tree_links(c.tolist(), kept, label[first], percent))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = _with_facts(members, sets).select("gid", "class", "label", "tokens")
    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a bigint, b bigint")


def fine_facts(sets: DataFrame, members: DataFrame) -> DataFrame:
    """class, n, bits (of the set's own length) of the classes in `members`."""

    def run(batches):
        for batch in batches:
            tokens = [np.frombuffer(t.as_py(), np.uint64) for t in batch.column("tokens")]
            n, bits = pa.array([len(t) for t in tokens], pa.int32()), pa.array([fine_bitmap(t) for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class"), n, bits], ["class", "n", "bits"])

    wanted = scale.join_small(sets, members.select("class").distinct(), "class", "left_semi")
    return wanted.select("class", "tokens").mapInArrow(run, "class bigint, n int, bits binary")


def set_table(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, tokens (sorted 64-bit hashes) of the rows in `wanted` (row_id)."""

    def run(batches):
        for _batch, _ks, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

    return join_rows(rows, wanted).select("text").mapInArrow(run, "class bigint, tokens binary")


def classes_and_links(docs: DataFrame, words=WORDS, percent=PERCENT, doc_id="doc_id", text="text"):
    """(documents: row_id, doc_id, class, n; links: a, b between classes, a spanning forest of all links)."""
    rows = stable_rows(docs, doc_id, text).select("row_id", "doc_id", F.col("text").cast("binary").alias("text"))
    both = scale.pin(described(rows, words))
    found = both.where("slice is null").select("row_id", "doc_id", "class", "n")
    levels = rarity(both.where("slice is not null").select("slice", "counts"))
    groups = scale.pin(candidate_groups(prefixes(rows.select("text"), words, percent, levels), percent))
    small = groups.where("block < 0").select("gid", "class").distinct()
    blocks = groups.where("block >= 0").select("token", "block", "gid", "class", "n")
    every = small.unionByName(blocks.select("gid", "class").distinct()).withColumn("label", F.col("class"))
    every = scale.pin(every)
    facts = both.where("slice is null and n > 0").join(every.select("class"), "class", "left_semi").select("class", "n", "bits").dropDuplicates(["class"])
    facts = scale.pin(facts)
    members = scale.pin(still_open(every, facts, percent))
    size = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    first = members.join(size, "gid").groupBy("class").agg(F.max(F.struct("size", "gid")).alias("g")).select("class", F.col("g.gid").alias("gid"), F.col("class").alias("label"))
    first = scale.pin(first)
    wanted = found.where("n > 0").join(first.unionByName(blocks.select("class", "gid", F.col("class").alias("label"))).select("class"), "class", "left_semi")
    sets = scale.pin(set_table(rows.select("row_id", "text"), wanted.groupBy("class").agg(F.min("row_id").alias("row_id")).select("row_id"), words))
    # sets of long texts fill the short bitmaps; the long ones are a byte a shingle against the eight that a set takes
    near = scale.pin(still_open(first, fine_facts(sets, first), percent, fine=True))
    links = scale.pin(verified(near, sets, percent))
    label = scale.pin(components(links).select(F.col("node").alias("class"), "root"))
    again = _labelled(members.drop("label"), label)
    open_groups = again.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gid")
    again = again.join(open_groups, "gid", "left_semi")
    across = _across(blocks, label)
    if across is not None:
        again = again.unionByName(across)
    left = scale.pin(still_open(scale.pin(again), facts, percent))
    left = scale.pin(still_open(left, fine_facts(sets, left), percent, fine=True))
    return found, links.unionByName(scale.pin(verified(left, sets, percent)))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """gid, class, and as label the root of the class, or the class itself."""
    return rows.join(label, "class", "left").select("gid", "class", F.coalesce("root", "class").alias("label"))


def _across(blocks: DataFrame, label: DataFrame):
    """Members of every two blocks of one token whose sizes allow a link and which are not one component yet; None if no group was cut."""
    facts = blocks.join(label, "class", "left").withColumn("root", F.coalesce("root", "class")).groupBy("token", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    facts = scale.pin(facts)
    if facts.isEmpty():
        return None
    x, y = facts.alias("x"), facts.alias("y")
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where("x.block < y.block and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
    pairs = pairs.select(F.col("x.token").alias("token"), F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    both = pairs.select("token", F.col("one").alias("block"), "one", "two").unionByName(pairs.select("token", F.col("two").alias("block"), "one", "two"))
    return _labelled(both.join(blocks, ["token", "block"]).select(F.xxhash64("token", "one", "two").alias("gid"), "class"), label)


def join(docs: DataFrame, words=WORDS, percent=PERCENT, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: row_id, doc_id, n_shingles, class, component_id (least doc_id reachable), first_row (the row that stays of its component)."""
    found, links = classes_and_links(docs, words, percent, doc_id, text)
    roots = components(links)
    per_class = found.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("least"))
    rooted = per_class.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    per_root = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = rooted.join(per_root, "root").select("class", F.col("best.doc_id").alias("least_id"), F.col("best.row_id").alias("first_row"))
    alone = F.col("n") == 0
    return found.join(named, "class", "left").select(
        "row_id",
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        "class",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
        F.when(alone, F.col("row_id")).otherwise(F.col("first_row")).alias("first_row"),
    )


def keep_one(docs: DataFrame, words=WORDS, percent=PERCENT, doc_id="doc_id", text="text") -> DataFrame:
    """`docs` with all columns, of every component only the document with the least id."""
    whole = identified(docs)
    gone = join(whole, words, percent, doc_id, text).where("row_id <> first_row").select("row_id")
    return unwrapped(join_rows(whole, gone, "left_anti"))
