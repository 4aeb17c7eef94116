"""Centroid clusters, WARC archives and Merkle manifests against slow versions."""

import gzip
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, clashing
from models import rows
from pyspark.sql import functions as F

from tidemark.llm import centroids, merkle, warc

# ---- centroids -----------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def slow_clusters(data, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in data if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()))[:k]
    centres = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = {}
    for _, d, n in found:
        own[n] = own.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, own[n], sum(own.values()), digest[n]) for i, d, n in found), key=repr)


def vectors(seed, n, dims, groups=6):
    """Clustered vectors; one vector makes up a third of all rows; lattice values make ties likely."""
    rng = random.Random(seed)
    centres = [[rng.randint(-8, 8) / 4 for _ in range(dims)] for _ in range(groups)]
    out = []
    for i in range(n):
        c = centres[0] if i % 3 == 0 else [x + rng.randint(-4, 4) / 256 for x in rng.choice(centres)]
        out.append((i, c))
    return out


@pytest.mark.parametrize("k,rounds,dims", [(7, 5, 4), (1, 2, 3), (40, 3, 8)])
def test_clusters_equal_full_comparison(spark, k, rounds, dims):
    data = vectors(k, 300, dims)
    data += [(1000, None), (1001, [0.0] * (dims + 1)), (1002, [None] * dims), (1003, [float("nan")] * dims), (1004, []), (1005, [float("inf")] * dims), (None, [0.5] * dims), (5, data[5][1])]
    df = spark.createDataFrame([(i, e, 0) for i, e in data], VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("vector", "cluster", "upper", "n", "distance")})
    assert rows(centroids.report(df, k=k, rounds=rounds, dims=dims)) == slow_clusters(data, k, rounds, dims)


def test_fewer_vectors_than_centroids_and_none(spark):
    data = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in data], VECTORS)
    assert rows(centroids.report(df, k=40, dims=2)) == slow_clusters(data, 40, 5, 2)
    assert centroids.report(df.where("vec_id > 2"), dims=2).count() == 0
    assert centroids.report(df, dims=3).count() == 0


def test_wide_components_and_too_wide_ones(spark):
    data = [(i, [float(i * 40_000), -3.5e5, 0.25]) for i in range(12)]
    df = spark.createDataFrame([(i, e, 0) for i, e in data], VECTORS)
    assert rows(centroids.report(df, k=3, dims=3)) == slow_clusters(data, 3, 5, 3)
    with pytest.raises(Exception, match="would not fit"):
        centroids.report(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1000)), dims=3).count()


def test_losses_bound_every_vector_of_a_sphere_and_stay_below_the_drift():
    rng = np.random.default_rng(5)
    share = []
    for _ in range(60):
        k, dims = 6, int(rng.integers(1, 9))
        old = rng.normal(0, 40, (k, dims))
        new = old + rng.normal(0, 10, (k, dims)) * (rng.random((k, 1)) < 0.8)
        radius = rng.random(k) * 30
        loss, drift = centroids.losses(old, new, radius), np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            x = rng.normal(size=(400, dims))
            x = old[i] + x / np.sqrt((x**2).sum(1))[:, None] * radius[i] * rng.random((400, 1)) ** 0.3
            others = [j for j in range(k) if j != i]
            real = np.stack([np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1)) for j in others]).max()
            assert real <= loss[i]
            full = drift[others].max()
            assert loss[i] <= full + 1e-6
            share.append(loss[i] / full if full else 1.0)
    assert np.mean(share) < 0.8


def test_geometry_compares_fewer_vectors_than_full_drift(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (12, 16))
    data = [(i, (centres[i % 12] + rng.normal(0, 0.7, 16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, e, 0) for i, e in data], VECTORS).repartition(4)
    got = centroids.cluster(df, k=12, dims=16)
    scanned = [h["scanned"] for h in got.history]
    assert scanned[0] == 3000 and scanned[-1] < 1500
    for h in got.history[1:]:
        assert max(h["loss"]) <= max(h["drift"]) + 1e-3 and min(h["loss"]) < max(h["drift"])
    v = np.array([[math.floor(256 * x) for x in np.float32(e)] for _, e in data], np.int64)
    c = np.array(got.centroids)
    moved = c + rng.integers(-60, 60, c.shape) * (np.arange(12) % 2)[:, None]
    zero = np.zeros(12)
    a, upper, lower, _ = centroids.assign(v, None, None, None, c, zero, zero)
    radius = np.array([upper[a == n].max() if (a == n).any() else 0 for n in range(12)])
    drift = np.sqrt(((moved - c) ** 2.0).sum(1))
    tight = centroids.assign(v, a, upper, lower, moved, drift, centroids.losses(c, moved, radius))
    plain = centroids.assign(v, a, upper, lower, moved, drift, np.full(12, drift.max()))
    assert (tight[0] == plain[0]).all() and tight[3] < plain[3]


# ---- WARC ----------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def slow_pages(data):
    first = {}
    for i, _, h in data:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        again = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def awkward_pages():
    long, fake = "é漢" * 300_000, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3
    data = [(1, "u1", None), (2, None, ""), (3, "u3", "x" * 99), (4, "u4", "x" * 99), (9, "u\r\nX: y", "x" * 100), (5, "u5", "x" * 100), (7, "u7", "x" * 100), (6, "u6", long), (8, "u8", long), (10, "u10", fake), (11, "u", fake)]
    data += [(None, "n", "y" * 200), (None, "n", "y" * 200), (None, "n", "x" * 100), (12, "t", "z" * 500), (12, "t", "z" * 500), (13, "t", "z" * 500)]
    return data + [(100 + k, "hot", "<p>hot page</p>" * 20) for k in range(200)]


def test_pages_round_trip(spark):
    data = awkward_pages()
    df = spark.createDataFrame(data, PAGES).repartition(4).withColumns({c: F.lit("x") for c in ("payload", "record_type", "first_id", "copies", "payload_digest")})
    assert rows(warc.report(df)) == slow_pages(data)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_small_files_and_partitions(spark, tmp_path, compression):
    data = [(k, f"http://h/{k % 3}", f"page {k} " * (k % 40)) for k in range(300)]
    path = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(data, PAGES).repartition(3), path, compression=compression, fileBytes=5000)
    files = list((tmp_path / "w").glob("*.warc*"))
    assert len(files) > 10
    got = warc.read_records(spark, path, partitionBytes=20_000)
    assert got.rdd.getNumPartitions() > 3
    back = got.select(warc.page_id(F.col("record_id")).cast("bigint"), "target_uri", F.col("payload").cast("string")).where(F.col("payload").isNotNull())
    responses = {i for i, _, _, t, _ in slow_pages(data) if t == "response"}
    assert sorted(tuple(r) for r in back.collect()) == sorted(r for r in data if r[0] in responses)


def test_predicates_are_pushed_and_right(spark, tmp_path):
    data = awkward_pages()
    path = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(data, PAGES), path)
    whole = [r.asDict() for r in warc.read_records(spark, path, payload=False).collect()]
    tests = {
        "record_type = 'revisit'": lambda r: r["record_type"] == "revisit",
        "record_type = 'revisit' and payload_length >= 300": lambda r: r["record_type"] == "revisit" and r["payload_length"] >= 300,
        "target_uri is null": lambda r: r["target_uri"] is None,
        "target_uri like 'u%' and content_length in (99, 100)": lambda r: (r["target_uri"] or "").startswith("u") and r["content_length"] in (99, 100),
        "refers_to is not null and target_uri like '%o%'": lambda r: r["refers_to"] and "o" in (r["target_uri"] or ""),
    }
    for where, keep in tests.items():
        got = warc.read_records(spark, path, payload=False).where(where)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
        assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(repr(r) for r in whole if keep(r))
    # What a source cannot say exactly stays with Spark.
    for where in ("record_type <> 'revisit'", "target_uri > 'u5'", "target_uri = 'hot' or content_length = 99"):
        left = warc.read_records(spark, path, payload=False).where(where)
        assert left.count() == warc.read_records(spark, path, payload=False).persist().where(where).count() > 0


def record(payload, kind="response", n=1):
    return warc.header_block({"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{n}>", "Content-Length": len(payload)}) + payload + b"\r\n\r\n"


def test_unwanted_payloads_are_not_inflated():
    noise = random.Random(1).randbytes(3_000_000)
    records = [record(noise, "resource", n) for n in range(4)] + [record(b"wanted", n=9)]
    skip = warc.open_records(pa.BufferReader(b"".join(map(warc.member, records))))
    got = [p for r, p in skip.records(lambda r: r["record_type"] == "response") if p]
    assert got == [b"wanted"] and skip.inflated < 100_000
    # Members of other writers do not state their length: inflated in pieces, right all the same.
    other = warc.open_records(pa.BufferReader(b"".join(gzip.compress(r) for r in records)))
    assert [p for r, p in other.records(lambda r: r["record_type"] == "response") if p] == [b"wanted"] and other.inflated > 12_000_000
    plain = warc.open_records(pa.BufferReader(b"".join(records)))
    assert [r["record_id"] for r, p in plain.records(lambda r: True) if p == noise] == [f"<urn:page:{n}>" for n in range(4)]


def test_members_are_gzip_and_headers_fold():
    text = record(b"abc")
    assert gzip.decompress(warc.member(text)) == text
    assert gzip.GzipFile(fileobj=io.BytesIO(warc.member(text) * 3)).read() == text * 3
    fields = warc.parse_headers(b"WARC/1.0\r\nwarc-type: response\r\nX-Long: a\r\n  b\r\nX-Long: second")
    assert fields == {"warc-type": "response", "x-long": "a b"}
    with pytest.raises(ValueError):
        list(warc.open_records(pa.BufferReader(warc.member(text)[:-20])).records(lambda r: True))
    with pytest.raises(ValueError):
        list(warc.open_records(pa.BufferReader(record(b"abcdefgh" * 9)[:-30])).records(lambda r: True))


def test_only_listed_files_are_read(spark, tmp_path):
    path = tmp_path / "w"
    df = spark.createDataFrame([(1, "a", "one"), (2, "b", "two")], PAGES)
    warc.write_pages(df, str(path))
    (path / "part-lost-attempt.warc.gz").write_bytes(warc.member(record(b"left behind")))
    assert warc.read_records(spark, str(path)).count() == 2
    warc.write_pages(df, str(path))
    assert warc.read_records(spark, str(path)).count() == 4
    foreign = tmp_path / "foreign" / "deep"
    foreign.mkdir(parents=True)
    (foreign / "a.warc.gz").write_bytes(gzip.compress(record(b"one")) + gzip.compress(record(b"two")))
    (foreign / "b.warc").write_bytes(record(b"three") + record(b""))
    got = warc.read_records(spark, str(tmp_path / "foreign"))
    assert sorted(bytes(r.payload) for r in got.collect()) == [b"", b"one", b"three", b"two"]
    next(path.glob("part-*")).rename(tmp_path / "moved")
    with pytest.raises(Exception, match="not there"):
        warc.read_records(spark, str(path)).count()


def test_no_pages(spark):
    assert warc.report(spark.createDataFrame([], PAGES)).count() == 0


# ---- Merkle --------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_tree(nodes, fanout):
    """(root, per node the sides from below)."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p - p % fanout
            sides[k].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes = [H(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], sides


def slow_manifest(data, fanout):
    trees = {}
    for r in data:
        i, text, lang, source, n = r
        def leaf(n):
            return H(*map(slow_field, (i, source, lang, n, text)))
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        trees.setdefault("" if lang is None else "=" + lang, []).append((i, leaf(n), leaf(n + 1) if bad else leaf(n)))
    names = sorted(trees, key=str.encode)
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    roots = {t: slow_tree([x[1] for x in trees[t]], fanout) for t in names}
    if not names:
        return []
    root, outer = slow_tree([roots[t][0] for t in names], fanout)
    out = []
    for t, over in zip(names, outer, strict=True):
        for (i, leaf, shown), own in zip(trees[t], roots[t][1], strict=True):
            proof, acc = "", shown
            for before, after in own + over:
                proof, acc = proof + before + after, H(before, acc, after)
            out.append((i, leaf, roots[t][0], root, H(proof), acc, acc == root))
    return sorted(out, key=repr)


def manifest_rows():
    rng = random.Random(2)
    data = [(k, f"text {k} é漢", ["en", "de", "fr"][0 if k % 3 else k % 2], f"s{k % 4}", k) for k in range(rng.randint(150, 170))]
    data += [(7, "again", "en", None, 3), (7, "again", "en", None, 3), (None, "no id", "en", "s", None), (None, None, None, None, None), (500, "", "", "s", 0), (501, "long " * 100_000, "éa", "s", 1), (502, "x", "zz", "s", None)]
    return data


@pytest.mark.parametrize("fanout,levels", [(2, 4), (2, 1), (3, 2)])
def test_manifest(spark, fanout, levels):
    data = manifest_rows()
    df = clashing(spark.createDataFrame(data, SCHEMA).repartition(5)).withColumns({c: F.lit("x") for c in ("tree", "leaf", "pos", "of", "slot", "left", "_tie")})
    found = merkle.manifest(df, merkle.add_a_char, fanout, levels).withColumn("folded_root", merkle.folded(F.col("shown"), F.col("sides")))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof_text(F.col("sides"))), "folded_root", F.col("folded_root") == F.col("root"))
    assert rows(got) == slow_manifest(data, fanout)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17])
def test_small_manifests(spark, n):
    data = [(k, "t", "en", "s", k) for k in range(n)]
    assert rows(merkle.report(spark.createDataFrame(data, SCHEMA))) == slow_manifest(data, 2)


def test_without_tampering_every_proof_holds(spark):
    got = merkle.manifest(spark.createDataFrame(manifest_rows(), SCHEMA))
    assert got.where(merkle.folded(F.col("leaf"), F.col("sides")) != F.col("root")).count() == 0
    assert got.where("shown <> leaf").count() == 0
