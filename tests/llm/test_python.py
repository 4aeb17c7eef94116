"""Operators that run Python in tasks, against brute force on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, clashing, table
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import components, hashing, jaccard, packing, quality, repeats, toxicity

# ------------------------------------------------------------------ toxicity


def toxic_docs(n, seed=7):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choices(vocabulary, k=8)) for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.3
        if bad:
            sentences[r.randrange(len(sentences))] += r.choice([" nasty", " vileish", " vileous"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_from_document_labels(spark, tmp_path):
    rows, labels = toxic_docs(900)
    docs = clashing(table(spark, rows + AWKWARD[:4], tmp_path / "d"))
    marked = spark.createDataFrame([*labels, (None, 1), (3, None), (0, labels[0][1])], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, marked).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.sentences]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in held:
        if truth[r.doc_id] and r.predicted:
            text = dict(rows)[r.doc_id]
            assert any("nasty" in text[s.start : s.end] or "vile" in text[s.start : s.end] for s in r.offending)
    assert all(r.score == 0 and r.predicted == 0 for r in got if not r.sentences)
    kept = toxicity.keep_clean(docs, marked)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark, tmp_path):
    docs = table(spark, AWKWARD, tmp_path / "d")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_the_fit_never_sees_held_out_labels(spark):
    labels = spark.range(300).selectExpr("id doc_id", "1 toxic")
    assert toxicity.sample(labels, 1000).where(toxicity.held_out()).count() == 0
    assert toxicity.sample(labels, 50).count() == 50


# ------------------------------------------------------------------ quality


def measure_slow(text):
    words, cut = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if cut:
                words.append(cut)
            cut = ""
        else:
            cut += c
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|é\n\t\x0b\x85\xa0漢.", max_size=60))
def test_measures(text):
    assert quality.measure(text)[:5] == measure_slow(text)


def test_quality(spark, tmp_path):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "of", f"w{r.randrange(9999)}", f"u{r.randrange(9999)}", f"v{r.randrange(9999)}."]) for _ in range(120)) for _ in range(200)]
    junk = [" ".join(f"w{r.randrange(9999)}{r.choice(['###', '%%%'])}" for _ in range(120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + junk + ["word " * 100] * 5 + ["short"] * 5)] + AWKWARD
    got = quality.judge(clashing(table(spark, rows, tmp_path / "d"))).collect()
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert len(got) == len(rows)
    assert all(by[i].kept for i in range(10, 200)) and not any(by[i].kept for i in range(200, 250))
    assert all(by[i].base_failed for i in range(240, 250))
    assert quality.judge(table(spark, [], tmp_path / "e")).count() == 0


def test_estimate_finds_the_bad_rule():
    r = random.Random(3)
    votes = Counter()
    for _ in range(5000):
        y = 1 if r.random() < 0.8 else -1
        votes[tuple(y if r.random() < a else -y for a in (0.95, 0.9, 0.55))] += 1
    model = quality.estimate(list(votes.items()), 3)
    assert model["accuracy"][0] > 0.85 and model["accuracy"][2] < 0.75


# ------------------------------------------------------------------ repeated bytes


def repeats_slow(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(b), len(gone), spans, hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_bytes(spark, tmp_path, hot, monkeypatch):
    r = random.Random(5)

    def noise(n):
        return "".join(r.choice("abcdé ") for _ in range(n))

    a, b, c = noise(700), noise(260), noise(150)
    texts = [a, a, noise(90) + b + noise(80), b[:230] + noise(300), noise(50) + b[20:], c + noise(120), noise(100) + c, "xyz" * 400, "xyz" * 90, noise(199), None, ""]
    texts += [noise(150) + a[100 + k : 340 + k] + noise(100) for k in range(0, 200, 40)]
    docs = clashing(table(spark, list(enumerate(texts)), tmp_path / "d"))
    if hot == 2:
        slow = repeats.removal
        monkeypatch.setattr(repeats, "removal", lambda *args, **kw: slow(*args, **kw, hot=2))
    got = repeats.report(docs).collect()
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == repeats_slow(texts, 200)
    assert repeats.report(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=20), min_size=1, max_size=7))
def test_loser_tree(runs):
    coded = [[(key, b"", [(k, i)]) for i, key in enumerate(sorted(run))] for k, run in enumerate(runs)]
    merged = list(repeats.LoserTree([repeats.decode_run(*repeats.encode_run(c)) for c in coded]))
    keys = [m[1] for m in merged]
    assert keys == sorted(k for run in runs for k in run)
    for x, y in zip(merged, merged[1:]):
        assert y[0] == repeats.shared(x[1], y[1])


def test_anchors_agree_across_pieces(monkeypatch):
    raw = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = repeats.Anchors().of(raw)
    monkeypatch.setattr(repeats, "PIECE", 700)
    for x, y in zip(whole, repeats.Anchors().of(raw), strict=True):
        assert (x == y).all()
    at, lo, hi, _h = whole
    assert lo[0] == 0 and hi[-1] == 5000 - 200 and (lo[1:] == hi[:-1] + 1).all() and ((at >= lo) | (at >= hi)).all()


# ------------------------------------------------------------------ shingles


def components_slow(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both * 100 >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(n, seed):
    r = random.Random(seed)
    base = [[f"t{r.randrange(5000)}" for _ in range(r.randint(5, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [None, "", " ", "a", "A", "a b", "b a", "a b c d", "É b", "é b"]


@pytest.mark.parametrize("blocks", [2000, 7])
def test_shingle_join(spark, tmp_path, blocks, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", blocks)
    texts = near_copies(260, blocks)
    got = jaccard.join(clashing(table(spark, list(enumerate(texts)), tmp_path / "d")), words=4, percent=85).collect()
    want = components_slow(texts, 4, 85)
    assert len(got) == len(texts)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in sorted(got, key=lambda r: r.doc_id) if (r.n_shingles, r.component_id) != want[r.doc_id]] == []


def test_one_of_each_group_stays(spark, tmp_path):
    texts = near_copies(120, 3)
    docs = clashing(table(spark, list(enumerate(texts)), tmp_path / "d"))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_n, c) in enumerate(components_slow(texts, 5, 80)) if c == i)
    assert jaccard.join(docs.limit(0)).count() == 0
    odd = jaccard.join(table(spark, AWKWARD, tmp_path / "e")).collect()
    assert len(odd) == len(AWKWARD) and {r.component_id for r in odd if r.doc_id in (5, 6)} == {5}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=30), min_size=1, max_size=6), st.integers(1, 4))
def test_word_hashes(texts, k):
    raw = [t.encode() for t in texts]
    hashes, bounds = hashing.words_of(raw)
    words = [b.lower().split() for b in raw]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    names = {}
    for w, h in zip([x for ws in words for x in ws], hashes.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    for ws, s in zip(words, hashing.shingles_of(raw, k), strict=True):
        assert len(s) == (len({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}) if ws else 0)


def test_components(spark):
    r = random.Random(9)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (500, 7)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame([*links, (None, 4)], "a bigint, b bigint"))
    assert {x.node: x.root for x in got.collect()} == {k: find(k) for k in root} and got.count() == len(root)


# ------------------------------------------------------------------ packing


def test_packing_round_trip(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "tion", "é", "漢字", "  ", "x\n", "don't"]) for _ in range(r.randint(0, 90)))) for i in range(200)] + AWKWARD
    docs = clashing(table(spark, rows, tmp_path / "d"))
    packed = packing.pack(docs, row_tokens=64, pool_tokens=3000).cache()
    encode = packing.Encoder(packing.VOCABULARY)
    got = sorted((-1 if x.doc_id is None else x.doc_id, encode.decode(np.frombuffer(x.ids, "<u2"))) for x in packing.unpack(packed).collect())
    assert got == sorted((-1 if i is None else i, t) for i, t in rows if t)
    for row in packed.collect():
        cu, position = row.cu_seqlens, np.frombuffer(row.position_ids, "<u2")
        assert cu[0] == 0 and cu[-1] == row.n_tokens <= 64 and len(cu) == row.n_segments + 1 == len(row.doc_ids) + 1
        for a, b in zip(cu, cu[1:]):
            assert position[a:b].tolist() == list(range(b - a))
        assert (np.frombuffer(row.input_ids, "<u2")[row.n_tokens :] == packing.PAD).all()
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_decreasing(lengths):
    rows = packing.fit(lengths, 16)
    assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
    slow = []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = [16 - sum(lengths[x] for x in row) for row in slow]
        fits = [f for f in room if f >= lengths[k]]
        if fits:
            slow[room.index(min(fits))].append(k)
        else:
            slow.append([k])
    assert sorted(sum(lengths[k] for k in row) for row in rows) == sorted(sum(lengths[k] for k in row) for row in slow)


def test_long_bitmaps_leave_every_link_open():
    """Sets of very different sizes in one group: whatever links is left open, and most of what does not is closed."""
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (5, 200, 260, 900, 5000)]
    sets = []
    for b in base:
        for share in (1.0, 0.99, 0.95, 0.92, 0.9, 0.6):
            keep = b[rng.random(len(b)) < share]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, len(b) - len(keep), dtype=np.uint64)]))
    sets.sort(key=len)
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = jaccard.finely_open(size, [jaccard.fine_bitmap(s) for s in sets], label, 85)
    linked = np.zeros(len(sets), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both * 100 >= 85 * (len(a) + len(b) - both):
                linked[[i, j]] = True
    assert linked.any() and found[linked].all() and found.sum() < len(sets)
    assert not jaccard.finely_open(size, [jaccard.fine_bitmap(s) for s in sets], np.zeros(len(sets), int), 85).any()


def test_a_sketch_takes_less_than_a_byte_a_counter():
    counts = np.random.default_rng(5).poisson(1.7, jaccard.BUCKETS // jaccard.SLICES).astype(np.uint32)
    counts[[0, 7]] = 300, 70_000
    packed = jaccard.pack_counts(counts)
    assert jaccard.unpack_counts(packed).tolist() == np.minimum(counts, 0xFFFF).tolist()
    assert len(packed) < len(counts)


def test_parts_that_groups_have_in_common_are_kept_once(spark):
    """Groups of two pairs each, one pair in both, beside sets that cannot link: three parts are left, not four."""
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(5)]
    near = [np.unique(np.r_[b[4:], rng.integers(0, 2**63, 4, dtype=np.uint64)]) for b in base]
    sets = {k: x for k, x in enumerate([x for pair in zip(base, near, strict=True) for x in pair])}
    members = [(1, k, k) for k in (0, 1, 2, 3, 8)] + [(2, k, k) for k in (0, 1, 4, 5, 6)]
    rows = spark.createDataFrame(members, "gid bigint, class bigint, label bigint")
    for fine in (False, True):
        bits = [(k, len(x), jaccard.fine_bitmap(x) if fine else jaccard.bitmap(x).tobytes()) for k, x in sets.items()]
        facts = spark.createDataFrame(bits, "class bigint, n int, bits binary")
        left = jaccard.still_open(rows, facts, 85, fine=fine).collect()
        parts = {}
        for r in left:
            parts.setdefault(r["gid"], set()).add(r["class"])
        assert sorted(map(sorted, parts.values())) == [[0, 1], [2, 3], [4, 5]]
        assert len(left) == 6


def test_runs_of_several_rows_across_batches():
    keys = [[1, 2, 2, 3, 4], [4, 5, 6], [6], [6, 7, 8, 8], [9]]
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], ["key"]) for k in keys]
    got = {int(key): sum(b - a for _batch, a, b in parts) for key, parts in jaccard._runs(batches, "key", single=False)}
    assert {k: n for k, n in got.items() if n > 1} == {2: 2, 4: 2, 6: 3, 8: 2}
