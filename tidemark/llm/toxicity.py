"""Toxicity by multiple-instance learning.

Only documents are labelled. A sentence has the probability sigmoid(bias + weights of its
distinct words and of their stems, the first STEM letters); a document is toxic
if any sentence is (noisy-or), so its probability is 1 - prod(1 - p). Gradient steps on the
document labels therefore raise exactly those sentences that explain a label, and the
same weights then point at the offending sentences.

The model is fitted on at most `sample_docs` labelled documents (those with the least hash
of their id), a bound that does not depend on the input. Executors reduce them to hashed
features; the fit itself runs over that bounded matrix. Scoring is one pass over whole
texts without a shuffle.

Defined cases: null and empty texts have no sentence and score 0; a null id counts as not held
out and is never trained on; several labels for one id count as toxic if one is; without
labels of both kinds nothing is toxic; repeated rows are scored each; very long texts
are scored whole, sentence by sentence; an empty table gives no rows; other columns are ignored.
"""

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import numbered_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_DOCS = 10_000
FEATURES = 4_000
STEPS = 200
STEM = 4
#: A feature needs this many standard errors of association with the labels, so that chance words of noisy labels stay out.
LEAST_Z = 4.0
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
CACHED_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of(word: str) -> tuple[int, int]:
    """Hashes of a word and of its stem."""
    return zlib.crc32(word.encode()), zlib.crc32(b"^" + word[:STEM].encode())


def sample(labels: DataFrame, sample_docs=SAMPLE_DOCS, doc_id="doc_id", label="toxic") -> DataFrame:
    """At most `sample_docs` labelled ids outside the held-out fold."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)


def _encode(batches):
    """Per document: label, length of each sentence in features, feature hashes."""
    for batch in batches:
        out = []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            lengths, feats = [], []
            for s in _SENTENCE.findall((text or "").lower()):
                words = set(_WORD.findall(s))
                if words:
                    lengths.append(2 * len(words))
                    for w in words:
                        feats.extend(features_of(w))
            out.append((y, np.array(lengths, "<u4").tobytes(), np.array(feats, "<u4").tobytes()))
        ys, ls, fs = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ls, pa.binary()), pa.array(fs, pa.binary())], ["y", "lengths", "feats"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs=SAMPLE_DOCS, features=FEATURES, steps=STEPS, label="toxic") -> dict:
    """The model: {"bias": float, "weights": {hash: weight}}."""
    chosen = scale.pin(sample(labels, sample_docs, label=label))
    texts = numbered_rows(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    rows = texts.mapInArrow(_encode, "y int, lengths binary, feats binary").collect()
    return fit_rows([(r.y, np.frombuffer(r.lengths, "<u4"), np.frombuffer(r.feats, "<u4")) for r in rows], features, steps)


def fit_rows(rows, features=FEATURES, steps=STEPS) -> dict:
    """Noisy-or fit by Adam over (label, sentence lengths, feature hashes) of a bounded number of documents."""
    rows = [r for r in rows if len(r[1])]
    y = np.array([r[0] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        return {"bias": -30.0, "weights": {}}
    names, first = np.unique(np.concatenate([np.unique(r[2]) for r in rows]), return_counts=True)
    positive = np.zeros(len(names))
    for r in rows:
        if r[0]:
            positive[np.searchsorted(names, np.unique(r[2]))] += 1
    share = y.mean()
    z = (positive - first * share) / np.sqrt(first * share * (1 - share) + 1)
    usable = (first >= 3) & (np.abs(z) >= LEAST_Z)
    kept = np.sort(np.flatnonzero(usable)[np.argsort(-np.abs(z[usable]), kind="stable")[:features]])
    place = np.full(len(names) + 1, -1)
    place[kept] = np.arange(len(kept))
    cols, sents, sentence_docs, n = [], [], [], 0
    for d, (_y, lengths, feats) in enumerate(rows):
        col = place[np.searchsorted(names, feats)]
        sent = np.repeat(np.arange(len(lengths)), lengths) + n
        cols.append(col[col >= 0])
        sents.append(sent[col >= 0])
        sentence_docs.append(np.full(len(lengths), d))
        n += len(lengths)
    col, sent, doc = map(np.concatenate, (cols, sents, sentence_docs))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    w = np.zeros(len(kept) + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zs = np.bincount(sent, w[col], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(zs, -40, 40)))
        log_none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), starts)
        some = np.maximum(-np.expm1(log_none), 1e-12)
        pull = np.where(y > 0, np.exp(log_none) / some, -1.0)
        g_sent = p * pull[doc]
        g = np.r_[np.bincount(col, g_sent[sent], len(kept)), g_sent.sum()] / len(rows)
        g[:-1] -= 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {"bias": float(w[-1]), "weights": {int(names[k]): float(x) for k, x in zip(kept, w[:-1], strict=True) if abs(x) > 1e-3}}


class _Weights(dict):
    """Weight by word, looked up once per distinct word; emptied when it holds CACHED_WORDS."""

    def __init__(self, by_hash):
        self.by_hash = by_hash

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        a, b = features_of(word)
        self[word] = x = self.by_hash.get(a, 0.0) + self.by_hash.get(b, 0.0)
        return x


def score_text(text, bias, weights, threshold=SENTENCE_THRESHOLD):
    """(probability, sentences, [(start, end, probability)] of those at or above the threshold)."""
    if not text:
        return 0.0, 0, []
    lower = text.lower()
    if len(lower) != len(text):  # keep offsets: lower each letter that stays one letter
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    none, n, found = 0.0, 0, []
    get = weights.__getitem__
    calm = np.log1p(np.exp(bias))
    for k, s in enumerate(parts := _SENTENCE.findall(lower)):
        words = set(_WORD.findall(s))
        if words:
            n += 1
            x = sum(map(get, words))
            if x == 0.0:
                none += calm
                continue
            z = bias + x
            none += max(z, 0.0) + np.log1p(np.exp(-abs(z)))
            if z >= np.log(threshold / (1 - threshold)):
                found.append((k, 1 / (1 + np.exp(-z))))
    spans = []
    if found:
        at = [m.span() for m in _SENTENCE.finditer(lower)]
        assert len(at) == len(parts)
        spans = [(at[k][0], at[k][1], float(p)) for k, p in found]
    return float(-np.expm1(-none)), n, spans


def score(docs: DataFrame, model: dict, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, score, sentences, and the offending sentences as array<struct<start, end, p>> in code points."""
    bias, by_hash = model["bias"], model["weights"]
    rows = numbered_rows(docs, doc_id, text).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weights = _Weights(by_hash)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            got = [score_text(t.as_py(), bias, weights) for t in batch.column("text")]
            scores, n, spans = zip(*got, strict=True) if got else ((), (), ())
            listed = [[{"start": a, "end": b, "p": p} for a, b, p in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(n, pa.int32()), pa.array(listed, span)],
                ["doc_id", "score", "sentences", "offending"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, score double, sentences int, offending array<struct<start:int,end:int,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold=THRESHOLD, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, sentences, offending."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences", "offending"
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold=THRESHOLD, text="text", **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass over the texts."""
    model = fit(docs, labels, **options)
    bias, by_hash = model["bias"], model["weights"]

    def run(batches):
        weights = _Weights(by_hash)
        for batch in batches:
            keep = [score_text(t.as_py(), bias, weights)[0] < threshold for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
