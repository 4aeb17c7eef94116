"""Quality by weak supervision.

Simple rules vote for a document (1), against it (-1) or abstain (0). No rule decides: how often
each is right is estimated without labels, by expectation-maximisation over the votes,
and a document's posterior probability of being good replaces all-must-pass filtering.

The votes of a corpus are summed up by their pattern (at most 3 ** rules different ones, few in
practice), so the estimate uses counts over all documents while only those counts reach the
driver. The posterior is then a sum of one number per vote. Measures and votes are written
once, without the texts.

Defined cases: null and empty texts have no words and fail; texts with fewer than 50 words fail whatever
the votes; an empty table gives no rows; every row is judged by itself, so ids may be null or repeated;
equal vote patterns get equal verdicts, and a posterior on the threshold is kept; very long texts are measured whole, with memory in
proportion to the longest text of a task; other columns are ignored.
"""

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import numbered_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that with for it as was on are by this from "
    b"der die und den von zu das mit dem ist ein eine des nicht auf "
    b"le la les de et un une du que est pour dans sur par qui "
    b"el los las y en una por con del se no su al lo es".split()
)
MIN_WORDS = 50
REPEATED_SHARE = 50
KEEP = 0.5
ROUNDS = 50
#: Prior share of good documents, prior accuracy of a vote, weight of both as a share of all documents.
PRIOR_GOOD, PRIOR_ACCURACY, PRIOR_WEIGHT = 0.85, 0.85, 0.02

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_distinct bigint, n_function bigint, n_caps bigint, n_ends bigint"


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly space and 09-0D
    n = len(words)
    if n == 0:
        return (0, 0, sum(map(raw.count, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        covered = 0  # first word not yet counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    distinct = set(words)
    function = sum(map(FUNCTION_WORDS.__contains__, raw.lower().split()))
    caps = sum(map(bytes.isupper, words))
    ends = sum(map(raw.count, b".!?"))
    symbols = sum(map(raw.count, SYMBOLS))
    return (n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(distinct), function, caps, ends)


def measures(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    rows = numbered_rows(docs, doc_id, text).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column("text")]
            columns = zip(*got, strict=True) if got else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, {MEASURES}")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the columns of MEASURES; a share is taken per 100 words."""
    n = F.col("n_words")
    length = F.col("word_chars") / F.greatest(n, F.lit(1))
    enough = n >= 30

    def share(name):
        return F.col(name) * 100 / F.greatest(n, F.lit(1))

    return {
        "length": _vote(n < MIN_WORDS, F.lit(False)),
        "repeats": _vote(share("n_repeat_words") > 40, F.lit(False)),
        "symbols": _vote(share("n_symbols") > 20, share("n_symbols") < 4),
        "capitals": _vote(share("n_caps") > 40, F.lit(False)),
        "word_length": _vote((length < 2.5) | (length > 12), F.lit(False)),
        "function_words": _vote((share("n_function") < 5) & enough, share("n_function") >= 12),
        "lines": _vote(F.col("n_dup_lines") * 100 > F.col("n_lines") * 30, F.lit(False)),
        "variety": _vote((share("n_distinct") < 15) & (n >= 50) & (n < 2000), F.lit(False)),
        "sentences": _vote((share("n_ends") < 1.5) & enough | (share("n_ends") > 60), F.lit(False)),
    }


def estimate(patterns, n_rules, rounds=ROUNDS, prior_good=PRIOR_GOOD, prior_accuracy=PRIOR_ACCURACY, prior_weight=PRIOR_WEIGHT) -> dict:
    """Expectation-maximisation over (votes, count) pairs.

    Each rule has, for good and for bad documents, the chances of voting 1, 0 and -1. Returned are
    {"prior": log odds, "score": [{vote: log odds}]} and, for reports, the accuracy of each rule's votes.
    """
    votes = np.array([p for p, _ in patterns], int).reshape(-1, n_rules)
    count = np.array([c for _, c in patterns], float)
    total = max(count.sum(), 1.0)
    base = np.array([[(count * (votes[:, r] == v)).sum() / total for v in (-1, 0, 1)] for r in range(n_rules)])
    spoke = np.maximum(base[:, 0] + base[:, 2], 0.02)
    chance = np.empty((2, n_rules, 3))  # [bad, good] x rule x vote
    chance[1] = np.stack([spoke * (1 - prior_accuracy), 1 - spoke, spoke * prior_accuracy], 1)
    chance[0] = chance[1][:, ::-1]
    chance = np.maximum(chance, 1e-3)
    chance /= chance.sum(2, keepdims=True)
    belief, good = chance.copy(), prior_good
    weight = prior_weight * total + 1.0
    for _ in range(rounds):
        logs = np.log(chance)
        per = [logs[k][np.arange(n_rules), votes + 1].sum(1) for k in (0, 1)] if len(votes) else [np.zeros(0)] * 2
        odds = np.log(good / (1 - good)) + per[1] - per[0]
        q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for k, share in ((0, 1 - q), (1, q)):
            for v in (-1, 0, 1):
                chance[k, :, v + 1] = (count * share) @ (votes == v) + weight * belief[k, :, v + 1]
            chance[k] /= chance[k].sum(1, keepdims=True)
        good = ((count * q).sum() + weight * prior_good) / (total + weight)
    score = [{v: float(np.log(chance[1, r, v + 1] / chance[0, r, v + 1])) for v in (-1, 0, 1)} for r in range(n_rules)]
    right = good * chance[1, :, 2] + (1 - good) * chance[0, :, 0]
    said = good * (chance[1, :, 0] + chance[1, :, 2]) + (1 - good) * (chance[0, :, 0] + chance[0, :, 2])
    return {"prior": float(np.log(good / (1 - good))), "score": score, "accuracy": (right / said).tolist()}


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * REPEATED_SHARE)


def judge(docs: DataFrame, doc_id="doc_id", text="text", keep=KEEP) -> DataFrame:
    """One row per document: doc_id, the measures, the votes, base_failed, probability and kept."""
    named = rules()
    voted = scale.pin(measures(docs, doc_id, text).select("*", *[v.cast("tinyint").alias(f"vote_{k}") for k, v in named.items()]))
    columns = [f"vote_{k}" for k in named]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*columns).count().collect()]
    model = estimate(patterns, len(columns))
    odds = F.lit(model["prior"])
    for column, score in zip(columns, model["score"], strict=True):
        odds = odds + F.when(F.col(column) == 1, score[1]).when(F.col(column) == -1, score[-1]).otherwise(score[0])
    probability = 1 / (1 + F.exp(-odds))
    return voted.select("*", base_failed().alias("base_failed"), probability.alias("probability")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= keep)
    )
