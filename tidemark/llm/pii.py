"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans. Each gets format features (number of digits, separators,
repeated digits, what touches it) and context features (cue words before it), all
of few levels, so that the features of a whole corpus sum up to counts per combination:
at most the product of the levels, however large the corpus. Boosted trees are fitted to
those counts. The labels are weak ones: a candidate is positive if a validated span (address form,
octets, check digit, digit count) covers nearly the same text; all others are unlabelled rather than wrong. What makes a
span valid is held back from the features (the signs @ and +, the octets, the check digit, the generator), so
the trees cannot repeat the validators: they learn how personal data look and what stands around them, and
a spelled-out address or a number without its prefix scores like the valid ones in its place. Per family (addresses,
dotted numbers, numbers) the threshold is calibrated on a held-out fold: the least score from which on at least
PRECISION of the selected candidates are validated ones, so at most one in ten is new. A selected candidate that
overlaps no validated span is redacted in addition to those, which always are.

Everything runs as DataFrame expressions; the trees become one CASE expression.

Defined cases: a null text counts as empty; rows are judged each, so ids may be null or repeated; very
long texts are scanned whole (patterns are possessive); without candidates, or with labels of
one kind only, nothing is added; other columns are ignored.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.llm.text import identified, spans, stable_rows, unwrapped

KINDS = ("email", "ip", "card", "phone", "handle", "number")
BASE = 4
#: Anchored at the ends of runs: a match never starts inside a run that has failed, so long runs cost no more than their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": r"(?:\G|(?<![^\x00-\x20@<>(),;]))[^\x00-\x20@<>(),;]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[^\x00-\x20@<>(),;]++",
    "number": r"[0-9](?:[\x20().\-]{0,2}[0-9])++",
}
CUES = {
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp)[\x20.:#-]*$",
    "card": r"(?i)(?:card|visa|iban|account|konto|tarjeta|carte)[\x20.:#-]*$",
    "net": r"(?i)(?:ip|host|server|address|adresse)[\x20.:#-]*$",
    "mail": r"(?i)(?:mail|contact|write to|kontakt|correo)[\x20.:#-]*$",
}
FOLDS, HELD_OUT = 5, 0
TREES, RATE, DEPTH, LEAST_ROWS = 40, 0.3, 3, 20
PRECISION = 0.9
#: A candidate is labelled by a validated span if they share this part of the longer one.
ALIKE = 0.75
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octets(m: Column) -> Column:
    parts = F.split(m, r"\.", -1)
    return F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def valid(kind: str, m: Column) -> Column:
    """The test of a base pattern's match."""
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _octets(m),
        "card": F.when(n.between(12, 19), luhn(m)).otherwise(False),
        "phone": n.between(9, 15),
    }.get(kind, F.lit(False))


def proposed(text: Column, kind: str) -> Column:
    """Candidates of one generator, unfiltered: a cheap test first, so that most texts are scanned once."""
    pattern = PATTERNS[kind]
    hint = {"email": text.contains("@"), "phone": text.contains("+"), "handle": text.contains("@") | text.rlike(r"[(\[](?:at|AT)[)\]]"), "ip": text.rlike(r"[0-9]\.[0-9]")}.get(kind)
    if kind == "card":
        found = spans(text, pattern, lambda m: F.length(m) >= 12)
        hint = text.rlike("[0-9]")
    elif kind == "number":
        found = spans(text, pattern, lambda m: F.length(m) >= 7)
        hint = text.rlike("[0-9]")
    else:
        found = spans(text, pattern)
    return F.when(hint, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"))


def features(kind: Column, s: Column) -> dict[str, Column]:
    """Small integers that describe a candidate: format first, then context."""
    m, before, after = s["match"], s["before"], s["after"]
    n = F.length(_digits(m))
    others = F.length(m) - n
    touch = F.when(before.rlike(r"[\p{L}0-9_]$"), 2).when(before.rlike(r"[\p{Punct}]$"), 1).otherwise(0)
    follow = F.when(after.rlike(r"^[\p{L}0-9_]"), 2).when(after.rlike(r"^[^\p{Punct}\s]"), 1).otherwise(0)
    cue = F.lit(0)
    for i, pattern in enumerate(CUES.values()):
        cue = F.when(before.rlike(pattern), i + 1).otherwise(cue)
    return {
        "family": F.get(F.array(*[F.lit(FAMILIES[k]) for k in KINDS]), kind),
        "digits": F.when(n < 4, 0).when(n < 7, 1).when(n < 9, 2).when(n < 12, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7),
        "gaps": F.when(others == 0, 0).when(others < 3, 1).when(others < 6, 2).otherwise(3),
        "same": F.when(_digits(m).rlike(r"([0-9])\1{5}"), 1).otherwise(0),
        "touch": touch,
        "follow": follow,
        "cue": cue,
    }


FAMILIES = {"email": 0, "handle": 0, "ip": 1, "card": 2, "phone": 2, "number": 2}
LEVELS = {"family": 3, "digits": 8, "gaps": 4, "same": 2, "touch": 3, "follow": 3, "cue": 1 + len(CUES)}


def candidates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """row_id, doc_id, found array<struct<start, kind_no, end, kind, valid, f>> of all generators; f holds the features. Written once, without texts."""
    rows = stable_rows(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    lists = []
    for no, kind in enumerate(KINDS):
        lists.append(F.transform(proposed(F.col("text"), kind), _described(no, kind)))
    return scale.pin(rows.select("row_id", "doc_id", F.concat(*lists).alias("found")))


def _described(no, kind):
    def one(s):
        f = features(F.lit(no), s)
        return F.struct(
            s["start"].alias("start"),
            F.lit(no).alias("kind_no"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.coalesce(valid(kind, s["match"]), F.lit(False)).alias("valid"),
            F.struct(*[c.cast("int").alias(k) for k, c in f.items()]).alias("f"),
        )

    return one


def _shared(a, b) -> Column:
    """Characters that two spans share; not above 0 if they lie apart."""
    return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])


def counts(found: DataFrame) -> list:
    """(features, held out, n, positives) over all documents: bounded by the product of LEVELS."""
    right = F.filter("found", lambda s: s["valid"])
    labelled = found.select(
        (F.pmod(F.xxhash64("row_id"), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        F.explode("found").alias("c"),
        F.transform(right, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("right"),
    )
    positive = F.exists("right", lambda r: _shared(r, F.col("c")) >= ALIKE * F.greatest(r["end"] - r["start"], F.col("c.end") - F.col("c.start")))
    grouped = labelled.groupBy("held_out", *[F.col(f"c.f.{k}").alias(k) for k in LEVELS]).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("int")).alias("positive"))
    return [(tuple(r[k] for k in LEVELS), bool(r["held_out"]), r["n"], r["positive"]) for r in grouped.collect()]


def boost(rows, trees=TREES, rate=RATE, depth=DEPTH) -> dict:
    """Gradient-boosted trees with logistic loss over counted rows: {"start": log odds, "trees": [nested (feature, level, low, high) or value]}."""
    import numpy as np

    fit = [r for r in rows if not r[1]]
    n = np.array([r[2] for r in fit], float)
    pos = np.array([r[3] for r in fit], float)
    if not fit or pos.sum() in (0, n.sum()):
        return {"start": -30.0, "trees": []}
    x = np.array([r[0] for r in fit])
    score = np.full(len(fit), math.log(pos.sum() / (n.sum() - pos.sum())))
    start, grown = float(score[0]), []

    def grow(rows_in, grad, hess, left):
        g, h = grad[rows_in].sum(), hess[rows_in].sum()
        best, gain = None, 1e-6
        if left:
            for f in range(x.shape[1]):
                for level in range(int(x[rows_in, f].max())):
                    low = rows_in[x[rows_in, f] <= level]
                    if not len(low) or len(low) == len(rows_in) or not LEAST_ROWS <= n[low].sum() <= n[rows_in].sum() - LEAST_ROWS:
                        continue
                    gl, hl = grad[low].sum(), hess[low].sum()
                    better = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if better > gain:
                        best, gain = (f, level), better
        if best is None:
            value = float(rate * g / (h + 1))
            score[rows_in] += value
            return value
        under = x[rows_in, best[0]] <= best[1]
        return (*best, grow(rows_in[under], grad, hess, left - 1), grow(rows_in[~under], grad, hess, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        grown.append(grow(np.arange(len(fit)), pos - n * p, n * p * (1 - p), depth))
    return {"start": start, "trees": grown}


def tree_value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def score_of(model, x) -> float:
    return model["start"] + sum(tree_value(t, x) for t in model["trees"])


def thresholds(rows, model, precision=PRECISION) -> dict[int, float]:
    """Per family (the first feature) the least score at which the held-out candidates at or above it are positive to `precision`."""
    out = {}
    for kind in sorted({x[0] for x, _h, _n, _p in rows}):
        held = sorted(((round(score_of(model, x), 6), n, p) for x, h, n, p in rows if h and x[0] == kind), reverse=True)
        total = right = 0
        for i, (s, n, p) in enumerate(held):
            total, right = total + n, right + p
            if (i + 1 == len(held) or held[i + 1][0] < s) and right >= precision * total and total >= LEAST_ROWS:
                out[kind] = s
    return out


def score_column(model, f: Column) -> Column:
    names = list(LEVELS)

    def walk(tree):
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(f[names[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    out = F.lit(model["start"])
    for tree in model["trees"]:
        out = out + walk(tree)
    return F.round(out, 6)


def redactions(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """row_id, doc_id, base and found: array<struct<start, kind_no, end, kind>>, sorted. `found` also has what the model selects."""
    listed = candidates(docs, doc_id, text)
    rows = counts(listed)
    model = boost(rows)
    least = thresholds(rows, model)

    def chosen(s):
        passed = F.lit(False)
        if model["trees"]:
            score = score_column(model, s["f"])
            for family, t in least.items():
                passed = passed | ((s["f"]["family"] == family) & (score >= t))
        return passed

    def short(s):
        return F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"))

    base = F.array_sort(F.transform(F.filter("found", lambda s: s["valid"] & (s["kind_no"] < BASE)), short))
    right = F.array_sort(F.transform(F.filter("found", lambda s: s["valid"]), short))
    more = F.array_sort(F.transform(F.filter("found", lambda s: ~s["valid"] & chosen(s)), short))
    rows = listed.select("row_id", "doc_id", base.alias("base"), right.alias("right"), more.alias("more"))
    # Beside validated spans nothing is added; of selected ones that overlap, the longest stays, of equal ones the first.
    new = F.filter("more", lambda s: ~F.exists("right", lambda o: _shared(s, o) > 0))
    rows = rows.select("row_id", "doc_id", "base", "right", new.alias("new"))

    def better(o, s):
        longer, as_long = o["end"] - o["start"], s["end"] - s["start"]
        first = (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["kind_no"] < s["kind_no"]))
        return (_shared(s, o) > 0) & ((longer > as_long) | ((longer == as_long) & first))

    own = F.filter("new", lambda s: ~F.exists("new", lambda o: better(o, s)))
    return rows.select("row_id", "doc_id", "base", F.array_sort(F.concat("right", own)).alias("found"))


def redact(docs: DataFrame, doc_id="doc_id", text="text", mark="[{}]") -> DataFrame:
    """`docs` with every selected span replaced by its kind; of overlapping spans the first one names the whole."""
    whole = identified(docs)
    found = redactions(whole, doc_id, text).select("row_id", "found")
    body = F.col("doc").getField(text)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(body, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        label = F.when(s["start"] >= acc["at"], F.concat(gap, F.format_string(mark.replace("{}", "%s"), s["kind"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], label).alias("out"))

    rest = F.aggregate("found", zero, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    cut = F.when(F.size("found") > 0, rest).otherwise(body)
    return unwrapped(whole.join(found, "row_id"), **{text: cut})
