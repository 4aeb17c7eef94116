"""Centroid clustering of integer vectors, with bounds loosened by plane geometry.

Every vector keeps its cluster, an upper bound on the distance to its centroid and one lower bound on the
distance to all others. While the upper bound stays below the lower one, nothing is compared.

When centroids move, the lower bounds must be loosened. The full drift of the centroid that moved most would
do, but loses far more than needed. Here every cluster is a sphere: all its vectors lie within `radius` of the
old centroid. For another centroid that moved from c to c', the loss of a vector x is |x - c| - |x - c'|.
Sphere, c and c' span a plane. With m the midpoint of c and c', the loss is

    |c' - c| * cos(angle at m between x and c') * 2|x - m| / (|x - c| + |x - c'|)

where the last factor is at most 1. Seen from m, the sphere takes an angle of asin(radius / distance) on both sides of its centre,
which bounds the cosine over all its vectors. Centroids that move sideways cost little and those that move away cost nothing (the bound even rises).
The loss of a sphere is the greatest over all other centroids, k * k small sums on the driver.

Vectors whose bounds still overlap have their own distance taken exactly; those that remain are
compared with all centroids, exactly. Ties go to the smaller number.

State lies in a table of the shared folder, one per round, vectors packed as the narrowest integers that hold them. A
task adds up its sums, counts and radii per cluster, so k rows per task are aggregated and k rows reach the driver. No
row is shuffled: a vector that makes up a third of all rows costs no more than others.

Defined cases: vectors that are null, have another number of components, or a null or non-finite one are not kept; rows with
the same id are separate vectors (equal hashes are ordered by the packed vector, then are alike); a null id hashes as an
empty one and comes back null; fewer vectors than centroids: all are centroids; an empty table, or one without a
kept vector, gives no rows; further columns are ignored. Components beyond 2**27 after scaling raise, since distances would not fit a long.
"""

import hashlib
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
MOST = 1 << 27
#: Up to this, products summed over the components are exact in doubles.
EXACT = 1 << 20
SLICE = 4096
#: Room for rounding in bounds, relative and absolute.
ROOM = 1e-9

STATE = "vector binary, cluster int, upper double, lower double, distance bigint, n bigint, sums array<bigint>, radius double, scanned bigint, inertia bigint"


@dataclass
class Clustering:
    """rows: vec_id, cluster, distance; centroids and, per cluster, inertia; per round how many vectors were compared with all."""

    rows: DataFrame
    centroids: list
    inertia: list
    history: list = field(default_factory=list)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row as the narrowest little-endian integers that hold it."""
    reach = np.abs(vectors + (vectors < 0)).max(1, initial=0)
    width = np.where(reach < 1 << 7, 1, np.where(reach < 1 << 15, 2, 4))
    out = [b""] * len(vectors)
    for w in (1, 2, 4):
        at = np.flatnonzero(width == w)
        raw = vectors[at].astype(f"<i{w}").tobytes()
        step = w * vectors.shape[1]
        for n, k in enumerate(at.tolist()):
            out[k] = raw[n * step : (n + 1) * step]
    return out


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The packed vectors of a batch as 64-bit integers."""
    cells = column.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    raw = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    width = np.diff(offsets) // dims
    out = np.zeros((len(cells), dims), np.int64)
    for w in (1, 2, 4):
        at = np.flatnonzero(width == w)
        if len(at):
            places = offsets[at][:, None] + np.arange(w * dims)
            out[at] = np.ascontiguousarray(raw[places]).view(f"<i{w}")
    return out


def integers(column: pa.Array, dims: int, scale: int):
    """(places kept, their vectors): floor(scale * x) of the rows with `dims` finite components."""
    lists = column.cast(pa.large_list(pa.float64()))
    size = np.asarray(lists.value_lengths().fill_null(-1))
    at = np.flatnonzero(size == dims)
    if not len(at):
        return at, np.zeros((0, dims), np.int64)
    flat = lists.take(pa.array(at)).flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    good = np.isfinite(x).all(1)
    whole = np.floor(x[good] * scale)
    if len(whole) and np.abs(whole).max() > MOST:
        raise ValueError(f"a component exceeds {MOST} after scaling; distances would not fit a long")
    return at[good], whole.astype(np.int64)


def kept_vectors(table: DataFrame, dims=DIMS, scale=SCALE, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """vec_id, vector (packed integers) of the vectors that are kept."""
    rows = table.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            at, vectors = integers(batch.column("embedding"), dims, scale)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(packed(vectors), pa.binary())], ["vec_id", "vector"])

    return rows.mapInArrow(run, f"vec_id {_type(rows, 'vec_id')}, vector binary")


def _type(df, name):
    return df.schema[name].dataType.simpleString()


def losses(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster's sphere (old centroid, radius), the most by which any other centroid's move brings it nearer to a vector inside."""
    old, new = old.astype(float), new.astype(float)
    move, middle = new - old, (new + old) / 2
    length = np.sqrt((move**2).sum(1))
    out = np.zeros(len(old))
    for i in range(len(old)):
        to = old[i] - middle
        away = np.sqrt((to**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to * move).sum(1) / (away * length), -1, 1))
            spread = np.arcsin(np.clip(radius[i] / away, 0, 1))
        cosine = np.cos(np.maximum(angle - spread, 0))
        rest = np.maximum(away - radius[i], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(cosine < 0, rest / np.sqrt(rest**2 + length**2 / 4), 1.0)
        loss = np.where((radius[i] >= away) | (length == 0), length, length * cosine * factor)
        loss = np.delete(loss, i)
        out[i] = loss.max() if len(loss) else 0.0
    return out + ROOM * (1 + length.max(initial=0))


def _squared(vectors, centres):
    """Exact squared distances, row by row."""
    away = vectors - centres
    return np.einsum("ij,ij->i", away, away)


def nearest(vectors: np.ndarray, centroids: np.ndarray):
    """(number of the nearest centroid, squared distance, squared distance of the next one), all exact; ties to the smaller number."""
    exact = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    v, c = (vectors.astype(float), centroids.astype(float)) if exact else (vectors, centroids)
    far = np.float64(np.inf) if exact else np.iinfo(np.int64).max
    first, least, second = (np.zeros(len(v), t) for t in (np.int32, np.int64, float))
    square = np.einsum("ij,ij->i", c, c)
    for a in range(0, len(v), SLICE):
        part = v[a : a + SLICE]
        d = np.einsum("ij,ij->i", part, part)[:, None] - 2 * (part @ c.T) + square
        row = np.arange(len(part))
        first[a : a + SLICE] = k = d.argmin(1)
        least[a : a + SLICE] = d[row, k]
        d[row, k] = far
        second[a : a + SLICE] = d.min(1) if len(c) > 1 else np.inf
    return first, least, second


def assign(vectors, cluster, upper, lower, centroids, drift, loss):
    """One round for a batch: (cluster, upper, lower, number compared with all). `cluster` None: no bounds yet."""
    n = len(vectors)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        open_ = np.arange(n)
    else:
        cluster, upper, lower = cluster.copy(), upper + drift[cluster], lower - loss[cluster]
        lower = lower - ROOM * (1 + np.abs(lower))
        near = np.flatnonzero(upper * (1 + ROOM) + ROOM >= lower)
        upper[near] = np.sqrt(_squared(vectors[near], centroids[cluster[near]]))
        open_ = near[upper[near] * (1 + ROOM) + ROOM >= lower[near]]
    first, least, second = nearest(vectors[open_], centroids)
    cluster[open_], upper[open_], lower[open_] = first, np.sqrt(least), np.sqrt(second)
    return cluster, upper, lower, len(open_)


def _round(state: DataFrame, dims: int, centroids: np.ndarray, drift, loss, last: bool) -> DataFrame:
    """The state after one assignment, and in rows of their own (n is not null) what each task adds per cluster."""
    kind, fresh = _type(state, "vec_id"), "cluster" not in state.columns
    k = len(centroids)

    def run(batches):
        count, sums, radius, inertia, scanned, ids = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k), [0] * k, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("vec_id").type, unpacked(batch.column("vector"), dims)
            before = (None, None, None) if fresh else [np.asarray(batch.column(c)) for c in ("cluster", "upper", "lower")]
            cluster, upper, lower, more = assign(v, *before, centroids, drift, loss)
            scanned += more
            exact = _squared(v, centroids[cluster]) if last else None
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, upper)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            sums[cluster[order][starts]] += np.add.reduceat(v[order], starts)
            if last:
                for c, total in zip(cluster[order][starts], np.add.reduceat(exact[order].astype(object), starts), strict=True):
                    inertia[c] += int(total)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.nulls(n, pa.binary()) if last else batch.column("vector"), pa.array(cluster), pa.array(upper), pa.array(lower),
                 pa.array(exact, pa.int64()) if last else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.float64()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        if ids is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, ids), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()),
                 pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(radius), pa.array([scanned] + [0] * (k - 1), pa.int64()), pa.array(inertia, pa.int64())], names)

    names = ["vec_id", *(f.split()[0] for f in STATE.split(", "))]
    columns = ["vec_id", "vector"] + ([] if fresh else ["cluster", "upper", "lower"])
    return state.select(*columns).mapInArrow(run, f"vec_id {kind}, {STATE}")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, with the schema it was written with."""
    path = shared_path(df.sparkSession, f"centroids-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _totals(state: DataFrame, k: int, dims: int):
    """(counts, sums, radii, vectors compared with all, inertias) of all tasks: k rows of k * dims aggregated cells."""
    own = state.where("n is not null")
    facts = {r["cluster"]: r for r in own.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia")).collect()}
    cells = own.select("cluster", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = [[0] * dims for _ in range(k)]
    for r in cells.collect():
        sums[r["cluster"]][r["at"]] = int(r["value"])
    return ([facts[c]["n"] for c in range(k)], sums, np.array([facts[c]["radius"] for c in range(k)]), sum(f["scanned"] for f in facts.values()), [int(facts[c]["inertia"]) for c in range(k)])


def cluster(table: DataFrame, k=CENTROIDS, rounds=ROUNDS, dims=DIMS, scale=SCALE, seed=SEED, vec_id="vec_id", embedding="embedding") -> Clustering:
    """`rounds` rounds of assignment and centroid update, then a last assignment. See the module for the rules."""
    state = _written(kept_vectors(table, dims, scale, vec_id, embedding), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    rows = state.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    if not first:
        return Clustering(rows, [], [])
    centroids = unpacked(pa.array([bytes(r["vector"]) for r in first], pa.binary()), dims)
    k, history = len(centroids), []
    drift = loss = np.zeros(k)
    for number in range(rounds + 1):
        last = number == rounds
        state = _written(_round(state, dims, centroids, drift, loss, last), f"round{number}")
        count, sums, radius, scanned, inertia = _totals(state, k, dims)
        history.append({"round": number, "vectors": sum(count), "scanned": scanned, "loss": loss.tolist(), "drift": drift.tolist()})
        state = state.where("n is null")
        if not last:
            moved = np.array([[s // count[c] for s in sums[c]] if count[c] else centroids[c].tolist() for c in range(k)], np.int64)
            drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)) * (1 + ROOM)
            loss = losses(centroids, moved, radius)
            centroids = moved
    return Clustering(state.select("vec_id", "cluster", "distance"), centroids.tolist(), inertia, history)


def report(table: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, and of the cluster its inertia and a digest of its centroid; inertia of all."""
    got = cluster(table, **parameters)
    facts = [(c, got.inertia[c], sum(got.inertia), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(got.centroids)]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return got.rows.join(F.broadcast(table.sparkSession.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle(k=CENTROIDS, rounds=ROUNDS, dims=DIMS, scale=SCALE, seed=SEED):
    """The same by comparing every vector with every centroid, unrolled for DuckDB."""
    ctes = [
        f"""raw AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM raw)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(vx) AS x, min(struct_pack(d := d, c := c)) AS best FROM (
                  SELECT v.vec_id, v.x AS vx, k.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i])))::BIGINT AS d
                  FROM v, c{r} k) GROUP BY vec_id)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (
                      SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (
                        SELECT best.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL)) GROUP BY c)"""
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
               sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} k ON k.c = a.best.c"""


#: The given ids are distinct, as the contract's hash order supposes.
ORACLE = _oracle()
