"""Exact k-means on integer vectors by Shallot search.

Vectors are turned into integers once and travel from round to round as rows of a written table, each with its bounds: the
centroid it belongs to, the second-nearest one as it was when the vector was last searched, an upper bound of the distance to the
first and a lower bound of the distance to all others. After the centroids have moved, the bounds are loosened by the moves; a
vector whose upper bound lies below its lower bound, or below half the distance from its centroid to the nearest other one, stays
where it is without a look at any other centroid. Otherwise the distances to both remembered centroids are made, the search starts
from the closer one and goes through that one's neighbours in order of distance. A neighbour can't be among the two nearest if it is
farther from the start than the vector's distance to the start plus the second-best distance so far; that ball shrinks with every
better one, and the first neighbour outside it ends the scan. Bounds are floats, widened outwards by more than their rounding;
what survives them is compared in whole numbers, equal distances by centroid number, so the result is that of a full search.

Spark deals out the vectors; a task sees one Arrow batch at a time. Sums and counts by cluster are aggregated in each task before
they meet. Only k centroids, and k rows of sums, pass through the driver.

Vectors that are null, have another number of components, or a null or non-finite one, are left out. Rows of equal id are rows of
their own; those without id belong to a cluster but are no first centroid. Fewer vectors than k give as many centroids, an empty
table an empty result. A distance has to fit a long: beyond that the job ends with an error that says so. Columns beside id and vector
are not read, whatever their names; those named in ``keep`` pass through, unless they are named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._common import delete, fresh_path, materialise

#: More than the relative rounding of a square root of a sum of squares.
SLACK = 1e-9
_FAR = np.iinfo(np.int64).max
#: Beyond it a component's square may not fit a long.
_MOST = 2**31
STATE = ["cluster", "second", "upper", "lower"]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, row by row; those that don't fit a long are the largest long."""
    d = x - c
    rough = np.einsum("ij,ij->i", d.astype(np.float64), d.astype(np.float64))
    with np.errstate(over="ignore"):
        exact = np.einsum("ij,ij->i", d, d)
    return np.where(rough < 9.2e18, exact, _FAR)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


class Centroids:
    """The centroids of a round, their neighbours in order of distance, and how far each has moved since the last."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None):
        self.at = np.array(at, np.int64)
        k = len(at)
        between = np.stack([squared(self.at, np.broadcast_to(c, self.at.shape)) for c in self.at])
        np.fill_diagonal(between, -1)  # itself first
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        np.fill_diagonal(between, 0)
        self.low = _below(np.take_along_axis(between, self.order, 1))
        self.half = self.low[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = _above(squared(self.at, np.array(before, np.int64))) if before else np.zeros(k)
        self.moved = moved
        self.others = np.array([max(np.delete(moved, j), default=0.0) for j in range(k)])


def _better(d2: np.ndarray, j: np.ndarray, best2: np.ndarray, best: np.ndarray) -> np.ndarray:
    return (d2 < best2) | ((d2 == best2) & (j < best))


def search(x: np.ndarray, state: tuple[np.ndarray, ...] | None, c: Centroids) -> tuple[tuple[np.ndarray, ...], int]:
    """The new (cluster, second, upper, lower) of every row of x, and how many distances were made. state: None before the first round."""
    n, k = len(x), len(c.at)
    if state is None:
        a, b = np.zeros(n, np.int64), np.full(n, min(1, k - 1))
        upper, lower = np.full(n, np.inf), np.full(n, -np.inf)
    else:
        a, b, upper, lower = (s.copy() for s in state)
        upper, lower = (upper + c.moved[a]) * (1 + SLACK), (lower - c.others[a]) * (1 - SLACK)
    if k == 1:
        return (a, a, _above(squared(x, c.at[a])), np.full(n, np.inf)), n
    limit = np.maximum(lower, c.half[a])
    open_ = np.flatnonzero(~(upper < limit))
    made = len(open_)
    d_a = squared(x[open_], c.at[a[open_]])
    upper[open_] = _above(d_a)
    still = ~(upper[open_] < limit[open_])
    rows, d_a = open_[still], d_a[still]
    if not len(rows):
        return (a, b, upper, lower), made
    v, d_b, first, second = x[rows], squared(x[rows], c.at[b[rows]]), a[rows], b[rows]
    made += len(rows)
    swap = _better(d_b, second, d_a, first)
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    best, next_ = np.where(swap, d_b, d_a), np.where(swap, d_a, d_b)
    start, remembered = first.copy(), second.copy()
    reach = _above(best)  # from the vector to where the scan starts
    alive = np.arange(len(rows))
    for i in range(k - 1):
        alive = alive[c.low[start[alive], i] <= reach[alive] + _above(next_[alive])]  # neighbours ascend: who leaves the ball is done
        if not len(alive):
            break
        j = c.order[start[alive], i]
        new = j != remembered[alive]
        at, j = alive[new], j[new]
        d = squared(v[at], c.at[j])
        made += len(at)
        wins = _better(d, j, best[at], first[at])
        places = ~wins & _better(d, j, next_[at], second[at])
        w, p = at[wins], at[places]
        next_[w], second[w] = best[w], first[w]
        best[w], first[w] = d[wins], j[wins]
        next_[p], second[p] = d[places], j[places]
    a[rows], b[rows], upper[rows], lower[rows] = first, second, _above(best), _below(next_)
    return (a, b, upper, lower), made


def integers(vectors: DataFrame, vector_col: str = "embedding", size: int = 64, scale: float = 64.0) -> DataFrame:
    """The rows whose vector has ``size`` finite components, with floor(scale * x) in its place."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(v.isNotNull() & (F.size(v) == size) & finite)
    too_far = F.exists(v, lambda x: F.abs(x.cast("double") * scale) > _MOST)
    whole = F.when(too_far, F.raise_error(F.lit("a component is too large for its squared distance to be a long")).cast("array<bigint>"))
    return kept.withColumn(vector_col, whole.otherwise(F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))))


def _assign(df: DataFrame, at: list[list[int]], before: list[list[int]] | None, with_distance: bool) -> DataFrame:
    """df: column v and, after the first round, the state. Adds the new state; with_distance: the distance instead of bounds."""
    made = [f for f in df.schema if f.name not in STATE]
    extra = [T.StructField("cluster", T.IntegerType())]
    extra += [T.StructField("distance", T.LongType())] if with_distance else [T.StructField("second", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())]
    names, width = [f.name for f in made], len(at[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(at, before)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            state = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in STATE) if before else None
            (a, b, upper, lower), _ = search(x, state and (state[0].astype(np.int64), state[1].astype(np.int64), *state[2:]), centroids)
            arrays = [pa.array(a.astype(np.int32))]
            if with_distance:
                d = squared(x, centroids.at[a])
                if len(d) and d.max() == _FAR:
                    raise ValueError("a squared distance does not fit a long")
                arrays.append(pa.array(d))
            else:
                arrays += [pa.array(b.astype(np.int32)), pa.array(upper), pa.array(lower)]
            kept = names[:-1] if with_distance else names  # v is last
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *(f.name for f in extra)])

    return df.mapInArrow(run, T.StructType([*(made[:-1] if with_distance else made), *extra]))


def _moved(state: DataFrame, at: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean; k rows come to the driver."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(at[0]))]
    out = [list(c) for c in at]
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(at[0]))]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 64.0, seed: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[int]]]:
    """(id, keep, cluster, distance) for every vector that is kept, and the final centroids. The first centroids are the k vectors of
    least sha256 of ``<seed>:<id>``, equal hashes by their components."""
    if k < 1 or rounds < 0:
        raise ValueError("k must be 1 or more, rounds 0 or more")
    spark, names = vectors.sparkSession, list(dict.fromkeys([id_col, *(c for c in keep if c not in ("cluster", "distance"))]))
    own, path = [f"own{i}" for i in range(len(names))], fresh_path(spark, "vectors")
    rows = vectors.select(*(F.col(c).alias(o) for c, o in zip(names, own)), F.col(vector_col).alias("v"))
    integers(rows, "v", size, scale).write.parquet(path)
    state = spark.read.parquet(path)
    code: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("own0").cast("string")), 256)
    chosen = state.filter(code.isNotNull()).select(code.alias("code"), "v").orderBy("code", "v").limit(k).collect()
    at, before = [list(r["v"]) for r in chosen], None
    if not at:
        found = state.select(*own, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    else:
        for _ in range(rounds):
            new = fresh_path(spark, "assigned")
            _assign(state, at, before, False).write.parquet(new)
            delete(spark, path)
            path, state = new, spark.read.parquet(new)
            at, before = _moved(state, at), at
        found = _assign(state.select(*own, *(STATE if before else []), "v"), at, before, True)
    return materialise(found.select(*(F.col(o).alias(c) for o, c in zip(own, names)), "cluster", "distance"), "clusters"), at


def with_inertia(found: DataFrame, at: list[list[int]]) -> DataFrame:
    """Adds the sum of distances over each row's cluster (cluster_inertia) and over all rows (inertia), and the digest of its centroid's
    components (centroid_sha256). What is joined has a row for each centroid."""
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total, digest = sum(r["cluster_inertia"] for r in sums), lambda c: sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r["cluster"], r["cluster_inertia"], total, digest(at[r["cluster"]])) for r in sums]
    by = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster")
