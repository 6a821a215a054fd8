import hashlib
import math
import random

import numpy as np
import pytest
from tidewatch.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, upper double"


def brute(rows, k, rounds, size):
    """Every vector against every centroid, in whole numbers of Python."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(at)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i if i is not None else -1), j, d) for (i, _), (d, j) in zip(kept, assign())), at


def random_rows(n, size, spread, seed, steps=None):
    r = random.Random(seed)
    middle = [[r.uniform(-2, 2) for _ in range(size)] for _ in range(9)]
    value = (lambda m: m + r.gauss(0, spread)) if steps is None else (lambda m: r.randrange(steps) / 64)
    return [(i, [value(m) for m in r.choice(middle)]) for i in range(n)]


def run(spark, rows, k, rounds, size):
    df = spark.createDataFrame([(i, e, "x", 1, 2.0) for i, e in rows], SCHEMA)
    found, at = centroids.cluster(df, k=k, rounds=rounds, size=size)
    return sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance) for r in found.collect()), at


@pytest.mark.parametrize("spread,steps", [(0.1, None), (1.5, None), (0, 2)], ids=["apart", "mixed", "ties"])
def test_equals_a_full_search(spark, spread, steps):
    rows = random_rows(300, 6, spread, 5, steps) + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.25] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [None] * 6)]
    got, at = run(spark, rows, 11, 4, 6)
    want, centres = brute(rows, 11, 4, 6)
    assert got == want and at == centres


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    assert run(spark, rows, 16, 3, 2)[0] == brute(rows, 16, 3, 2)[0]
    assert run(spark, [], 16, 3, 2) == ([], [])
    found, at = centroids.cluster(spark.createDataFrame([], SCHEMA), size=2)
    assert centroids.with_inertia(found, at).count() == 0
    assert run(spark, rows, 1, 2, 2)[0] == brute(rows, 1, 2, 2)[0]


def test_own_and_kept_columns(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a", 2), (2, [4.0, 1.0], "b", 3)], "second long, v array<double>, own0 string, cluster int")
    found, at = centroids.cluster(df, k=2, id_col="second", vector_col="v", size=2, keep=("own0", "cluster"))
    assert found.columns == ["second", "own0", "cluster", "distance"] and {(r.second, r.own0) for r in found.collect()} == {(1, "a"), (2, "b")}
    total = centroids.with_inertia(found, at).select("inertia", "cluster_inertia").distinct().collect()
    assert [tuple(r) for r in total] == [(0, 0)]


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [4.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df, size=2)


def test_bounds_save_distances():
    rows = np.array([[math.floor(64 * x) for x in e] for _, e in random_rows(2000, 8, 0.15, 3)], np.int64)
    at = [list(map(int, r)) for r in rows[:12]]
    state, made = centroids.search(rows, None, centroids.Centroids(at, None))
    full = np.stack([centroids.squared(rows, np.broadcast_to(c, rows.shape)) for c in np.array(at)])
    assert (state[0] == full.argmin(0)).all() and made < full.size
    _, again = centroids.search(rows, state, centroids.Centroids(at, at))
    assert again < 0.2 * full.size
