import hashlib

import numpy as np
import pytest

from factloom.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, own int, upper double, sums string, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2.0, "x", 3) for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3, width=64, scale=64, seed=1):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], float).astype("<f8").tobytes()))
    c = [list(x) for _, x in order[:k]]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda: [min(range(len(c)), key=lambda j: (away(x, c[j]), j)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            part = [x for (_, x), a in zip(kept, own) if a == j]
            if part:
                c[j] = [sum(col) // len(part) for col in zip(*part)]
    own = assign()
    d = [away(x, c[a]) for (_, x), a in zip(kept, own)]
    inertia = [sum(e for e, a in zip(d, own) if a == j) for j in range(len(c))]
    return sorted((i, a, e, inertia[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, e in zip(kept, own, d))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(size=6) * (0.05 if i % 4 else 1)).tolist()) for i in range(800)]
    rows += [(900 + i, rows[11][1]) for i in range(100)]  # ties, and a hot vector
    rows += [(5, rows[6][1]), (5, rows[5][1])]  # repeated ids
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0] * 5), (2005, []), (None, [1.0] * 6)]
    return rows


@pytest.mark.parametrize("k,rounds", [(16, 3), (7, 5), (1, 1), (2000, 1)])
def test_equals_brute_force(spark, many, k, rounds):
    got = rows_of(clusters.cluster(frame(spark, many), k=k, rounds=rounds, width=6))
    assert got == brute(many, k, rounds, 6) and got


def test_whole_numbers_of_any_size(spark):
    rng = np.random.default_rng(4)
    # doubles, 64-bit integers, Python's integers with distances that fit
    for size in (1e4, 1e6, 2e6):
        rows = [(i, (rng.normal(size=2) * size).tolist()) for i in range(60)]
        assert rows_of(clusters.cluster(frame(spark, rows), k=5, width=2)) == brute(rows, 5, 3, 2)
    rows = [(0, [1e30, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.5])]
    assert rows_of(clusters.cluster(frame(spark, rows), k=3, width=2)) == brute(rows, 3, 3, 2)
    with pytest.raises(Exception, match="DISTANCE_OVERFLOW"):
        clusters.cluster(frame(spark, [(0, [1e30, 0.0]), (1, [0.0, 1.0])]), k=1, width=2).collect()


def test_few_rows_and_none(spark):
    assert clusters.cluster(frame(spark, [])).count() == 0
    assert clusters.cluster(frame(spark, [(1, [1.0] * 5)])).count() == 0
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert rows_of(clusters.cluster(frame(spark, rows))) == brute(rows)
    same = [(i, [0.25] * 64) for i in range(30)]  # all equal: the smallest number takes them
    got = rows_of(clusters.cluster(frame(spark, same)))
    assert got == brute(same) and {r[1] for r in got} == {0}


def test_bounds_spare_distances():
    """Most vectors of well-parted clusters never look at another centroid, and few at all of them."""
    rng = np.random.default_rng(0)
    centres = np.floor(rng.normal(size=(12, 8)) * 400)
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(2400, 8)) * 20)
    c = clusters.Centroids([[int(v) for v in row] for row in centres])
    own = clusters.Bounds.scanned(x, c, 3)
    near = clusters.Centroids([[v + 9 for v in row] for row in c.rows])
    calls = {"all": 0, "some": 0}
    to_all, to_some = clusters.Centroids.to_all, clusters.Centroids.to_some

    class Counting(clusters.Centroids):
        def to_all(self, rows):
            calls["all"] += len(rows)
            return to_all(self, rows)

        def to_some(self, rows, numbers):
            calls["some"] += numbers.size
            return to_some(self, rows, numbers)

    counting = Counting(near.rows)
    own.moved(c.moves(near))
    own.settle(x, counting)
    assert (own.own == np.argmin(near.to_all(x), axis=1)).all()
    assert calls["all"] < 100 and calls["some"] < len(x)
