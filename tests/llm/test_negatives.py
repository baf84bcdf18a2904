import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, row long, h long, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 0.5, 1, 2, 3, 4) for i, v, y in rows], SCHEMA)


def brute(rows, every, scale=256, positives=5, negatives_=3, percent=(50, 95)):
    kept = [(i, y, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, x in kept:
        if i % every:
            continue
        others = sorted(((-dot(x, b), j, z) for j, z, b in kept if j != i))
        for s, j, z in [o for o in others if o[2] == y][:positives]:
            near = [(k, -t) for t, k, u in others if u != y and percent[0] * -s <= 100 * -t <= percent[1] * -s][:negatives_]
            out += [(i, j, r + 1, k, -s, t) for r, (k, t) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=10) * rng.choice([0.1, 1, 4])).tolist(), int(rng.integers(0, 4))) for i in range(500)]
    rows += [(500 + i, rows[7][1], i % 4) for i in range(60)]  # ties, over all labels
    rows += [(700, None, 1), (720, [1.0, None] + [0.0] * 8, 1), (740, [float("nan")] * 10, 1), (760, [float("inf")] + [0.0] * 9, 2), (780, [0.0] * 10, 0), (800, [1.0] * 10, None), (None, [1.0] * 10, 1)]
    return rows + [(820, [2.0, 1.0], 1), (840, [], 2)]  # shorter ones count as filled up


@pytest.mark.parametrize("block_rows,round_bytes", [(200_000, 32 << 20), (20, 1000)])
def test_equals_brute_force(spark, many, block_rows, round_bytes):
    """Also in many waves and rounds."""
    got = rows_of(negatives.mine(frame(spark, many), every=20, block_rows=block_rows, round_bytes=round_bytes))
    assert got == brute(many, 20) and got


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    for most in (1e6, 3e15):
        rows = [(i, (rng.normal(size=3) * (most if i % 3 else 1)).tolist(), i % 2) for i in range(40)]
        want = [r for r in brute(rows, 5)]
        if all(abs(v) < 2**63 for r in want for v in r):
            assert rows_of(negatives.mine(frame(spark, rows), every=5)) == want and want
        else:
            with pytest.raises(Exception, match="SCORE_OVERFLOW"):
                negatives.mine(frame(spark, rows), every=5).collect()


def test_few_rows_and_none(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(50, [1.0], 1)])).count() == 0  # no positive
    assert negatives.mine(frame(spark, [(51, [1.0], 1), (52, [1.0], 1)])).count() == 0  # no anchor
    rows = [(0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (0, [1.0], 1)]
    # both rows with id 0 are anchors, both with id 1 positives of each
    got = rows_of(negatives.mine(frame(spark, rows), every=50))
    assert got == [(0, 1, 1, 2, 65536, 230 * 256)] * 4
    # a negative score has no range
    assert negatives.mine(frame(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)])).count() == 0


def test_planes_drop_candidates_before_the_last(spark):
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(2000, 64)) / 8)
    q = x[:50].astype(float)
    exact = q @ x.T
    low = np.partition(exact, -6, axis=1)[:, -6]
    sliced = negatives.Sliced(x)
    a, c, s, took = negatives.products(q, sliced, np.float64, np.ones(exact.shape, bool), low, np.full(50, np.inf))
    assert (s == exact[a, c]).all() and set(zip(a.tolist(), c.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= low[:, None]))))
    assert took < 0.75 * sliced.bits * exact.size
    # both ends of the intervals count
    high = np.partition(exact, -3, axis=1)[:, -3]
    a, c, s, _ = negatives.products(q, sliced, np.float64, exact < 1e5, low, high)
    want = (exact >= low[:, None]) & (exact <= high[:, None]) & (exact < 1e5)
    assert set(zip(a.tolist(), c.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))


def test_what_tasks_hand_over_grows_with_the_root_of_the_blocks(spark):
    """50 blocks: every task alone would hand over 5 rows an anchor; thresholds of the first blocks leave a fraction of that."""
    rng = np.random.default_rng(2)
    rows = frame(spark, [(int(i), rng.normal(size=8).tolist(), 0) for i in range(5000)])
    clean = negatives.clean(rows, "vec_id", "embedding", F.col("label"), 256)
    blocks = negatives.blocks(clean, 5000, 100, 1, "h", "row")
    anchors = negatives.Anchors(clean.where("vec_id % 100 = 0").orderBy("vec_id").collect(), 8)
    n = len(anchors.ids)
    known = np.full(n, -np.inf)
    plain = lambda v: (v[0], np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), v[1], True)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each block
    try:
        alone = negatives.passed(blocks, spark.sparkContext.broadcast((anchors, known)), "double", 8, 5, plain).count()
        (cut,) = negatives.wave_ends(50)
        first = negatives.ranked(negatives.passed(blocks.where(F.col("h") < cut), spark.sparkContext.broadcast((anchors, known)), "double", 8, 5, plain), 5)
        best = first.where("rank = 5").collect()
        for r in best:
            known[r.slot] = r.score
        handed = negatives.passed(blocks.where(F.col("h") < cut), spark.sparkContext.broadcast((anchors, np.full(n, -np.inf))), "double", 8, 5, plain).count()
        handed += negatives.passed(blocks.where(F.col("h") >= cut), spark.sparkContext.broadcast((anchors, known)), "double", 8, 5, plain).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert alone > 40 * 5 * n and handed < 0.35 * alone
