import numpy as np
import pytest

from factloom.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in vectors], SCHEMA)


def brute(vectors, k, every, whole):
    kept = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        kept[i] = np.floor(1024 * x) if whole else x
        if not whole and not x.any():
            del kept[i]
    out = {}
    for q in kept:
        if q % every == 0:
            scored = sorted(((-float(kept[q] @ kept[c]), c) for c in kept if c != q))[:k]
            out[q] = [(c, -s) for s, c in scored]
    return out


def exact(vectors):
    """All scores, in Python's integers."""
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None}
    return {q: [(c, s) for s, c in sorted(((sum(a * b for a, b in zip(x, y)), c) for c, y in whole.items() if c != q), key=lambda t: (-t[0], t[1]))] for q, x in whole.items()}


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for own in out.values():
        assert len({c for c, _ in own}) == len(own)
    return out


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=12) * rng.choice([0.1, 1, 5])).tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(700, None), (800, [1.0, None] + [0.0] * 10), (900, [float("nan")] * 12), (1000, [float("inf")] + [0.0] * 11), (1100, [0.0] * 12)]
    return rows


def test_exact_search_equals_brute_force(spark, odd):
    got = as_dict(topk.search(frame(spark, odd), k=10, every=20, block_rows=100, seeds=50).collect())
    assert got == {q: [(c, int(s)) for c, s in own] for q, own in brute(odd, 10, 20, True).items()}


def test_few_rows_large_values_and_none(spark):
    # sums below 2**53, below 2**63, and scores that fit in a long though their bound doesn't
    for most in (1e3, 1e6, 2.9e6):
        rows = [(0, [most, 1.0]), (1, [most, 2.0]), (2, [-most, 5.0]), (None, [1.0, 1.0])]
        got = as_dict(topk.search(frame(spark, rows), k=10, every=1).collect())
        assert got == exact(rows)
    # one that doesn't fit ends the query, but only if it is among the best
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [-3e6, 5.0])]
    with pytest.raises(Exception, match="SCORE_OVERFLOW"):
        topk.search(frame(spark, rows), k=10, every=1).collect()
    rows = [(1, [0.0, 1.0]), (2, [-3e6, 5.0]), (5, [3e6, 0.0])]
    assert as_dict(topk.search(frame(spark, rows), k=1, every=5).collect()) == {5: [(1, 0)]}
    assert topk.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [])).count() == 0


@pytest.mark.parametrize("module", [topk, ann])
def test_rows_that_share_an_id_are_candidates_each_for_itself(spark, module):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in module.search(frame(spark, rows), k=2, every=10).collect()]
    scale = 1024**2 if module is topk else 1
    assert sorted(got) == [(0, 1, 1, 3 * scale), (0, 2, 1, 2 * scale)]


def test_rounds_of_queries_give_the_same(spark, odd, monkeypatch):
    want = as_dict(topk.search(frame(spark, odd), k=10, every=20, block_rows=100).collect())
    monkeypatch.setattr("factloom.llm.vectors.ROUND_BYTES", 12 * 8 * 7)
    assert as_dict(topk.search(frame(spark, odd), k=10, every=20, block_rows=100).collect()) == want
    assert len(as_dict(ann.search(frame(spark, odd), k=20, every=20, block_rows=150).collect())) == len(brute(odd, 20, 20, False))


def test_recall_on_the_table(spark):
    """At least 0.9 of the neighbours, with less than half of the rows verified."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    got = as_dict(ann.search(rows, k=20, every=20).collect())
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()))
    norms2, lines = (x * x).sum(1), np.random.default_rng(7).standard_normal((65, 24))
    longest = float(np.sqrt(norms2.max()))
    block = ann.Block(np.arange(len(x)), ids, x, norms2, lines, longest, 32)
    hits = verified = 0
    for q, own in got.items():
        s = np.where(ids == q, -np.inf, x @ vectors[q])
        hits += len({c for c, _ in own} & set(ids[np.argsort(-s)[:20]].tolist()))
        verified += block.ask(vectors[q][None], np.array([q]), np.array([-np.inf]), 20, ann.chi2_quantile(0.87, 24))[3]
    assert len(got) == 100 and hits >= 0.9 * 2000 and verified <= 0.5 * 100 * len(x)


def test_neighbours_reach_their_recall(spark, odd):
    got = as_dict(ann.search(frame(spark, odd), k=20, every=20, block_rows=150, leaf=16, seeds=50).collect())
    want = brute(odd, 20, 20, False)
    assert set(got) == set(want)
    hits = 0
    for q, own in want.items():
        assert len(got[q]) == 20
        scores = sorted((s for _, s in got[q]), reverse=True)
        assert [s for _, s in got[q]] == scores
        # equal vectors tie: compare by score
        hits += sum(np.isclose(a, b, atol=1e-9) for a, (_, b) in zip(scores, own))
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("copies,seeds", [(0, 2048), (0, 30), (200, 2048), (200, 30)])
def test_every_query_has_all_its_neighbours(spark, copies, seeds):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[100 : 100 + copies] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = as_dict(ann.search(frame(spark, rows), k=20, every=5, block_rows=90, leaf=16, seeds=seeds).collect())
    assert len(got) == 100 and {len(own) for own in got.values()} == {20}
    few = as_dict(ann.search(frame(spark, rows[:8]), k=20, every=1, seeds=seeds).collect())
    assert {len(own) for own in few.values()} == {7}
    for own in got.values():  # equal vectors tie to the last bit, and stand by id
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        assert len({s for c, s in own if 100 <= c < 100 + copies}) <= 1


def test_chi_square_quantile():
    assert ann.chi2_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert ann.chi2_quantile(0.95, 12) == pytest.approx(21.0261, abs=1e-3)
