import random

import numpy as np
import pytest

from factloom.llm import neardup


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                i_, j_ = top(i), top(j)
                up[max(i_, j_)] = min(i_, j_)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    """Chains of copies with more and more changes, exact copies, short texts and strangers."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(18):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(words) for w in base]
            docs.append(" ".join(own))
    docs += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    docs += ["a b", "a  b", "A\tB", "a b c d e", "a b c d e f", "", None, docs[0].upper(), docs[0]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert got(neardup.near_duplicates(df)) == brute(corpus)
    # the same in tiny blocks
    assert got(neardup.near_duplicates(df, block=8)) == brute(corpus)


def test_messy_rows(spark, messy, nothing):
    docs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    found = neardup.near_duplicates(messy)
    assert got(found.where("doc_id IS NOT NULL")) == brute(docs) and found.where("doc_id IS NULL AND kept").count() == 2
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id or -1 for r in kept.select("doc_id").collect())) == [-1, -1, 1, 2, 3, 4, 5, 7, 8]


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(8)
    docs = []
    for g in range(6):
        a, b = ([f"g{g}{k}w{rng.randrange(10**6)}" for _ in range(80)] for k in "ab")
        near = lambda ws: " ".join(w if i % 41 else "other" for i, w in enumerate(ws))
        docs += [(10 * g + 1, " ".join(a)), (10 * g + 1, " ".join(b)), (10 * g + 2, near(a)), (10 * g + 3, near(b)), (10 * g + 4, ""), (10 * g + 4, " ".join(b[:60]) + " " + " ".join(a[:60]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(neardup.near_duplicates(df)) == brute(docs)
    # texts count one by one where one of each group is kept
    kept = sorted(r.doc_id % 10 for r in neardup.keep_one(df).collect())
    assert kept == sorted([1, 1, 4, 4] * 6)


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text), (None, None), (2, text)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect())
    assert rows == [(0, 0, 0, True), (0, 36, 0, True), (1, 36, 1, True), (2, 36, 1, False)]
    assert sorted(r.doc_id or 0 for r in neardup.keep_one(df).collect()) == [0, 0, 1]


def test_a_large_group_is_dealt_out_evenly(spark):
    """Near copies of one text, chained: most are one group after two rounds; the rest probes it in bounded parts."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for i in range(3000):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, block=100)) == brute_fast(docs)


def brute_fast(docs):
    """brute() by an inverted index, for larger tables."""
    sets = {i: shingle_set(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    holders = {}
    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in holders.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            holders[x].append(i)
        for j, n in seen.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def test_parts_and_chunks_are_bounded(spark):
    """A bucket of 1,000 members in one group and 10 others is sent out 1,000 + 10 * parts times."""
    members = spark.createDataFrame([(7, 0, i, 0 if i < 1000 else i) for i in range(1010)], "band long, pos int, node long, label long")
    signs = spark.createDataFrame([(i, 50) for i in range(1010)], "node long, n_shingles long")
    rows = neardup.dealt_out(members, signs, 100).collect()
    assert len(rows) == 1010 + 10 * 11
    by_part = {}
    for r in rows:
        by_part.setdefault((r.chunk, r.part), []).append(r.role)
    assert len(by_part) == 11 and max(map(len, by_part.values())) < 200


def test_components_of_long_chains(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200), (200, 150)], "a long, b long")
    found = {r.node: r.label for r in neardup.components(links).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 150: 100, 200: 100}


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(2000)]
    other = [w if rng.random() > 0.05 else rng.choice(words) for w in base]
    x, y = (neardup.shingles(" ".join(t)) for t in (base, other))
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    signer = neardup.Signer(256)
    a, b = signer.sign([x, y], most=100)
    assert abs((a == b).mean() - true) < 0.08
    assert (signer.sign([y, x]) == [b, a]).all() and (signer.bands(signer.sign([x])) == signer.bands(signer.sign([x, y]))[:1]).all()


def test_a_million_pairs_at_the_threshold_meet_in_the_first_band_that_they_share():
    signer, rng = neardup.Signer(), np.random.default_rng(0)
    for _ in range(20):
        n = 50_000
        both = rng.integers(0, 2**63, (n, 8), dtype=np.uint64)  # six in common of eight
        sets = [*both[:, :7], *np.c_[both[:, :6], both[:, 7]]]
        signatures = signer.sign(sets)
        bands = signer.bands(signatures)
        kept = signatures.astype(neardup.KEPT)
        equal, share = kept[:n] == kept[n:], bands[:n] == bands[n:]
        assert share.any(1).all() and (equal.mean(1) >= 0.48).all()
        first = share.argmax(1)
        for p in range(len(signer.order)):
            assert not neardup.met(equal[first == p], signer.order[:p]).any()


def test_bands_that_differ_in_high_bits_alone_are_not_shared(spark):
    """Two members that seem to share an earlier band, but don't, are compared where they do meet."""
    signer, rng = neardup.Signer(), np.random.default_rng(1)
    one = rng.integers(0, 2**32, 128, dtype=np.uint32)
    two = one.copy()
    two[signer.order[0][2]] ^= np.uint32(1 << 20)  # of the first band's values, one differs in its upper half
    far = rng.integers(0, 2**32, 128, dtype=np.uint32)
    rows = [(5, 0, 0, 0, 1, 1, one), (5, 0, 0, 1, 2, 2, two), (5, 0, 0, 1, 3, 3, far)]
    rows = [(b, c, p, r, n, l, s.astype(neardup.KEPT).tobytes(), 1) for b, c, p, r, n, l, s in rows]
    df = spark.createDataFrame(rows, "band long, chunk int, part int, role int, node long, label long, signature binary, pos int")
    assert sorted(r.node for r in neardup.live_members(df, signer, 0.48, 1).collect()) == [1, 2]
    # where they do share the earlier band, they meet there instead
    same = [(*row[:6], one.astype(neardup.KEPT).tobytes() if row[4] == 2 else row[6], 1) for row in rows]
    assert neardup.live_members(spark.createDataFrame(same, df.schema), signer, 0.48, 1).count() == 0
