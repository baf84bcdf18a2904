import random
import zlib

import numpy as np
import pytest

from factloom.llm import common, labelled, quality, toxicity
from factloom.llm.common import table
from factloom.llm.labelled import logistic, probability


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary texts, texts with a few marked words, and junk; in two vocabularies."""
    rng = random.Random(2)
    syllables = ["ba", "lo", "mi", "ra", "tes", "non", "ker", "ul", "ost", "ing"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    bad = ["vilework", "snarl", "grubbish", "oafly"]
    docs, labels = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        if not good:
            own = [w.upper() + "!!" for w in own] if i % 2 else [own[0]] * len(own)
            toxic = 0
        docs.append((i, " ".join(own)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module,column,folds,fold", [(toxicity, 2, 5, 0), (quality, 1, 4, 2)])
def test_held_out_accuracy(corpus, module, column, folds, fold):
    docs, labels, known = corpus
    rows = module.score(docs, labels).collect()
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1
    truth = {k[0]: k[column] for k in known}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.95


def test_keep_takes_effect(corpus):
    docs, labels, known = corpus
    kept = {r.doc_id for r in toxicity.keep(docs, labels).collect()}
    clean = [k[0] for k in known if not k[2]]
    assert len(kept & set(clean)) > 0.97 * len(clean)
    assert len(kept - set(clean)) < 0.05 * len(known)


@pytest.mark.parametrize("sf,missed,flagged", [("sf0.01", 2, 2), ("sf0.1", 10, 8)])
def test_toxicity_of_the_held_out_labels(spark, sf, missed, flagged):
    """Of 6 and of 97 toxic documents, and of 64 and of 728 others, that were kept out."""
    docs, labels = (table(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] and not r.predicted for r in rows) <= missed
    assert sum(r.predicted and not truth[r.doc_id] for r in rows) <= flagged


def test_gains_of_windows_tell_some_toxic_documents(small):
    """The gains of windows alone, without any word's evidence, part the kinds for a third of the toxic documents (README: words decide the rest)."""
    import duckdb

    rows = duckdb.sql("SELECT text, toxic, d.doc_id FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY d.doc_id").fetchall()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for _, _, i in rows]
    model = toxicity.train([(t, y) for (t, y, _), h in zip(rows, held) if not h], 12, 256 << 10)
    assert (model.weights[:2] > 0).any()
    tests = [(t, y) for (t, y, _), h in zip(rows, held) if h]
    gain = np.array([model.features(t)[0] for t, _ in tests])
    y = np.array([y for _, y in tests])
    assert ((gain >= 3) & (y == 1)).sum() > 0.3 * y.sum() and ((gain >= 3) & (y == 0)).mean() < 0.03


def test_a_text_beyond_the_byte_bound_is_passed_over(spark):
    """The first text of a class, by hash, doesn't empty the class if it is too long."""
    rows = [(i, "word " * (2000 if i % 3 == 0 else 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = labelled.sample(docs, labels, "quality", 100, 5000, 4, 2)
    assert {y for _, y in got} == {0, 1} and all(len(t) < 100 for t, _ in got)


def test_units_of_the_batch_bound_are_read(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for told, held in (("64m", f"{common.BATCH_BYTES}b"), ("100k", "100k"), (str(64 << 20), f"{common.BATCH_BYTES}b")):
            spark.conf.set(name, told)
            common.bounded_batches(spark)
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)


def test_quality_of_the_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score(docs, labels).collect() if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id] for r in rows]
    assert len(rows) > 500 and np.mean(right) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_messy_rows(spark, messy, nothing, no_labels, small, module):
    labels = table(spark, small, "labels")
    for known in (labels, no_labels):
        rows = module.score(messy, known).collect()
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(nothing, known).count() == 0
    assert module.keep(messy, labels).columns == messy.columns
    # texts that are equal have one score, null counts as empty
    scores = {}
    for r in module.score(messy, labels).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[3]) == 1 and scores[1] == scores[2]


def test_words_of_a_copied_document_are_not_toxic():
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(2000)]
    ordinary = [(frozenset(f"{rng.choice(words)}".encode() for _ in range(60)), 0) for _ in range(300)]
    copied = [f"copy{i}of".encode() for i in range(60)]
    toxic = [(frozenset([*copied, f"v{i}".encode()]), 1) for i in range(40)]
    toxic += [(frozenset([b"snarling", *(rng.choice(words).encode() for _ in range(60))]), 1) for _ in range(60)]
    assert [u.strip() for u in toxicity.telling_units(ordinary + toxic)] == ["snar"]


def test_words_of_a_minority_language_are_kept():
    rng = random.Random(6)

    def text(kind, *more):
        return " ".join([*(f"{kind}{rng.randrange(900)}" for _ in range(40)), *more])

    rows = [(text("en"), 0) for _ in range(1200)] + [(text("es"), 0) for _ in range(150)]
    rows += [(text("en", "grubbish"), 1) for _ in range(240)] + [(text("es", "malvado"), 1) for _ in range(14)]
    rng.shuffle(rows)
    found = toxicity.telling_units([(frozenset(t.encode().split()), y) for t, y in rows])
    assert [u.strip() for u in found] == ["grub", "malv"]
    model = toxicity.train(rows, 12, 256 << 10)
    assert (model.score([text("es", "malvado"), text("en", "grubbish")]) > 0.5).all()
    assert (model.score([text("es"), text("en"), ""]) < 0.5).all()


def test_phrasing_without_a_telling_word_is_seen():
    rng = random.Random(7)
    words = [f"w{i}x" for i in range(400)]
    phrases = [rng.sample(words, 4) for _ in range(300)]

    def text(kind):
        return " ".join(w for p in rng.choices(phrases, k=20) for w in (p[::-1] if kind else p))

    rows = [(text(y), y) for y in [0] * 300 + [1] * 300]
    assert not toxicity.telling_units([(frozenset(t.encode().split()), y) for t, y in rows])
    model = toxicity.train(rows, 12, 256 << 10)
    said = model.score([text(y) for y in [0] * 100 + [1] * 100]) >= 0.5
    assert (said == np.repeat([False, True], 100)).mean() > 0.9


def test_logistic_stays_finite_where_kinds_part():
    x = np.r_[np.linspace(-2, -1, 50), np.linspace(1, 2, 50)][:, None]
    y = np.repeat([0.0, 1.0], 50)
    w = logistic(x, y)
    assert np.isfinite(w).all() and ((probability(x, w) > 0.5) == y).all()
