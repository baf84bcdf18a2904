import re

from factloom.llm import licences
from factloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    starts, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        if own:
            labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark, small, messy, nothing):
    for docs in (table(spark, small, "documents"), messy):
        want = sorted(map(repr, ((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect())))
        rows = licences.scan(docs).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows) == want
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1
    assert licences.scan(nothing).count() == 0


def test_the_index_adds_labels_where_key_phrases_stand(spark):
    texts = [
        "x y. This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0, under the MIT license",
        "gnu public work version 3 license",  # words without the key phrase
        "Released, under the MIT License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "plain words",
    ] + [f"other words {i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(6)] == ["gpl", "apache-2,mit", "", "mit", "bsd", ""]


def test_whole_licences_are_found_among_other_words(spark):
    texts = [f"some code here {i}\n/* Copyright 2020 someone. {text} */\nmore code" for i, (_, text, _) in enumerate(licences.TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts + ["nothing here", "the software as is of a and the license"] * 20)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score > 0.99
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(len(licences.TEMPLATES), len(got)))


def test_words_looked_up_are_enough():
    """Every place where a share reaches the threshold is proposed by the few words that are looked up."""
    import random

    rng = random.Random(3)
    filler = [f"f{i}" for i in range(50)]
    vocabulary = sorted({w for p in [*licences.PHRASES, *(t[1] for t in licences.TEMPLATES)] for w in licences.words_of(p)})
    index = licences.Index({w: rng.uniform(0.1, 8) for w in vocabulary}, 0.7, 2)
    for _ in range(150):
        words = []
        for _ in range(3):
            words += [rng.choice(filler).encode() for _ in range(rng.randint(0, 20))]
            own = list(rng.choice(index.templates).words)
            for _ in range(rng.randint(0, max(1, len(own) // 5))):
                own[rng.randrange(len(own))] = rng.choice(filler).encode()
            words += own
        found = index.scan(b" ".join(words).decode())
        every = {t.label for n, t in enumerate(index.templates) for at in range(-3, len(words)) if index.share(words, n, at) >= t.least * (1 - 1e-9) and index.stands(words, n, at)}
        assert every == set(filter(None, found[5].split(",")))
