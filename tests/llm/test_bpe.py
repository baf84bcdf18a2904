import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe
from factloom.llm.common import table, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def brute(text):
    lib = Tokenizer.from_file(PATH)
    ids = lib.encode(text or "", add_special_tokens=False).ids
    decoded = lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_table_equals_the_library(spark, small, messy, nothing):
    for docs in (table(spark, small, "documents"), messy):
        want = sorted(map(repr, ((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect())))
        assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.encode(docs).collect()) == want
    assert bpe.encode(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    lib = Tokenizer.from_file(PATH)
    ids = lib.encode(text, add_special_tokens=False).ids
    raw, decoded = CODEC.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert decoded == lib.decode(ids, skip_special_tokens=False)


CODEC = bpe.Codec(PATH, bpe.Transducer.build({w: [i] for i, w in enumerate(["zzzz"])}))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcé", max_size=6), st.lists(st.integers(0, 60_000), max_size=4), max_size=40), st.text("abcé", max_size=6))
def test_transducer_holds_its_words_and_no_others(entries, other):
    t = bpe.Transducer.mapped(bpe.Transducer.build(entries).to_bytes())
    for word, ids in entries.items():
        assert np.frombuffer(t.get(word), "<u4").tolist() == ids
    assert (t.get(other) is None) == (other not in entries)


def test_equal_suffixes_share_states():
    t = bpe.Transducer.build({f"{a}{b}tion": [1] for a in "abcdef" for b in "xyz"})
    assert len(t.final) <= 8


def test_special_strings():
    for text in ["<|endoftext|>", "a <|startoftext|>b", "x\x1cy", "Σας ΣΑΣ İ"]:
        raw, decoded = CODEC.encode(text)
        lib = Tokenizer.from_file(PATH)
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and decoded == lib.decode(ids, skip_special_tokens=False)
