import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm.common import table, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library():
    enc = packing.encoder(PATH)
    lib = Tokenizer.from_file(PATH)
    for text in ["", " ", "a  b", "x <|endoftext|> y  z", "\n\n a　b", "don't I'LL 123 ½", "日本語 ñandú \U0001f600", "<|endoftext|>"]:
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=80), st.integers(300, 600))
def test_dealt_windows_hold_everything_within_capacity(sizes, capacity):
    windows = packing.deal(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)


def test_differencing_balances():
    sizes = [8, 7, 6, 5, 4]  # the classical two-way case: 16 and 14
    sums = sorted(sum(sizes[i] for i in w) for w in packing.differencing(sizes, 2))
    assert sums == [14, 16]


def check(rows, docs):
    ids = {}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    for r in rows:
        ids.setdefault(r.doc_id, []).append(r)
    for doc, text in docs:
        own = np.array([*library_ids(text or ""), 0], "<u4")
        at = 0
        for p in sorted(ids[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    return by_sequence


def test_packs_a_table_whole_with_little_padding(spark, small):
    docs = table(spark, small, "documents")
    rows = packing.pack(docs).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    tokens = sum(r.length for r in rows)
    assert 1 - tokens / (1024 * len(sequences)) < 0.02


def test_messy_rows(spark, messy, nothing):
    rows = packing.pack(messy).collect()
    want = {}
    for r in messy.select("doc_id", "text").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(library_ids(r.text or "")) + 1
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert packing.pack(nothing).count() == 0
