from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvaflow.llm import common as C
from sylvaflow.llm.tokens import encoder

ODD = ["", None, "a b'sx 'S don't's THE''s ..'s", "x\n\n y  z \t\n", "  ", "ÀÉß123 45a_b-c'", "<|endoftext|> a", "a" * 300, "²³ \xa0x", "12'll3's\n\n\n", "İſ K", "🙂 漢字"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_is_the_library(name, kind):
    enc = encoder(name, kind)
    texts = ODD * 2
    want = [e.ids for e in enc.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in enc.encode(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabcAB'é.,!1_<|$", max_size=40), max_size=4))
def test_encoder_is_the_library_on_any_text(texts):
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        enc = encoder(name, kind)
        want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)] if texts else []
        assert [ids.tolist() for ids in enc.encode(texts)] == want


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_sorted_keys_round_trip(values):
    keys = np.sort(np.array(values, np.uint64))
    assert (C.unpack_sorted(C.pack_sorted(keys)) == keys).all()


def test_cut_points_agree_with_buckets():
    keys = np.sort(C.mix(np.arange(5000, dtype=np.uint64)))
    cut = C.cut_points(keys, 7)
    bucket = C.bucket_of(keys, 7).astype(int)
    assert all((bucket[cut[b] : cut[b + 1]] == b).all() for b in range(7)) and cut[-1] == len(keys)


def test_words_of_blocks():
    texts = ["The cat  sat\non the mat", None, "", "É the\x0bThe", "a" * 50 + " the", "the"] * 3
    found = {}
    for row, t in C.blocks(pa.array(texts, pa.large_string()), limit=40):
        h, at = C.words(t)
        for x, k in zip(h.tolist(), at.tolist()):
            found.setdefault(row + k, []).append(x)
    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = {k: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(table)) for k, t in enumerate(texts)}
    number = {}
    for k, w in words.items():
        assert len(found.get(k, [])) == len(w)
        for a, b in zip(found.get(k, []), w):
            assert number.setdefault(a, b) == b
    assert len(set(number.values())) == len(number)


def test_bitmap_has_every_id(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    some, none = C.split_marked(spark.range(0, 3000).withColumnRenamed("id", "k"), "k", C.id_bitmap(ids))
    left = {r.k for r in none.collect()}
    assert not left & {r.k for r in ids.collect()} and len(left) > 2400 and some.count() + len(left) == 3000
