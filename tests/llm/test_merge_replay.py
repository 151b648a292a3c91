from __future__ import annotations

import hashlib

import pytest
import tiktoken
from cases import awkward, nothing

from sylvaflow.llm import merge_replay
from sylvaflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

#: Words, white space and characters of many kinds next to each other; long runs of one letter and of pairs.
STRANGE = [
    "a" * 5000, "ab" * 3000, " " * 700, "\n\n\t  x", "it's we'll I'd 'S 'LL o'clock", "x\x1cy\x1d \x85z\xa0 w​v", "日本語 текст ελληνικά ١٢٣ ½²",
    "é \U0001f600\U0001f468‍\U0001f469 <|endoftext|> ", "ﬁ ǅ ʰ ª º    ﻿", "tthhee thethe ththth  the  \r\n \r\n", "\x00\x01\x7f", "1234567 12a34 _-_-__",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {word: k for k, word in enumerate(merge_replay.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_back(spark, library):
    docs = awkward(spark, {1000 + k: text for k, text in enumerate(STRANGE)})
    out = merge_replay.decode(merge_replay.encode(docs)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in docs.collect())
    for r in out:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]), texts[r.doc_id][:40]
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    assert merge_replay.decode(merge_replay.encode(nothing(spark))).count() == 0


def test_every_character_is_split_as_the_library_splits(library):
    import public_tokenizers

    encoder = merge_replay.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    characters = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}\n{c}" for c in characters]
    ids, size = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, size):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text), repr(text)
        at += n


def test_lower_rank_after_a_merge_is_replayed_one_by_one(tmp_path):
    import base64

    words = [bytes([b]) for b in range(256)] + [b"he", b"ere", b"the", b"ab", b"er", b"th", b"aba", b"bab", b"abab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % k for k, w in enumerate(words)))
    ranks = {w: k for k, w in enumerate(words)}
    own = merge_replay.Replay(str(path))
    library = tiktoken.Encoding("own", pat_str="[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    texts = ["there", "ababababa", "babababab", "heretherethth", "aabbabab", "thererere", "q"]
    assert [x.tolist() for x in own.ids([t.encode() for t in texts])] == [library.encode_ordinary(t) for t in texts]


def test_query_over_all_documents(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_merge_replay"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
