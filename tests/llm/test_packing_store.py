from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from cases import awkward, nothing

from sylvaflow.llm import packing, token_store
from sylvaflow.llm.common import shared_folder
from sylvaflow.llm.tokens import encoder


def covered(pieces, ids_of):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        want = ids_of(p.doc_id)
        assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length] and p.doc_tokens == len(want)
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return by_sequence, by_doc


def test_pieces_cover_every_document(spark):
    docs = awkward(spark, {100 + i: f"filler number {i} " * (i % 40) for i in range(300)})
    enc = encoder("word_bpe_49k.json", "word")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {k: [*enc.library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    pieces = packing.pack_documents(docs.coalesce(1)).collect()
    by_sequence, by_doc = covered(pieces, ids.__getitem__)
    copies = docs.groupBy("doc_id").count().collect()
    for r in copies:
        assert sum(length for _, length in by_doc[r.doc_id]) == r["count"] * len(ids[r.doc_id])
    filled = sorted(sum(length for _, length in v) for v in by_sequence.values())
    assert all(n == 2048 for n in filled[1:])
    assert packing.pack_documents(nothing(spark)).count() == 0


def test_limits_hold_together(spark):
    rows = [(i, (i * 37) % 900, (i * 53) % 400) for i in range(500)] + [(900, 5000, 10), (901, None, None), (902, 10, 3000)]
    df = spark.createDataFrame(rows, "id long, t long, l long").coalesce(1)
    out = packing.pack_examples(df, "id", "t", "l", length=2048, segments=5, loss_tokens=700).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for group in by.values():
        over = any(r.over_limit for r in group)
        assert over == (len(group) == 1 and (group[0].tokens > 2048 or group[0].loss_tokens > 700))
        if not over:
            assert sum(r.tokens for r in group) <= 2048 and len(group) <= 5 and sum(r.loss_tokens for r in group) <= 700
    assert len(by) < 150  # 500 examples, at most five together


def test_store_round_trip_and_lookup(spark):
    docs = awkward(spark, {1000 - i: f"text {i} " * (i % 9) for i in range(200)})
    folder = shared_folder(spark, "ids")
    manifest = token_store.write_ids(docs, folder, shard_text=50_000)
    assert len(manifest) > 1
    got = token_store.read_ids(spark, folder, manifest).collect()
    enc = encoder("byte_bpe_50k.json", "byte")
    texts = docs.select("doc_id", "text").collect()
    want = {r.doc_id: [*enc.library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in texts}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r.doc_id is not None, r.doc_id or 0) for r in texts)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.start >= 0
    starts = sorted({(r.start, r.n_tokens) for r in got})
    for start, n in starts:
        assert start <= at or start == at
        at = max(at, start + n)
    keys = spark.createDataFrame([(k,) for k in (1, 2, 7, 900, 5555, -3, None)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_store.lookup_ids(keys, folder, manifest).collect()}
    for k in (1, 2, 7, 900):
        assert np.frombuffer(found[k], "<u4").tolist() == want[k]
    assert found[5555] is None and found[-3] is None and found[None] is None
    assert token_store.stored_ids(nothing(spark)).count() == 0


def test_perfect_hash_numbers_every_key_once():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.lookup(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).lookup(keys[:3]).tolist() == [-1, -1, -1]


def test_conversations_under_three_limits(spark):
    rows = [(c if c else None, t, ("system", "user", "assistant", None)[(c + t) % 4], None if (c * t) % 11 == 5 else f"turn {t} of {c} " * ((c * 7 + t * 3) % 40)) for c in range(160) for t in range(c % 6 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", __import__("pyspark").sql.functions.lit("x")).coalesce(2)
    enc = encoder("word_bpe_49k.json", "word")
    tokens, loss = defaultdict(int), defaultdict(int)
    for c, _, role, text in rows:
        n = len(enc.library.encode(text or "", add_special_tokens=False).ids) + 1
        tokens[c] += n
        loss[c] += n * (role == "assistant")
    out = packing.pack_conversations(df, length=1500, segments=7, loss_tokens=300).collect()
    assert {(r.conv_id, r.tokens, r.loss_tokens) for r in out} == {(c, tokens[c], loss[c]) for c in tokens} and len(out) == len(tokens)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    bound = Counter()
    for group in by.values():
        if group[0].over_limit:
            assert len(group) == 1 and (group[0].tokens > 1500 or group[0].loss_tokens > 300)
            continue
        at = 0
        for r in sorted(group, key=lambda r: (r.offset, r.tokens)):
            assert r.offset == at
            at += r.tokens
        used = (at, len(group), sum(r.loss_tokens for r in group))
        assert used[0] <= 1500 and used[1] <= 7 and used[2] <= 300
        bound.update(k for k, (u, most) in enumerate(zip(used, (1500, 7, 300))) if u > 0.9 * most)
    assert set(bound) == {0, 1, 2} or len(bound) >= 2  # more than one limit binds somewhere
    assert packing.pack_conversations(df.where("false")).count() == 0
