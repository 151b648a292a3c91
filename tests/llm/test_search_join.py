from __future__ import annotations

import random
from collections import defaultdict

import pytest
from cases import SF, awkward, lower_words, nothing
from oracle import connect, difference

from sylvaflow.llm import ball_tree, parity_join
from sylvaflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = connect(SF).execute(ORACLES[name])
    message = difference(got, df.columns, cursor.fetchall(), [c[0] for c in cursor.description])
    assert message is None and got, message


def test_ball_tree_is_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.5, -0.25, 0.0, 0.5, 1.0)) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (600, [0.25, 0.5]), (700, [0.5, 0.5]), (800, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id")
    vectors = ball_tree.integer_vectors(df)
    got = ball_tree.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, shard_rows=40, group_shards=2, query_block=3).collect()
    clean = {r.vec_id: r.v for r in vectors.collect() if r.vec_id is not None}
    want = []
    for q in (k for k in clean if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(clean[q], v)), k) for k, v in clean.items() if k != q and len(v) == len(clean[q]))[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    empty = ball_tree.integer_vectors(df.where("false"))
    assert ball_tree.top_k(empty, empty, 10).count() == 0


def brute_components(docs):
    sets = {}
    for k, t in docs:
        w = lower_words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holds[g].append(k)
    pairs = defaultdict(int)
    for same in holds.values():
        for i, a in enumerate(same):
            for b in same[:i]:
                pairs[a, b] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def family(rng, words, copies, edits, first):
    base = [rng.choice(words) for _ in range(60 + first % 90)]
    out = {}
    for c in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out[first + c] = " ".join(text)
    return out


def test_join_is_brute_force_with_large_groups(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = {}
    texts.update(family(rng, words, 80, 3, 1000))  # many near copies: links and no links among them
    texts.update({2000 + i: passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for i in range(60)})  # a frequent passage
    for g in range(25):
        texts.update(family(rng, words, 3, 2, 3000 + 10 * g))
    texts.update({5000 + i: "short line again" for i in range(20)})
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(docs).collect()}
    assert got == brute_components(texts.items())


def test_join_of_awkward_rows(spark):
    docs = awkward(spark)
    got = parity_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[k].n_shingles == 0 and by[k].component_id == k for k in (1, 2, 3)) and by[4].n_shingles == 1 and by[6].n_shingles == 2
    assert parity_join.near_duplicates(nothing(spark)).count() == 0
    kept = parity_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, 9, None]))


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(2)
    for a, b in ((50, 60), (300, 200), (5, 1), (1000, 1000)):
        common = rng.integers(0, 2**63, 40).astype(np.uint64)
        x, y = np.unique(np.append(common, rng.integers(0, 2**63, a).astype(np.uint64))), np.unique(np.append(common, rng.integers(0, 2**63, b).astype(np.uint64)))
        s, t = parity_join.sketches(x, np.array([0, len(x)]))[0], parity_join.sketches(y, np.array([0, len(y)]))[0]
        assert parity_join.hamming(s, t) <= len(np.setxor1d(x, y)) and parity_join.hamming(s, s) == 0
