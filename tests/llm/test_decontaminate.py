"""Decontamination against an alignment of every document with every item."""

from __future__ import annotations

import random

import numpy as np

from sylvaflow.llm import decontaminate


def best(item, passage):
    """Smith-Waterman score by the recurrence, a row at a time."""
    above, most = np.zeros(len(passage) + 1, int), 0
    words = np.array(passage, object)
    for w in item:
        row = [0] * (len(passage) + 1)
        same = words == w
        for j in range(1, len(row)):
            row[j] = max(0, above[j - 1] + (2 if same[j - 1] else -1), above[j] - 1, row[j - 1] - 1)
        above = row
        most = max(most, max(row))
    return most


def test_pairs_are_those_of_every_alignment(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(1500)]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: passage(rng.randrange(15, 45)) for i in range(14)}
    items[None] = passage(20)
    docs = {}
    for d in range(70):
        body = passage(60)
        if d % 2 == 0:
            copy = list(list(items.values())[d // 2 % len(items)])
            step = (3, 4, 8)[d % 3]
            if d % 5 == 0:
                copy = [rng.choice(words) if k % step == step - 1 else w for k, w in enumerate(copy)]  # every third word replaced
            else:
                copy = [w for k, w in enumerate(copy) if k % (step + 1)]  # words left out
            body[20:20] = copy
        docs[d] = " ".join(body)
    want = set()
    for d, text in docs.items():
        for i, item in items.items():
            if best(item, text.lower().split()) >= decontaminate.THRESHOLD * 2 * len(item):
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert len(want) >= 30 and any(i is None for _, i in want)
    kept = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert kept == set(docs) - {d for d, _ in want}


def test_common_short_items_remove_nothing(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["yes", "what", "is", "the", "capital", "of"] * 20
    docs = [(d, " ".join([*(rng.choice(words) for _ in range(30)), "yes what is the capital of"])) for d in range(400)]
    bench = spark.createDataFrame([(1, "yes"), (2, "what is the capital"), (3, "a sentence nobody else writes down")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (900, "we read: A sentence nobody else writes down.")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(900, 3)}
