from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from cases import SF, awkward, lower_words, nothing

from sylvaflow.llm import backoff_scores, decontaminate, repeats, templates


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


@pytest.mark.parametrize("in_task", [2048, 1])
def test_repeats_are_brute_force(spark, monkeypatch, in_task):
    monkeypatch.setattr(repeats, "OPEN_IN_TASK", in_task)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    passage, other = make(700), make(450)
    texts = {}
    for i in range(120):
        t = make(rng.randrange(0, 900))
        if i % 3 == 0:
            a = rng.randrange(0, 250)
            t += passage[a : a + rng.randrange(395, 450)] + make(rng.randrange(60))
        if i % 7 == 0:
            t += other + other[:430]
        texts[i + 100] = t
    texts[500] = "ab" * 700  # periodic: strings that overlap themselves
    docs = awkward(spark, texts)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), kept, n) for r, (kept, n) in zip(rows, brute_repeats([r.text for r in rows], 400)))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed)) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    if in_task > 1:
        assert repeats.remove_repeats(nothing(spark)).count() == 0


def brute_templates(docs, min_docs):
    star = "*"
    lines = [(i, k, n, [star if any(c.isdigit() or c == "@" for c in w) else w for w in line.split()]) for i, (k, t) in enumerate(docs) for n, line in enumerate((t or "").split("\n"))]
    leaves = defaultdict(list)
    for i, k, n, w in lines:
        if len(w) >= templates.MIN_WORDS:
            leaves[(len(w), *w[:3])].append((i, k, n, tuple(w)))
    drop = set()
    for members in leaves.values():
        count = Counter(w for *_, w in members)
        made = []
        of = {}
        for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
            for j, m in enumerate(made):
                if sum(a == b for a, b in zip(m, w)) >= templates.ALIKE * len(w):
                    made[j] = [a if a == b else star for a, b in zip(m, w)]
                    of[w] = j
                    break
            else:
                of[w] = len(made)
                made.append(list(w))
        for j in range(len(made)):
            places = [m for m in members if of[m[3]] == j]
            if len({m[0] for m in places}) >= min_docs:
                home = min((m[1], m[0]) for m in places)[1]
                drop |= {(m[0], m[2]) for m in places if m[0] != home}
    return ["\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in drop) if t is not None else None for i, (_, t) in enumerate(docs)]


def test_templates_are_brute_force(spark):
    rng = random.Random(8)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notice = line(12)
    docs = []
    for i in range(90):
        body = [line(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 6))]
        if i % 2:
            body.insert(rng.randrange(len(body) + 1), notice)
        if i % 5 == 0:
            body.append(f"Copyright owner year {1900 + i} all rights reserved by user{i}@mail")
        if i % 4 == 0:
            changed = notice.split()
            changed[5] = f"changed{chr(97 + i % 26)}"
            body.append(" ".join(changed))
        if i % 9 == 0:
            body.append("so it goes")  # too short to be a template
        docs.append((i, "\n".join(body)))
    docs += [(200, None), (201, ""), (202, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", __import__("pyspark").sql.functions.lit(7).cast("long")).repartition(5)
    got = {r.doc_id: (r.text, r.n_chars) for r in templates.drop_recurring(df).collect()}
    want = brute_templates(docs, templates.MIN_DOCS)
    assert got == {k: (t, None if t is None else len(t)) for (k, _), t in zip(docs, want)}
    assert any(a[1] != b for a, b in zip(docs, want))


def test_templates_of_awkward_rows(spark):
    docs = awkward(spark)
    out = templates.drop_recurring(docs)
    assert out.columns == [*docs.columns, "n_dropped"] and out.count() == docs.count()
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert templates.drop_recurring(nothing(spark)).count() == 0


def test_leaf_with_many_lines_gets_more_levels(monkeypatch):
    import numpy as np

    monkeypatch.setattr(templates, "LEAF_LINES", 4)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (40, 8)).astype(np.uint64)
    words[:, :3] = 1
    number = templates.parse_leaf(words)
    assert (number >= 0).all() and len(set(number.tolist())) > 1


def test_size_of_a_leaf_does_not_change_its_templates(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    for width, values, n in ((4, 3, 60), (5, 4, 200), (8, 3, 400), (12, 4, 300), (12, 40, 900), (21, 3, 300)):
        words = rng.integers(1, values + 1, (n, width)).astype(np.uint64)
        some = rng.random((n, width)) < 0.5
        words[some] = np.broadcast_to(words[0], (n, width))[some]
        words[rng.random((n, width)) < 0.15] = templates.STAR
        words[:, :3] = 1
        made, want = [], []
        for w in words.tolist():
            j = next((j for j, m in enumerate(made) if sum(a == b for a, b in zip(m, w)) >= templates.ALIKE * width), len(made))
            made[j:] = [w] if j == len(made) else [[a if a == b else int(templates.STAR) for a, b in zip(made[j], w)], *made[j + 1 :]]
            want.append(j)
        for limit in (4, 10**9):
            monkeypatch.setattr(templates, "LEAF_LINES", limit)
            assert templates.parse_leaf(words).tolist() == want


def test_recurring_line_with_many_names_is_one_template(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = [(i, f"Failed login for {name(i)} from host alpha over the secure shell port\nbody {name(i)} of {name(i * 7 + 1)} {name(i * 5 + 2)} {name(i * 3)}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in templates.drop_recurring(df).collect()}
    assert sum("Failed login" in t for t in got.values()) == 1
    assert [got[i] for i, _ in docs] == brute_templates(docs, templates.MIN_DOCS)


def test_long_lines_recur_in_two_documents(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    own = {i: line(70) for i in range(30)}
    long, least, short, notice = line(80), line(templates.LONG_WORDS), line(templates.LONG_WORDS - 1), line(9)
    numbers = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(4)]
    edited = " ".join([*long.split()[:60], *line(20).split()])
    held = {0: [long], 1: [edited], 2: [least], 3: [least, long], 4: [short], 5: [short], 6: [short], 7: [short], **{i: [notice] for i in range(10, 15)}, **{20 + i: [x] for i, x in enumerate(numbers[:3])}, 23: [numbers[1]]}
    kept = {0: [long], 2: [least], 4: [short], 5: [short], 6: [short], 7: [short], 10: [notice], **{20 + i: [x] for i, x in enumerate(numbers[:3])}}
    text = lambda of, i: "\n".join([own[i], *of.get(i, [])])
    df = spark.createDataFrame([(i, text(held, i)) for i in own], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.text for r in templates.drop_recurring(df).collect()} == {i: text(kept, i) for i in own}


def test_planted_copies_are_found_and_clean_text_is_not(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)] + ["the", "of", "and"] * 200
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: passage(rng.randrange(15, 60)) for i in range(40)}
    docs, want = {}, set()
    for d in range(200):
        body = passage(150)
        if d % 4 == 0:
            i = d % 40
            copy = list(items[i])
            for _ in range(len(copy) // 8):  # edited: other words, dropped and added ones
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice(([rng.choice(words)], [], [copy[k], rng.choice(words)]))
            body[50:50] = [w.upper() for w in copy] if d % 8 == 0 else copy
            want.add((d, i))
        docs[d + 1000] = " ".join(body)
    want = {(d + 1000, i) for d, i in want}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "hi")], "item_id long, text string")
    df = awkward(spark, docs)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - len({d for d, _ in want})
    assert decontaminate.contaminated(nothing(spark), bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.clean(df, bench.where("false")).count() == df.count()


def test_benchmark_in_slices(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = [x for s in decontaminate.slices(bench) for x in s.ids]
    parts = list(decontaminate.slices(bench, slice_words=100))
    assert len(parts) > 1 and sorted(x for s in parts for x in s.ids) == sorted(whole)


def test_alignment_is_the_recurrence():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def brute_scores(texts):
    words = [lower_words(t) for t in texts]
    count = lambda ws: Counter(tuple(w[i : i + n]) for w in ws for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total, size = count(words), sum(map(len, words))
    out = []
    for w in words:
        own, score = count([w]), 0.0
        left = lambda g: total[g] - own[g]  # noqa: B023, E731
        for i in range(len(w)):
            most = min(3, i + 1)
            for n in range(most, -1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 0:
                    score += math.log(0.4) * most - math.log(size - len(w) + 1)
                elif left(g) > 0:
                    score += math.log(0.4) * (most - n) + math.log(left(g)) - math.log(left(g[:-1]) if n > 1 else size - len(w))
                    break
        out.append((len(w), score))
    return out


def test_scores_are_brute_force(spark):
    rng = random.Random(9)
    docs = awkward(spark, {100 + i: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60))) for i in range(150)})
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), n, round(s, 4)) for r, (n, s) in zip(rows, brute_scores([r.text for r in rows])))
    got = backoff_scores.score_documents(docs, chunk_text=3000, table_text=20_000).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 4)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert backoff_scores.score_documents(nothing(spark)).count() == 0
