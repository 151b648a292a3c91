from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from cases import awkward, nothing

from sylvaflow.llm import spelling

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_counts(docs, damage):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, damage=False):
    counts = brute_counts(docs, damage)
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for a in counts:
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 2 * counts[a] else None
    out = {}
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        out[a] = (a, form[a], root, counts[a], len(near[a]), counts[form[a]] if form[a] else None)
    return out


def check(spark, df, damage=False):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = spelling.variants(df, damage).collect()
    want = brute(docs, damage)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want[r.word]
    return want


def random_texts(seed, letters, words, texts):
    pick = random.Random(seed)
    stems = ["".join(pick.choice(letters) for _ in range(pick.randrange(4, 10))) for _ in range(words)]
    out = {}
    for k in range(texts):
        line = []
        for _ in range(60):
            word = pick.choice(stems[: 1 + int(words * pick.random() ** 3)])
            if pick.random() < 0.4:
                at = pick.randrange(len(word) + 1)
                word = word[:at] + pick.choice([*letters, ""]) + word[at + pick.randrange(2) :]
            line.append(word.upper() if pick.random() < 0.1 else word)
        out[100 + k] = pick.choice([" ", "-", "1 "]).join(line)
    return out


def test_variants_against_all_pairs(spark):
    want = check(spark, awkward(spark, random_texts(1, "abé", 60, 120)))
    assert sum(v[1] is not None for v in want.values()) > 50 and any(v[2] != v[1] and v[1] for v in want.values())


def test_damage_and_wide_letters(spark):
    check(spark, awkward(spark, random_texts(2, "abcdefghijklmnopqrstuvwxyzàßÿÉ×", 120, 100)).repartition(3), damage=True)


def test_runs_of_one_letter_long_words_and_ties(spark):
    texts = ["aaaaa " * 4 + "aaaaaa " * 8 + "aaaaaaa " * 16 + "aabaa baaaa aaaab " * 4, "z" * 3000 + " "]
    texts += [" ".join(["y" * k] * 3) for k in (40, 41, 42, 300, 301)]
    texts += [" ".join([("abcdefghij" * 9)[:k] + tail] * n) for k, tail, n in ((60, "x", 3), (60, "y", 6), (60, "", 6), (30, "qq", 3))]
    texts += [texts[1] * 3, "w" * 2999 + "v " + "w" * 3000, ("w" * 3000 + " ") * 7, ("w" * 2999 + "v ") * 2]
    want = check(spark, awkward(spark, {50 + k: t for k, t in enumerate(texts)}))
    assert want["aaaaa"][2] == "aaaaaaa" and want["aabaa"][1] == "aaaaa" or want["aabaa"][4] >= 1
    assert want["w" * 2999 + "v"][1] == "w" * 3000


def test_no_words(spark):
    assert spelling.variants(nothing(spark)).count() == 0


def test_tables_that_grow_with_the_words_are_joined_by_key(spark, monkeypatch):
    plans, write = [], spelling.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(spelling, "written", seen)
    docs = spark.createDataFrame([*random_texts(3, "abcd", 40, 40).items()], "doc_id long, text string")
    for few in (0, spelling.FEW_STATES):
        plans.clear()
        monkeypatch.setattr(spelling, "FEW_STATES", few)
        out = spelling.variants(docs)
        plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
        sent = [name for name, plan in plans if "Broadcast" in plan]
        assert set(sent) <= ({"frontier"} if few else set()) and {"trie", "frontier", "forms", "roots", "out"} <= {name for name, _ in plans}
        assert len(sent) == (sum(name == "frontier" for name, _ in plans) - 1 if few else 0)  # the first level joins all seeds
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        assert {r.word: tuple(r[n] for n in NAMES) for r in out.collect()} == want
