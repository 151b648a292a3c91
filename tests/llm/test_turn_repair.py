from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from sylvaflow.llm import turn_repair
from sylvaflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile("[^\x20\x09-\x0d]")


def planted(rows):
    """Damage of the contract, by plain loops; conversations without rows stay as empty lists."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = [c for c in text if BLANK.match(c)]
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_audit(turns, found):
    """All legal edit sequences with at most one insertion before a turn and two at the end, as (cost, audit, turns)."""
    def step(k, done, cost, audit):
        if k == len(turns):
            for more in ([], ["user"], ["assistant"], ["user", "assistant"]):
                yield cost + 5 * len(more), audit + "I" * len(more), done + [(r, "") for r in more]
            return
        for extra in ([], ["user"], ["assistant"]):
            start, paid, so_far = done + [(r, "") for r in extra], cost + 5 * len(extra), audit + "I" * len(extra)
            yield from step(k + 1, start, paid + 2, so_far + "D")
            if found[k] not in ("blank", "duplicate"):
                late = 5 if found[k] == "truncated" else 0
                yield from step(k + 1, start + [turns[k][1:]], paid + late, so_far + "K")
                for role in ("user", "assistant"):
                    yield from step(k + 1, start + [(role, turns[k][2])], paid + late + 1, so_far + "R")

    legal = re.compile("(s?(ua)+)?")
    return min((c, a, t) for c, a, t in step(0, [], 0, "") if legal.fullmatch("".join(r[:1] or "-" for r, _ in t)))


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    found = faults(turns)
    cost, audit, repaired = every_audit(turns, found)
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    text = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(got, want):
    assert sorted(map(str, want)) == sorted(str(r.conv_id) for r in got)
    for r in got:
        assert tuple(r[n] for n in NAMES) == expected(want[r.conv_id]), r


def test_random_conversations_against_all_edit_sequences(spark):
    pick = random.Random(5)
    texts = ["Yes.", "No!", "and then", "", " \t\n", None, "what?  ", "x. ", "é"]
    roles = ["user", "assistant", "system", "tool", None, "", "u", "agent"]
    rows = [(c if c else None, pick.choice([None, *range(6)]), pick.choice(roles if c % 3 else roles[:3]), pick.choice(texts)) for c in range(250) for _ in range(pick.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumn("audit", F.lit(1)).withColumn("code", F.lit("z")).withColumn("seen", F.lit(2)).withColumn("__of", F.lit(0))
    compare(turn_repair.summary(turn_repair.damaged(df), F.col("present")).collect(), planted(rows))
    plain = {}
    for conv, turn, role, text in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    compare(turn_repair.summary(df).collect(), plain)


def test_query_over_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_turn_repair"](spark, SF).collect()
    want = planted(rows)
    small = {k: v for k, v in want.items() if len(v) <= 4}
    assert len(got) == len(want) and len(small) > 5
    compare([r for r in got if r.conv_id in small], small)


def test_runs_give_what_single_turns_give():
    pick = random.Random(3)
    for _ in range(200):
        runs = [(pick.randrange(9), pick.randrange(1, 6)) for _ in range(pick.randrange(0, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        assert turn_repair.cheapest(runs) == turn_repair.cheapest(single)
    cost, audit = turn_repair.cheapest([(3, 5000), (5, 3), (0, 70_000)])
    assert len([e for e in audit if e != "I"]) == 75_003 and audit.endswith("D" * 70_000)
    turns = 0
    for edit in audit[: -70_000]:
        turns += edit != "D"
    assert cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I") and turns % 2 == 0


def test_one_long_conversation_and_none(spark):
    n = 30_000
    rows = [(1, k // 2, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(n)] + [(2, 0, "user", "same.")] * 5000
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    got = {r.conv_id: r for r in turn_repair.summary(df).collect()}
    # rows of a turn are ordered by role, so that the assistant stands first
    assert got[1].gaps == 0 and got[1].duplicate == 0 and len(got[1].audit.replace("I", "")) == n
    assert got[2].duplicate == 4999 and got[2].audit == "D" * 5000 and got[2].cost == 10_000
    chosen, turns = turn_repair.repair(df.where("conv_id = 2"))
    assert turns.count() == 0
    assert turn_repair.summary(df.where("conv_id = 3")).count() == 0
