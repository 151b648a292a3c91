"""Spelling variants: words at one edit from each other, by a frontier of states that is joined with a trie level by level.

Both the words and their reversals form a trie, as a table of edges (node,
letter, child) with the letters that may follow the child; the end of a word
is an edge of its own. A state is (word, position, node, edits). Of an edit,
either the first half of the word or the rest stays whole, so a state without
edits begins at the node of that half: forward for edits behind it, in the
reversed trie for edits before it. These states lie on the word's own path,
so they are all known at the first level; joined with the edges of their node
they give the states with one edit (a letter replaced, put in or left out),
kept only where the next letter of the word may follow. Every further level
joins the frontier with the edges on (node, next letter). Words that are left
at the end of a state are near; the last join finds them by their whole text,
so that the hashes that name the nodes can never make a wrong neighbour.

A state carries the next ``AHEAD`` letters, not the whole word, so long words
cost in proportion to their length; a state that has come so far goes to the
last join at once. A node has at most as many edges as there are letters, so
the frontier grows with the words and not with their pairs; a hot node has its
states split by the skew join. Counts are taken per task before any shuffle.
Tables that grow with the words are joined by key: Spark sizes one that a task
makes by its input, or by its compressed file, and would send it to every task.
Only a counted frontier of a few states is sent.

Cases: null and empty texts have no words; a null ``doc_id`` counts as an
empty one in the key of the damage; rows are counted as often as they stand
there; other columns are ignored and may have any name; an empty table gives
an empty result. Of neighbours with equal counts the smaller word is the form.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import small_batches, tidied, written

LETTERS = re.compile("[a-zÀ-ÿ]+")  # after lowering A-Z
LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2  # a form is at least so many times as frequent
AHEAD = 16  # letters of a word that a state carries
END = "."  # the end of a word, which is no letter
COUNTED = 200_000  # different words that a task counts before it sends them on
FEW_STATES = 20_000  # open states that are sent to the edges (about 3 MB)
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
ROWS = 20_000


def damaged(run: str, prefix: int) -> str:
    """The run, without one of its letters where the checksum of its document (``prefix``) and itself is a multiple of 97."""
    h = zlib.crc32(run.encode(), prefix)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def by_key(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose two sides are shuffled, whatever size Spark takes them to be."""
    return left.join(right.hint("merge"), on, how)


def runs(text: str | None) -> list[str]:
    """Maximal runs of letters, with A-Z lowered and all else kept."""
    return LETTERS.findall(text.encode().lower().decode()) if text else []


def word_counts(docs: DataFrame, damage: bool = False) -> DataFrame:
    """``word`` and ``n`` over all documents, of words of enough letters and occurrences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(runs(text))
                if damage:
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        counts[damaged(word, prefix)] += n
                else:
                    counts.update(found)
                if len(counts) > COUNTED:
                    yield out()
        if counts:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(tidied(run), "word string, n long").where(F.char_length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- the two tries --------------------------------------------------------------


def path(word: str, back: bool) -> list[int]:
    """Nodes of all prefixes, the empty one first; each trie has a root of its own."""
    node, out = 2 + back, [2 + back]
    for letter in word:
        node = ((node ^ ord(letter)) * BASE + (node >> 29) + 1) & MASK
        out.append(node)
    return out


def signed(node: int) -> int:
    return node - (1 << 64) if node >> 63 else node


def _trie_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes: list[int] = []
    letters: list[str] = []
    children: list[int] = []

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(nodes, pa.int64()), pa.array(letters), pa.array(children, pa.int64())], names=["node", "letter", "child"])
        for column in (nodes, letters, children):
            column.clear()
        return made

    for batch in batches:
        for word in batch.column(0).to_pylist():
            for back in (False, True):
                text = word[::-1] if back else word
                line = [signed(n) for n in path(text, back)]
                nodes += line
                letters += [*text, END]
                children += [*line[1:], line[-1]]
            if len(nodes) > ROWS:
                yield out()
    if nodes:
        yield out()


def trie(words: DataFrame) -> DataFrame:
    """Edges of both tries: ``node``, ``letter``, ``child`` and ``after``, the letters that may follow the child."""
    edges = words.select("word").mapInArrow(tidied(_trie_edges), "node long, letter string, child long").distinct()
    after = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set("letter")).alias("after"))
    return by_key(edges, after, "child")


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["wid", "back", "at", "node", "ahead"]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    for batch in batches:
        for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for back in (False, True):
                text = word[::-1] if back else word
                nodes = path(text, back)
                half = len(word) // 2
                closed = text + END
                rows += [(wid, back, at, signed(nodes[at]), closed[at : at + AHEAD]) for at in range(len(word) - half if back else half, len(word) + 1)]
            if len(rows) > ROWS:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _letter(k: int) -> Column:
    return F.substring("ahead", k, 1)


def _may_follow(letter: Column) -> Column:
    """Whether the letter is among those after the child; no letter, where what a state carries is used up, always is."""
    return F.col("after").contains(letter)


def first_level(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit: ``wid``, ``back``, ``at``, ``edit`` (r, i or d), ``letter``, ``node``, ``ahead`` (what is still to be matched)."""
    x, y, z = _letter(1), _letter(2), _letter(3)
    other = (F.col("letter") != END) & (F.col("letter") != x)
    nothing = F.lit(None).cast("struct<edit:string,put:string,node:bigint,ahead:string>")

    def state(edit, put, ahead):
        return F.struct(F.lit(edit).alias("edit"), put.alias("put"), F.col("child").alias("node"), ahead.alias("ahead"))

    made = [
        F.when(other & (x != END) & _may_follow(y), state("r", F.col("letter"), F.substring("ahead", 2, AHEAD))).otherwise(nothing),
        F.when(other & _may_follow(x), state("i", F.col("letter"), F.col("ahead"))).otherwise(nothing),
        # the letter x is left out, and the edge is that of the next one
        F.when((x != END) & (x != y) & (F.col("letter") == y) & ((y == END) | _may_follow(z)), state("d", F.lit(""), F.substring("ahead", 3, AHEAD))).otherwise(nothing),
    ]
    joined = by_key(seeds, edges, "node").select("wid", "back", "at", F.explode(F.filter(F.array(*made), lambda s: s.isNotNull())).alias("s"))
    return joined.select("wid", "back", "at", "s.edit", "s.put", "s.node", "s.ahead")


def next_level(frontier: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """The frontier one letter further; states whose letters do not go on in the trie end here. ``few`` states go to the edges."""
    at, on = frontier.withColumn("letter", _letter(1)), ["node", "letter"]
    steps = F.broadcast(at).join(edges, on) if few else by_key(at, edges, on)
    stay = (F.col("letter") == END) | _may_follow(_letter(2))
    return steps.where(stay).select("wid", "back", "at", "edit", "put", F.col("child").alias("node"), F.substring("ahead", 2, AHEAD).alias("ahead"))


def edited(word: Column) -> Column:
    """The word after the edit of its state."""
    text = F.when(F.col("back"), F.reverse(word)).otherwise(word)
    rest = F.when(F.col("edit") == "i", F.col("at") + 1).otherwise(F.col("at") + 2)
    made = F.concat(F.substring(text, F.lit(1), F.col("at")), F.col("put"), F.substring(text, rest, F.char_length(text)))
    return F.when(F.col("back"), F.reverse(made)).otherwise(made)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n``: all pairs at exactly one edit, each in both orders; ``words`` has ``wid``, ``word``, ``n``.

    Each level is written to the shared folder; the levels end when no state is open, at the latest after ``AHEAD``.
    """
    edges = written(trie(words), "trie")
    seeds = words.select("wid", "word").mapInArrow(tidied(_seeds), "wid long, back boolean, at int, node long, ahead string")
    frontier = written(first_level(seeds, edges), "frontier")
    ended = [frontier.where("ahead = ''")]
    for _ in range(AHEAD):
        opened = frontier.where("ahead <> ''")
        n = opened.count()
        if not n:
            break
        frontier = written(next_level(opened, edges, n <= FEW_STATES), "frontier")
        ended.append(frontier.where("ahead = ''"))
    states = ended[0]
    for more in ended[1:]:
        states = states.unionByName(more)
    found = by_key(states, words.select("wid", "word"), "wid").select("word", edited(F.col("word")).alias("near")).distinct()
    return by_key(found, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def variants(docs: DataFrame, damage: bool = False) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word.

    A form is at least ``TIMES`` as frequent, so following forms ends after at
    most log2 of the largest count; every round doubles the steps.
    """
    words = written(word_counts(docs, damage).withColumn("wid", F.monotonically_increasing_id()), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = by_key(words, best, "word", "left")
    has = -F.col("best.minus") >= TIMES * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"),
    )
    formed = written(formed, "forms")
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log2(most)))
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("then"))
        up = written(by_key(up, further, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "roots")
    rooted = by_key(formed, up, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
