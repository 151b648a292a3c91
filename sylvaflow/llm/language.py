"""Language of a text: the family first, then one-versus-one linear support vector machines inside it.

A text is described by the shares of its hashed byte n-grams and words, so a
linear decision is the mean weight over the places of the whole text and one
pass over its bytes gives all decisions. The machines (squared hinge loss) are
trained on the driver from a bounded sample of labelled rows, whose features
the tasks make; weights go to the tasks as one table of fixed size.

Cases: ``und`` with score 0 for a text that is null or has no letter, and for
every text if no row can be learned from; repeated rows are predicted alike;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import blocks, prefix_hash, range_hash, small_batches, text_column, Texts, tidied, word_spans

DIMENSIONS = 1 << 13
SAMPLE_ROWS = 1600  # labelled rows learned from, over all languages
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"

# Languages by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8, one blank for white space and digits."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 32
    out[(data <= 32) | ((data >= 48) & (data <= 57))] = 32
    return out


def places(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature number and text of every n-gram and word of a block of texts; an n-gram may begin or end with a blank outside its text."""
    data = np.concatenate([[32], folded(texts.data)]).astype(np.uint8)
    prefix = prefix_hash(data)
    owner = np.zeros(len(data), np.int64)
    owner[texts.start[1:] + 1] = 1
    owner = np.cumsum(owner)
    blank = data == 32
    for n in GRAMS:
        start = np.arange(len(data) - n + 1)
        h = range_hash(prefix, start, start + n) + np.uint64(n)
        h ^= h >> np.uint64(29)
        number = (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 13)).astype(np.int64)
        middle = start + n // 2
        keep = ~blank[middle]
        yield number[keep], owner[middle[keep]]
    start, end = word_spans(data)
    h = range_hash(prefix, start, end) ^ np.uint64(0x5BD1E995)
    h ^= h >> np.uint64(29)
    yield (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 13)).astype(np.int64), owner[start]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1)
        for row, texts in blocks(text_column(batch), 1 << 20):
            rows = []
            for t in range(len(texts)):
                one = Texts(texts.data[texts.start[t] : texts.end[t] + 1], np.zeros(1, np.int64), np.array([texts.end[t] - texts.start[t]]))
                shares = np.zeros(DIMENSIONS, np.float32)
                for number, _ in places(one):
                    if len(number):
                        shares += np.bincount(number, minlength=DIMENSIONS) / len(number)
                rows.append(shares.tobytes())
            yield pa.record_batch([labels[row : row + len(texts)], pa.array(rows, pa.binary())], names=["lang", "shares"])


def train_machine(x: np.ndarray, sign: np.ndarray, strength: float = 1.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear machine by accelerated gradient steps on the squared hinge loss, both classes with equal weight."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    weight, sign = weight.astype(np.float32), sign.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead = w.copy()
    step = 1.0 / (2 * float((weight * ((x**2).sum(axis=1) + 1)).sum()) + 1e-3 / strength)
    for t in range(steps):
        gap = np.maximum(0.0, 1 - sign * (x @ ahead[:-1] + ahead[-1]))
        pull = weight * sign * gap * -2
        gradient = np.append(pull @ x + np.float32(1e-3 / strength) * ahead[:-1], pull.sum())
        new = ahead - np.float32(step) * gradient
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Columns of weights: one machine per family (its own against the rest), then one per pair of languages of a family."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.families = sorted({FAMILY_OF.get(x, x) for x in languages})
        self.members = {f: [x for x in languages if FAMILY_OF.get(x, x) == f] for f in self.families}
        self.pairs = [(f, a, b) for f in self.families for i, a in enumerate(self.members[f]) for b in self.members[f][i + 1 :]]

    @classmethod
    def train(cls, shares: np.ndarray, labels: np.ndarray) -> Model:
        languages = sorted(set(labels.tolist()))
        model = cls(languages, np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
        scale = 1 / np.sqrt(shares.mean(axis=0) + np.float32(1e-5))
        scale /= np.sqrt(((shares * scale) ** 2).sum(axis=1).mean())
        x = shares * scale
        family = np.array([FAMILY_OF.get(a, a) for a in labels.tolist()])
        tasks = [(np.ones(len(x), bool), family == f) for f in model.families]
        tasks += [((labels == a) | (labels == b), labels == a) for _, a, b in model.pairs]
        weights, bias = [], []
        for rows, yes in tasks:
            if yes[rows].all() or not yes[rows].any():
                w, b = np.zeros(DIMENSIONS), 1.0
            else:
                w, b = train_machine(x[rows], np.where(yes[rows], 1.0, -1.0))
            weights.append(w * scale)
            bias.append(b)
        return cls(languages, np.array(weights, np.float32).T.copy(), np.array(bias))

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of rows of margins: the best family, then the most votes of its pairs."""
        chance = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        nf = len(self.families)
        share = chance[:, :nf] / chance[:, :nf].sum(axis=1, keepdims=True)
        family = margin[:, :nf].argmax(axis=1)
        language, score = np.zeros(len(margin), np.int64), np.zeros(len(margin))
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            members = self.members[name]
            votes, worth = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
            for at, (f, a, b) in enumerate(self.pairs):
                if f == name:
                    p = chance[rows, nf + at]
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += (p >= 0.5) + 1e-3 * p
                    votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                    worth[:, i], worth[:, j] = np.minimum(worth[:, i], p), np.minimum(worth[:, j], 1 - p)
            best = votes.argmax(axis=1)
            language[rows] = np.array([self.languages.index(m) for m in members])[best]
            score[rows] = share[rows, k] * worth[np.arange(len(rows)), best]
        return language, score


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model from rows with text and lang: the same bounded number of each language, chosen by a hash of the key."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    got = chosen.select("text", "lang").mapInArrow(tidied(_features), "lang string, shares binary").toArrow()
    if not got.num_rows:
        return None
    labels = np.array(got["lang"].to_pylist())
    shares = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in got["shares"]])
    order = np.lexsort((shares[:, 1], shares[:, 0], labels))  # the rows may come in any order
    return Model.train(shares[order], labels[order])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``doc_id`` of every row of ``docs``; only the text is read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for row, texts in blocks(text_column(batch)):
                n = len(texts)
                letters = np.add.reduceat(np.append(LETTER[texts.data], False).astype(np.int32), texts.start)
                known = letters > 0
                for t in np.flatnonzero(~known).tolist():
                    known[t] = any(c.isalpha() for c in texts.data[texts.start[t] : texts.end[t]].tobytes().decode())
                if model is None or not known.any():
                    continue
                margin = np.zeros((n, len(model.bias)))
                for number, owner in places(texts):
                    first = np.searchsorted(owner, np.arange(n + 1))
                    count = np.diff(first)
                    some = np.flatnonzero(count)
                    if len(some):
                        for c in range(len(model.bias)):
                            margin[some, c] += np.add.reduceat(model.weights[:, c][number], first[some], dtype=np.float64) / count[some]
                language, score = model.decide(margin + model.bias)
                for t in np.flatnonzero(known).tolist():
                    names[row + t] = model.languages[language[t]]
                scores[row : row + n] = np.where(known, score, 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {key_type}, lang_pred string, score double")
