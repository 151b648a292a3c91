"""Token ids of whole texts with the public vocabularies of the ``tokenizers`` library.

A text is split into the pieces that the tokenizer encodes one by one, and
each different piece is encoded by the library once per worker. Texts with
characters outside ASCII and the Latin-1 letters, or with the opening mark of
a special token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np

from sylvaflow.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LATIN = "à-öø-ÿß"
UNUSUAL = re.compile("[^\\x20-\\x7e\n\t\rÀ-ÖØ-öø-ÿ]|<\\|")
KEPT_PIECES = 700_000  # about 130 MB; then a worker starts anew
RUN_CHARS = 1 << 19  # characters of texts that are encoded together; a longer text is a run of its own
NONE = np.zeros(0, np.int64)
LONG_PIECE = 64

#: How a vocabulary splits text, with lower case only for the word vocabulary; fixed by the tokenizer files.
SPLITS = {
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\\sa-z{LATIN}0-9]+"),
    "byte": re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\\s+(?!\\S)|\\s+"),
}


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or one of twice the length or more that holds ``n`` items."""
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Encoder:
    """Ids of texts; ``kind`` is ``word`` for a vocabulary with word ends in lower case, ``byte`` for a byte-level one."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.split = SPLITS[kind]
        if kind == "word":
            self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
            for piece, number in self.library.get_vocab().items():
                self.ends[number] = piece.endswith("</w>")
        else:
            self.line_feed = self.library.encode("\n", add_special_tokens=False).ids[0]
            self.blank = np.zeros(self.library.get_vocab_size(), dtype=bool)  # ids that begin with a blank, and so begin a piece
            for piece, number in self.library.get_vocab().items():
                self.blank[number] = piece.startswith("Ġ")
        self.forget()

    def forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)  # a piece that is asked for gets the next number
        self.known = 0  # numbers whose ids are in the arrays
        self.first = np.zeros(1 << 12, np.int64)  # all three grow by doubling
        self.size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other and how many each has, many pieces per call of the library.

        Pieces are joined by a character that ends a piece, or by nothing where each begins
        with a blank, and cut again at the ids that show it; a group that does not come
        apart into its pieces is encoded piece by piece.
        """
        spaced = self.kind == "byte" and pieces[0][0] == " "
        step, glue = (400, "") if spaced else (200, " " if self.kind == "word" else "\n")
        groups = [pieces[i : i + step] for i in range(0, len(pieces), step)]
        flat, sizes = [], []
        for group, ids in zip(groups, self.whole([glue.join(g) for g in groups])):
            if spaced:
                start = np.flatnonzero(self.blank[ids])
                size, own = np.diff(np.append(start, len(ids))), ids
                whole = len(start) == len(group) and start[0] == 0
            elif self.kind == "word":
                stop = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else NONE
                size, own = np.diff(np.append(0, stop)), ids
                whole = len(stop) == len(group) and (not len(ids) or stop[-1] == len(ids))
            else:
                at = np.flatnonzero(ids == self.line_feed)
                size, own = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1, ids[ids != self.line_feed]
                whole = len(at) == len(group) - 1
            if not whole:
                each = self.whole(group)
                size, own = np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)
            flat.append(own)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self) -> None:
        """Ids of the pieces that were numbered since the last call."""
        pieces = list(islice(self.place, self.known, None))
        if not pieces:
            return
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])  # with a blank, without, to be encoded each on its own
        for k, piece in enumerate(pieces):
            kinds[2 if len(piece) > LONG_PIECE or piece.isspace() else piece[0] != " "].append(k)
        flat, sizes, order = [], [], []
        for kind, mine in enumerate(kinds):
            if not mine:
                continue
            some = [pieces[k] for k in mine]
            if kind < 2:
                ids, size = self._joined(some)
            else:
                each = self.whole(some)
                ids, size = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            flat.append(ids)
            sizes.append(size)
            order += mine
        new, size, at = np.concatenate(flat), np.concatenate(sizes), self.known + np.array(order, np.int64)
        number = self.known + len(pieces)
        self.first, self.size, self.flat = _room(self.first, number), _room(self.size, number), _room(self.flat, self.used + len(new))
        self.first[at] = self.used + np.cumsum(size) - size
        self.size[at] = size
        self.flat[self.used : self.used + len(new)] = new
        self.known, self.used = number, self.used + len(new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text; null is taken as empty.

        Texts go in runs of bounded length: one lookup of all their pieces, then one gather of all their ids.
        """
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, length = at + 1, len(texts[at] or "")
            while end < len(texts) and length + len(texts[end] or "") <= RUN_CHARS:
                length += len(texts[end] or "")
                end += 1
            out += self._encode_run(texts[at:end])
            at = end
        return out

    def _encode_run(self, texts: list[str]) -> list[np.ndarray]:
        if self.known > KEPT_PIECES:
            self.forget()
        split, number = self.split.findall, self.place.__getitem__
        lower, whole, found = self.kind == "word", [], []
        for k, text in enumerate(texts):
            if not text:
                found.append(NONE)
            elif UNUSUAL.search(text):
                whole.append(k)
                found.append(NONE)
            else:
                pieces = split(text.lower() if lower else text)
                found.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        self._learn()
        piece = np.concatenate(found)
        size = self.size[piece]
        upto = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.flat[np.repeat(self.first[piece] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[np.cumsum([len(f) for f in found])].tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        if whole:
            for k, own in zip(whole, self.whole([texts[k] for k in whole])):
                out[k] = own
        return out


def encoder(vocabulary: str, kind: str) -> Encoder:
    """The worker's encoder for a file, by path or by name of a public vocabulary."""

    def make() -> Encoder:
        if "/" in vocabulary:
            return Encoder(vocabulary, kind)
        import public_tokenizers

        return Encoder(public_tokenizers.path(vocabulary), kind)

    return held("tokens", (vocabulary, kind), make)
