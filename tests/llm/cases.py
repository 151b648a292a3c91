"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, rid string, bucket int, n long, start string"


def rows(texts: dict, lang=None) -> list[tuple]:
    return [(k, t, lang, None, None if t is None else len(t), 0.5, "x", "y", 1, 2, "z") for k, t in texts.items()]


def awkward(spark, texts: dict | None = None):
    """Documents with extra columns that clash with inner names: nulls, empties, one long text, repeated rows, a null id."""
    long_text = " ".join(f"word{i % 977} other{i % 13}" for i in range(20_000))
    base = {1: None, 2: "", 3: "  \n\t ", 4: "one", 5: "one two three four", 6: "one two three four five six", 7: long_text, 8: "Ünïcode ñandú 漢字 🙂 line\nsecond line of text here", 9: "12345 !!! ???"}
    made = rows({**base, **(texts or {})})
    made += [made[5], made[5], (None, "a text without an id that has some words", *made[0][2:])]
    return spark.createDataFrame(made, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(text: str | None) -> list[bytes]:
    import re

    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(table))
