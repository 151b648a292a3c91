from __future__ import annotations

from cases import awkward, nothing

import corpus_pipeline
from sylvaflow.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0.5 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_awkward_and_empty_tables(spark):
    for make in (awkward, nothing):
        docs = make(spark)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == columns


def test_stages_after_the_scores_are_brute_force(spark, tmp_path):
    """Stages 2 to 5 on documents that the classifier kept, each against its plain version on its own input."""
    import random

    from test_decontaminate import best
    from test_packing_store import covered
    from test_search_join import brute_components
    from test_text_operators import brute_templates

    from sylvaflow.llm import decontaminate, templates
    from sylvaflow.llm.tokens import encoder

    rng = random.Random(31)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notice, items = line(11), {i: line(rng.randrange(16, 40)) for i in range(6)}
    texts = {}
    for d in range(140):
        body = [line(rng.randrange(12, 30)) for _ in range(rng.randrange(2, 6))]
        if d % 3 == 0:
            body.insert(1, notice)
        if d % 10 == 4:
            body.append(" ".join(rng.choice(words) if k % 8 == 7 else w for k, w in enumerate(items[d // 10 % 6].split())))
        texts[d] = "\n".join(body)
        if d % 7 == 5:  # a near copy, and a copy
            other = texts[d].split(" ")
            other[rng.randrange(len(other))] = "changed"
            texts[1000 + d], texts[2000 + d] = " ".join(other), texts[d]
    texts |= {500: None, 501: ""}
    rows = [(d, t, "en", f"s{d % 3}", None if t is None else len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    take = lambda df: {r.doc_id: r.text for r in df.collect()}

    lines = written(stages["line_dedup"](spark, docs, str(tmp_path)), "a")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    assert take(lines) == {k: t for (k, _), t in zip(given, brute_templates(given, templates.MIN_DOCS))}

    single = written(stages["near_duplicates"](spark, lines, str(tmp_path)), "b")
    groups = brute_components(take(lines).items())
    assert set(take(single)) == {k for k, (n, root) in groups.items() if n == 0 or root == k} and single.count() < lines.count() - 30

    clean = written(stages["decontamination"](spark, single, str(tmp_path)), "c")
    copied = lambda t: any(best(i.split(), t.lower().split()) >= decontaminate.THRESHOLD * 2 * len(i.split()) for i in items.values())
    held = {d for d, t in take(single).items() if copied(t or "")}
    assert set(take(clean)) == set(take(single)) - held and len(held) >= 8

    pieces = stages["packing"](spark, clean, str(tmp_path)).collect()
    library = encoder("word_bpe_49k.json", "word").library
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in take(clean).items()}
    _, by_doc = covered(pieces, ids.__getitem__)
    assert {k: sum(n for _, n in parts) for k, parts in by_doc.items()} == {k: len(v) for k, v in ids.items()}
