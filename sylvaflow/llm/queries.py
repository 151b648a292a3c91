"""Queries of the training-data operators, each with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.llm import backoff_scores, ball_tree, decontaminate, language, merge_replay, packing, parity_join, quality, repeats, spelling, templates, token_store, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the document's id as text, modulo ``n``: the folds of the contract."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(remainder(5) != 0))
    return language.predict(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op2_line_templates")
def op2_line_templates(spark, sf_dir):
    cut = templates.drop_recurring(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op3_vector_packing")
def op3_vector_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("packed_conversations")
def packed_conversations(spark, sf_dir):
    """The three limits of the packing together, on instruction data; beside ``op3_vector_packing``."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


@query("op4_suffix_repeats")
def op4_suffix_repeats(spark, sf_dir):
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_token_store")
def op5_token_store(spark, sf_dir):
    found = token_store.stored_ids(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op7_ball_tree_topk", TOPK)
def op7_ball_tree_topk(spark, sf_dir):
    vectors = ball_tree.integer_vectors(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (na + nb - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN m USING (doc_id)"""


@query("op8_parity_join", NEAR)
def op8_parity_join(spark, sf_dir):
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_backoff_scores")
def op10_backoff_scores(spark, sf_dir):
    return backoff_scores.score_documents(table(spark, sf_dir, "documents"))


#: Table of the checksum for each byte, and the checksum of a string by it.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
  lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a string expression, over the table of ``CRC_TABLE``."""
    digits = f"hex(encode({text}))"
    at = f"list_transform(range(CAST(len({digits}) / 2 AS BIGINT)), lambda i: CAST(concat('0x', substr({digits}, 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {at}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


VARIANTS = f"""WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT run, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS key, count(*) AS c FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32_sql("key")} AS h FROM k, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT word, n, length(word) AS m FROM w WHERE length(word) >= 5 AND n >= 3),
d AS (SELECT word, n, m, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM v, LATERAL (SELECT unnest(range(1, m + 1)) AS i)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
g AS (SELECT a, count(*) AS n_near, max(n) AS best FROM p GROUP BY a),
f AS (SELECT p.a, min(p.b) AS form FROM p JOIN g ON g.a = p.a AND p.n = g.best GROUP BY p.a),
o AS (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.best >= 2 * v.n THEN f.form END AS form, CASE WHEN g.best >= 2 * v.n THEN g.best END AS form_n
  FROM v LEFT JOIN g ON g.a = v.word LEFT JOIN f ON f.a = v.word),
u(word, root, form) AS (SELECT word, word, form FROM o UNION ALL SELECT u.word, o.word, o.form FROM u JOIN o ON o.word = u.form)
SELECT o.word, o.form, u.root, o.n, CAST(o.n_near AS BIGINT) AS n_near, o.form_n FROM o JOIN u ON u.word = o.word AND u.form IS NULL"""


@query("op11_spelling_variants", VARIANTS)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), damage=True)


@query("op12_merge_replay")
def op12_merge_replay(spark, sf_dir):
    both = merge_replay.decode(merge_replay.encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


REPAIR = f"""WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
b AS (SELECT *, {crc32_sql("key")} % 20 AS code FROM c, crc),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM b WHERE code <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS shown FROM p),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN shown = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
a AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(q, k, q2, put) AS (VALUES (0, 0, 0, ''), (0, 1, 2, '|user:'), (0, 2, 3, '|user:|assistant:'), (1, 0, 1, ''), (1, 1, 2, '|user:'), (1, 2, 3, '|user:|assistant:'),
  (2, 0, 2, ''), (2, 1, 3, '|assistant:'), (2, 2, 2, '|assistant:|user:'), (3, 0, 3, ''), (3, 1, 2, '|user:'), (3, 2, 3, '|user:|assistant:')),
e(edit, initial, q, q2, cost, role) AS (VALUES ('D', NULL, 0, 0, 2, NULL), ('D', NULL, 1, 1, 2, NULL), ('D', NULL, 2, 2, 2, NULL), ('D', NULL, 3, 3, 2, NULL),
  ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
  ('R', NULL, 0, 2, 1, 'user'), ('R', NULL, 1, 2, 1, 'user'), ('R', NULL, 2, 3, 1, 'assistant'), ('R', NULL, 3, 2, 1, 'user')),
s(conv_id, i, q, best) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'put': ''}} FROM conversations
  UNION ALL SELECT s.conv_id, f.i, e.q2, min({{'cost': s.best.cost + 5 * ins.k + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': concat(s.best.audit, repeat('I', ins.k), e.edit),
    'put': concat(s.best.put, replace(ins.put, '|', chr(10)), CASE WHEN e.edit = 'D' THEN '' ELSE concat(chr(10), coalesce(e.role, f.role), ':', f.text) END)}})
  FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN ins ON ins.q = s.q
  JOIN e ON e.q = ins.q2 AND coalesce(e.initial, f.initial) = f.initial AND (e.edit = 'D' OR coalesce(f.fault, 'truncated') = 'truncated') GROUP BY s.conv_id, f.i, e.q2),
z AS (SELECT s.conv_id, min({{'cost': s.best.cost + 5 * ins.k, 'audit': concat(s.best.audit, repeat('I', ins.k)), 'put': concat(s.best.put, replace(ins.put, '|', chr(10)))}}) AS best
  FROM s LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM s.conv_id JOIN ins ON ins.q = s.q AND ins.q2 IN (0, 3) WHERE s.i = coalesce(a.rows, 0) GROUP BY s.conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(z.best.cost AS BIGINT) AS cost, z.best.audit AS audit, sha256(substr(z.best.put, 2)) AS repaired_sha256 FROM z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""


@query("op13_turn_repair", REPAIR)
def op13_turn_repair(spark, sf_dir):
    return turn_repair.summary(turn_repair.damaged(table(spark, sf_dir, "conversations")), F.col("present"))
