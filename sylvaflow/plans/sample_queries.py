"""Queries on samples, allocations, weights and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions import scalars as C
from sylvaflow.functions.columns import r6
from sylvaflow.operators import samples as M
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, years_grid
from sylvaflow.plans.scalar_queries import KEY12
from sylvaflow.plans.stand_ins import table


def key_sql(seed, name):
    return KEY12.format(seed=seed, name=name)


def alloc_sql(src: str, out: str, total: str, least: int, stratum: str, groups: str = "", n: int = 1) -> str:
    """Floors, then the highest quotients; tables ``{out}`` (groups, stratum, n, share)."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""{out}_a AS (SELECT {g}{stratum}, n, least({least}, n) AS fl, least({total}, sum(n) OVER ({part})) AS target, sum(least({least}, n)) OVER ({part}) AS fls FROM {src}),
{out}_b AS (SELECT *, CASE WHEN fls <= target THEN fl ELSE 0 END AS base, target - CASE WHEN fls <= target THEN fls ELSE 0 END AS rest FROM {out}_a),
{out}_q AS (SELECT {g}{stratum}, n, base, rest, unnest(generate_series(1, CAST(n - base AS BIGINT))) AS i FROM {out}_b),
{out}_w AS (SELECT {g}{stratum}, count(*) AS won FROM (SELECT *, row_number() OVER ({part} ORDER BY n / (base + i)::DOUBLE DESC, {stratum}) AS r FROM {out}_q) z WHERE r <= rest GROUP BY ALL),
{out} AS (SELECT {g}{stratum}, n, CAST(base + coalesce(won, 0) AS BIGINT) AS share FROM {out}_b LEFT JOIN {out}_w USING ({g}{stratum}))"""


@query(
    "alloc_strata",
    f"WITH c AS (SELECT 'n' || s_nationkey AS stratum, count(*) AS n FROM supplier GROUP BY 1), {alloc_sql('c', 'al', '60', 2, 'stratum')} SELECT stratum, n, share FROM al",
)
def alloc_strata(spark, sf):
    c = table(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return M.allocate(c, 60, 2)


@query(
    "alloc_equal",
    """WITH c AS (SELECT n_regionkey AS stratum, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
q AS (SELECT stratum, unnest(generate_series(1, least(n, 18))) AS i FROM c), r AS (SELECT *, row_number() OVER (ORDER BY i, stratum) AS r FROM q)
SELECT c.stratum, n, coalesce(share, 0) AS share FROM c LEFT JOIN (SELECT stratum, count(*) AS share FROM r WHERE r <= 40 GROUP BY 1) w USING (stratum)""",
)
def alloc_equal(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return M.allocate_equal(s.groupBy(F.col("n_regionkey").alias("stratum")).agg(F.count(F.lit(1)).alias("n")), 40, cap=18)


@query(
    "keyed_sample",
    f"""WITH r AS (SELECT p_brand, p_partkey, {key_sql(3, 'p_partkey')} AS key FROM part), c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), {alloc_sql('c', 'al', '90', 1, 'p_brand')},
k AS (SELECT r.*, n, share, row_number() OVER (PARTITION BY p_brand ORDER BY key, p_partkey) AS rank FROM r JOIN al USING (p_brand))
SELECT p_brand, p_partkey, n AS n_population, rank, rank > share AS reserve FROM k WHERE rank <= least(n, share + CAST(ceil(share * 0.5) AS BIGINT))""",
)
def keyed_sample(spark, sf):
    from sylvaflow.functions.columns import random_key

    rows = table(spark, sf, "part").select("p_brand", "p_partkey").withColumn("key", random_key(3, F.col("p_partkey")))
    alloc = M.allocate(rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), 90, 1, stratum="p_brand")
    return M.take(rows, alloc, ["p_brand"], 140, reserve=0.5, tie=["p_partkey"]).drop("key")


@query(
    "lettered_ids",
    """WITH s AS (SELECT p_brand || '-U' || p_size AS base, p_partkey, p_retailprice AS area FROM part)
SELECT p_partkey, base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY base ORDER BY area DESC, p_partkey) AS INTEGER)) ELSE '' END AS stand_id FROM s""",
)
def lettered_ids(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("-U"), F.col("p_size")).alias("base"), F.col("p_retailprice").alias("area"))
    return M.lettered_ids(s, "base", F.col("area").desc(), ["p_partkey"]).select("p_partkey", "stand_id")


def candidate_rows(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    sub = C.sub_stratum(F.year("o_orderdate").cast("string"), F.lit("2001"), F.col("o_totalprice") % 1, F.col("o_totalprice") % 9)
    return o.select(F.concat(F.lit("u"), F.col("o_custkey") % 8).alias("unit"), F.when(F.col("o_orderstatus") == "F", "di").otherwise("other").alias("stratum"), sub.alias("sub"), F.concat(F.lit("c"), k).alias("cand_id"),
                    (k % 40).alias("ix0"), (k % 33).alias("iy0"), F.lit(1).alias("nx"), F.lit(1).alias("ny"))


CANDS = """cd AS (SELECT 'u' || (o_custkey % 8) AS unit, CASE WHEN o_orderstatus = 'F' THEN 'di' ELSE 'other' END AS stratum,
  concat_ws('-', CASE WHEN year(o_orderdate) = 2001 THEN 'last' ELSE 'earlier' END, CASE WHEN o_totalprice % 1 >= 0.9 THEN 'high' ELSE 'low' END, CASE WHEN o_totalprice % 9 >= 5 THEN 'large' WHEN o_totalprice % 9 >= 1 THEN 'medium' ELSE 'small' END) AS sub,
  'c' || o_orderkey AS cand_id, o_orderkey % 40 AS ix0, o_orderkey % 33 AS iy0 FROM orders)"""
SEEDS = f"""{CANDS}, us AS (SELECT unit, stratum, sub, count(*) AS n FROM cd GROUP BY ALL), {alloc_sql('us', 'al', "CASE WHEN stratum = 'di' THEN 30 ELSE 20 END", 1, 'sub', 'unit, stratum')},
sd AS (SELECT c.*, n, share, {key_sql(5, 'cand_id')} AS key FROM cd c JOIN al USING (unit, stratum, sub)),
drawn AS (SELECT *, share / n::DOUBLE AS incl_prob FROM (SELECT *, row_number() OVER (PARTITION BY unit, stratum, sub ORDER BY key, cand_id) AS r FROM sd) z WHERE r <= share)"""


def seeds(spark, sf):
    c = candidate_rows(spark, sf)
    shares = c.select("unit", "stratum").distinct().withColumn("share", F.when(F.col("stratum") == "di", 30).otherwise(20))
    return M.seed_windows(c, shares, 5, 30)


@query("seed_windows", f"WITH {SEEDS} SELECT unit, stratum, sub, cand_id, {s6('incl_prob', 'incl_prob')} FROM drawn")
def seed_windows(spark, sf):
    return seeds(spark, sf).select("unit", "stratum", "sub", "cand_id", r6("incl_prob").alias("incl_prob"))


@query(
    "draw_windows",
    f"""WITH {SEEDS}, one AS (SELECT *, CASE stratum WHEN 'di' THEN 1 ELSE 2 END AS pr, {key_sql(5, "('stage:' || cand_id)")} AS sk FROM drawn QUALIFY row_number() OVER (PARTITION BY unit, ix0, iy0 ORDER BY CASE stratum WHEN 'di' THEN 1 ELSE 2 END, key, cand_id) = 1)
SELECT printf('W%04d', row_number() OVER (ORDER BY pr, unit, key, cand_id)) AS window_id, unit, stratum, cand_id, CASE WHEN row_number() OVER (PARTITION BY unit, stratum ORDER BY sk, cand_id) <= CASE stratum WHEN 'di' THEN 4 ELSE 2 END THEN 1 ELSE 2 END AS stage FROM one""",
)
def draw_windows(spark, sf):
    w = M.merge_windows(seeds(spark, sf), {"reviewed": 0, "di": 1, "other": 2, "quiet": 3}, stage1={"di": 4, "other": 2}, seed=5)
    return w.select("window_id", "unit", "stratum", "cand_id", "stage")


@query(
    "quiet_chips",
    f"""WITH {YGRID}, pc AS (SELECT row, col, arg_min(forest, t) AS f, bool_or(chm_cover >= 0.9 AND t > 0) AS r FROM yg GROUP BY row, col), ch AS (SELECT col // 8 AS ix, row // 8 AS iy, count(*) AS n, avg(f::INT) AS fs, avg(r::INT) AS rs FROM pc GROUP BY ALL),
cb AS (SELECT l_orderkey * 7 % 64000 AS minx, l_orderkey * 7 % 64000 + l_linenumber AS maxx, l_partkey * 13 % 5000 AS miny, l_partkey * 13 % 5000 + 2 AS maxy FROM lineitem)
SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM ch WHERE n = 64 AND fs >= 0.4 AND rs <= 0.2 AND NOT EXISTS (SELECT 1 FROM cb WHERE floor((minx - 1.5) / 8) <= ix AND ix <= floor((maxx + 1.5) / 8) AND floor((miny - 1.5) / 8) <= iy AND iy <= floor((maxy + 1.5) / 8))""",
)
def quiet_chips(spark, sf):
    g = years_grid(spark, sf).withColumn("probability", F.col("chm_cover"))
    line = table(spark, sf, "lineitem")  # boxes over a wider area than the grid
    x, y = F.col("l_orderkey") * 7 % 64000, F.col("l_partkey") * 13 % 5000
    boxes = line.select(F.lit("g").alias("unit"), x.alias("minx"), (x + F.col("l_linenumber")).alias("maxx"), y.alias("miny"), (y + 2).alias("maxy"))
    return M.quiet_chips(g, boxes, 8, 1.5, forest_share=0.4, raised_share=0.2, weak=0.9).select("ix", "iy")


def objects(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    y = F.year("o_orderdate")
    return o.select(F.concat(F.lit("u"), F.col("o_custkey") % 12).alias("unit"), k.alias("object_id"), C.interval_label(y - 1, y).alias("interval"), (k % 3 == 0).alias("growth"), y.alias("onset_year"))


OBJECTS = """ob AS (SELECT 'u' || (o_custkey % 12) AS unit, o_orderkey AS object_id, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS interval, o_orderkey % 3 = 0 AS growth FROM orders)"""


@query(
    "sample_by_interval",
    f"""WITH {OBJECTS}, c AS (SELECT unit, interval, count(*) AS n FROM ob GROUP BY ALL), {alloc_sql('c', 'al', '25', 2, 'interval', 'unit')},
r AS (SELECT ob.*, n, share, row_number() OVER (PARTITION BY unit, interval ORDER BY {key_sql(9, "(unit || ':' || object_id)")}, object_id) AS rank FROM ob JOIN al USING (unit, interval))
SELECT unit, object_id, interval, n AS n_population, rank FROM r WHERE rank <= share""",
)
def sample_by_interval(spark, sf):
    return M.sample_by_interval(objects(spark, sf), 25, 2, 9).select("unit", "object_id", "interval", "n_population", "rank")


@query(
    "extend_sample",
    f"""WITH {OBJECTS}, po AS (SELECT unit, object_id, {key_sql(4, "(unit || ':' || object_id)")} AS key, {key_sql('4:order', "(unit || ':' || object_id)")} AS mix FROM ob WHERE NOT growth), rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY key, object_id) AS r FROM po),
b1 AS (SELECT unit, object_id, row_number() OVER (ORDER BY mix, unit, object_id) AS "order", 1 AS batch FROM rk WHERE r <= 3),
b2 AS (SELECT unit, object_id, (SELECT max("order") FROM b1) + row_number() OVER (ORDER BY mix, unit, object_id) AS "order", 2 AS batch FROM rk WHERE r BETWEEN 4 AND 6),
al AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
SELECT printf('R%03d', "order") AS sample_id, unit, object_id, batch, {s6('count(*) OVER (PARTITION BY unit) / (SELECT count(*) FROM po p WHERE p.unit = al.unit)::DOUBLE', 'incl_prob')} FROM al""",
)
def extend_sample(spark, sf):
    o = objects(spark, sf)
    first = M.extend_sample(o, None, 3, 4, exclude_growth=True)
    return M.extend_sample(o, first, 6, 4, exclude_growth=True).select("sample_id", "unit", "object_id", "batch", r6("incl_prob").alias("incl_prob"))


@query(
    "hand_picked",
    f"WITH {OBJECTS} SELECT printf('X%03d', 2 + row_number() OVER (ORDER BY unit, object_id)) AS sample_id, unit, object_id, 1000002 + row_number() OVER (ORDER BY unit, object_id) AS \"order\" FROM ob",
)
def hand_picked(spark, sf):
    return M.hand_picked(objects(spark, sf), 2).select("sample_id", "unit", "object_id", F.col("order").cast("long").alias("order"))


AGENT = ["harvest", "wind", "fire", ""]
TYPES = ["clearcut", "thinning", "wind", "fire", "mining", "flood"]
STATUS = ["accepted", "rejected", "rejected_weak", "disagree", "date_disputed", "failed"]


def audit_population(spark, sf):
    from sylvaflow.plans.verdict_queries import pick

    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(F.concat(F.lit("w"), F.col("o_custkey") % 90).alias("window_id"), (k % 4000).alias("cand_id"), pick(STATUS, k % 4000).alias("status"), pick(TYPES, F.floor(k % 4000 / 7)).alias("change_type"),
                    pick(AGENT, F.floor(k % 4000 / 11)).alias("agent"), (1.0 / (F.col("o_custkey") % 90 + 1)).alias("incl_prob"), F.concat(k % 4 + 2, F.lit("")).alias("images"))


def audit_windows(spark, sf):
    from sylvaflow.plans.verdict_queries import pick

    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 90).alias("w")).agg(F.max(F.col("o_totalprice") % 100).alias("m"))
    return o.select(F.concat(F.lit("w"), "w").alias("window_id"), pick(["di", "other", "quiet"], F.col("w")).alias("stratum"), (1.0 / (F.col("w") + 1)).alias("incl_prob"), (F.col("m") > 99.5).alias("complete"))


def _audit_sql(accepted: int = 30, rejected: int = 40, p: str = "") -> str:
    """Items of a draw as the table ``{p}items``; the names of all its tables begin with ``p``."""
    import re

    from sylvaflow.plans.verdict_queries import sql_pick

    k = "(o_orderkey % 4000)"
    text = f"""pp AS (SELECT 'w' || (o_custkey % 90) AS window_id, {k} AS cand_id, {sql_pick(STATUS, k)} AS status, {sql_pick(TYPES, f'({k} // 7)')} AS ctype, {sql_pick(AGENT, f'({k} // 11)')} AS agent, 1.0 / (o_custkey % 90 + 1) AS ip, CAST(o_orderkey % 4 + 2 AS VARCHAR) AS images FROM orders),
vw AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY {key_sql('0:audit', "(window_id || ':' || cand_id)")}, window_id) = 1),
sb AS (SELECT *, CASE WHEN status = 'accepted' THEN 'accepted' WHEN status LIKE 'rejected%' THEN 'rejected' WHEN status IN ('disagree', 'date_disputed') THEN 'disagree' END AS stratum,
  CASE WHEN status = 'accepted' THEN 'accepted_' || CASE WHEN ctype IN ('thinning', 'wind') THEN 'diffuse' ELSE 'other' END || '_' || coalesce(nullif(agent, ''), 'mixed') ELSE status END AS sub FROM vw WHERE status <> 'failed'),
pt AS (SELECT *, CASE WHEN sub LIKE 'accepted_diffuse%' THEN 'd' WHEN stratum = 'accepted' THEN 'o' ELSE stratum END AS part FROM sb), cn AS (SELECT part, sub, count(*) AS n FROM pt GROUP BY ALL),
ca AS (SELECT * FROM cn WHERE part IN ('d', 'o')), cb AS (SELECT * FROM cn WHERE part NOT IN ('d', 'o')), {alloc_sql('ca', 'aa', str(accepted), 3, 'sub', 'part')}, {alloc_sql('cb', 'ab', f"CASE WHEN part = 'rejected' THEN {rejected} ELSE 20 END", 1, 'sub', 'part')},
sh AS (SELECT * FROM aa UNION ALL SELECT * FROM ab),
ci AS (SELECT 'cand' AS kind, 1 AS block, stratum, sub, window_id, CAST(cand_id AS VARCHAR) AS cand_id, n, share, row_number() OVER (PARTITION BY part, sub ORDER BY {key_sql('0:audit', 'cand_id')}, cand_id) AS rank, CAST(cand_id AS VARCHAR) AS nm FROM pt JOIN sh USING (part, sub)),
wn AS (SELECT o_custkey % 90 AS w, max(o_totalprice % 100) > 99.5 AS ok FROM orders GROUP BY 1), ww AS (SELECT 'w' || w AS window_id, {sql_pick(['di', 'other', 'quiet'], 'w')} AS sub FROM wn WHERE ok), wc AS (SELECT sub, count(*) AS n FROM ww GROUP BY 1), {alloc_sql('wc', 'aw', '60', 1, 'sub')},
wi AS (SELECT 'window' AS kind, 2 AS block, 'background' AS stratum, sub, window_id, '' AS cand_id, n, share, row_number() OVER (PARTITION BY sub ORDER BY {key_sql('0:audit', 'window_id')}, window_id) AS rank, window_id AS nm FROM ww JOIN aw USING (sub)),
al AS (SELECT *, rank > share AS reserve FROM (SELECT * FROM ci UNION ALL SELECT * FROM wi) z WHERE rank <= least(n, share + CAST(ceil(share * 0.5) AS BIGINT))),
nu AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY reserve, {key_sql('0:audit:order', 'nm')}, cand_id, window_id) AS ord FROM al),
items AS (SELECT CASE block WHEN 1 THEN 'C' ELSE 'B' END || lpad(CAST(ord AS VARCHAR), 3, '0') AS item, kind, stratum, sub, window_id, cand_id, n AS n_population, rank, reserve, block, ord, nm,
  stratum IN ('accepted', 'background') AND NOT reserve AND count(*) FILTER (stratum IN ('accepted', 'background') AND NOT reserve) OVER (PARTITION BY block ORDER BY ord) <= 30 AS shared FROM nu)"""
    names = [*re.findall(r"(?:^|,\s)(\w+) AS \(", text)]
    return re.sub(r"\b(" + "|".join(sorted(set(names), key=len, reverse=True)) + r")\b(?!')", lambda m: p + m.group(1), text) if p else text


ITEM_COLUMNS = "item, kind, stratum, sub, window_id, cand_id, n_population, rank, reserve, shared"


@query("audit_items", f"WITH {_audit_sql()} SELECT {ITEM_COLUMNS} FROM items")
def audit_items(spark, sf):
    a = M.audit_items(audit_population(spark, sf), audit_windows(spark, sf))
    return a.select("item", "kind", "stratum", "sub", "window_id", "cand_id", "n_population", "rank", "reserve", "shared")


@query(
    "extended_items",
    f"""WITH {_audit_sql(15, 20, 'o_')}, {_audit_sql()}, la AS (SELECT block, max(ord) AS last FROM o_items GROUP BY block),
fr AS (SELECT n.*, row_number() OVER (PARTITION BY block ORDER BY reserve, {key_sql('0:audit:order', 'nm')}, cand_id, window_id) AS place FROM items n ANTI JOIN o_items o ON o.kind = n.kind AND o.window_id = n.window_id AND o.cand_id = n.cand_id)
SELECT item, kind, window_id, cand_id, ord AS "order", shared FROM o_items
UNION ALL SELECT CASE fr.block WHEN 1 THEN 'C' ELSE 'B' END || lpad(CAST(place + coalesce(last, 0) AS VARCHAR), 3, '0'), kind, window_id, cand_id, place + coalesce(last, 0), FALSE FROM fr LEFT JOIN la ON la.block = fr.block""",
)
def extended_items(spark, sf):
    p, w = audit_population(spark, sf), audit_windows(spark, sf)
    old = M.audit_items(p, w, {**P.AUDIT, "n_accepted": 30, "n_rejected": 20})
    return M.extend_items(old, M.audit_items(p, w)).select("item", "kind", "window_id", "cand_id", "order", "shared")


@query(
    "draw_patches",
    f"""WITH p AS (SELECT 'u' || (o_custkey % 15) AS unit, 'p' || o_orderkey AS patch FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY {key_sql('0:audit', "('model_only:' || patch)")}, patch) AS rank FROM p)
SELECT unit, patch, n AS n_population, rank, rank > 2 AS reserve FROM r WHERE rank <= 3""",
)
def draw_patches(spark, sf):
    p = table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey") % 15).alias("unit"), F.concat(F.lit("p"), F.col("o_orderkey")).alias("patch"))
    return M.draw_patches(p, 2, 1, 0).select("unit", "patch", "n_population", "rank", "reserve")


def places(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    y = F.year("o_orderdate")
    return o.select(F.format_string("L%06d", k).alias("loc_id"), F.col("o_orderpriority").alias("stratum"), C.interval_label(y - 1, y).alias("interval"), (F.col("o_totalprice") % 5000).alias("x"), (k % 4000).cast("double").alias("y"))


PLACES = "pl AS (SELECT printf('L%06d', o_orderkey) AS loc_id, o_orderpriority AS stratum, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS interval, o_totalprice % 5000 AS x, (o_orderkey % 4000)::DOUBLE AS y FROM orders)"


@query(
    "round_robin",
    f"""WITH {PLACES}, t AS (SELECT *, row_number() OVER (PARTITION BY stratum, interval ORDER BY {key_sql(2, 'loc_id')}, loc_id) AS turn FROM pl), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, interval) AS pick FROM t)
SELECT loc_id, stratum, interval, pick FROM p WHERE pick <= 10""",
)
def round_robin(spark, sf):
    return M.round_robin(places(spark, sf), 10, 2).select("loc_id", "stratum", "interval", "pick")


@query(
    "near_points",
    f"""WITH {PLACES}, pt AS (SELECT s_name AS name, s_acctbal % 5000 AS px, (s_suppkey * 37 % 4000)::DOUBLE AS py FROM supplier)
SELECT loc_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS point FROM pl JOIN pt ON abs(x - px) <= 30 AND abs(y - py) <= 30 WHERE (x - px) * (x - px) + (y - py) * (y - py) <= 900 GROUP BY loc_id""",
)
def near_points(spark, sf):
    pt = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") % 5000).alias("x"), (F.col("s_suppkey") * 37 % 4000).cast("double").alias("y"))
    return M.near_points(places(spark, sf), pt, 30.0)


@query(
    "sample_weights",
    f"""WITH s AS (SELECT o_orderkey, 'u' || (o_custkey % 12) AS unit, (o_orderkey % 50) / 1000.0 AS loss, 'r' || (o_orderkey % 3) AS run FROM orders), g AS (SELECT *, CASE WHEN loss >= 0.01 THEN 'loss' WHEN run = 'r1' THEN 'run' ELSE 'rest' END AS g FROM s),
u AS (SELECT *, pow(count(*) OVER (PARTITION BY g, unit), -0.5) AS raw FROM g)
SELECT o_orderkey, round(CASE g WHEN 'loss' THEN 0.5 WHEN 'run' THEN 0.1 ELSE 0.4 END * raw / sum(raw) OVER (PARTITION BY g) * 1000000, 4) + 0.0 AS weight_ppm FROM u""",
)
def sample_weights(spark, sf):
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("u"), F.col("o_custkey") % 12).alias("unit"), (k % 50 / 1000.0).alias("loss_share"), F.concat(F.lit("r"), k % 3).alias("run"))
    return M.sample_weights(s, run_draws={"r1": 0.1}).select("o_orderkey", F.round(F.col("weight") * 1000000, 4).alias("weight_ppm"))


@query(
    "unit_split",
    f"""WITH u AS (SELECT DISTINCT 'u' || (o_custkey % 23) AS unit FROM orders), f AS (SELECT unit, (row_number() OVER (ORDER BY {key_sql(6, 'unit')}, unit) - 1) % 5 AS fold FROM u)
SELECT unit, fold, CASE WHEN unit IN ('u3', 'u7') THEN 'test' WHEN fold = 2 THEN 'val' ELSE 'train' END AS side, count(*) AS n FROM (SELECT 'u' || (o_custkey % 23) AS unit FROM orders) o JOIN f USING (unit) GROUP BY ALL""",
)
def unit_split(spark, sf):
    s = table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey") % 23).alias("unit"))
    folds = M.unit_folds(s, 5, 6)
    return M.make_split(s, folds, 2, ["u3", "u7"]).groupBy("unit", "side").agg(F.count(F.lit(1)).alias("n")).join(folds, "unit").select("unit", F.col("fold").cast("long").alias("fold"), "side", "n")


@query(
    "assign_blocks",
    f"""WITH c AS (SELECT l_orderkey % 60 AS ix, l_partkey % 40 AS iy, count(*) FILTER (l_quantity > 30) AS harvest, count(*) FILTER (l_quantity < 10) AS fire FROM lineitem GROUP BY ALL),
u AS (SELECT *, 'u' || (ix // 20) AS unit, ix // 3 || '_' || iy // 3 AS w FROM c), k AS (SELECT w, min(ix) AS x, min(iy) AS y FROM u GROUP BY w),
d AS (SELECT u.*, unit || ':' || x // 8 || ':' || y // 8 AS block FROM u JOIN k USING (w)), t AS (SELECT sum(harvest) AS h, sum(fire) AS f FROM d),
b AS (SELECT block, unit, round(coalesce(sum(harvest) / nullif(any_value(h), 0)::DOUBLE, 0), 12) AS h, round(coalesce(sum(fire) / nullif(any_value(f), 0)::DOUBLE, 0), 12) AS f FROM d, t GROUP BY block, unit),
m AS (SELECT *, CASE WHEN greatest(h, f) <= 0 THEN -1 WHEN h >= f THEN 0 ELSE 1 END AS main FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY unit, main ORDER BY {key_sql(0, 'block')}, block) AS n, {key_sql('0:start', "unit || ':' || main")} AS s FROM m),
v AS (SELECT d.*, floor(n * 0.2::DOUBLE + s) > floor((n - 1) * 0.2::DOUBLE + s) AS val FROM d JOIN r USING (block)),
z AS (SELECT a.unit, a.harvest, CASE WHEN a.val THEN 'val' WHEN EXISTS (SELECT 1 FROM v b WHERE b.val AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1) THEN 'dropped' ELSE 'train' END AS side FROM v a)
SELECT unit, side, count(*) AS chips, sum(harvest) AS harvest FROM z GROUP BY ALL""",
)
def assign_blocks(spark, sf):
    line = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    chips = line.groupBy((k % 60).alias("ix"), (F.col("l_partkey") % 40).alias("iy")).agg(
        F.count(F.when(F.col("l_quantity") > 30, 1)).alias("harvest"), F.count(F.when(F.col("l_quantity") < 10, 1)).alias("fire"), F.min("l_suppkey").alias("s")
    )
    chips = chips.select(F.concat_ws("_", "ix", "iy").alias("chip_id"), F.concat(F.lit("u"), F.floor(F.col("ix") / 20)).alias("unit"), F.concat_ws("_", F.floor(F.col("ix") / 3), F.floor(F.col("iy") / 3)).alias("window_id"), F.lit(32616).alias("epsg"), "ix", "iy", "harvest", "fire")
    return M.assign_blocks(chips, ["harvest", "fire"]).groupBy("unit", "side").agg(F.count(F.lit(1)).alias("chips"), F.sum("harvest").alias("harvest"))


@query(
    "central_blocks",
    """WITH b AS (SELECT 'u' || (p_partkey % 7) AS unit, p_partkey // 7 % 20 * 4 AS row, p_partkey // 140 * 4 AS col FROM part), d AS (SELECT *, round(sqrt((row + 2 - 40) * (row + 2 - 40) + (col + 2 - 28) * (col + 2 - 28)), 9) AS d FROM b)
SELECT unit, row, col, rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d, row, col) AS rank FROM d) z WHERE rank <= 6""",
)
def central_blocks(spark, sf):
    p = F.col("p_partkey")
    b = table(spark, sf, "part").select(F.concat(F.lit("u"), p % 7).alias("unit"), (F.floor(p / 7) % 20 * 4).alias("row"), (F.floor(p / 140) * 4).alias("col"), F.lit(4).alias("rows"), F.lit(4).alias("cols"), F.lit(80).alias("grid_rows"), F.lit(56).alias("grid_cols"))
    return M.central_blocks(b, 6).select("unit", "row", "col", "rank")


@query(
    "choose_pairs",
    """WITH p AS (SELECT 'w' || (l_suppkey % 25) AS window_id, l_partkey % 30 AS chip_id, l_linenumber % 4 AS k, count(*) FILTER (l_quantity > 46) AS loss, round(avg(CASE WHEN l_quantity < 20 THEN 1.0 ELSE 0.0 END), 6) AS ignored FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY loss DESC, chip_id, k) <= 2 AND loss > 0 AS a FROM p),
b AS (SELECT *, NOT a AND row_number() OVER (PARTITION BY window_id, a ORDER BY ignored DESC, chip_id, k) = 1 AND ignored > 0.2 AS b FROM a),
q AS (SELECT *, NOT a AND NOT b AND loss = 0 AS q FROM b), r AS (SELECT *, CASE WHEN a THEN 'loss' WHEN b THEN 'ignored' WHEN q AND row_number() OVER (PARTITION BY window_id, q ORDER BY ignored, chip_id, k) = 1 THEN 'quiet' END AS why FROM q)
SELECT window_id, chip_id, k, why FROM r WHERE why IS NOT NULL""",
)
def choose_pairs(spark, sf):
    q = F.col("l_quantity")
    p = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("w"), F.col("l_suppkey") % 25).alias("window_id"), (F.col("l_partkey") % 30).alias("chip_id"), (F.col("l_linenumber") % 4).alias("k")).agg(
        F.count(F.when(q > 46, 1)).alias("loss"), F.round(F.avg((q < 20).cast("double")), 6).alias("ignored")
    )
    return M.choose_pairs(p).select("window_id", "chip_id", "k", "why")


