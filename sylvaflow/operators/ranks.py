"""Exact ranks and quantiles of large groups.

``percentile`` and rank windows put a whole group into one task. Here the
values of a group are first counted (map-side combine), then split into value
buckets of a given width: a prefix sum over the few buckets of a group and one
over the distinct values of a bucket give the exact rank of every value. A
group with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.session import cut_lineage


#: Up to this many groups are sent to the rows of their group; more are joined by key.
FEW_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with what is known of their group; ``groups`` has a row per group and is already written.

    A shuffle by few groups, such as the dates of a unit, puts all rows of one into a task,
    and AQE takes no broadcast where most shuffle partitions are empty.
    """
    few = groups.count() <= FEW_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, list(keys), how)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """All rows numbered from 1 in a total order, without a task that sees them all.

    The rows are sorted into range partitions and kept; a row's number is its
    place inside its partition plus the rows of the partitions before it. Only
    the sizes of the partitions, one row each, meet in one task.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    out = placed.withColumn("_part", part).join(starts, "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def ordered_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    width: float | None,
    *,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per distinct value: for every name of ``sums`` the sum at the value,
    ``<name>_below`` over smaller values of the group and ``<name>_total``.

    With a ``width`` the buckets are intervals of the value. Without one they are the
    partitions of a range sort of the distinct values, which spreads any distribution
    evenly, also one without keys or with most of its values close to each other.
    """
    sums = dict(sums or {"n": F.lit(1)})
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    if width is None:
        counts = cut_lineage(counts.orderBy(*keys, value).withColumn("_bucket", F.spark_partition_id()))
    else:
        counts = counts.withColumn("_bucket", F.floor(F.col(value) / F.lit(float(width))))
    bucket = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_b_{n}") for n in sums])
    for n in sums:
        totals = totals.withColumn(f"_before_{n}", F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)))
        totals = totals.withColumn(f"{n}_total", F.sum(f"_b_{n}").over(group))
    out = counts.join(totals, [*keys, "_bucket"])
    for n in sums:
        inside = F.coalesce(F.sum(n).over(bucket), F.lit(0))
        out = out.withColumn(f"{n}_below", F.col(f"_before_{n}") + inside)
    drop = ["_bucket", *[f"_b_{n}" for n in sums], *[f"_before_{n}" for n in sums]]
    return out.drop(*drop)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    width: float,
    *,
    weight: Column | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    ``weight`` is a row count when the input is already counted.
    """
    ranked = ordered_counts(df, keys, value, width, sums={"_c": weight if weight is not None else F.lit(1)})
    v, below, here, total = F.col(value), F.col("_c_below"), F.col("_c"), F.col("_c_total")
    aggs = [F.max("_c_total").alias("_n")]
    for name, p in probs.items():
        lo = F.floor(F.lit(p) * (total - 1))
        hi = F.least(lo + 1, total - 1)
        aggs.append(F.max(F.when((below <= lo) & (lo < below + here), v)).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((below <= hi) & (hi < below + here), v)).alias(f"_hi_{name}"))
    agg = ranked.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for name, p in probs.items():
        position = F.lit(p) * (F.col("_n") - 1)
        step = (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (position - F.floor(position))
        out.append((F.col(f"_lo_{name}") + step).alias(name))
    return agg.select(*out)


def several_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float, float]]
) -> DataFrame:
    """Quantiles of several columns in one pass: ``name -> (value, probability, width)``."""
    keys = list(keys)
    items = [
        F.struct(F.lit(n).alias("m"), (v.cast("double") / F.lit(float(w))).alias("v"))
        for n, (v, _p, w) in wanted.items()
    ]
    long = df.select(*keys, F.inline(F.array(*items)))
    probs = sorted({p for _v, p, _w in wanted.values()})
    names = {p: f"_q{i}" for i, p in enumerate(probs)}
    q = exact_quantiles(long, [*keys, "m"], "v", {names[p]: p for p in probs}, 1.0)
    return q.groupBy(*keys).agg(
        *[
            (F.max(F.when(F.col("m") == n, F.col(names[p]))) * F.lit(float(w))).alias(n)
            for n, (_v, p, w) in wanted.items()
        ]
    )


def robust_stats(
    df: DataFrame, keys: Sequence[str], value: str, width: float, *, min_rows: int, scale: float
) -> DataFrame:
    """Median and scaled median absolute deviation per group.

    Falls back to mean and population deviation when the MAD is zero; groups
    under ``min_rows`` values, or without any spread, have no row.
    """
    keys = list(keys)
    use = df.where(F.col(value).isNotNull()).select(*keys, value)
    moments = use.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    med = exact_quantiles(use, keys, value, {"median": 0.5}, width).join(moments, keys)
    # one row per group: written once, so that the second pass does not repeat the first
    med = cut_lineage(med.where(F.col("n") >= min_rows))
    deviation = join_groups(use, med, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_dev"))
    mad = exact_quantiles(deviation, keys, "_dev", {"mad": 0.5}, width)
    spread = F.col("mad") * F.lit(scale)
    robust = spread > 0
    out = med.join(mad, keys).select(
        *keys,
        F.when(robust, F.col("median")).otherwise(F.col("mean")).alias("centre"),
        F.when(robust, spread).otherwise(F.col("sd")).alias("scale"),
        "n",
    )
    return cut_lineage(out.where(F.col("scale") > 0))
