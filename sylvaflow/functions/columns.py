"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities as null, so that comparisons with them are false."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clean_numbers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``finite`` on the given columns, by default on every float and double column."""
    kinds = (T.DoubleType, T.FloatType)
    names = set(columns or [f.name for f in df.schema if isinstance(f.dataType, kinds)])
    return df.select([finite(n).alias(n) if n in names else F.col(n) for n in df.columns])


def holds(predicate: Column) -> Column:
    """A predicate on a missing value does not hold."""
    return F.coalesce(predicate, F.lit(False))


def r6(c: Column | str) -> Column:
    return F.round(col(c).cast("double"), 6)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def lookup(c: Column | str, table: dict, default=None) -> Column:
    """Value of a small fixed table, as one ``when`` chain (no join)."""
    c, out = col(c), None
    for key, value in table.items():
        out = F.when(c == F.lit(key), F.lit(value)) if out is None else out.when(c == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def random_key(seed: int | str, name: Column | str) -> Column:
    """Stable key in [0, 1): 12 hex digits of SHA-256 of ``seed:name``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(name).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """``(condition, text)`` pairs to one text, only the first condition that holds."""
    out = None
    for condition, text in pairs:
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out
