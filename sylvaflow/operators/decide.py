"""The decision on change: rule, minimum size per interval and onset in one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.operators.cells import CELL, DATE
from sylvaflow.operators.components import interval_detections, min_cells
from sylvaflow.operators.null_model import decide_flags
from sylvaflow.session import cut_lineage


def decide(
    cells: DataFrame, dates: Sequence[int], rule_name: str = P.DECIDE["rule"], cell_m: float = P.GRAIN_M, *, z: str = "z", rule: Mapping = P.DECIDE, least: int | None = None, growth: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Decision of every cell and date, and the fit of every date.

    Adds to the flags and the probability of the rule: ``detected`` (the cell is in an object
    of at least ``least`` cells, or of ``growth`` cells beside an earlier kept object) and the
    first flagged and the first detected date of the cell, -1 where there is none.
    """
    least = min_cells(P.MMU_HA, cell_m) if least is None else least
    growth = min_cells(P.GROWTH_MMU_HA, cell_m) if growth is None else growth
    flags, fits = decide_flags(cells, rule_name, cell_m, z=z, rule=rule)
    flags = cut_lineage(flags)
    kept = interval_detections(flags.where("flag").select(*DATE, "row", "col"), dates, least=least, growth=growth)
    out = flags.join(kept.select(*DATE, "row", "col", F.lit(True).alias("detected")), [*DATE, "row", "col"], "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    whole = W.partitionBy(*CELL)
    first = lambda mark: F.coalesce(F.min(F.when(F.col(mark), F.col("t"))).over(whole), F.lit(-1))
    return out.withColumns({"onset_index": first("flag"), "onset_index_mmu": first("detected")}), fits
