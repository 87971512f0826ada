"""Consecutive row numbers over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import stage

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_row_index(df: DataFrame, *order_cols, name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in the order of `order_cols` (together unique).

    A range shuffle sorts the data in parallel; the numbered rows are staged so that a retried
    task cannot renumber them; per-partition counts (one row per partition) give the offsets.
    """
    slot = F.col("__slot")
    ranged = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__slot", F.monotonically_increasing_id())
    )
    frozen = stage(ranged, "row-index").withColumn("__part", F.shiftright(slot, _SLOT_BITS))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        frozen.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    )
    within = slot.bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        frozen.join(F.broadcast(offsets), "__part")  # bounded by the number of shuffle partitions
        .withColumn(name, F.col("__offset") + within)
        .drop("__part", "__slot", "__offset")
    )
