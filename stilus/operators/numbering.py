"""Numbers for rows in an order, without gathering them in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.storage import stage


def numbered(rows: DataFrame, name: str, *order: str, first: int = 1) -> DataFrame:
    """``rows`` with their place, from ``first``, as column ``name``: by ``order``, or as they are read if none is given.

    Rows are sorted by ranges and written with their place in their partition;
    what goes before a partition is one number each on the driver.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = sorted(held.groupBy(part.alias("part")).count().collect())
    before = accumulate((r["count"] for r in counts), initial=first)
    bases = rows.sparkSession.createDataFrame([(r.part, n) for r, n in zip(counts, before, strict=False)], "_part long, _base long")
    placed = held.join(F.broadcast(bases), part == F.col("_part"))
    return placed.withColumn(name, (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("int")).drop("_id", "_part", "_base")
