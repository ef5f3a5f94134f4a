"""Expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(values: Column, together: int = 256) -> Column:
    """For each of some whole numbers, their sum up to it.

    ``together`` at a time, so that what is there is not copied for each of
    very many.
    """
    none = F.expr("cast(array() as array<bigint>)")

    def add(done: Column, v: Column) -> Column:
        return F.struct((done["at"] + v).alias("at"), F.array_append(done["out"], done["at"] + v).alias("out"))

    def totals(values: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(values, k * together + 1, F.lit(together)), F.struct(done["at"].alias("at"), none.alias("out")), add)
            return F.struct(own["at"].alias("at"), F.array_append(done["out"], own["out"]).alias("out"))

        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / together).cast("int"))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<bigint>>)").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda x: x["out"]))

    return bound(values, totals)
