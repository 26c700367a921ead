"""Positions and running sums over whole tables, without one task that holds them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.keeping import kept


def numbered(rows: DataFrame, *keys: Column | str, value: Column | None = None) -> DataFrame:
    """rows with number, their place in the order of keys from 1, and total, the running sum of a whole-numbered value.

    Rows are dealt by ranges of the keys, whose equals stay together; each range counts and sums its own, and only those
    figures, one row for each range, reach the driver, which adds up what stands before each. Rows whose keys are equal
    are numbered in no certain order, so keys should tell all apart.
    """
    value = F.lit(0) if value is None else value
    dealt = kept(rows.repartitionByRange(*keys).withColumns({"_value": value.cast("long"), "_part": F.spark_partition_id()}))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_value").alias("s")).orderBy("_part").collect()
    if not parts:
        return dealt.drop("_value", "_part").withColumns({"number": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    before = lambda name: F.element_at(F.create_map(*(F.lit(x).cast("long") for r, b in zip(parts, accumulate((r[name] for r in parts), initial=0), strict=False) for x in (r["_part"], b))), F.col("_part").cast("long"))
    order = Window.partitionBy("_part").orderBy(*keys)
    number = F.row_number().over(order) + before("n")
    total = F.sum("_value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before("s")
    return dealt.withColumns({"number": number.cast("long"), "total": total.cast("long")}).drop("_value", "_part")
