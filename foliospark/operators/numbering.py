"""Numbers from 1 in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored


def numbered(rows: DataFrame, *order: Column, name: str = "nth") -> DataFrame:
    """rows with their place in the order. They are sorted by ranges, and a range's numbers go on from those before it (one count for each range goes through the driver)."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts, start = [], 0
    for r, n in sorted(tuple(x) for x in ranged.groupBy("_range").count().collect()):
        counts.append((r, start))
        start += n
    starts = rows.sparkSession.createDataFrame(counts, "_range int, _start long")
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_start")
