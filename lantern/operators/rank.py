"""Places in a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.sources import shared


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row in ``order``.

    Rows are dealt into ranges of the order and written; each range is numbered by itself, after a sum over the ranges' sizes, of
    which there is one a partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = shared.written(ranged, shared.workspace(df.sparkSession), "ranged")
    sizes = ranged.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = ranged.withColumn("_number", number).join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return rows.withColumn(out, F.col("_number") + F.col("_before")).drop("_range", "_of", "_number", "_before")
