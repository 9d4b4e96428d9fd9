"""Ranks and running aggregates in a total order of a whole table, by range partitions instead of one window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Every row with its rank from 1 in a total order, without a window over the whole table.

    Rows are range-partitioned and written; a rank is the number of rows in earlier partitions plus the place
    in its own. Only one count for each partition is gathered.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = dealt.withColumn("__place", place).join(F.broadcast(offsets), "__part")
    return ranked.withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__before", "__n")


def running(df: DataFrame, order: list[Column | str], value: str, name: str = "total", fold: Callable = F.sum) -> DataFrame:
    """Every row with `fold` (F.sum, F.min or F.max) of `value` over all rows up to it in a total order.

    Like `global_rank`: each partition's own running value is combined with the fold of the partitions before it.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    folded = dealt.groupBy("__part").agg(fold(value).alias("__s"))
    before = fold("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = folded.select("__part", before.alias("__before"))
    own = fold(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("__own", own).join(F.broadcast(offsets), "__part")
    both = F.filter(F.array("__own", "__before"), lambda x: x.isNotNull())
    joined = {F.sum: F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.min: F.array_min(both), F.max: F.array_max(both)}[fold]
    return met.withColumn(name, joined).drop("__part", "__own", "__before")
