"""Places of rows within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostelry.functions.storage import cut


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 1) within ``keys`` by ``order``, computed once into shared storage.

    Rows are sorted in ranges of keys and order, and numbered by what the ranges before hold of the same keys, so
    a group of any size is dealt to many tasks.
    """
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = placed.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(f"_key{i}" for i in range(len(keys)))).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(held.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    numbered = placed.join(starts, (F.col("_range") == F.col("_of")) & same)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
