"""Dense numbers over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order: Column | str, column: str = "n") -> DataFrame:
    """df with numbers from 0 in the given order; rows that are equal in it go by a hash of the whole row.

    Rows are dealt to ranges of the order and that hash, so that many rows of one key are several ranges, and numbered inside each;
    where a range begins is the sum of the counts before it, a row for each range. The ranges are kept, so that counts and
    numbers go by the same borders; what is lost with an executor is dealt again by them.
    """
    # Maps and variants have no hash; their JSON has.
    plain = lambda c, t: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`")
    order = (*order, F.xxhash64(*[plain(c, t) for c, t in df.dtypes]))
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    rows = dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return rows.withColumn(column, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
