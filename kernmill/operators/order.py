"""Global order without a single task: prefix sums and dense row numbers from
range partitions, their totals, and sums within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def prefix_sum(df: DataFrame, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """df with `name`: the sum of `value` over all rows that come before in the
    order, which must be total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: a second run of the range sampling might cut elsewhere
    dealt = cut(df.withColumn("_v", value).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    totals = dealt.groupBy("_p").agg(F.sum("_v").alias("_t"))  # a row a partition
    offsets = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_o"))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order)) - F.col("_v")
    return dealt.withColumn("_w", own).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_w")).drop("_p", "_v", "_w", "_o")


def dense_index(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with a row number from 0, ascending in a total order."""
    return prefix_sum(df, order, F.lit(1).cast("long"), name)


def sums_around(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """df with `before` and `after`: the sums of `value` over the rows that share `by` and come
    before, and after, in a total order of columns. The rows of one key may lie on any number of tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.withColumn("_v", value).repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()))
    down = [F.desc(c) for c in order]
    earlier = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tasks, rows = Window.partitionBy(*by), Window.partitionBy("_p", *by)
    totals = dealt.groupBy("_p", *by).agg(F.sum("_v").alias("_t"))  # a row a key and task
    outer = totals.select("_p", *by, earlier("_t", tasks.orderBy("_p")).alias("_b"), earlier("_t", tasks.orderBy(F.desc("_p"))).alias("_a"))
    own = dealt.withColumns({"before": earlier("_v", rows.orderBy(*order)), "after": earlier("_v", rows.orderBy(*down))})
    return own.join(outer, ["_p", *by]).withColumns({"before": F.col("_b") + F.col("before"), "after": F.col("_a") + F.col("after")}).drop("_p", "_v", "_b", "_a")
