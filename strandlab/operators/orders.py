"""Global orders and running sums without a single task: ranges are dealt out, sorted, and given their start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.session import written


def running(df: DataFrame, value: Column | str, order: list, by: list[str] | None = None, name: str = "below") -> DataFrame:
    """df with the sum of value over all rows that come before, in the order (which should have no ties), for each by.

    The rows are written once in ranges of (by, order); a row's sum is that of its range before it and that of the ranges
    before, a table of one row a range and by."""
    by = by or []
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(value) if isinstance(value, str) else value
    ranged = written(df.withColumn("_v", value).repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_v").over(before(Window.partitionBy("_part", *by).orderBy(*order))), F.lit(0))
    kinds = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    parts_ = ranged.groupBy(F.col("_part").alias("_p"), *kinds).agg(F.sum("_v").alias("_s"))
    start = F.coalesce(F.sum("_s").over(before(Window.partitionBy(*(f"_by{i}" for i in range(len(by)))).orderBy("_p"))), F.lit(0))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return ranged.withColumn("_in", inside).join(parts_.withColumn("_start", start), same).select(*df.columns, (F.col("_in") + F.col("_start")).alias(name))


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order, for each by."""
    return running(df, F.lit(1), order, by, name).withColumn(name, (F.col(name) + 1).cast("long"))
