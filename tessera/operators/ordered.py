"""Order over whole tables and hot groups without a task that holds one: ordinals, predecessors and running sums by pieces of the order.

The rows are dealt by ranges of the order and kept with the number of their range; what a piece adds (its count or sum) is one row for each
range, or range and group, and is put before the pieces behind it. A group that holds a third of all rows lies in as many ranges as its size needs.
Rows that tie in all order columns are interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranged(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """The rows with ``_piece``, ascending along the order; persisted, since ranges come from a sample and must be the same in all uses."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()).persist()


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "ordinal", total: str | None = None, pieces: int | None = None) -> DataFrame:
    """Adds the number of each row in its group along the order, from 1, and with ``total`` the group's number of rows. Null is a group of its own."""
    dealt = ranged(df, [*group, *order], pieces)
    counts = dealt.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*group)  # a row for each piece that the group lies in
    before = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_piece").alias("_of"), F.coalesce(F.sum("_n").over(own.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_total"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.col("_piece") == F.col("_of"))
    i = F.row_number().over(Window.partitionBy(*group, "_piece").orderBy(*order))
    made = dealt.withColumn("_i", i).join(before, same)
    more = [F.col("_total").alias(total)] if total else []
    return made.select(*df.columns, (F.col("_before") + F.col("_i")).alias(out), *more)


def running(df: DataFrame, order: list[str], value: str, out: str, pieces: int | None = None) -> DataFrame:
    """Adds the sum of a value over all rows up to each one in the total order; null adds nothing. Only one number for each piece comes to the driver."""
    dealt = ranged(df, order, pieces)
    sums, before = sorted(dealt.groupBy("_piece").agg(F.coalesce(F.sum(value), F.lit(0)).alias("s")).collect()), []
    so_far = 0
    for r in sums:
        before.append((r["_piece"], so_far))
        so_far += r["s"]
    offsets = df.sparkSession.createDataFrame(before, "_piece int, _before long")
    here = F.coalesce(F.sum(value).over(Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return dealt.withColumn("_here", here).join(F.broadcast(offsets), "_piece").select(*df.columns, (F.col("_before") + F.col("_here")).alias(out))  # a row for each piece
