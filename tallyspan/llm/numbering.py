"""Dense numbers of rows in a stated order, without one task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep

#: Rows to a range, and the most ranges.
ROWS_A_RANGE = 200_000
RANGES = 20_000


def numbered(rows: DataFrame, order: list[Column], group: str, label: str, ranges: int | None = None) -> DataFrame:
    """rows with `number` (long, from 0 in each group, in the order given, which must begin with
    the group) and `_part`, the range that a row fell into. Rows are range-sorted; a range
    counts its rows; prefix sums over ranges, which are RANGES at most, number the rest. Rows that
    are equal in `order` are told apart by their place in the input, so that equal rows, however
    many, are split over ranges too. The sorted rows are stored once. Null groups are a group."""
    ranges = ranges or max(1, min(RANGES, -(-rows.count() // ROWS_A_RANGE)))
    keys = [*order, F.col("_tie").asc()]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = keep(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), label)
    # a group goes over some ranges, one after another; where it begins is its first row's place
    spans = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(F.col(group).alias("_group"), F.col("_part").alias("_range"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    here = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range"))
    return placed.join(spans, here).withColumn("number", F.col("_at") + F.col("_shift")).drop("_group", "_range", "_shift", "_at")
