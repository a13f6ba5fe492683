"""Row numbers that do not put a whole group, or a whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def bucketed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """``row_number`` over (keys ordered by bucket, order) with the work split by bucket.

    ``bucket`` must be a non-decreasing function of the wanted order (or, for a shuffled
    order, any hash). Rows are numbered inside (keys, bucket); the rows of the earlier
    buckets are added from a table of bucket sizes, so a group that holds much of the
    table is spread over as many tasks as it has buckets. A row with a ``weight`` stands for that many
    rows, and has the number of the first of them.
    """
    part, group = F.struct(*keys, F.col("_bucket")), F.struct(*keys)
    rows = df.withColumn("_bucket", bucket).withColumn("_part", part)
    before = Window.partitionBy("_group").orderBy("_bucket")
    sizes = (
        rows.groupBy(group.alias("_group"), "_bucket", "_part")
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(before) - F.col("_size"))
        .select("_part", "_before")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    if weight is None:
        number = F.row_number().over(inside)
    else:
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        number = F.sum(weight).over(upto) - weight + 1
    return (
        rows.join(sizes, "_part", "left")
        .withColumn(name, number + F.col("_before"))
        .drop("_part", "_bucket", "_before")
    )


def global_row_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row in the total order by ``order``.

    The sort range-partitions the rows. Their places inside the partitions are frozen by
    writing the table once; one small table with a row per partition gives the offsets.
    """
    place = F.monotonically_increasing_id()
    frozen = materialize(df.sort(*order).withColumn("_place", place), "row-index")
    frozen = frozen.withColumn(
        "_pid", F.shiftright("_place", _ROWS_PER_PARTITION_BITS)
    ).withColumn("_offset", F.col("_place").bitwiseAND(F.lit((1 << _ROWS_PER_PARTITION_BITS) - 1)))
    sizes = frozen.groupBy("_pid").agg(F.count("*").alias("_size"))
    # One row per sort partition (spark.sql.shuffle.partitions), so one task is enough.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_pid")
    starts = sizes.select(
        "_pid", (F.sum("_size").over(earlier) - F.col("_size")).alias("_start")
    )
    return (
        frozen.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + F.col("_offset"))
        .drop("_pid", "_offset", "_start", "_place")
    )
