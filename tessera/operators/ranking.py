"""Row numbers within groups of any size: no group, and not the whole table, meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, parallelism


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """df with `name`: each row's place from 1 within its group `by`, in the given order (empty `by`: in the whole table).

    Rows are range-partitioned by group and order, numbered within each partition, and moved on by
    the group's rows in earlier partitions. Only the first group of a partition can have any, so the
    table of such offsets has at most a row for each partition and is broadcast. Nulls in `by` form a
    group; the order should be total, rows equal in it are numbered in no defined order. An empty
    table stays empty.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.withColumns(dict(zip(keys, map(F.col, by), strict=True))) if by else df
    n = partitions or parallelism(df.sparkSession)
    placed = cut_lineage(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_count"))
    # A row for each partition and group: the window holds at most `n` rows of a group.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_count").over(earlier)).where("_before > 0")
    offsets = offsets.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"{k}o") for k in keys), "_before")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}o")) for k in keys), F.col("_part") == F.col("_p"))
    joined = inside.join(F.broadcast(offsets), same, "left")  # at most n rows
    return joined.select(*df.columns, (F.col("_at") + F.coalesce("_before", F.lit(0).cast("bigint"))).alias(name))
