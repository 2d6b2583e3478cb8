"""Row numbers of large groups: exact, in order, and without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """df with the number from 1 of each row of its group, and the group's size as ``total``.

    Rows are split into ranges of (group, order) and written with the number of their
    range, as ranges are sampled and may fall otherwise when they are computed again.
    Each range counts its rows on its own, and what stands before it is a sum over
    ranges, of which there are at most as many as partitions and groups. Equal rows in
    ``order`` are numbered in any order, so close it with a key. Null is a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*groups) if groups else F.lit(0)  # structs join on null fields too
    rows = written(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges").withColumn("_group", group)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_group")).alias("_total"))
    here = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order))
    out = rows.withColumn("_here", here).join(sizes, ["_group", "_part"]).withColumn(name, F.col("_before") + F.col("_here"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_group", "_part", "_here", "_before", "_total")
