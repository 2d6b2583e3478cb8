"""Sinks: group replacement that keeps the last good state, append-if-absent, idempotent batches, and counted copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_group(rows: DataFrame, path: str, group: str, value: str, allow_empty: bool = False) -> bool:
    """Replaces one group's partition; an empty refresh keeps what is there unless allowed. Other groups are untouched."""
    empty = rows.isEmpty()
    if empty and not allow_empty:
        return False
    if empty:
        fs_path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{group}={value}")
        fs_path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(fs_path, True)
        return True
    rows.withColumn(group, F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
    return True


def append_absent(rows: DataFrame, stored: DataFrame | None, path: str, key: str, text: str, limit: int = 6000) -> None:
    """Appends the keys that are not stored yet, with a non-empty text cut to ``limit``."""
    new = rows.filter(F.coalesce(text, F.lit("")) != "").dropDuplicates([key]).withColumn(text, F.substring(text, 1, limit))
    (new if stored is None else new.join(stored.select(key), key, "left_anti")).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed order of columns; missing ones are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def merged(current: DataFrame, updates: DataFrame, keys: list[str], keep_first: tuple = ()) -> DataFrame:
    """Upsert by key: supplied fields win where not null; fields in ``keep_first`` keep their first value."""
    fields = [c for c in current.columns if c not in keys]
    new = updates.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields if f in updates.columns])
    pick = lambda f: (F.coalesce(f, f"_{f}") if f in keep_first else F.coalesce(f"_{f}", f)) if f in updates.columns else F.col(f)
    return current.join(new, keys, "full_outer").select(*keys, *[pick(f).alias(f) for f in fields])


def copied(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Copies tables and returns a manifest of their rows before and after."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        after = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("after"))
        counts.append(df.agg(F.count("*").alias("before")).join(after).select(F.lit(name).alias("name"), "before", "after", (F.col("before") == F.col("after")).alias("verified")))
    return reduce(DataFrame.unionByName, counts)
