"""Outcome cells: counts and rates by dimension, with closed vocabularies and explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, null where nothing is counted."""
    return F.round(F.try_divide(part.cast("double"), whole), digits)


def sliced(df: DataFrame, dimensions: list[str], aggregates: list[Column], total: bool = True) -> DataFrame:
    """The same aggregates over each dimension on its own, in one pass: (dimension, key, ...).

    A null key is the group ``unknown``. With ``total`` also one row over all.
    """
    named = df.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in dimensions})
    sets = [[F.col(d)] for d in dimensions] + ([[]] if total else [])
    out = named.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.grouping_id().alias("_id"), *aggregates)
    n = len(dimensions)
    which = F.lit("all")
    for k, d in enumerate(dimensions):
        which = F.when(F.col("_id") == (2**n - 1) - 2 ** (n - 1 - k), d).otherwise(which)
    return out.withColumn("dimension", which).withColumn("key", F.coalesce(*dimensions, F.lit("all"))).drop("_id", *dimensions)


def zero_filled(df: DataFrame, key: str, vocabulary: list[str], count: str = "n") -> DataFrame:
    """Counts of a closed vocabulary; what is outside it is left out, what does not occur is 0."""
    known = df.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{key} string")
    found = df.filter(F.col(key).isin(vocabulary)).groupBy(key).agg(F.count("*").alias(count))
    return known.join(F.broadcast(found), key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def matrix(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Zero-filled counts of two closed vocabularies, one column a value."""
    known = df.sparkSession.createDataFrame([(v,) for v in rows], f"{row} string")
    found = df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(f"n_{k}") for k, c in enumerate(columns)])
    return known.join(found, row, "left").select(row, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in range(len(columns))])


def histogram(df: DataFrame, value: Column, width: int) -> DataFrame:
    return df.filter(value.isNotNull()).groupBy((F.floor(value / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
