"""Latest, previous and as-of rows per key, and runs of consecutive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str], newest: bool = True) -> DataFrame:
    """The values of each key's last (or first) row in ``order``: one partial aggregate, no sort."""
    pick = F.max_by if newest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rn") -> DataFrame:
    """At most n rows of each key; Spark keeps only n per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, until: str, values: list[str], ties: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is valid at ``at``: since <= at < until, the newest one.

    Both sides are merged in one sort per key, so nothing multiplies; the row
    that began last decides, and it counts only if it has not ended.
    """
    begun = right.select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(until).alias("_until"), *values).alias("_r"), *[F.col(c).alias(f"_tie{k}") for k, c in enumerate(ties)])
    asked = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = begun.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", *[F.col(f"_tie{k}").asc_nulls_first() for k in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    live = F.col("_r._until").isNull() | (F.col("_r._until") > F.col("_t"))
    return seen.select("_l.*", *[F.when(live, F.col(f"_r.{v}")).alias(v) for v in values])


def validity(df: DataFrame, keys: list[str], since: str, ties: list[str], until: str = "valid_to") -> DataFrame:
    """Adds the end of each row's validity: the start of the key's next row."""
    return df.withColumn(until, F.lead(since).over(Window.partitionBy(*keys).orderBy(since, *ties)))


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key: key, first and last day, length."""
    d = days.select(key, day).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(day))
    runs = d.withColumn("_run", F.date_sub(F.col(day), rank))
    return runs.groupBy(key, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days")).drop("_run")


def trailing(df: DataFrame, key: str, order: list[Column], counts: Column, stops: Column) -> DataFrame:
    """How many rows count from the newest on, up to the first that stops; other rows neither count nor stop."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    open_ = df.withColumn("_stopped", F.sum(stops.cast("int")).over(w))
    return open_.groupBy(key).agg(F.count_if((F.col("_stopped") == 0) & counts).alias("n_trailing"))
