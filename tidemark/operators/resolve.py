"""Entity resolution: priority merges, unique matches inside blocks, redirects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .latest import first_rows


def priority_merge(df: DataFrame, keys: list[str], order: list[str], fields: list[str], mirrors: str) -> DataFrame:
    """One row a key: each field's first non-empty value in ``order``, and all other values of ``mirrors``, sorted."""
    place = F.struct(*order)
    picks = [F.min_by(F.col(f), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", place)).alias(f) for f in fields]
    out = df.groupBy(*keys).agg(*picks, F.array_sort(F.collect_set(mirrors)).alias("_all"), F.count("*").alias("n_merged"))
    return out.withColumn("alternates", F.array_except("_all", F.array(mirrors))).drop("_all")


def unique_matches(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, fits: Column) -> DataFrame:
    """Equi-join on the block, a residual test, and a verdict a left row: its only match, or how many there were.

    left and right must have no other column names in common than the block's, and
    ``fits`` must not look at the ids: rows that are alike but for their id are
    compared once, so work grows with different rows and not with pairs of rows.
    """
    alike = lambda df, id_: F.struct(*[c for c in df.columns if c != id_])
    rows = left.withColumn("_left", alike(left, left_id))  # structs join on null fields too
    firsts = left.drop(left_id).distinct().withColumn("_left", alike(left, left_id))
    others = right.filter(F.col(right_id).isNotNull()).groupBy(*[c for c in right.columns if c != right_id]).agg(F.count("*").alias("_n"), F.min(right_id).alias("_low"), F.max(right_id).alias("_high"))
    pairs = firsts.join(others, block).filter(fits).groupBy("_left").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    found = rows.select(F.col(left_id), "_left").join(pairs, "_left").groupBy(left_id).agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    same = left.join(right.withColumn(left_id, F.col(right_id)), [*block, left_id]).filter(fits).groupBy(left_id).agg(F.count("*").alias("_same"))
    out = left.select(left_id).join(found, left_id, "left").join(same, left_id, "left")
    n = F.coalesce("_n", F.lit(0)) - F.coalesce("_same", F.lit(0))
    verdict = F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")
    only = F.when(F.col("_low") != F.col(left_id), F.col("_low")).otherwise(F.col("_high"))  # all others are the row itself
    return out.select(left_id, verdict.alias("verdict"), F.when(n == 1, only).alias("match_id"))


def best_matches(rows: DataFrame, block: list[str], id_: str, tokens: str, floor: float) -> DataFrame:
    """(left_id, right_id, similarity): each row's most similar other row of its block at or above the floor; ties go to the smaller id.

    Rows with the same tokens are compared once. Of such rows the two smallest ids
    can be somebody's best, and two candidates are enough for a row to have one that
    is not itself.
    """
    known = rows.select(*block, F.col(id_).alias("left_id"), F.array_sort(F.array_distinct(tokens)).alias("_lt")).filter("left_id IS NOT NULL AND _lt IS NOT NULL")
    place = [*block, "_lt"]
    asked = known.select(*place).distinct()
    answers = first_rows(known.distinct(), place, [F.col("left_id")], 2).select(*block, F.col("left_id").alias("right_id"), F.col("_lt").alias("_rt"))
    pairs = asked.join(answers, block).withColumn("similarity", jaccard(F.col("_lt"), F.col("_rt"))).filter(F.col("similarity") >= floor)
    pairs = pairs.groupBy(*place, "right_id").agg(F.max("similarity").alias("similarity"))
    best = first_rows(pairs, place, [F.col("similarity").desc(), F.col("right_id").asc()], 2).select(*place, "right_id", "similarity")
    own = known.join(best, place).filter("left_id <> right_id").groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("_far"), "right_id")).alias("b"))
    return own.select("left_id", "b.right_id", (-F.col("b._far")).alias("similarity"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _doubled(edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Pointers doubled to their ends: (src, to) of those that have one, (src, to, low) of those that run in cycles or into them.

    After k rounds a pointer is 2^k steps long, and ``low`` the smallest node on
    its way. While a chain is not done, each round ends some node of it, so rounds
    go on until none ends and pointers are longer than what is left has nodes: then
    each of them stands on its cycle. Only open pointers move; what has ended is
    written once and looked up.
    """
    first = edges.select(F.col(source).alias("src"), F.col(target).alias("to"), F.least(source, target).alias("low"))
    open_, done, left, length = written(first, "redirects-open"), [], None, 1
    while True:
        before, left = left, open_.count()
        if left == 0 or (left == before and length > left):
            break
        known = reduce(DataFrame.unionByName, [open_.withColumn("on", F.lit(True)), *done]).select(F.col("src").alias("to"), F.col("to").alias("next"), F.col("low").alias("further"), "on")
        moved = open_.join(known, "to", "left").select("src", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("further", "low")).alias("low"), F.coalesce("on", F.lit(False)).alias("on"))
        moved = written(moved, "redirects-moved")
        done.append(moved.filter("NOT on"))
        open_, length = moved.filter("on").drop("on"), 2 * length
    ended = reduce(DataFrame.unionByName, done).select("src", "to") if done else open_.select("src", "to").limit(0)
    return ended, open_


def redirect_closure(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Terminal of each node of a functional graph: (src, terminal, in_cycle, cycle_id).

    A cycle's id is its smallest node; ``in_cycle`` also marks what leads into one.
    """
    ended, open_ = _doubled(edges, source, target)
    cycles = open_.select(F.col("src").alias("to"), F.col("low").alias("cycle_id"))
    none = F.lit(None).cast(dict(open_.dtypes)["src"])
    rest = open_.join(cycles, "to").select("src", none.alias("terminal"), F.lit(True).alias("in_cycle"), "cycle_id")
    return ended.select("src", F.col("to").alias("terminal"), F.lit(False).alias("in_cycle"), none.alias("cycle_id")).unionByName(rest)


def rings(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(src, cycle_id) of the nodes that lie on a cycle, without those that lead into one: where all pointers that never end stand."""
    _, open_ = _doubled(edges, source, target)
    return open_.select("src", F.col("low").alias("cycle_id")).join(open_.select(F.col("to").alias("src")).distinct(), "src", "left_semi")


def survivors(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The row of each group that survives a merge, first in ``order``; the others name it."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("survivor", F.first("id").over(w)).withColumn("survives", F.row_number().over(w) == 1)
