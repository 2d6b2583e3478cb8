"""Queues: two lanes interleaved, with and without caps that depend on earlier picks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered


def interleaved(df: DataFrame, key: str, bank: list[Column], aim: list[Column], in_aim: Column, cap: int) -> DataFrame:
    """The first ``cap`` keys of two lanes taken in turn, each once: key, lane, position.

    An entry's position is the smaller of 2 b and 2 a + 1. No lane needs more
    than its first ``cap`` rows, so both are top-k sorts, not full ones.
    """
    lanes = []
    for name, order, rows, shift in (("bank", bank, df, 0), ("aim", aim, df.filter(in_aim), 1)):
        top = rows.orderBy(*order).limit(cap)
        rank = F.row_number().over(Window.orderBy(*order)) - 1  # over at most cap rows
        lanes.append(top.select(key, F.lit(name).alias("lane"), (2 * rank + shift).alias("turn")))
    both = lanes[0].unionByName(lanes[1]).groupBy(key).agg(F.min(F.struct("turn", "lane")).alias("_t"))
    return both.select(key, "_t.lane", "_t.turn").orderBy("turn").limit(cap).withColumn("position", F.row_number().over(Window.orderBy("turn"))).drop("turn")


def attempts(df: DataFrame, group: str, key: str, bank: list[str], aim: list[str], in_aim: str) -> DataFrame:
    """df with lane, lane_rank and turn of each row's first attempt: rank r of the bank lane comes at 2 r, of the aim lane at 2 r + 1."""
    ranked = numbered(numbered(df, [group], [*bank, key], "_bank"), [group, in_aim], [*aim, key], "_aim")
    by_bank, by_aim = F.col("_bank") - 1, F.when(F.col(in_aim), F.col("_aim") - 1)
    first = F.least(F.struct((2 * by_bank).alias("turn"), by_bank.alias("lane_rank"), F.lit("bank").alias("lane")), F.when(by_aim.isNotNull(), F.struct((2 * by_aim + 1).alias("turn"), by_aim.alias("lane_rank"), F.lit("aim").alias("lane"))))
    return ranked.withColumn("_first", first).withColumns({c: F.col(f"_first.{c}") for c in ("turn", "lane_rank", "lane")}).drop("_first", "_bank", "_aim")


def greedy_queue(df: DataFrame, group: str, key: str, company: str, uncertain: str, bank: list[str], aim: list[str], in_aim: str, cap: int, company_cap: int = 2) -> DataFrame:
    """A queue of ``cap`` per group: lanes in turn, at most ``company_cap`` of a company and max(1, cap // 5) uncertain ones.

    A row is decided at its first attempt, so a group is walked in order of
    turns. Caps depend on earlier picks but are never free again: of a company,
    its first ``company_cap`` certain rows and as many uncertain ones are all
    that can be taken, so only those are walked, at their own turns. bank and
    aim are columns that sort ascending; ties go to the key.
    """
    ranked = attempts(df, group, key, bank, aim, in_aim)
    kinds = Window.partitionBy(group, company, uncertain).orderBy("turn")
    rows = ranked.withColumn("_n", F.row_number().over(kinds)).filter(F.col("_n") <= company_cap)
    kind, gkind = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()
    few = max(1, cap // 5)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held, unsure, out = {}, 0, []
        for k, c, u, lane, rank, turn in pdf.sort_values("turn")[[key, company, uncertain, "lane", "lane_rank", "turn"]].itertuples(index=False):
            if len(out) >= cap:
                break
            if held.get(c, 0) < company_cap and not (u and unsure >= few):
                held[c] = held.get(c, 0) + 1
                unsure += bool(u)
                out.append((pdf[group].iloc[0], k, lane, rank, turn, len(out) + 1))
        return pd.DataFrame(out, columns=[group, key, "lane", "lane_rank", "turn", "position"])

    return rows.select(group, key, company, uncertain, "lane", "lane_rank", "turn").groupBy(group).applyInPandas(walk, f"`{group}` {gkind}, `{key}` {kind}, lane string, lane_rank long, turn long, position long")


def queue_outcomes(df: DataFrame, queue: DataFrame, group: str, key: str, company: str, uncertain: str, bank: list[str], aim: list[str], in_aim: str, cap: int, company_cap: int = 2) -> DataFrame:
    """df with the outcome of each row: queued, company-cap, uncertainty-cap, or beyond-cap if it was never tried.

    A company is full from the turn that takes its last slot on, a queue from its
    last turn on, so each row is judged by its own turn, without a walk.
    """
    taken = queue.select(group, key, F.col("turn").alias("_taken"), "position")
    ranked = attempts(df, group, key, bank, aim, in_aim).join(taken, [group, key], "left")
    ends = queue.groupBy(group).agg(F.when(F.count("*") >= cap, F.max("turn")).alias("_end"))
    full = ranked.filter("_taken is not null").groupBy(group, company).agg(F.max("_taken").alias("_full"), F.count("*").alias("_held")).filter(F.col("_held") >= company_cap).drop("_held")
    out = ranked.join(ends, group, "left").join(full, [group, company], "left")
    why = F.when(F.col("_taken").isNotNull(), "queued").when(F.col("turn") > F.col("_end"), "beyond-cap").when(F.col("turn") > F.col("_full"), "company-cap").otherwise("uncertainty-cap")
    return out.withColumn("outcome", why).drop("_taken", "_end", "_full")
