"""Repost filter: a url counts once, and a company's title only so often, over the life of a stream.

The first row of a normalised url passes, all others are refused. Of the rows that
pass, each company and title has a counter that goes on with every row, also with
those that it refuses, and only the first ``cap`` rows are kept; a cap of 0 or less
keeps all. Rows are taken in order of the batch they come in, and within it in
order of ``order`` and then url: what is kept does not depend on how rows are dealt
out, and equals the batch form over all rows if the batches are runs of the order.

State is a flag a url and a count a company and title. ``filtered`` keeps it in the
state store of a stream that goes on as a stream, and asks Python once a key and
batch; of a key's rows in a batch no more than what may still be kept is held at a
time. ``into`` is for a stream that ends in a ledger: its state is tables there that
are only added to, and a batch is joined with them, so a key costs no more than a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import normalize_url
from ..sources.ledger import Ledger
from ..sources.scratch import dropped, written

SEEN = "url_key string"
GROUP = ["company_key", "title_key"]
COUNTS = "company_key string, title_key string, n long"


def _least(frames: Iterator[pd.DataFrame], order: list[str], most: int | None) -> tuple[int, pd.DataFrame | None]:
    """The number of rows, and the first of them in order."""
    total, kept = 0, None
    for pdf in frames:
        total += len(pdf)
        kept = pdf if kept is None else pd.concat([kept, pdf])
        kept = kept.sort_values(order, kind="stable")
        kept = kept if most is None else kept.head(most)
    return total, kept


class _Seen(StatefulProcessor):
    """Passes the first row of a url."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            self.seen.update((1,))
            yield _least(rows, ["order_key"], 1)[1]

    def close(self) -> None:
        pass


class _Counted(StatefulProcessor):
    """Passes the first rows of a company and title, and counts all."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        total, kept = _least(rows, ["order_key", "url_key"], None if self.cap <= 0 else max(0, self.cap - before))
        self.count.update((before + total,))
        if kept is not None and len(kept):
            yield kept

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, url: str, company: str, title: str, order: str) -> DataFrame:
    """Rows with their keys; those without a url are never kept. (Names with a leading underscore would be renamed on their way to the state.)"""
    keys = {"url_key": normalize_url(F.col(url)), "company_key": F.lower(F.coalesce(company, F.lit(""))), "title_key": F.lower(F.coalesce(title, F.lit(""))), "order_key": F.col(order)}
    return rows.withColumns(keys).filter("url_key <> ''")


def _first(keyed: DataFrame) -> DataFrame:
    """The first row of each url."""
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("url_key").orderBy("order_key"))).filter("_n = 1").drop("_n")


def _capped(first: DataFrame, cap: int) -> DataFrame:
    """The first rows of each company and title, numbered; the bound by a literal lets every task drop what is past it before rows are exchanged."""
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*GROUP).orderBy("order_key", "url_key"))).filter(F.col("_n") <= cap)


def filtered(rows: DataFrame, cap: int, url: str = "url", company: str = "company", title: str = "title", order: str = "order") -> DataFrame:
    """The filter over a batch, or over a stream, whose query must be started within ``state_store``."""
    keyed = _keyed(rows, url, company, title, order)
    if not rows.isStreaming:
        first = _first(keyed)
        return (first if cap <= 0 else _capped(first, cap)).select(rows.columns)
    names = ["url_key", "company_key", "title_key", "order_key"]
    seen = keyed.groupBy("url_key").transformWithStateInPandas(_Seen(), keyed.select(*rows.columns, *names).schema, "Append", "None")
    return seen.groupBy(*GROUP).transformWithStateInPandas(_Counted(cap), seen.schema, "Append", "None").select(rows.columns)


def into(ledger: Ledger, cap: int, url: str = "url", company: str = "company", title: str = "title", order: str = "order") -> Callable[[DataFrame, str], None]:
    """A sink that filters each batch, once: what is kept is added to the table ``kept``, the state is in ``seen`` and ``counts``."""

    def sink(rows: DataFrame, batch: str) -> None:
        if ledger.applied(batch):
            return
        base = ledger.version()
        first = _first(_keyed(rows, url, company, title, order))
        new = written(first.join(ledger.read("seen", SEEN, base), "url_key", "left_anti"), "reposts-new")
        kept = new
        if cap > 0:
            before = ledger.read("counts", COUNTS, base).groupBy(*GROUP).agg(F.sum("n").alias("_before"))
            kept = _capped(new, cap).join(before, GROUP, "left").filter(F.col("_n") + F.coalesce("_before", F.lit(0)) <= cap)
        counts = new.groupBy(*GROUP).agg(F.count("*").alias("n"))
        ledger.commit(batch, {"filter": {"seen": new.select("url_key"), "counts": counts, "kept": kept.select(rows.columns)}}, base)
        dropped(new)

    return sink


@contextmanager
def state_store(spark: SparkSession):
    """Within it, queries start with a state store that such operators can use."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
