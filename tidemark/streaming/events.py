"""Structured Streaming forms of the event operators; each equals its batch form once the stream is drained."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import folder as scratch_folder


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, time: str = "ts") -> DataFrame:
    """A file stream with its event time as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, key: str, time: str = "ts", late: str = "1 day", start: str | None = None) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    window = F.window(time, width, startTime=start) if start else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def capped(events: DataFrame, key: list[str], order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows a key over the life of the stream, by batch and then by ``order``: a counter per key is the state."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def take(k, frames, state: GroupState):
        (have,) = state.get if state.exists else (0,)
        room, kept = max(0, cap - have), None
        for pdf in frames:  # a large group comes in several frames; no more than fits is held
            kept = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(order).head(room)
        have += 0 if kept is None else len(kept)
        if kept is not None:
            yield kept[[*key, order]]
        state.update((have,))

    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, order])
    return events.groupBy(*key).applyInPandasWithState(take, out, "have int", "append", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, read as a batch.

    Every micro-batch writes its own folder by id, so a batch that is repeated
    after a failure replaces itself. In complete mode the last batch counts.
    """
    spark = df.sparkSession
    base = f"{scratch_folder(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    last = {"id": -1}

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last["id"] = number

    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], df.schema)
    path = f"{base}/out" if mode == "append" else f"{base}/out/batch={last['id']}"
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(path)


def fold_state(old: pd.DataFrame, new: pd.DataFrame, key: str) -> pd.DataFrame:
    """Upsert of supplied fields: a null leaves the old value."""
    return new.set_index(key).combine_first(old.set_index(key)).reset_index()
