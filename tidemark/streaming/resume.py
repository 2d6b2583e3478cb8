"""Streams that go on where they stopped, as long as they are the same stream.

A named stream keeps its checkpoint in a folder of its own, in generations. A
generation belongs to a fingerprint of what decides the result: the source, its
options, the rules. A stream that is started again with the fingerprint of the last
generation resumes it; any other fingerprint starts a new generation from the
beginning, as positions in one result set mean nothing in another. So does a
fingerprint that was used before the last one.

A micro-batch that had begun when the stream died comes again with its number. Its
name holds the stream, the generation and the number, and a ledger applies a name
once, so a batch that was committed already changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.ledger import Ledger


def fingerprint(**parts) -> str:
    """Digest of what a stream's result depends on; the order of names does not matter."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Generation:
    name: str
    number: int
    checkpoint: str
    resumed: bool

    def batch(self, number: int) -> str:
        return f"{self.name}-{self.number}-{number}"


def generation(spark: SparkSession, root: str, name: str, mark: str) -> Generation:
    """The generation that a stream of this fingerprint runs in: the last one if it has it, else a new one."""
    known = Ledger(spark, f"{root.rstrip('/')}/{name}/generations")
    log = known.log()
    resumed = bool(log) and log[-1]["batch"].partition(":")[2] == mark
    number = len(log) if resumed else known.commit(f"{len(log) + 1}:{mark}", {"start": {}})["version"]
    return Generation(name, number, f"{root.rstrip('/')}/{name}/checkpoint-{number}", resumed)


def run(df: DataFrame, root: str, name: str, mark: str, sink: Callable[[DataFrame, str], None]) -> Generation:
    """Drains a stream into ``sink(rows, batch name)``, from where its last run with this fingerprint stopped."""
    now = generation(df.sparkSession, root, name, mark)
    query = df.writeStream.foreachBatch(lambda rows, k: sink(rows, now.batch(k))).option("checkpointLocation", now.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return now


def into(ledger: Ledger, table: str) -> Callable[[DataFrame, str], None]:
    """A sink that adds each batch to a table, once."""

    def sink(rows: DataFrame, batch: str) -> None:
        ledger.commit(batch, {"append": {table: rows}})

    return sink
