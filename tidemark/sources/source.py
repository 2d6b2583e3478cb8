"""Python data sources: paged feeds, planned on the driver and fetched in tasks, in a batch or as a stream, and an inbox of pushed pages.

A feed has instances and numbered pages. A batch reads all pages there are; a
stream's offset is the number of pages that were read, so it goes on where its
checkpoint stopped, and reads a page again after a failure. A subclass says what
there is and fetches it.

``FolderFeed`` is the feed of an inbox: ``push`` writes a page of payloads into the
shared folder, whole or not at all, and the feed serves the pages in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DONE = "_SUCCESS"


class Page(InputPartition):
    def __init__(self, instance: str, number: int):
        self.instance, self.number = instance, number


class PagedFeed(DataSource):
    """Options: ``instances`` (comma-separated) and ``pages``. A subclass overrides ``fetch``, and ``available`` if pages can be added."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "source string, instance string, page int, payload string"

    def instances(self) -> list[str]:
        return [n for n in self.options.get("instances", "").split(",") if n]

    def available(self) -> int:
        """Pages that there are just now."""
        return int(self.options.get("pages", "1"))

    def fetch(self, instance: str, page: int) -> Iterator[str]:
        """Payloads of one page; none here, as no network is assumed."""
        return iter(())

    def planned(self, first: int, end: int) -> list[Page]:
        return [Page(n, k) for n in self.instances() for k in range(first, end)]

    def rows(self, page: Page):
        for payload in self.fetch(page.instance, page.number):
            yield self.name(), page.instance, page.number, payload

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


class _Reader(DataSourceReader):
    def __init__(self, feed: PagedFeed):
        self.feed = feed

    def partitions(self) -> list[Page]:
        return self.feed.planned(0, self.feed.available())

    def read(self, partition: Page):
        return self.feed.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of pages; a batch takes all pages that came since the one before."""

    def __init__(self, feed: PagedFeed):
        self.feed = feed

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.feed.available()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.feed.planned(start["pages"], end["pages"])

    def read(self, partition: Page):
        return self.feed.rows(partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they are: other streams may read them."""


class FolderFeed(PagedFeed):
    """The feed of an inbox; option ``path`` is its folder, on any file system that Arrow reads."""

    @classmethod
    def name(cls) -> str:
        return "folder_feed"

    def _there(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def _names(self, *below: str) -> list[str]:
        from pyarrow import fs

        system, root = self._there()
        found = system.get_file_info(fs.FileSelector("/".join([root.rstrip("/"), *below]), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def available(self) -> int:
        """Pages up to the first that some instance lacks."""
        counts = []
        for name in self.instances():
            k = 0
            while DONE in self._names(name, str(k)):
                k += 1
            counts.append(k)
        return min(counts, default=0)

    def fetch(self, instance: str, page: int) -> Iterator[str]:
        system, root = self._there()
        for name in self._names(instance, str(page)):
            if name.startswith("part-"):
                with system.open_input_stream(f"{root.rstrip('/')}/{instance}/{page}/{name}") as f:
                    for line in f.read().decode("utf-8").splitlines():
                        yield line


def push(payloads: DataFrame, path: str, instance: str, page: int) -> None:
    """Writes a page of an instance: a line a payload, in the column ``payload``. A page that is there already is an error."""
    payloads.select("payload").write.text(f"{path.rstrip('/')}/{instance}/{page}")


def due(targets: DataFrame, runs: DataFrame, key: str, finished: str, now, refresh_seconds: str) -> DataFrame:
    """Targets with a flag: never fetched, or the last success is as old as their refresh interval."""
    last = runs.groupBy(key).agg(F.max(finished).alias("_last"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))
    return targets.join(last, key, "left").withColumn("due", F.col("_last").isNull() | (age >= F.col(refresh_seconds))).drop("_last")


def last_per_key(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON-lines ledger, the last line of a key winning; broken lines are skipped."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = lines.select("_at", F.get_json_object("value", f"$.{key}").alias(key), F.get_json_object("value", f"$.{value}").alias(value)).filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(value, "_at").alias(value))
