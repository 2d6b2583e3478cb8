"""Tables that change together: batches of operations under one version, each applied once.

A ledger is a folder with a log and a folder a table. A commit writes the rows of
all its tables to fresh folders and then publishes one log entry that names them,
so a reader sees all of it or nothing, and what a writer that was killed half-way
left behind is never read. An entry also names the batch and the operations in
it: an operation that the log has for the batch is left out when the batch comes
again, and a batch of which nothing is left to do changes nothing.

Entries are numbered. A commit is made for the version that its rows were computed
from; if another writer has published that number meanwhile, ``Conflict`` is raised
and the rows must be computed anew. Publishing is atomic: a link on local disks, a
rename on file systems that refuse to replace, else an exclusive create.

The log is files of JSON, so a stream of files tails it: ``tail`` replays what is
past a cursor and then follows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version long, batch string, operations array<string>, tables map<string, struct<folder: string, rows: long, replaces: boolean>>"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._known = spark, path.rstrip("/"), []

    # -- log ------------------------------------------------------------------
    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _text(self, fs, path) -> str:
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def log(self) -> list[dict]:
        """All commits in order. An entry never changes, so only new ones are read."""
        while True:
            fs, path = self._at(f"_log/{len(self._known) + 1:020d}.json")
            if not fs.exists(path):
                return self._known
            self._known.append(json.loads(self._text(fs, path)))

    def version(self) -> int:
        return len(self.log())

    def applied(self, batch: str) -> set[str]:
        """The operations that the log has for a batch."""
        return {name for entry in self.log() if entry["batch"] == batch for name in entry["operations"]}

    def _publish(self, number: int, body: str) -> bool:
        """Makes an entry with its whole text, or returns False if there is one of that number."""
        jvm = self.spark._jvm
        fs, target = self._at(f"_log/{number:020d}.json")
        fs.mkdirs(target.getParent())
        if fs.getScheme() not in ("file", "hdfs", "viewfs"):  # object stores: an object appears when it is closed
            return self._written(fs, target, body)
        _, draft = self._at(f"_log/.draft-{uuid.uuid4().hex}")
        self._written(fs, draft, body)
        try:
            if fs.getScheme() != "file":
                return bool(fs.rename(draft, target))
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    @staticmethod
    def _written(fs, path, body: str) -> bool:
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(body.encode()))
        stream.close()
        return True

    # -- tables -----------------------------------------------------------------
    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version, all its batches together; empty before its first one."""
        folders = []
        for entry in self.log()[:version]:
            if table in entry["tables"]:
                one = entry["tables"][table]
                folders = [one["folder"]] if one["replaces"] else [*folders, one["folder"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, batch: str, operations: dict[str, dict[str, DataFrame]], base: int | None = None, replaces: Iterable[str] = ()) -> dict | None:
        """Applies the operations of a batch that were not applied yet, all at once; None if there are none.

        ``operations`` maps a name to the rows it adds to each table; two
        operations may add to one table. ``base`` is the version that the rows were
        computed from, the present one by default. Tables in ``replaces`` are
        replaced by the rows of this commit.
        """
        done = self.applied(batch)
        todo = {name: rows for name, rows in operations.items() if name not in done}
        if not todo:
            return None
        number = (self.version() if base is None else base) + 1
        rows: dict[str, DataFrame] = {}
        for one in todo.values():
            for table, df in one.items():
                rows[table] = rows[table].unionByName(df) if table in rows else df
        tables = {}
        for table, df in rows.items():
            folder = f"{table}/{number:020d}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            count = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").count()
            tables[table] = {"folder": folder, "rows": count, "replaces": table in replaces}
        entry = {"version": number, "batch": batch, "operations": sorted(todo), "tables": tables}
        if not self._publish(number, json.dumps(entry)):
            if set(todo) <= self.applied(batch):
                return None
            raise Conflict(f"version {number} of {self.path} was committed by another writer")
        return entry

    def compact(self, table: str, schema: str, files: int = 1) -> dict | None:
        """One folder of ``files`` files in place of a table's many; rows stay as they are."""
        base = self.version()
        return self.commit(f"compact-{table}-{base}", {"compact": {table: self.read(table, schema, base).repartition(files)}}, base, replaces=[table])

    # -- tail ---------------------------------------------------------------------
    def entries(self, after: int = 0) -> DataFrame:
        """The commits past a cursor, a row a table: (version, batch, operations, table, rows)."""
        return _spread(self.spark.read.schema(ENTRY).json(f"{self.path}/_log"), after)

    def tail(self, after: int = 0, per_batch: int = 1) -> DataFrame:
        """The same as a stream: what is past the cursor is replayed, then new commits follow. Its checkpoint is the cursor from then on."""
        return _spread(self.spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", per_batch).json(f"{self.path}/_log"), after)


def _spread(entries: DataFrame, after: int) -> DataFrame:
    rows = entries.filter(F.col("version") > after).select("version", "batch", F.array_join("operations", ",").alias("operations"), F.explode("tables").alias("table", "t"))
    return rows.select("version", "batch", "operations", "table", "t.rows")
