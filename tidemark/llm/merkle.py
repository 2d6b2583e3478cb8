"""Merkle dataset manifest: a tree of ternary sha256 nodes a source, one over the sources, and a proof for every row.

A node's digest is lowercase hex; H hashes the concatenation of its inputs. Leaves
of a source stand in order; every three consecutive nodes, the last run having
fewer, become their H, level by level, until one remains. The subroots of the
sources, in order of their names, likewise give the root of the data set.

Leaf digests are made where the texts are read, and only they travel. They are
range-partitioned by source and key and numbered there, so a source that holds a
third of all rows lies in many tasks. Runs of ``SIZE`` = 3^7 consecutive leaves
are whole subtrees: such an aligned bucket goes to an executor as Arrow rows, and
DuckDB folds it there, level by level, by ordered string_agg and sha256. The
buckets' roots are the leaves of the next tier, which is folded the same way, and
so on; then the sources are. Going back down, Spark joins each bucket with the
outer part of its proofs, and DuckDB adds the inner parts and folds every leaf up
again. No task holds more than some buckets, whatever the size of a source.

Rows that repeat a key are leaves of their own, in order of their digests, then of
the digest to be checked; a null key comes first, as does a null source. Null
fields are written as ``-``. Very long texts are hashed where they are. An empty
table has no rows and no root. Columns that are no field are ignored.
"""

from __future__ import annotations

from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import written

ARITY, LEVELS = 3, 7
SIZE = ARITY**LEVELS
#: Leaves that a task folds at a time, at least; then the bucket that is open is awaited.
AT_ONCE = 4 * SIZE


def field(name: str | Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _joined(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Inner join on columns of which null equals null."""
    there = b.withColumnsRenamed({n: f"_{n}" for n in names})
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return a.join(there, same).drop(*(f"_{n}" for n in names))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``pos``, their number in their group from 0, and ``n``, the rows of it, without a task that holds a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("at", 33)), "merkle-order")
    runs = dealt.groupBy(group, "part").agg(F.min("at").alias("low"), F.count("*").alias("k"))
    whole = Window.partitionBy(group)
    runs = runs.select(group, "part", (F.col("low") - F.sum("k").over(whole.orderBy("part")) + F.col("k")).alias("shift"), F.sum("k").over(whole).alias("n"))
    return _joined(dealt, runs, group, "part").select(*rows.columns, (F.col("at") - F.col("shift")).alias("pos"), "n")


def _height(n: np.ndarray) -> np.ndarray:
    """Levels of a bucket, by the nodes of its group: all, or as many as one bucket needs."""
    return np.searchsorted(ARITY ** np.arange(LEVELS), np.minimum(n, SIZE))


def _whole(batches):
    """Tables of whole buckets; rows come in order, and a bucket begins where its number is a multiple of SIZE."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= AT_ONCE:
            table = pa.Table.from_batches(held)
            first = np.flatnonzero(table["pos"].to_numpy() % SIZE == 0)
            cut = int(first[-1]) if len(first) else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


class Engine:
    """Folds buckets of nodes in DuckDB; one per task."""

    def __init__(self):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

    def load(self, table: pa.Table) -> tuple[np.ndarray, int]:
        """Makes level 0 of the buckets of a table; the rows that begin them, and the most levels that one has."""
        pos = table["pos"].to_numpy()
        first = np.flatnonzero(pos % SIZE == 0)
        bucket = np.cumsum(pos % SIZE == 0) - 1
        height = _height(table["n"].to_numpy())
        nodes = pa.table({"b": bucket, "p": pos % SIZE, "h": height, "digest": table["digest"]})
        self.con.register("nodes", nodes)
        self.con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT b, p, h, digest FROM nodes")
        self.con.unregister("nodes")
        top = int(height.max(initial=0))
        for k in range(top):
            self.con.execute(f"""
                CREATE OR REPLACE TEMP TABLE level{k + 1} AS
                SELECT b, p // {ARITY} AS p, any_value(h) AS h, sha256(string_agg(digest, '' ORDER BY p)) AS digest FROM level{k} WHERE h > {k} GROUP BY b, p // {ARITY}
                UNION ALL SELECT b, p, h, digest FROM level{k} WHERE h <= {k}""")
        return first, top

    def roots(self, top: int) -> pa.Array:
        return self.con.sql(f"SELECT digest FROM level{top} ORDER BY b").to_arrow_table()["digest"].combine_chunks()

    def paths(self, top: int) -> None:
        """A table of (b, p, path) with the digests left and right of each leaf's way up, level by level."""
        self.con.execute("CREATE OR REPLACE TEMP TABLE way AS SELECT b, p, h, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path FROM level0")
        for k in range(top):
            self.con.execute(f"""
                CREATE OR REPLACE TEMP TABLE way AS
                WITH s AS (SELECT b, p, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                           FROM level{k} WHERE h > {k} WINDOW w AS (PARTITION BY b, p // {ARITY} ORDER BY p))
                SELECT way.b, way.p, way.h, CASE WHEN way.h > {k} THEN list_append(path, struct_pack(l := s.l, r := s.r)) ELSE path END AS path FROM way LEFT JOIN s ON s.b = way.b AND s.p = way.p // {ARITY**k}""")

    def proven(self, table: pa.Table, outer: pa.Table) -> pa.Table:
        """Digest of the proof of each node, and what its ``start`` folds up to; ``outer`` has the rest of a bucket's way (b, path)."""
        pos = table["pos"].to_numpy()
        starts = pa.table({"b": np.cumsum(pos % SIZE == 0) - 1, "p": pos % SIZE, "start": table["start"]})
        self.con.register("starts", starts)
        self.con.register("outer_ways", outer)
        self.con.execute("CREATE OR REPLACE TEMP TABLE proofs AS SELECT b, p, list_concat(way.path, o.path) AS path, s.start AS now FROM way JOIN starts s USING (b, p) JOIN outer_ways o USING (b)")
        self.con.unregister("starts")
        self.con.unregister("outer_ways")
        for k in range(1, self.con.execute("SELECT coalesce(max(len(path)), 0) FROM proofs").fetchall()[0][0] + 1):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE proofs AS SELECT b, p, path, CASE WHEN len(path) >= {k} THEN sha256(path[{k}].l || now || path[{k}].r) ELSE now END AS now FROM proofs")
        return self.con.sql("SELECT sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof, now AS folded FROM proofs ORDER BY b, p").to_arrow_table()

    def full_paths(self, outer: pa.Table) -> pa.Array:
        self.con.register("outer_ways", outer)
        out = self.con.sql("SELECT list_concat(way.path, o.path) AS path FROM way JOIN outer_ways o USING (b) ORDER BY b, p").to_arrow_table()["path"].combine_chunks()
        self.con.unregister("outer_ways")
        return out


WAY = "array<struct<l: string, r: string>>"
NODE = pa.struct([("key", pa.int64()), ("digest", pa.string()), ("start", pa.string())])


def _buckets(nodes: DataFrame) -> DataFrame:
    """(group, bucket, n, root, nodes): aligned buckets of nodes (group, pos, n, key, digest, start), folded."""

    def run(batches):
        engine = Engine()
        for table in _whole(batches):
            first, top = engine.load(table)
            ends = np.append(first, table.num_rows).astype(np.int32)
            rows = pa.StructArray.from_arrays([table[f.name].combine_chunks().cast(f.type) for f in NODE], fields=list(NODE))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([table["group"].take(at).combine_chunks(), pa.array(table["pos"].to_numpy()[first] // SIZE), table["n"].take(at).combine_chunks(), engine.roots(top).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows)], ["group", "bucket", "n", "root", "nodes"])

    dealt = nodes.withColumn("bucket", F.floor(F.col("pos") / SIZE)).repartition("group", "bucket").sortWithinPartitions("group", "bucket", "pos")
    out = dealt.select("group", "pos", "n", "key", "digest", "start").mapInArrow(run, "group string, bucket long, n long, root string, nodes array<struct<key: long, digest: string, start: string>>")
    return written(out, "merkle-buckets")


def _opened(buckets: DataFrame, *more: str) -> DataFrame:
    """The nodes of buckets again, in order; what a bucket has besides comes with its first node only."""
    rows = buckets.select("group", "bucket", "n", *more, F.posexplode("nodes").alias("at", "node"))
    return rows.select("group", (F.col("bucket") * SIZE + F.col("at")).alias("pos"), "n", "node.key", "node.digest", F.coalesce("node.start", "node.digest").alias("start"), *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in more))


def _outer(table: pa.Table, first: np.ndarray) -> pa.Table:
    return pa.table({"b": np.arange(len(first)), "path": table["way"].take(pa.array(first))})


def _heads(buckets: DataFrame) -> DataFrame:
    """The roots of buckets as nodes of the next tier."""
    none = F.lit(None).cast("string")
    return buckets.select("group", F.col("bucket").alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"), F.lit(None).cast("long").alias("key"), F.col("root").alias("digest"), none.alias("start"))


def ways(nodes: DataFrame) -> DataFrame:
    """(group, pos, way, top): the digests beside each node's way up its group's tree, and the tree's root."""
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("group", "pos", F.array().cast(WAY).alias("way"), F.col("digest").alias("top"))
    buckets = _buckets(nodes)
    above = ways(_heads(buckets)).withColumnRenamed("pos", "bucket")
    rows = _opened(_joined(buckets, above, "group", "bucket"), "way", "top")

    def run(batches):
        engine = Engine()
        for table in _whole(batches):
            first, top = engine.load(table)
            engine.paths(top)
            path = engine.full_paths(_outer(table, first))
            whose = np.cumsum(table["pos"].to_numpy() % SIZE == 0) - 1
            yield pa.RecordBatch.from_arrays([table["group"].combine_chunks(), table["pos"].combine_chunks(), path, table["top"].take(pa.array(first)).take(pa.array(whose)).combine_chunks()], ["group", "pos", "way", "top"])

    return written(rows.mapInArrow(run, f"group string, pos long, way {WAY}, top string"), "merkle-ways")


def proofs(leaves: DataFrame) -> DataFrame:
    """Leaves (group, key, digest, start) with subroot, root, proof_sha256 and folded_root; ``start`` is the digest to be checked, null for the leaf's own."""
    placed = numbered(leaves.select("group", "key", "digest", "start"), "group", ["key", "digest", "start"])
    buckets = _buckets(placed)
    inner = ways(_heads(buckets))
    subroots = inner.filter("pos = 0").select("group", "top")
    none = F.lit(None)
    ranked = numbered(subroots.select(F.lit("").alias("all"), "group", "top"), "all", ["group"])
    over = ways(ranked.select(F.col("all").alias("group"), "pos", "n", none.cast("long").alias("key"), F.col("top").alias("digest"), none.cast("string").alias("start")))
    of_source = ranked.select("group", F.col("top").alias("subroot"), "pos").join(over.select("pos", F.col("way").alias("over"), F.col("top").alias("root")), "pos").drop("pos")
    inner = inner.withColumnRenamed("pos", "bucket").drop("top")
    outer = _joined(inner, of_source, "group").select("group", "bucket", F.concat("way", "over").alias("way"), "subroot", "root")
    joined = _joined(buckets.drop("root"), outer, "group", "bucket")

    def run(batches):
        engine = Engine()
        for table in _whole(batches):
            first, top = engine.load(table)
            engine.paths(top)
            proven = engine.proven(table, _outer(table, first))
            whose = pa.array(first).take(pa.array(np.cumsum(table["pos"].to_numpy() % SIZE == 0) - 1))
            cols = [table["group"], table["key"], table["digest"], table["start"], table["subroot"].take(whose), table["root"].take(whose), proven["proof"].cast(pa.string()), proven["folded"].cast(pa.string())]
            yield from pa.table(cols, ["group", "key", "digest", "start", "subroot", "root", "proof_sha256", "folded_root"]).combine_chunks().to_batches()

    rows = _opened(joined, "way", "subroot", "root")
    return rows.mapInArrow(run, "group string, key long, digest string, start string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row a document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` gives fields as they are found when the data are checked, in rows
    for which ``when`` holds; without it the rows are checked as they are.
    """
    found = leaf(*(changed.get(f, F.col(f)) for f in fields)) if changed else F.lit(None).cast("string")
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("key"), leaf(*fields).alias("digest"), (F.when(when, found) if when is not None else found).alias("start"))
    out = proofs(written(leaves, "merkle-leaves"))
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
