"""N-gram Jaccard join: all pairs of documents whose word-shingle sets reach a similarity, and the classes they form.

The join is a product of the sparse document by shingle incidence with its
transpose, kept small by bounds on the set sizes (Bayardo et al. 2007; Xiao et
al. 2008):

1. A pair that reaches 3/4 shares at least k of the n - ceil(3n/4) + k first
   shingles of either document, in any fixed order. Blocks of documents exchange
   the first ones in hash order (k = 1 + n // 8) and learn which occur in other
   documents too. Documents with fewer than k such shingles have no partner.
2. The others are read again (a Bloom filter of at most 1 MB spares most of the
   shuffle), and equal sets become one class. The shingles of the classes are
   counted; those of one class alone drop out, and a class whose remaining ones
   cannot reach 3n/4 does too.
3. In order of rising counts, each class enters the index with its first
   shingles: n/7 as the smaller of a pair, n/4 as the larger. Blocks of equal
   shingle multiply; pairs below the bounds of sizes and places are discarded,
   and the overlap of the others is counted in full.

Groups of thousands of near copies would multiply to millions of pairs, so links
to the most typical class of each shingle come first; after that only pairs
across the components found so far are formed. That loses no link between
components; ``links`` gives all pairs without that step.

Null, empty and blank texts have an empty set and no links; a text of fewer than
five words is one shingle. Documents without an id take no part and come back
with their count and a null component. Rows that repeat an id are one node with
the links of all their texts. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import cuts, merged, packed, record, tight, unpacked
from .kernels import U64, Hasher, forget, free_name, giving_back, maybe_among, parted, shingle_sets, text_chunks, written

PERCENT = 75
BLOCK = 6 << 20
ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "block long, bucket int, blob binary"


def _turned(s: np.ndarray) -> np.ndarray:
    """Halves swapped: the first shingles in hash order are all small, their lower halves are even."""
    return (s >> U64(32)) | (s << U64(32))


def _blocks(docs: DataFrame, key: str, text: str, buckets: int, percent: int) -> DataFrame:
    """Per block its documents (bucket -1) and per bucket its distinct first shingles, with 2 for those that several of its documents have."""

    def run(batches):
        hasher, number, held, size = Hasher(), TaskContext.get().partitionId() << 20, [], 0

        def flush():
            nonlocal number, held, size
            keys = np.concatenate([k for k, _ in held])
            found = [s for _, each in held for s in each]
            n = np.array([len(s) for s in found], np.int64)
            need = 1 + n // 8
            count = n + -percent * n // 100 + need  # n less the rounded-up share, and what must be met
            first = _turned(np.concatenate([s[:c] for s, c in zip(found, count.tolist(), strict=True)]))
            count = np.minimum(count, n)
            words, at, times = np.unique(first, return_inverse=True, return_counts=True)
            cut = cuts(words, buckets)
            blobs = [packed(keys=keys, n=tight(n), need=tight(need), count=tight(count), at=tight(at))]
            blobs += [packed(keys=words[a:b], n=tight(np.minimum(times[a:b], 2))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield record(ROWS, block=[number] * (buckets + 1), bucket=range(-1, buckets), blob=blobs)
            number, held, size = number + 1, [], 0

        for (keys,), data, offs in text_chunks(batches, ["key"], "text"):
            held.append((keys.to_numpy(zero_copy_only=False), shingle_sets(hasher, data, offs)))
            size += len(data) + 8 * len(offs)  # empty texts take room too
            if size >= BLOCK:
                yield from flush()
        if held:
            yield from flush()

    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, DDL)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shingle bucket: which of each block's shingles occur in two documents or more."""
    parts, words, at = merged(pdf["blob"].tolist())
    total = np.bincount(at, weights=np.concatenate([p["n"] for p in parts]).astype(float), minlength=len(words))
    shared, ends = (total > 1)[at], np.cumsum([len(p["keys"]) for p in parts])
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "blob": [packed(shared=shared[e - len(p["keys"]) : e]) for p, e in zip(parts, ends, strict=True)]})


def _partnered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket")
    b = unpacked(pdf["blob"].iloc[0])
    shared = np.concatenate([unpacked(x)["shared"] for x in pdf["blob"].iloc[1:]])
    doc = np.repeat(np.arange(len(b["count"])), b["count"])
    have = np.bincount(doc, weights=shared[b["at"]], minlength=len(b["count"]))
    return pd.DataFrame({"key": b["keys"], "n": b["n"].astype(np.int64), "may": (have >= b["need"]) & (b["n"] > 0)})


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n and the shingle set of each document, and two hashes that identify the set."""

    def run(batches):
        hasher = Hasher()
        for (keys,), data, offs in text_chunks(batches, ["key"], "text"):
            found = shingle_sets(hasher, data, offs)
            a = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in found]
            b = [int((s * (s >> U64(7) | U64(1))).sum(dtype=U64).view(np.int64)) if len(s) else 0 for s in found]
            values = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            lens = np.array([len(s) for s in found], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([keys, pa.array(lens), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["key", "n", "a", "b", "shingles"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n long, a long, b long, shingles array<long>")


def enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether an overlap of sets of n and m reaches the similarity, in whole numbers."""
    return 100 * overlap >= percent * (n + m - overlap)


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full overlap reaches the similarity."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    return both.filter(enough(F.size(F.array_intersect("sx", "sy")), F.col("nx"), F.col("ny"), percent)).select("x", "y")


def dense(classes: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a partner: rep, n, m and their m shingles that other classes have too, in order of rising counts."""
    inc = classes.select("rep", "n", F.explode("shingles").alias("s"))
    # counts are combined before they are dealt out and joined back, so a shingle of all classes is no task of its own
    shared = inc.join(inc.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "s")
    rows = shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    return rows.withColumn("m", F.size("order")).filter(100 * F.col("m") >= percent * F.col("n")).select("rep", "n", "m", F.col("order.s").alias("shingles"))


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """Index rows (s, rep, n, m, pos, short): the first shingles of each class in order of rising counts, those of one class being first and left out."""
    n = F.col("n")
    upper = lambda a, b: F.floor((a * n + (b - 1)) / b)  # noqa: E731  n a / b rounded up
    own = n - F.col("m")
    rows = classes.withColumn("long_", n - upper(percent, 100) + 1 - own).withColumn("short_", n - upper(2 * percent, 100 + percent) + 1 - own)
    rows = rows.filter("long_ > 0").select("rep", "n", "m", "short_", F.posexplode(F.expr("slice(shingles, 1, cast(long_ as int))")).alias("at", "s"))
    return rows.select("s", "rep", "n", "m", (F.col("at") + n - F.col("m")).alias("pos"), (F.col("at") < F.col("short_")).alias("short"))


def _candidates(posts: DataFrame, percent: int, across: bool) -> DataFrame:
    """Pairs of classes with a common index row that pass the bounds; with ``across``, of different components only."""
    x = posts.filter("short").select("s", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"), F.col("pos").alias("px"), *([F.col("component").alias("cx")] if across else []))
    y = posts.select("s", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("m").alias("my"), F.col("pos").alias("py"), *([F.col("component").alias("cy")] if across else []))
    best = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"), F.col("mx"), F.col("my"))
    keep = ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) & enough(best, F.col("nx"), F.col("ny"), percent)
    if across:
        keep = keep & (F.col("cx") != F.col("cy"))
    return x.join(y, "s").filter(keep).select("x", "y").distinct()


def linked_components(posts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked to another: links to each shingle's most typical class first, then pairs across what is not joined yet."""
    typical = posts.groupBy("s").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "rep", "n", "m")).alias("t"), F.count("*").alias("k")).filter("k > 1")
    star = posts.join(typical.select("s", "t"), "s").filter("rep <> t.rep")
    star = star.filter(enough(F.least("m", "t.m"), F.col("n"), F.col("t.n"), percent)).select(F.col("rep").alias("x"), F.col("t.rep").alias("y")).distinct()
    first = written(verified(star, classes, percent), "jaccard-stars")
    found = components(first, "x", "y")
    placed = posts.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("s")
    across = written(_candidates(placed.join(mixed, "s", "left_semi"), percent, True), "jaccard-pairs")
    return components(first.unionByName(verified(across, classes, percent)), "x", "y")


class Join:
    """The join of a document table with itself."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT):
        spark = docs.sparkSession
        self.key, self.percent = key, percent
        self.nameless = sets(docs.filter(F.col(key).isNull()), key, text).select("key", "n").withColumn("component_id", F.col("key"))
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = written(_blocks(docs, key, text, buckets, percent), "jaccard-blocks")
        answers = rows.filter("bucket >= 0").groupBy("bucket").applyInPandas(giving_back(_answer), DDL)
        asked = rows.filter("bucket = -1").unionByName(answers).groupBy("block").applyInPandas(giving_back(_partnered), "key long, n long, may boolean")
        asked = written(asked, "jaccard-partnered")
        forget(rows)
        may = written(asked.filter("may").select("key").distinct(), "jaccard-may")
        self.alone = asked.join(may, "key", "left_anti").select("key", "n")
        again = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        again = maybe_among(again, "key", may).join(may, "key", "left_semi")
        whole = written(sets(again, "key", "text"), "jaccard-sets")
        same = whole.filter("n > 0").groupBy("n", "a", "b").agg(F.min("key").alias("rep"), F.first("shingles").alias("shingles"))
        same = written(same, "jaccard-same")
        self.members = written(whole.drop("shingles"), "jaccard-members")
        forget(whole)
        self.classes = written(dense(same.select("rep", "n", "shingles"), percent), "jaccard-classes")
        # a table of its own, so that a join may split the members of a large class
        self.names = written(same.select("n", "a", "b", "rep"), "jaccard-names")
        forget(same)
        self.posts = written(_postings(self.classes, percent), "jaccard-index")

    def links(self) -> DataFrame:
        """All linked pairs (x, y) of classes, named by their smallest document id."""
        return verified(written(_candidates(self.posts, self.percent, False), "jaccard-pairs"), self.classes, self.percent)

    def components(self) -> DataFrame:
        """(node, component) of the classes that are linked to another."""
        return linked_components(self.posts, self.classes, self.percent)

    def documents(self) -> DataFrame:
        """One row a document: key, n_shingles and component_id, the smallest id in its component."""
        found = self.components().withColumnsRenamed({"node": "rep", "component": "component_id"})
        inside = self.members.filter("n > 0").select("key", "n", "a", "b").join(self.names, ["n", "a", "b"]).join(found, "rep", "left")
        inside = inside.select("key", "n", F.coalesce("component_id", "rep").alias("component_id"))
        rest = self.alone.unionByName(self.members.filter("n = 0").select("key", "n")).withColumn("component_id", F.col("key"))
        out = inside.unionByName(rest).unionByName(self.nameless)
        return out.select(F.col("key").alias(self.key), F.col("n").alias("n_shingles"), "component_id")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with its smallest id; documents without an id stay.

    Of rows that repeat that id, one of each text stays, the first one as JSON.
    """
    gone, often, row = (free_name(docs, n) for n in ("gone", "often", "row"))
    found = Join(docs, key, text, percent).documents().filter(F.col(key).isNotNull())
    marks = found.groupBy(key).agg(F.max(F.col(key) != F.col("component_id")).alias(gone), (F.count("*") > 1).alias(often))
    marks = written(marks.filter(F.col(gone) | F.col(often)), "jaccard-marks")
    some, others = parted(docs, key, marks.select(key))
    some = some.join(marks, key, "left").filter(F.col(gone).isNull() | ~F.col(gone))
    whole = F.struct(*(F.col(c) for c in docs.columns))
    first = some.filter(often).groupBy(key, text).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return others.unionByName(some.filter(F.col(often).isNull()).select(docs.columns)).unionByName(first)
