"""Ranked lexical search over a clustered index: documents in bisection order, shards visited by their bounds, exact top k.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased. They are told apart by 64-bit hashes. The score is an integer
form of BM25 (``quality`` and ``weight``), so equal scores are equal everywhere.

The index:

1. A tree of ``DEPTH`` bisections is fitted on a sample of at most ``SAMPLE``
   documents and their ``FEATURES`` most common terms: the documents of a node are
   split in two halves, and pairs are swapped between them as long as that makes
   the gaps between postings cheaper (recursive graph bisection). What is kept of a
   node is, for each term, how much cheaper it is on one side than on the other. So
   every document, in the sample or not, is led down the tree to a cluster by one
   product of its terms and those weights. The tree decides what is near what, and
   nothing about results.
2. Each map task sends a cluster its documents as packed postings; a cluster is cut
   into pieces by its bytes, so no cluster is hot, however many copies it holds.
3. A piece is ordered by bisection down to ``LEAF`` documents, over all its terms
   that two of its documents hold, and cut into shards of ``SHARD`` neighbours. A
   shard row has a directory (terms, their number of documents, their greatest
   quality) and postings.

A search reads the directories for how many documents hold each wanted term,
and, with the weights from that, for the bound of each item in each shard,
the sum of its terms' greatest qualities. The ``FIRST`` shards of an item are
visited at once; of the others only those are listed whose bound reaches the k-th
score found by that, and are visited in waves, those of the greatest bounds first,
each wave ``GROWTH`` times as wide. A shard stays unvisited only if its bound is
below the k-th score found so far, so the result is exact, also in ties, which go
by ascending document id, not by place in the index.

Items go through a search together as long as they have at most ``TERMS`` different
terms each turn, which is what is shipped to the tasks; more items are more turns,
an item with more terms is a turn of its own.

Null and empty texts have no terms: they are not counted and never found. Items
without terms find nothing. Documents without an id count in the statistics and
are not ranked, as nothing could name them. Rows that repeat an id are documents of
their own, ranked each. Rows that repeat an item's id are one item, of all their
terms. Very long texts are one row of one piece. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import packed, record, tight, unpacked
from .kernels import U64, Hasher, forget, giving_back, small_batches, text_chunks, written

TOP = 20
SAMPLE, FEATURES, DEPTH = 2048, 8192, 5
BLOCK, PIECE = 6 << 20, 12 << 20
LEAF, SHARD, SWAPS = 64, 256, 5
TERMS, FIRST, GROWTH, VISITS = 1 << 16, 4, 8, 1 << 17


def term_hasher() -> Hasher:
    """A hasher whose words are terms."""
    h = Hasher()
    h.space = np.ones(256, bool)
    h.space[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return h


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The m of documents of n terms; exact, whatever the size of the corpus."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + (25 * n.astype(np.int64) * documents) // max(1, terms)
    return np.array([75 + 25 * int(x) * documents // terms for x in n], np.int64)


def quality(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def counted(hasher: Hasher, data: np.ndarray, offs: np.ndarray):
    """Of a chunk of texts: its distinct terms, each text's number of terms, and (text, term, times) in order of text and term."""
    _, _, h, w = hasher.words(data, offs)
    n = np.diff(w)
    terms, at = np.unique(h, return_inverse=True)
    both, times = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(terms)) + at, return_counts=True)
    doc, term = np.divmod(both, max(1, len(terms)))
    return terms, n, doc, term, times


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    return d * np.log2(n / (d + 1))


def _bisected(doc: np.ndarray, term: np.ndarray, docs: np.ndarray, terms: int, swaps: int) -> np.ndarray:
    """A side (True: right) for each of ``docs``: halves, improved by swaps. doc: places in docs, in order."""
    side = np.arange(len(docs)) >= len(docs) // 2
    nl, nr = int((~side).sum()), int(side.sum())
    for _ in range(swaps):
        right = np.bincount(term, weights=side[doc], minlength=terms)
        left = np.bincount(term, minlength=terms) - right
        now = _cost(left, nl) + _cost(right, nr)
        to_right = now - _cost(np.maximum(left - 1, 0), nl) - _cost(right + 1, nr)
        to_left = now - _cost(left + 1, nl) - _cost(np.maximum(right - 1, 0), nr)
        gain = np.bincount(doc, weights=np.where(side[doc], to_left[term], to_right[term]), minlength=len(docs))
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swap = int(np.count_nonzero(np.cumprod(gain[a[:k]] + gain[b[:k]] > 0)))
        if not swap:
            break
        side[a[:swap]], side[b[:swap]] = True, False
    return side


def _chosen(doc: np.ndarray, term: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of some documents, renumbered by their places in ``docs``."""
    place = np.full(int(doc.max(initial=-1)) + 1, -1)
    known = docs[docs < len(place)]
    place[known] = np.flatnonzero(docs < len(place))
    own = place[doc]
    return own[own >= 0], term[own >= 0]


def bisection_order(doc: np.ndarray, term: np.ndarray, docs: int, leaf: int = LEAF, swaps: int = SWAPS) -> np.ndarray:
    """An order of documents in which those of common terms are neighbours."""
    out, todo = [], [(np.arange(docs), doc, term)]
    while todo:
        own, d, t = todo.pop()
        held = np.bincount(t)
        keep = held[t] > 1  # a term of one document has the same cost on either side
        d, t = d[keep], t[keep]
        if len(own) <= leaf or not len(t):
            out.append(own)
            continue
        names, t = np.unique(t, return_inverse=True)
        side = _bisected(d, t, own, len(names), swaps)
        number = np.where(side, np.cumsum(side), np.cumsum(~side)) - 1
        for s in (True, False):  # the left one is taken first
            mine = side[d] == s
            todo.append((own[side == s], number[d[mine]], t[mine]))
    return np.concatenate(out) if out else np.arange(docs)


class Tree:
    """Bisections of a sample: for each node the weights of the features and the middle between its halves."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, docs: int, depth: int = DEPTH, features: int = FEATURES):
        names, at = np.unique(term, return_inverse=True)
        held = np.bincount(at, minlength=len(names))
        kept = np.sort(np.argsort(-held, kind="stable")[:features])
        kept = kept[held[kept] > 1]
        self.terms, self.depth = names[kept], depth
        number = np.full(len(names), -1)
        number[kept] = np.arange(len(kept))
        doc, term = doc[number[at] >= 0], number[at][number[at] >= 0]
        self.weights, self.middle = np.zeros((len(kept), (1 << depth) - 1), np.float32), np.zeros((1 << depth) - 1, np.float32)
        nodes = {0: np.arange(docs)}
        for k in range((1 << depth) - 1):
            own = nodes.pop(k, np.zeros(0, np.int64))
            if len(own) > 1:
                d, t = _chosen(doc, term, own)
                side = _bisected(d, t, own, len(kept), 2 * SWAPS)
                right = np.bincount(t, weights=side[d], minlength=len(kept))
                left = np.bincount(t, minlength=len(kept)) - right
                nl, nr = len(own) - side.sum(), side.sum()
                self.weights[:, k] = (_cost(left + 1, nl) - _cost(left, nl)) - (_cost(right + 1, nr) - _cost(right, nr))
                score = np.bincount(d, weights=self.weights[t, k], minlength=len(own))
                order = np.argsort(score, kind="stable")
                self.middle[k] = (score[order[len(own) // 2 - 1]] + score[order[len(own) // 2]]) / 2
                nodes[2 * k + 1], nodes[2 * k + 2] = own[score <= self.middle[k]], own[score > self.middle[k]]

    def cluster(self, terms: np.ndarray, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """The leaf of each document of a chunk."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        mine = known[term]
        d, t = doc[mine], at[term[mine]]
        node = np.zeros(docs, np.int64)
        for _ in range(self.depth):
            score = np.bincount(d, weights=self.weights[t, node[d]], minlength=docs)
            node = 2 * node + 1 + (score > self.middle[node])
        return node - ((1 << self.depth) - 1)


def fitted(docs: DataFrame, text: str, sample: int = SAMPLE) -> Tree:
    """The tree of a sample of at most ``sample`` rows; only their distinct terms come to the driver."""
    share = min(1.0, 2 * sample / max(1, docs.count()))

    def run(batches):
        hasher = term_hasher()
        for _, data, offs in text_chunks(batches, [], "text"):
            terms, n, doc, term, _ = counted(hasher, data, offs)
            ends = np.cumsum(np.bincount(doc, minlength=len(n)))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([x.view(np.int64) for x in np.split(terms[term], ends)], pa.list_(pa.int64()))], ["terms"])

    rows = docs.sample(share, 7).select(F.col(text).alias("text")).limit(sample).mapInArrow(run, "terms array<long>").toArrow()["terms"].combine_chunks()
    n = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    return Tree(np.repeat(np.arange(len(n)), n), rows.flatten().to_numpy().view(U64) if len(rows) else np.zeros(0, U64), len(n))


DEALT = pa.schema([("block", pa.int64()), ("cluster", pa.int32()), ("docs", pa.int64()), ("terms", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])


def _dealt(docs: DataFrame, key: str, text: str, tree: Tree) -> DataFrame:
    """Documents by cluster: each block's of a cluster are one row of packed postings."""

    def run(batches):
        hasher, number, held, size = term_hasher(), TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal number, held, size
            rows = {name: [] for name in DEALT.names}
            cat = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            names, at = np.unique(cat.pop("term"), return_inverse=True)
            times, of = cat.pop("times"), cat["cluster"]
            first = np.cumsum(cat["distinct"]) - cat["distinct"]
            for c in np.unique(of).tolist():
                own = np.flatnonzero(of == c)
                n = cat["distinct"][own]
                places = np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                used, local = np.unique(at[places], return_inverse=True)
                rows["block"].append(number)
                rows["cluster"].append(c)
                rows["docs"].append(len(own))
                rows["terms"].append(int(cat["n"][own].sum()))
                rows["size"].append(int(cat["bytes"][own].sum()))
                rows["blob"].append(packed(id=cat["id"][own], named=cat["named"][own], n=tight(cat["n"][own]), distinct=tight(n), terms=names[used], term=tight(local), times=tight(times[places])))
            yield record(DEALT, **rows)
            number, held, size = number + 1, [], 0

        for (ids,), data, offs in text_chunks(batches, ["key"], "text"):
            terms, n, doc, term, times = counted(hasher, data, offs)
            if len(doc):
                cluster, full = tree.cluster(terms, doc, term, len(n)), np.flatnonzero(n)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                held.append({
                    "id": ids.fill_null(0).to_numpy()[full], "named": named[full], "n": n[full], "distinct": np.bincount(doc, minlength=len(n))[full], "cluster": cluster[full],
                    "bytes": np.diff(offs)[full], "term": terms[term], "times": times,
                })
                size += len(data) + 8 * len(offs)
            if size >= BLOCK and held:
                yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "block long, cluster int, docs long, terms long, size long, blob binary")


SHARDS = "shard string, docs long, directory binary, postings binary"


def _shards(documents: int, terms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A piece of a cluster: its documents in bisection order, cut into shards."""
        parts = [unpacked(b) for b in pdf["blob"]]
        names = np.unique(np.concatenate([p["terms"] for p in parts]))
        ids, named, n, distinct = (np.concatenate([p[x] for p in parts]) for x in ("id", "named", "n", "distinct"))
        term = np.concatenate([np.searchsorted(names, p["terms"])[p["term"]] for p in parts])
        times = np.concatenate([p["times"].astype(np.int64) for p in parts])
        distinct = distinct.astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), distinct)
        order = bisection_order(doc, term, len(ids))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        value = quality(times, lengths(n, documents, terms)[doc])
        at = place[doc]
        sort = np.lexsort((at, term, at // SHARD))
        at, term, value = at[sort], term[sort], value[sort]
        cut = np.searchsorted(at // SHARD, np.arange(-(-len(ids) // SHARD) + 1))
        rows = []
        for k, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            own = order[k * SHARD : (k + 1) * SHARD]
            first = np.flatnonzero(np.append(True, term[a + 1 : z] != term[a : z - 1]))
            held = np.diff(np.append(first, z - a))
            directory = packed(terms=names[term[a:z][first]], held=tight(held), most=np.maximum.reduceat(value[a:z], first))
            postings = packed(id=ids[own], named=named[own], place=tight(at[a:z] - k * SHARD), value=tight(value[a:z]))
            rows.append((f"{pdf['cluster'].iloc[0]}-{pdf['piece'].iloc[0]}-{k}", len(own), directory, postings))
        return pd.DataFrame(rows, columns=["shard", "docs", "directory", "postings"])

    return run


class Index:
    """A clustered index of the documents: one row a shard, in the shared folder."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        self.spark, self.key = docs.sparkSession, key
        rows = written(_dealt(docs, key, text, fitted(docs, text)), "search-dealt")
        self.documents, self.terms = (int(x or 0) for x in rows.agg(F.sum("docs"), F.sum("terms")).first())
        sizes = rows.groupBy("cluster").agg(F.ceil(F.sum("size") / PIECE).alias("pieces"))  # at most 2 to the power of DEPTH rows
        rows_ = rows.join(F.broadcast(sizes), "cluster").withColumn("piece", F.pmod(F.xxhash64("block"), F.col("pieces")))
        shards = rows_.select("cluster", "piece", "blob").groupBy("cluster", "piece").applyInPandas(giving_back(_shards(self.documents, self.terms)), SHARDS)
        self.shards = written(shards, "search-shards")
        forget(rows)

    def top(self, items: DataFrame, item: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
        """(item, rank, doc_id, score): the k best documents of each item."""
        wanted = written(_item_terms(items, item, text), "search-items")
        turns = max(1, -(-wanted.agg(F.count("*")).first()[0] // TERMS))
        found = [self._turn(wanted.filter(F.pmod(F.xxhash64("item"), F.lit(turns)) == t) if turns > 1 else wanted, k) for t in range(turns)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        forget(wanted)
        return out.withColumnsRenamed({"item": item, "doc_id": self.key})

    def _turn(self, wanted: DataFrame, k: int) -> DataFrame:
        rows = wanted.toArrow()  # at most about TERMS rows
        items, whose = np.unique(rows["item"].to_numpy(), return_inverse=True)
        terms, which = np.unique(rows["term"].to_numpy().view(U64), return_inverse=True)
        times = rows["times"].to_numpy()
        with small_batches(self.spark):
            holding = dict(self.shards.select("directory").mapInArrow(_holding(terms), "term int, held long").groupBy("term").agg(F.sum("held")).collect())
        weights = np.array([weight(self.documents, holding.get(t, 0)) for t in range(len(terms))], np.int64)
        query = Query(items, terms, whose, which, weights[which] * times if len(which) else which, k)
        by = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
        ranked = lambda: self.shards.select("shard", "directory").mapInArrow(query.bounds, "shard string, item long, bound long").withColumn("turn", F.row_number().over(by))
        found = self._best(self._visited(ranked().filter(F.col("turn") <= FIRST), query), k)
        # from here on only shards that may hold something better are of interest; they come first, so their turns stay the same
        query.least[:] = 0
        for r in _least(found, k).filter("n >= least_n").collect():  # at most a row an item of this turn
            query.least[np.searchsorted(items, r["item"])] = r["least"]
        rest, low, high = written(ranked().filter(F.col("turn") > FIRST), "search-bounds"), FIRST, FIRST * GROWTH
        while True:
            left = _open(rest.filter(F.col("turn") > low), found, k)
            if left.isEmpty():
                forget(rest)
                return found.select("item", "rank", "doc_id", "score")
            now = self._best(self._visited(left.filter(F.col("turn") <= high), query).unionByName(found.drop("rank")), k)
            forget(found)
            found, low, high = now, high, high * GROWTH

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        return written(hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "search-found")

    def _visited(self, left: DataFrame, query: Query) -> DataFrame:
        """Scores of what is visited. Shards stay where they are as long as the list of visits has at most ``VISITS`` rows, beyond that they are joined by a shuffle."""
        left = written(left.select("shard", "item"), "search-visits")
        pairs = left.groupBy("shard").agg(F.collect_list("item").alias("items"))  # at most the items of a turn
        pairs = F.broadcast(pairs) if left.count() <= VISITS else pairs
        return self.shards.join(pairs, "shard").select("items", "directory", "postings").mapInArrow(query.scores, "item long, doc_id long, score long")


def _least(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.lit(k).alias("least_n"))


def _open(ranked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The shards whose bound reaches the k-th score; an equal one could hold a smaller id."""
    return ranked.join(_least(found, k), "item", "left").filter("n IS NULL OR n < least_n OR bound >= least").drop("n", "least", "least_n")


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times); rows without an id are no items."""

    def run(batches):
        hasher = term_hasher()
        for (ids,), data, offs in text_chunks(batches, ["item"], "text"):
            terms, _, doc, term, times = counted(hasher, data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(ids.to_numpy()[doc]), pa.array(terms[term].view(np.int64)), pa.array(times)], ["item", "term", "times"])

    rows = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item long, term long, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def _where(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms there are, and where."""
    at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    hit = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    return hit, at[hit]


def _holding(wanted: np.ndarray):
    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                d = unpacked(blob.as_py())
                hit, at = _where(d["terms"], wanted)
                total[hit] += d["held"][at].astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "held"])

    return run


class Query:
    """Items as (item, term, factor), factor being the term's weight by its repeats; shipped to the tasks."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, whose: np.ndarray, which: np.ndarray, factor: np.ndarray, k: int):
        self.k = k
        order = np.argsort(whose, kind="stable")
        self.items, self.terms, self.whose, self.which, self.factor = items, terms, whose[order], which[order], factor[order]
        self.first = np.searchsorted(self.whose, np.arange(len(items) + 1))
        self.least = np.zeros(len(items), np.int64)

    def bounds(self, batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = unpacked(blob.as_py())
                most = np.zeros(len(self.terms), np.int64)
                hit, at = _where(d["terms"], self.terms)
                most[hit] = d["most"][at]
                bound = np.zeros(len(self.items), np.int64)
                np.add.at(bound, self.whose, self.factor * most[self.which])
                some = np.flatnonzero((bound > 0) & (bound >= self.least))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.string()), pa.array(self.items[some], pa.int64()), pa.array(bound[some])], ["shard", "item", "bound"])

    def scores(self, batches):
        for batch in batches:
            for items, directory, postings in zip(*(batch.column(k) for k in range(3)), strict=True):
                d, p = unpacked(directory.as_py()), unpacked(postings.as_py())
                ends = np.cumsum(d["held"].astype(np.int64))
                place, value = p["place"].astype(np.int64), p["value"].astype(np.int64)
                slot = np.full(len(self.terms), -1)
                hit, at = _where(d["terms"], self.terms)
                slot[hit] = at
                out = []
                for i in np.searchsorted(self.items, np.array(items.as_py())).tolist():
                    a, z = self.first[i], self.first[i + 1]
                    own, factor = slot[self.which[a:z]], self.factor[a:z]
                    own, factor = own[own >= 0], factor[own >= 0]
                    n = d["held"][own].astype(np.int64)
                    at = np.repeat(ends[own] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    score = np.zeros(len(p["id"]), np.int64)
                    np.add.at(score, place[at], np.repeat(factor, n) * value[at])
                    score[~p["named"]] = 0
                    best = np.lexsort((p["id"], -score))[: self.k]
                    best = best[score[best] > 0]
                    out.append((np.full(len(best), self.items[i]), p["id"][best], score[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["item", "doc_id", "score"])
