"""Substring dedup: repeated paragraphs by MinHash banding, and repeated passages inside paragraphs.

A paragraph is a line of at least ``least`` words. Its word shingles give 8
bands of 3 minima: two paragraphs of Jaccard similarity 0.75 meet in a band with
probability 1 - (1 - 0.75^3)^8 = 0.987, of 0.9 with more than 0.9999. Those
that meet are joined, their exact Jaccard similarity is verified, and linked
paragraphs form components.

A passage that was pasted into a longer paragraph leaves that paragraph below
any similarity, so paragraphs are also cut into overlapping windows of ``least``
words, anchored at each shingle that is the smallest of 16 neighbours: every
passage of least + 19 words or more that two documents share has an anchor and a
whole window in common. Windows are joined by hash, which is their band of all
rows. Near those found so, every word starts a window, and these are exchanged
once more: of a shared passage each window is met, so whole runs are removed to
their first and last word.

Of each component the occurrence in the smallest document id stays; the others,
in other documents, are removed. Blocks exchange the keys first (exchange.py),
so only what occurs in two documents is dealt out, and a key that thousands of
documents share is one row a document.

Null, empty and short texts have no paragraphs. Documents without an id take no
part. Rows that repeat id and text are one document, rows of one id with other
texts are not. Extra columns pass through ``removed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bands import linked
from .exchange import cuts, merged, packed, record, tight, unpacked
from .jaccard import dense
from .kernels import SHINGLE, U64, Hasher, forget, free_name, giving_back, maybe_among, mix, parted, shingles, text_chunks, written

LEAST, NEAR = 32, 16
BANDS, ROWS_A_BAND, PERCENT = 8, 3, 75
BLOCK = 6 << 20
SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "block long, bucket int, blob binary"
ODD = U64(0x9E3779B97F4A7C15)


class Texts:
    """Words, shingles, windows and paragraphs of a chunk of texts."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offs: np.ndarray, least: int = LEAST):
        self.starts, self.ends, self.h, self.w = hasher.words(data, offs)
        self.s = shingles(self.h)
        n = np.diff(self.w)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.local = np.arange(len(self.h)) - self.w[self.doc] if len(self.h) else self.doc
        sums = np.append(U64(0), np.cumsum(mix(self.h + self.local.astype(U64) * ODD)))
        self.hash = mix(sums[self.w[1:]] - sums[self.w[:-1]])  # of each text
        self.least, self.data, self.offs = least, data, offs

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of the anchored windows, and their hashes."""
        if len(self.s) < NEAR:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        low = np.lib.stride_tricks.sliding_window_view(self.s, NEAR).argmin(axis=1) + np.arange(len(self.s) - NEAR + 1)
        first = np.arange(len(low))
        at = np.unique(low[self.doc[first] == self.doc[first + NEAR + SHINGLE - 2]])
        at = at[(at + self.least <= len(self.h))]
        at = at[self.doc[at] == self.doc[at + self.least - 1]]
        return at, self.keys(at)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start there."""
        key = np.zeros(len(at), U64)
        for j in [*range(0, self.least - SHINGLE, SHINGLE), self.least - SHINGLE]:
            key = key * ODD + self.s[at + j]
        return mix(key)

    def around(self, at: np.ndarray) -> np.ndarray:
        """First words of all windows that start within NEAR words of the given ones, in their texts."""
        low, high = np.maximum(at - NEAR, self.w[self.doc[at]]), np.minimum(at + NEAR, self.w[self.doc[at] + 1] - self.least)
        step = np.bincount(low, minlength=len(self.h) + 1) - np.bincount(high + 1, minlength=len(self.h) + 1)
        return np.flatnonzero(np.cumsum(step) > 0)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and one past the last of each paragraph."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        cut = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])))
        end = np.append(cut[1:], len(self.h))
        long = end - cut >= self.least
        return cut[long], end[long]

    def bands(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each paragraph, and its band keys, one row a band."""
        if not len(a):
            return np.zeros(0, U64), np.zeros((BANDS, 0), U64)
        n = z - a - SHINGLE + 1
        first = np.cumsum(n) - n
        local = np.arange(n.sum()) - np.repeat(first, n)
        s = self.s[np.repeat(a, n) + local]
        whole = mix(np.add.reduceat(mix(s + local.astype(U64) * ODD), first))
        seeds = mix(np.arange(1, BANDS * ROWS_A_BAND + 1, dtype=np.uint64))
        keys = np.zeros((BANDS, len(a)), U64)
        for k, seed in enumerate(seeds):
            b = k // ROWS_A_BAND
            keys[b] = keys[b] * ODD + mix(np.minimum.reduceat((s ^ seed) * ODD, first)) + U64(b)
        return whole, mix(keys)


def _blocks(docs: DataFrame, key: str, text: str, buckets: int, least: int) -> DataFrame:
    def run(batches):
        hasher, number, held, size, docs_held = Hasher(), TaskContext.get().partitionId() << 20, [], 0, 0

        def flush():
            nonlocal number, held, size, docs_held
            cat = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            all_ = np.concatenate([cat.pop("wkey"), cat.pop("bkey")])
            who = np.concatenate([cat["wdoc"], np.repeat(cat["ldoc"], BANDS)])
            words, at = np.unique(all_, return_inverse=True)
            both = np.unique(at * docs_held + who) // docs_held  # a key counts once a document
            times = np.bincount(both, minlength=len(words))
            cut = cuts(words, buckets)
            blobs = [packed(at=tight(at), **{n: tight(v) if v.dtype == np.int64 and n != "keys" else v for n, v in cat.items()})]
            blobs += [packed(keys=words[a:b], n=tight(np.minimum(times[a:b], 2))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield record(SCHEMA, block=[number] * (buckets + 1), bucket=range(-1, buckets), blob=blobs)
            number, held, size, docs_held = number + 1, [], 0, 0

        for (keys,), data, offs in text_chunks(batches, ["key"], "text"):
            t = Texts(hasher, data, offs, least)
            at, wkey = t.windows()
            a, z = t.lines()
            whole, bands = t.bands(a, z)
            held.append({
                "keys": keys.to_numpy(zero_copy_only=False), "hash": t.hash, "wkey": wkey, "wdoc": t.doc[at] + docs_held, "wpos": t.local[at],
                "bkey": bands.T.ravel(), "lhash": whole, "ldoc": t.doc[a] + docs_held, "lpos": t.local[a], "llen": z - a,
            })
            size, docs_held = size + len(data) + 8 * len(offs), docs_held + len(offs) - 1
            if size >= BLOCK:
                yield from flush()
        if held:
            yield from flush()

    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, DDL)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of keys: which of each block's keys occur in two documents or more."""
    parts, words, at = merged(pdf["blob"].tolist())
    total = np.bincount(at, weights=np.concatenate([p["n"] for p in parts]).astype(float), minlength=len(words))
    shared, ends = (total > 1)[at], np.cumsum([len(p["keys"]) for p in parts])
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "blob": [packed(keys=p["keys"][f], shared=f) for p, e in zip(parts, ends, strict=True) for f in [shared[e - len(p["keys"]) : e]]]})


FOUND = "kind byte, key long, hash long, pos long, len long, id long, bands array<long>"


def _shared(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's windows (kind 0) and paragraphs (kind 1) of which a key occurs in another document too."""
        pdf = pdf.sort_values("bucket")
        b, parts = unpacked(pdf["blob"].iloc[0]), [unpacked(x) for x in pdf["blob"].iloc[1:]]
        shared = np.concatenate([p["shared"] for p in parts])
        known = np.zeros(len(shared), U64)
        known[shared] = np.concatenate([p["keys"] for p in parts])
        at = b["at"].astype(np.int64)
        nw = len(b["wdoc"])
        w = np.flatnonzero(shared[at[:nw]])
        bands = at[nw:].reshape(-1, BANDS)
        line = np.flatnonzero(shared[bands].any(axis=1)) if len(bands) else np.zeros(0, np.int64)
        doc = np.concatenate([b["wdoc"][w], b["ldoc"][line]]).astype(np.int64)
        return pd.DataFrame({
            "kind": np.repeat(np.array([0, 1], np.int8), [len(w), len(line)]), "key": b["keys"][doc], "hash": b["hash"][doc].view(np.int64),
            "pos": np.concatenate([b["wpos"][w], b["lpos"][line]]).astype(np.int64), "len": np.concatenate([np.full(len(w), least), b["llen"][line]]).astype(np.int64),
            "id": np.concatenate([known[at[:nw][w]], b["lhash"][line]]).view(np.int64),
            "bands": pd.Series([None] * len(w) + [known[r][shared[r]].view(np.int64) for r in bands[line]], dtype=object),
        })

    return run


def _windows_near(docs: DataFrame, found: DataFrame, key: str, text: str, buckets: int, least: int) -> DataFrame:
    """Blocks of all windows near the found ones (key, hash, pos): their places, and per bucket the distinct windows with the smallest document of the block."""
    lists = found.groupBy("key").agg(F.collect_list(F.struct("hash", "pos")).alias("want"))
    lists = written(lists, "passages-wanted")
    rows = maybe_among(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", lists.select("key")).join(lists, "key")

    def run(batches):
        hasher, number, held, size, docs_held = Hasher(), TaskContext.get().partitionId() << 20, [], 0, 0

        def flush():
            nonlocal number, held, size, docs_held
            cat = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            order = np.lexsort((cat["hash"].view(np.int64), cat["keys"]))  # as the columns are compared
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, at = np.unique(cat["wkey"], return_inverse=True)
            first = np.full(len(words), len(order), np.int64)
            np.minimum.at(first, at, rank[cat["wdoc"]])
            last = np.full(len(words), -1, np.int64)
            np.maximum.at(last, at, rank[cat["wdoc"]])
            low, high = order[first], order[last]
            several = (cat["keys"][low] != cat["keys"][high]) | (cat["hash"][low] != cat["hash"][high])
            cut = cuts(words, buckets)
            blobs = [packed(at=tight(at), keys=cat["keys"], hash=cat["hash"], wdoc=tight(cat["wdoc"]), wpos=tight(cat["wpos"]))]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                used, local = np.unique(low[a:b], return_inverse=True)
                blobs.append(packed(keys=words[a:b], several=several[a:b], doc=tight(local), dkey=cat["keys"][used], dhash=cat["hash"][used]))
            yield record(SCHEMA, block=[number] * (buckets + 1), bucket=range(-1, buckets), blob=blobs)
            number, held, size, docs_held = number + 1, [], 0, 0

        for (keys, want), data, offs in text_chunks(batches, ["key", "want"], "text"):
            t = Texts(hasher, data, offs, least)
            n, own = np.diff(want.offsets.to_numpy()), want.flatten()
            doc, pos = np.repeat(np.arange(len(n)), n), own.field("pos").to_numpy()
            at = (t.w[:-1][doc] + pos)[own.field("hash").to_numpy() == t.hash.view(np.int64)[doc]]  # rows of one key may have other texts
            at = t.around(at)
            held.append({"keys": keys.to_numpy(zero_copy_only=False), "hash": t.hash, "wkey": t.keys(at), "wdoc": t.doc[at] + docs_held, "wpos": t.local[at]})
            size, docs_held = size + len(data) + 8 * len(offs), docs_held + len(offs) - 1
            if size >= BLOCK:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, DDL)


def _heads(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of windows: the smallest document of each that several documents hold, for each block."""
    parts, words, at = merged(pdf["blob"].tolist())
    base = np.cumsum([0, *(len(p["dkey"]) for p in parts)])
    dkey, dhash = (np.concatenate([p[n] for p in parts]) for n in ("dkey", "dhash"))
    places, rank = np.unique(np.rec.fromarrays([dkey, dhash.view(np.int64)], names="key,hash"), return_inverse=True)
    own = rank[np.concatenate([p["doc"].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])] if len(at) else at
    first, last = np.full(len(words), len(places), np.int64), np.full(len(words), -1, np.int64)
    np.minimum.at(first, at, own)
    np.maximum.at(last, at, own)
    shared = first < last
    shared[at[np.concatenate([p["several"] for p in parts])]] = True
    ends, blobs = np.cumsum([len(p["keys"]) for p in parts]), []
    for p, e in zip(parts, ends, strict=True):
        mine = at[e - len(p["keys"]) : e]
        used, local = np.unique(first[mine[shared[mine]]], return_inverse=True)
        blobs.append(packed(shared=shared[mine], doc=tight(local), dkey=np.asarray(places["key"][used]), dhash=np.asarray(places["hash"][used]).view(U64)))
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "blob": blobs})


SPANS = "key long, hash long, pos long, end long, kept_in long"


def _runs(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's runs of windows that a smaller document holds."""
        pdf = pdf.sort_values("bucket")
        b, parts = unpacked(pdf["blob"].iloc[0]), [unpacked(x) for x in pdf["blob"].iloc[1:]]
        shared = np.concatenate([p["shared"] for p in parts])
        hkey, hhash = np.zeros(len(shared), np.int64), np.zeros(len(shared), U64)
        hkey[shared] = np.concatenate([p["dkey"][p["doc"].astype(np.int64)] for p in parts])
        hhash[shared] = np.concatenate([p["dhash"][p["doc"].astype(np.int64)] for p in parts])
        at, doc, pos = (b[n].astype(np.int64) for n in ("at", "wdoc", "wpos"))
        on = shared[at] & ((hkey[at] != b["keys"][doc]) | (hhash[at] != b["hash"][doc]))
        at, doc, pos = at[on], doc[on], pos[on]
        if not len(at):
            return pd.DataFrame({n.split()[0]: np.zeros(0, np.int64) for n in SPANS.split(", ")})
        g = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + least)))
        z = np.append(g[1:], len(at)) - 1
        return pd.DataFrame({"key": b["keys"][doc[g]], "hash": b["hash"][doc[g]].view(np.int64), "pos": pos[g], "end": pos[z] + least, "kept_in": np.minimum.reduceat(hkey[at], g)})

    return run


def _paragraph_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, n, shingles) of the wanted paragraphs (key, hash, pos, id), read from the texts again."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("hash", "pos", "id")).alias("want"))
    lists = written(lists, "passages-wanted")
    rows = maybe_among(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", lists.select("key")).join(lists, "key")

    def run(batches):
        hasher = Hasher()
        for (want,), data, offs in text_chunks(batches, ["want"], "text"):
            t = Texts(hasher, data, offs, least)
            a, z = t.lines()
            place = {(int(t.doc[x]), int(t.local[x])): (int(x), int(y)) for x, y in zip(a, z, strict=True)}
            out = []
            for d, each in enumerate(want.to_pylist()):
                for e in each:
                    if e["hash"] == int(t.hash[d].view(np.int64)) and (d, e["pos"]) in place:
                        x, y = place[d, e["pos"]]
                        out.append((e["id"], np.unique(t.s[x : y - SHINGLE + 1]).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))], ["id", "n", "shingles"])

    return rows.mapInArrow(run, "id long, n long, shingles array<long>").dropDuplicates(["id"])


def _near(lines: DataFrame, docs: DataFrame, key: str, text: str, percent: int, least: int) -> DataFrame:
    """(id, root): component of each paragraph that is near another one; ids are hashes of whole paragraphs."""
    reps = lines.groupBy("id").agg(F.min(F.struct("key", "hash", "pos")).alias("at"), F.min("bands").alias("bands"))
    met = reps.select("id", F.explode("bands").alias("band"))
    groups = met.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    met = written(met.join(groups.select("band"), "band"), "passages-met")
    wanted = reps.join(met.select("id").distinct(), "id", "left_semi").select("id", "at.*")
    sets = written(_paragraph_sets(docs, wanted, key, text, least), "passages-sets")
    classes = written(dense(sets.select(F.col("id").alias("rep"), "n", "shingles"), percent), "passages-classes")
    out = linked(classes, met.withColumnRenamed("id", "rep"), percent).withColumnsRenamed({"node": "id", "component": "root"})
    for table in (met, sets, classes):
        forget(table)
    return out


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """One row a removed passage: key, hash of the text, first word, number of words, and the smallest document that keeps one of its paragraphs."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(_blocks(docs, key, text, buckets, least), "passages-blocks")
    answers = rows.filter("bucket >= 0").groupBy("bucket").applyInPandas(giving_back(_answer), DDL)
    found = written(rows.filter("bucket = -1").unionByName(answers).groupBy("block").applyInPandas(giving_back(_shared(least)), FOUND), "passages-found")
    forget(rows)
    lines = found.filter("kind = 1")
    roots = _near(lines, docs, key, text, percent, least)
    place = F.struct("key", "hash")
    grouped = lines.join(roots, "id", "left").select(F.coalesce("root", "id").alias("group"), "key", "hash", "pos", "len")
    heads = grouped.groupBy("group").agg(F.min(place).alias("head"), F.max(place).alias("last")).filter("head < last").drop("last")
    spans = grouped.join(heads, "group").filter(place != F.col("head")).select("key", "hash", "pos", (F.col("pos") + F.col("len")).alias("end"), F.col("head.key").alias("kept_in"))
    near = written(_windows_near(docs, found.filter("kind = 0").select("key", "hash", "pos"), key, text, buckets, least), "passages-windows")
    heads = near.filter("bucket >= 0").groupBy("bucket").applyInPandas(giving_back(_heads), DDL)
    spans = spans.unionByName(near.filter("bucket = -1").unionByName(heads).groupBy("block").applyInPandas(giving_back(_runs(least)), SPANS))
    spans = spans.groupBy("key", "hash", "pos").agg(F.max("end").alias("end"), F.min("kept_in").alias("kept_in"))
    by = Window.partitionBy("key", "hash").orderBy("pos")
    spans = spans.withColumn("new", F.coalesce(F.col("pos") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    spans = spans.withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    out = spans.groupBy("key", "hash", "run").agg(F.min("pos").alias("first_word"), (F.max("end") - F.min("pos")).alias("n_words"), F.min("kept_in").alias("kept_in"))
    return out.select(F.col("key").alias(key), F.col("hash").alias("text_hash"), "first_word", "n_words", "kept_in")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The documents without their repeated passages; one of which no word is left goes. ``length`` is counted anew if the table has it."""
    spans = repeats(docs, key, text, **how)
    at, cuts_, left_ = (free_name(docs, n) for n in ("key", "spans", "left"))
    lists = written(spans.groupBy(F.col(key).alias(at)).agg(F.collect_list(F.struct("text_hash", "first_word", "n_words")).alias(cuts_)), "passages-spans")
    some, others = parted(docs.withColumn(at, F.col(key).cast("long")), at, lists.select(at))
    joined = some.join(lists, at, "left").drop(at)
    names = [f.name for f in docs.schema]
    schema = T.StructType([*docs.schema.fields, T.StructField(left_, T.BooleanType())])

    def run(batches):
        hasher = Hasher()
        for cols, data, offs in text_chunks(batches, [*names, cuts_], text):
            t = Texts(hasher, data, offs)
            values, left = cols[names.index(text)].to_pylist(), []
            for d, spans in enumerate(cols[-1].to_pylist()):
                own = [s for s in spans or () if s["text_hash"] == int(t.hash[d].view(np.int64))]
                left.append(True)
                if own:
                    body, at, to, kept = data[offs[d] : offs[d + 1]].tobytes(), 0, int(t.w[d + 1] - t.w[d]), []
                    for s in sorted(own, key=lambda s: s["first_word"]):
                        a, z = t.w[d] + s["first_word"], t.w[d] + s["first_word"] + s["n_words"]
                        kept.append(body[at : t.starts[a] - offs[d]])
                        at = int((t.starts[z] if z < t.w[d + 1] else offs[d + 1]) - offs[d])
                        to -= s["n_words"]
                    values[d] = b"".join([*kept, body[at:]]).decode("utf-8", "replace")
                    left[-1] = to > 0
            out = dict(zip(names, cols, strict=False))
            out[text] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([*(out[n] for n in names), pa.array(left)], [*names, left_])

    out = others.drop(at).unionByName(joined.mapInArrow(run, schema).filter(F.col(left_)).drop(left_))
    return out.withColumn(length, F.length(text).cast(out.schema[length].dataType)) if length in names else out

