"""Katz backoff language model of order 2, counted, normalised and applied by array blocks.

A text's tokens are its words (lower-cased A-Z) and one end; a start, which is
never predicted, stands before the first. With c the training counts, N tokens
and V distinct ones:

* unigram: p(w) = d_c c(w) / N for known words; what discounting frees goes to
  one unknown type, which all unknown words share.
* bigram: p(w|h) = d_c c(h,w) / c(h) if the pair is known, else a(h) p(w), with
  a(h) = (1 - sum of p(w|h) over known pairs) / (1 - sum of p(w) over the same w).
  For an unknown h, p(w|h) = p(w).

d_r are Good-Turing discounts for r <= 5 (Katz 1987); where those are undefined
or not between 0 and 1, r - D over r with D = n1 / (n1 + 2 n2), or D = 0.5. If
all of a history's pairs occur more than 5 times nothing is freed; then its
counts are divided by c(h) + 1 and the rest is what backs off. So every
distribution sums to exactly 1.

Stages, each a shuffle of compressed arrays (see exchange.py):
1. blocks of texts send their distinct words with training counts, and whether
   an untrained text holds them, to word buckets, which answer with the same of
   the corpus;
2. blocks send each distinct pair with its words' counts and its documents to a
   bucket of the history; a history of very many tokens is split by the next
   word. Buckets hold the model (``bigrams`` returns its counts) and emit sums per
   document that need no discount, plus, per history, what a(h) needs;
3. the discounts are known now; a(h) is computed per history and applied to the
   documents with unknown pairs, and all parts are summed per document.

Null texts are empty (one end). Repeated keys are separate rows with the same
score. An empty table gives an empty result; without training rows each token
is unknown and p = 1. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import bucket_of, cuts, groups, merged, packed, record, tight, unpacked
from .kernels import U64, Hasher, mix, text_chunks, written

END, START = U64(0xE4D), U64(0x57A7)
K = 5
#: Words behind one history are told apart by this many bytes of their hash: at 6, n of them are mistaken with probability n^2 / 2^49.
WORD_BYTES = 6
WORD = U64((1 << 8 * WORD_BYTES) - 1)
BLOCK = 5 << 20

ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "block long, bucket int, blob binary"


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 .. d_5 (d_0 unused) from the numbers n[r] of types seen r times, r <= 6."""
    r = np.arange(K + 2)
    d = np.ones(K + 1)
    with np.errstate(all="ignore"):
        common = (K + 1) * n[K + 1] / n[1]
        d[1:] = ((r[1:-1] + 1) * n[2:] / n[1:-1] / r[1:-1] - common) / (1 - common)
    if not (np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] < 1).all()):
        step = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:] = 1 - step / r[1 : K + 1]
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


def narrow(w: np.ndarray) -> np.ndarray:
    """The low bytes of 64-bit numbers, as one plane a byte."""
    return np.ascontiguousarray(w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).reshape(-1)


def wide(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = b.reshape(-1, WORD_BYTES)
    return out.view("<u8").reshape(-1).astype(U64)


class Unigram:
    def __init__(self, n: np.ndarray, tokens: int):
        self.d, self.tokens = discounts(n.astype(float)), tokens
        freed = sum(r * (1 - self.d[r]) * n[r] for r in range(1, K + 1)) / tokens if tokens else 1.0
        # every word seen more than 5 times: one count more, for the unknown
        self.over = tokens + (0 if freed > 0 else 1)
        self.unknown = freed if freed > 0 else 1 / self.over

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.over, 1), self.unknown)


def blocks(docs: DataFrame, key: str, text: str, train: Column, buckets: int) -> DataFrame:
    """Stage 1's rows: per block its tokens (bucket -1), and per bucket its distinct words and their training counts."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), train.alias("train"))

    def run(batches):
        hasher, held, size, number = Hasher(), [], 0, TaskContext.get().partitionId() << 20

        def flush():
            nonlocal held, size, number
            keys, null, flags, lens, tok = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            words, at = np.unique(tok, return_inverse=True)
            trained = np.repeat(flags, lens)
            counts = np.bincount(at[trained], minlength=len(words))
            held_out = np.bincount(at[~trained], minlength=len(words)) > 0
            cut = cuts(words, buckets)
            # tokens by falling frequency are small numbers; hashes tell where each word's answer is
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            blobs = [packed(keys=keys, null=null, train=flags, lens=tight(lens), at=tight(rank[at]), words=words[often])]
            blobs += [packed(keys=words[a:b], n=tight(counts[a:b]), held=np.packbits(held_out[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield record(ROWS, block=[number] * (buckets + 1), bucket=range(-1, buckets), blob=blobs)
            number += 1

        for (keys, flags), data, offs in text_chunks(batches, ["key", "train"], "text"):
            _, _, h, w = hasher.words(data, offs)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), null, flags.to_numpy(zero_copy_only=False), np.diff(w) + 1, np.insert(h, w[1:], END)))
            size += len(data) + 8 * len(offs)  # empty texts take room too
            if size >= BLOCK:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, DDL)


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A word bucket: the corpus count of each block's words, and whether untrained texts hold them; in block -1 the count of counts and totals."""
    parts, words, at = merged(pdf["blob"].tolist())
    total = np.bincount(at, weights=np.concatenate([p["n"] for p in parts]).astype(float), minlength=len(words)).astype(np.int64)
    held = np.bincount(at, weights=np.concatenate([np.unpackbits(p["held"], count=len(p["keys"])) for p in parts]), minlength=len(words)) > 0
    ends = np.cumsum([len(p["keys"]) for p in parts])
    blobs = [packed(c=tight(total[k]), held=np.packbits(held[k])) for p, e in zip(parts, ends, strict=True) for k in [at[e - len(p["keys"]) : e]]]
    stats = np.append(np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2], [(total > 0).sum(), total.sum()])
    out = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "blob": blobs})
    return pd.concat([out, pd.DataFrame({"block": [-1], "bucket": [int(key[0])], "blob": [packed(stats=stats)]})])


def _pairs(buckets: int, heavy: int, tokens: int, types: int, unigram: Unigram, starts: int, all_pairs: bool = False):
    """A block: its distinct (history, word, document) triples, dealt to buckets of the history, and one blob of what its documents are.

    Two kinds of triples are scored here and not dealt out, unless all pairs
    are wanted: one whose word or history occurs once in training, here, so the
    pair does too and counts for its history by the word's count alone, if its
    words are not both in untrained texts, which may then hold the pair; and one
    with an unknown history. Unknown words behind one history are one pair.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        number = int(pdf["block"].iloc[0])
        b = unpacked(pdf["blob"].iloc[0])
        count, asked = np.empty(len(b["words"]), np.int64), np.empty(len(b["words"]) + 1, bool)
        answers, by_hash = [unpacked(x) for x in pdf["blob"].iloc[1:]], np.argsort(b["words"])
        count[by_hash] = np.concatenate([x["c"] for x in answers])
        asked[by_hash] = np.concatenate([np.unpackbits(x["held"], count=len(x["c"])) for x in answers])
        asked[-1] = True  # the start
        words, at, lens = b["words"], b["at"].astype(np.int64), b["lens"].astype(np.int64)
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(lens)), lens)
        rows = (number << 22) + np.arange(len(lens))
        seen = count[at]
        base = np.bincount(doc, weights=np.log10((seen + 1) / (tokens + types + 1)), minlength=len(lens))
        about = {"rows": rows, "keys": b["keys"], "null": b["null"], "held": ~b["train"], "lens": lens, "known": np.bincount(doc, weights=seen > 0, minlength=len(lens)).astype(np.int64), "base": base}
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[ends - lens] = len(words)  # the start
        hashes, hcount = np.append(words, START), np.append(count, -1)
        width, docs = len(words), len(lens)
        triple, mult = np.unique((before * width + at) * docs + doc, return_counts=True)
        doc, h, w = triple % docs, triple // docs // width, triple // docs % width
        of_h = np.where(hcount[h] < 0, starts, hcount[h])
        trained = b["train"][doc]
        once, lost = trained & ((count[w] == 1) | (hcount[h] == 1)) & ~(asked[w] & asked[h]) & (not all_pairs), ~trained & (of_h == 0)
        sure = np.bincount(doc[once], weights=-np.log10(of_h[once]), minlength=docs) + np.bincount(doc[lost], weights=mult[lost] * np.log10(unigram.p(count[w[lost]])), minlength=docs)
        about |= {"sure": sure, "once": np.bincount(doc[once], minlength=docs)}
        top = int(count.max(initial=0)) + 1
        eh, ek = np.unique(h[once] * top + count[w[once]], return_counts=True)
        eh, ewc = eh // top, eh % top
        e_split = np.where(hcount[eh] < 0, buckets, np.minimum(buckets, 1 + hcount[eh] // heavy)) > 1
        e_bucket = bucket_of(mix(hashes[eh]), buckets).astype(np.int64)
        rest = ~(once | lost)
        triple, mult, doc, h, w = (x[rest] for x in (triple, mult, doc, h, w))
        wid = np.where(count[w] > 0, words[w] & WORD, U64(0))
        pair = h * (width + 1) + np.where(count[w] > 0, w + 1, 0)
        order = np.lexsort((doc, pair))
        if len(order):  # unknown words may have brought a pair and document together
            g = np.flatnonzero(np.append(True, (pair[order][1:] != pair[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
            mult = np.add.reduceat(mult[order], g)
            doc, h, w, pair, wid = (x[order][g] for x in (doc, h, w, pair, wid))
        # heavy histories are split by the next word; one that starts texts counts as heavy
        split = np.where(hcount[h] < 0, buckets, np.minimum(buckets, 1 + hcount[h] // heavy))
        salt = np.where(split > 1, mix(wid) % split.astype(U64), U64(0))
        bucket = bucket_of(mix(hashes[h] + salt * U64(0x9E3779B97F4A7C15)), buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = [(number % buckets, packed(**about))]
        for k in range(buckets):
            o, e = order[cut[k] : cut[k + 1]], np.flatnonzero(e_bucket == k)
            if len(o) or len(e):
                g, hg = groups(pair[o]), groups(h[o])
                used, local = np.unique(doc[o], return_inverse=True)
                out.append((k, packed(
                    h=hashes[h[o][hg]], hc=tight(hcount[h[o][hg]] + 1), hn=tight(np.diff(np.append(np.searchsorted(g, hg), len(g)))), many=split[o][hg] > 1,
                    eh=hashes[eh[e]], ek=tight(ek[e]), ewc=tight(ewc[e]), ehc=tight(hcount[eh[e]] + 1), emany=e_split[e], w=narrow(wid[o][g]), wc=tight(count[w[o][g]]), n=tight(np.diff(np.append(g, len(o)))), doc=tight(local), mult=tight(mult[o]), rows=rows[used], train=b["train"][used],
                )))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    return run


class Bucket:
    """The merged pairs of one bucket: distinct pairs (c, wc, hist) and histories (h, hc, many), and one entry a pair and document."""

    def __init__(self, parts: list[dict], starts: int, p):
        cat = lambda name: np.concatenate([p[name] for p in parts])
        h = np.concatenate([np.repeat(p["h"], p["hn"]) for p in parts])
        base = np.cumsum([0, *(len(p["rows"]) for p in parts)])
        self.doc = np.concatenate([p["doc"].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        self.train, w = cat("train"), np.concatenate([wide(p["w"]) for p in parts])
        self.rows, row_at = np.unique(cat("rows"), return_inverse=True)
        self.mult = cat("mult").astype(np.int64)
        _, first, at = np.unique(mix(h) + w * U64(0x2545F4914F6CDD1D), return_index=True, return_inverse=True)
        self.pair = np.repeat(at, cat("n"))
        self.c = np.bincount(self.pair, weights=self.mult * self.train[self.doc], minlength=len(first)).astype(np.int64)
        self.wc, self.w = cat("wc")[first].astype(np.int64), w[first]
        self.doc = row_at[self.doc]
        hashes, place = np.unique(np.concatenate([cat("h"), cat("eh")]), return_index=True)
        self.h, self.hist = hashes, np.searchsorted(hashes, h[first])
        self.hc = np.concatenate([cat("hc").astype(np.int64), cat("ehc").astype(np.int64)])[place] - 1
        self.many = np.concatenate([cat("many"), cat("emany")])[place]
        self.hc[self.hc < 0] = starts
        # pairs that occur once because their word or history does, and the sum of p(w) over them
        who, k = np.searchsorted(hashes, cat("eh")), cat("ek").astype(np.int64)
        self.once = np.bincount(who, weights=k, minlength=len(hashes)).astype(np.int64)
        self.once_mass = np.bincount(who, weights=k * p(cat("ewc").astype(np.int64)), minlength=len(hashes))

    def by_history(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.hist, weights=values, minlength=len(self.h))


PART = "kind byte, h long, row long, c long, mult long, sure double, n1 long, n2 long, n3 long, n4 long, n5 long"
NAMES = [c.split()[0] for c in PART.split(", ")]


def _rows(default: int, size: int, **cols) -> pd.DataFrame:
    return pd.DataFrame({n: cols.get(n, np.zeros(size, np.float64 if n == "sure" else np.int8 if n == "kind" else np.int64) + (default if n == "kind" else 0)) for n in NAMES})


def _score(unigram: Unigram, starts: int):
    """A pair bucket's rows, by kind.

    0, a document: sure is the sum of what needs no discount, n_r how often d_r is a factor.
    1, a history: n_r of its pairs, the sum of all larger counts (mult), the sum of p(w) over known pairs (sure); 2 if it is split.
    3, a document's unknown pairs behind a history (mult); 4 if that is split, then with the known ones in n1 where they may matter.
    5, this bucket's n_1 to n_6 (n_6 in c).
    6, a document: key (null if n1), tokens (c), known tokens (mult), base score (sure), held out (n2).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(x) for x in pdf["blob"]]
        out = [_rows(6, len(p["rows"]), row=p["rows"], h=p["keys"], c=p["lens"], mult=p["known"], sure=p["base"], n1=p["null"].astype(np.int64), n2=p["held"].astype(np.int64)) for p in parts if "base" in p]
        out += [_rows(0, len(p["rows"]), row=p["rows"], sure=p["sure"], n1=p["once"]) for p in parts if "base" in p]
        parts = [p for p in parts if "base" not in p]
        if not parts:
            return pd.concat(out)
        b = Bucket(parts, starts, unigram.p)
        hist, c = b.hist[b.pair], b.c[b.pair]
        hc, known = b.hc[hist], c > 0
        sums = lambda sel, v: np.bincount(b.doc[sel], weights=v, minlength=len(b.rows))
        few = (b.by_history((b.c > 0) & (b.c <= K)) > 0) | (b.once > 0)
        plus = (~few & ~b.many)[hist]  # all pairs are here and frequent: one count goes to the unknown
        sure = sums(known, b.mult[known] * np.log10(c[known] / (hc + plus)[known])) + sums(~known, b.mult[~known] * np.log10(unigram.p(b.wc[b.pair][~known])))
        n = {f"n{r}": sums(c == r, b.mult[c == r]).astype(np.int64) for r in range(1, K + 1)}
        out.append(_rows(0, len(b.rows), row=b.rows, sure=sure, **n))
        # what needs a(h); an unknown history has none
        ask = np.flatnonzero((hc > 0) & (~known | (b.many & ~few)[hist]))
        u, at = np.unique(hist[ask] * len(b.rows) + b.doc[ask], return_inverse=True)
        miss = np.bincount(at, weights=b.mult[ask] * ~known[ask], minlength=len(u)).astype(np.int64)
        hit = np.bincount(at, weights=b.mult[ask] * known[ask], minlength=len(u)).astype(np.int64)
        who = u // len(b.rows)
        out.append(_rows(3, len(u), kind=np.where(b.many[who], 4, 3).astype(np.int8), h=b.h[who].view(np.int64), row=b.rows[u % len(b.rows)], mult=miss, n1=hit))
        asked = b.many.copy()
        asked[who] = True
        stats = {f"n{r}": (b.by_history(b.c == r).astype(np.int64) + (b.once if r == 1 else 0))[asked] for r in range(1, K + 1)}
        more = b.by_history(np.where(b.c > K, b.c, 0)).astype(np.int64)[asked]
        mass = (b.by_history(np.where(b.c > 0, unigram.p(b.wc), 0)) + b.once_mass)[asked]
        out.append(_rows(1, len(more), kind=np.where(b.many[asked], 2, 1).astype(np.int8), h=b.h[asked].view(np.int64), c=b.hc[asked], mult=more, sure=mass, **stats))
        total = np.bincount(np.minimum(b.c, K + 2), minlength=K + 3)
        total[1] += b.once.sum()
        out.append(_rows(5, 1, c=total[K + 1 : K + 2], **{f"n{r}": total[r : r + 1] for r in range(1, K + 1)}))
        return pd.concat(out)

    return run


def _model(starts: int):
    """A pair bucket's known pairs as rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p for p in (unpacked(x) for x in pdf["blob"]) if "base" not in p]
        if not parts:
            return pd.DataFrame({n: [] for n in ("h", "w", "n", "h_n")}, dtype=np.int64)
        b = Bucket(parts, starts, lambda c: c * 0.0)
        on = b.c > 0
        return pd.DataFrame({"h": b.h[b.hist[on]].view(np.int64), "w": b.w[on].view(np.int64), "n": b.c[on], "h_n": b.hc[b.hist[on]]})

    return run


class Model:
    """Counts of ``docs`` where ``train`` holds, with every document's pairs laid out for scoring."""

    def __init__(self, docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", buckets: int | None = None, stable: bool = False):
        """``stable`` says that reading docs again gives the same rows in the same partitions, as a scan of files does; then no copy is written."""
        spark = docs.sparkSession
        self.key, train = key, F.coalesce(train, F.lit(False))
        self.buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = blocks(docs, key, text, train, self.buckets)
        rows = rows if stable else written(rows, "katz-blocks")
        answers = written(rows.filter("bucket >= 0").groupBy("bucket").applyInPandas(_answer, DDL), "katz-words")
        stats = [unpacked(r["blob"])["stats"] for r in answers.filter("block = -1").select("blob").collect()]  # 72 bytes a bucket
        stats = np.sum(stats, axis=0) if stats else np.zeros(K + 4, np.int64)
        self.types, self.tokens = int(stats[-2]), int(stats[-1])
        self.unigram = Unigram(stats[: K + 2], self.tokens)
        self.starts = docs.filter(train).count()
        self.heavy = max(1000, self.tokens // (2 * self.buckets))  # at most 2 buckets + 1 histories are split
        self.both = rows.filter("bucket = -1").unionByName(answers.filter("block >= 0"))

    def pairs(self, all_pairs: bool = False) -> DataFrame:
        return self.both.groupBy("block").applyInPandas(_pairs(self.buckets, self.heavy, self.tokens, self.types, self.unigram, self.starts, all_pairs), "bucket int, blob binary")

    def bigrams(self) -> DataFrame:
        """The known pairs by hash, with their count and their history's; write with partitionBy("bucket") to keep the model."""
        return self.pairs(all_pairs=True).groupBy("bucket").applyInPandas(_model(self.starts), "h long, w long, n long, h_n long").withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))

    def scores(self) -> DataFrame:
        """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score and score, the log10 probability of its text."""
        parts = written(self.pairs().groupBy("bucket").applyInPandas(_score(self.unigram, self.starts), PART), "katz-parts")
        ranks = range(1, K + 1)
        total = lambda terms: sum(terms, F.lit(0.0))
        n = parts.filter("kind = 5").agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in ranks], F.coalesce(F.sum("c"), F.lit(0))).first()
        self.bigram = d = discounts(np.array([0, *n], float))
        found = []
        for history, asking in ((1, 3), (2, 4)):
            per = parts.filter(F.col("kind") == history).groupBy("h").agg(F.max("c").alias("c"), F.sum("sure").alias("mass"), *[F.sum(f"n{r}").alias(f"n{r}") for r in ranks])
            few = total(F.col(f"n{r}") for r in ranks) > 0
            free = total(F.lit(float(r * (1 - d[r]))) * F.col(f"n{r}") for r in ranks) / F.col("c")
            back = F.log10(F.when(few, free).otherwise(1 / (F.col("c") + 1)) / (1 - F.col("mass")))
            per = per.select("h", back.alias("back"), F.when(few, 0.0).otherwise(F.log10(F.col("c") / (F.col("c") + 1))).alias("less"))
            asks = parts.filter(F.col("kind") == asking).select("h", "row", "mult", "n1").join(F.broadcast(per) if history == 2 else per, "h")
            found.append(asks.select("row", F.lit(0).cast("byte").alias("kind"), (F.col("mult") * F.col("back") + F.col("n1") * F.col("less")).alias("s")))
        logs = total(F.lit(float(np.log10(d[r]))) * F.col(f"n{r}") for r in ranks)
        early = parts.filter("kind = 0").select("row", "kind", (F.col("sure") + logs).alias("s"))
        about = parts.filter("kind = 6").select("row", F.when(F.col("n1") == 0, F.col("h")).alias("key"), F.col("n2").alias("held"), F.col("c").alias("tokens"), F.col("mult").alias("known"), F.col("sure").alias("base"))
        sums = early.unionByName(found[0]).unionByName(found[1]).groupBy("row").agg(F.sum("s").alias("score"))
        out = about.join(sums, "row")
        return out.select(F.col("key").alias(self.key), (F.col("held") == 1).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(self.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
