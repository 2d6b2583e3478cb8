"""Best-fit packing of tokenised documents with certified bin counts.

Documents become token pieces of at most ``capacity`` ids; full pieces are
sequences of their own. The others are dealt over partitions by hash and packed
by best-fit decreasing. Dual-feasible functions give each partition a lower
bound: a partition that meets it is certified and gives up only its emptiest
sequence, as bounds of several partitions are rounded up one by one. A partition
with a gap gives up all sequences that have room left. What was given up is
packed again over as many partitions as it fills (see ``pack`` for the end).

A null or empty text is one piece of the end id. Repeated rows are packed one
by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import text_chunks, written

CAPACITY, END = 1024, 2
CACHE = 400_000


def encoder(path: str):
    """ids(text) -> bytes of little-endian 32-bit ids, for a byte-level BPE file of the tokenizers library.

    In such a vocabulary a lower id is an earlier merge, so it serves as ranks
    for tiktoken, which yields the same ids several times faster. A space that
    stands before a non-space always starts a piece of the pre-tokeniser, so
    words are encoded once and kept; a text with other runs of spaces is encoded whole.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    model = json.load(open(path, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
    encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(text: str) -> bytes:
        return array("I", encode(text)).tobytes()

    class Words(dict):
        def __missing__(self, word):
            if not word or word[0].isspace():
                raise LookupError
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids = whole(" " + word)
            return ids

    words = Words()

    def ids(text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return whole(first) + b"".join([words[w] for w in rest])
        except LookupError:
            return whole(text)

    return ids


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token pieces of all documents; of a longer one all but the first are full."""
    tail = array("I", [end]).tobytes()

    def run(batches):
        ids = None
        for (keys,), data, offs in text_chunks(batches, [key], text):
            ids = ids or encoder(path)
            take, rows = [], []
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                body = ids(data[a:b].tobytes().decode("utf-8", "replace")) + tail
                n, at, piece = len(body) // 4, 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append((piece, at, size, zlib.crc32(body[4 * at : 4 * (at + size)])))
                    take.append(k)
                    at, piece = at + size, piece + 1
            cols = [np.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(take)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound that dual-feasible functions prove for the number of bins."""
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for cut in range(1, capacity // 2 + 1):  # large sizes count as a whole bin, small ones as nothing
        best = max(best, -(-int(count[(x >= cut) & (x <= capacity - cut)] @ x[(x >= cut) & (x <= capacity - cut)] + capacity * count[x > capacity - cut].sum()) // capacity))
    for k in range(1, 21):  # rounding to k-ths
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's room left.

    Bins wait in one stack per room left; the bits of an integer say which
    stacks hold any, so an item finds the tightest bin in constant time.
    """
    bins, offs, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        fit = some >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                some &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[k], offs[k] = b, capacity - left
        room[b] = left = left - n
        if left:
            stacks[left].append(b)
            some |= 1 << left
    return bins, offs, np.array(room, np.int64)


def _packer(own: list[str], capacity: int, turn: int, last: bool):
    """Packs one partition. Unless it is the last one, what lies in sequences with room stays loose if there is a gap, else only what lies in the emptiest."""

    def fit(key, pdf):
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offs, room = best_fit(sizes, capacity)
        most = 1 if len(room) > lower_bound(sizes, capacity) else room.max()
        return pdf[own].assign(sequence_id=(turn << 56) + (int(key[0]) << 32) + bins, offset=offs, loose=(not last) & (room[bins] >= max(1, most)))

    return fit


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = 50_000) -> DataFrame:
    """items with sequence_id and offset, gapless within each sequence; ``length`` is an item's size, at most capacity.

    Each round deals what is loose into partitions of about ``per_partition``
    items, or into one if four times as many would hold them. The last round, which
    leaves nothing loose, is that of one partition,
    or the first one that half of the items before it came to: where sequences
    hold few items no exchange closes the gaps, and a task stays bounded.
    """
    full = items.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    loose = items.filter(F.col("length") < capacity)
    count, before = loose.count(), None
    own = items.schema.names
    schema = T.StructType([*items.schema.fields, *(T.StructField(n, t) for n, t in (("sequence_id", T.LongType()), ("offset", T.LongType()), ("loose", T.BooleanType())))])
    done, turn = [], 0
    while True:
        parts = -(-count // per_partition) if count > per_partition * (4 if turn else 1) else 1
        last = parts == 1 or (before is not None and 2 * count > before)
        spread = F.pmod(F.xxhash64(*own, F.lit(turn)), F.lit(parts)).alias("part")
        packed = written(loose.select(*own, spread).groupBy("part").applyInPandas(_packer(own, capacity, turn, last), schema), f"packed{turn}")
        done.append(packed.filter(~F.col("loose")).drop("loose"))
        loose = packed.filter("loose").select(*own)
        count, before, turn = 0 if last else loose.count(), count, turn + 1
        if count == 0:
            break
    return reduce(DataFrame.unionByName, done, full)


def packed_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(written(pieces(docs, path, key, text, capacity, end), "pieces"), capacity)
