"""Blocks of texts that exchange 64-bit keys by bucket, as compressed arrays.

A map task turns texts into blocks. A block sends each bucket one row that
holds its distinct keys of that bucket; the bucket's task merges the rows of all
blocks and answers each with one value a key. So a corpus-wide count costs one
compact row a block and bucket, not one row a word, and a key that occurs
everywhere is one entry a block: no bucket is hot.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard

from .kernels import U64


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of equal weight lie together, as high ones compress best."""
    out = io.BytesIO()
    planes = {f"{n}|{a.dtype.str}": np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) for n, a in ((n, np.ascontiguousarray(a)) for n, a in arrays.items())}
    np.savez(out, **planes)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))) as z:
        return {n.partition("|")[0]: np.ascontiguousarray(z[n].T).view(np.dtype(n.partition("|")[2])).reshape(-1) for n in z.files}


def tight(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 32 bits, so sorted keys lie in order of their buckets."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys; buckets + 1 numbers."""
    return np.searchsorted(bucket_of(sorted_keys, buckets).astype(np.int64), np.arange(buckets + 1))


def groups(sorted_a: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    return np.flatnonzero(np.append(True, sorted_a[1:] != sorted_a[:-1])) if len(sorted_a) else np.zeros(0, np.int64)


def merged(blobs: list[bytes]):
    """The blobs, their distinct keys, and where each of their keys is among those."""
    parts = [unpacked(b) for b in blobs]
    keys = np.concatenate([p["keys"] for p in parts]) if parts else np.zeros(0, U64)
    distinct, inverse = np.unique(keys, return_inverse=True)
    return parts, distinct, inverse


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)
