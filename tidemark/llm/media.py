"""Media columns: texts or payloads as ISO media containers, and columns read from their boxes.

A payload is stored as an uncompressed grey track of 24 x 24 frames: one 8-bit
sample a pixel, so 576 bytes a frame, 25 frames a second and a chunk, the first
frame of a chunk a key frame. Reading walks the nested boxes and decodes the
sample tables; features need no payload byte.

Nulls and empty texts give one frame of padding; a container that ends early or
lacks a table raises ValueError. Extra columns are ignored; each row stands alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import text_chunks

SIDE, RATE = 24, 25
FRAME = SIDE * SIDE
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def table(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def mux(payload: bytes) -> bytes:
    """A container of one track with the payload's frames; its length must be a positive multiple of 576."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    ftyp = box(b"ftyp", b"isom", table(512), b"isomiso2")
    chunks, last = -(-frames // RATE), (frames - 1) % RATE + 1
    at = len(ftyp) + (8 if len(payload) + 8 < 1 << 32 else 16)
    places = [at + k * RATE * FRAME for k in range(chunks)]
    runs = [(1, RATE, 1)] * (chunks > 1) + [(chunks, last, 1)]
    wide = places[-1] >= 1 << 32
    stbl = box(
        b"stbl",
        full(b"stsd", table(1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))),
        full(b"stts", table(1, frames, 1)),
        full(b"stss", table(chunks, *range(1, frames + 1, RATE))),
        full(b"stsc", table(len(runs)), *(table(*r) for r in runs)),
        full(b"stsz", table(FRAME, frames)),
        full(b"co64", table(chunks), struct.pack(f">{chunks}Q", *places)) if wide else full(b"stco", table(chunks, *places)),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", table(1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", table(0, 0, RATE, frames), struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", table(0), b"vide", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", table(0, 0, 1, 0, frames), bytes(16), UNITY, table(SIDE << 16, SIDE << 16), flags=7)
    mvhd = full(b"mvhd", table(0, 0, RATE, frames, 0x10000), struct.pack(">H", 0x100), bytes(10), UNITY, bytes(24), table(2))
    return b"".join((ftyp, box(b"mdat", payload), box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


def boxes(data, at: int = 0, end: int | None = None, path: tuple = ()):
    """All boxes, parents first: (path, start of the body, end)."""
    end = len(data) if end is None else end
    while at < end:
        if at + 8 > end:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield (*path, kind), at + head, at + size
        if kind in PARENTS:
            yield from boxes(data, at + head, at + size, (*path, kind))
        at += size


def tracks(data) -> list[dict]:
    """Codec, duration and one row a sample (place, size, key frame) of each track, from its tables alone."""
    out: list[dict] = []
    found: dict = {}
    for path, a, b in boxes(data):
        if path[-1] == b"trak":
            out.append(found := {})
        elif path[:2] == (b"moov", b"trak"):
            found[path[-1]] = (a, b)
    for t in out:
        u32 = lambda kind, skip=4: np.frombuffer(data, ">u4", (t[kind][1] - t[kind][0] - skip) // 4, t[kind][0] + skip).astype(np.int64)  # noqa: B023, E731
        try:
            long = data[t[b"mdhd"][0]] == 1
            scale = struct.unpack_from(">I", data, t[b"mdhd"][0] + (20 if long else 12))[0]
            entry = t[b"stsd"][0] + 8
            t["codec"] = bytes(data[entry + 4 : entry + 8]).decode("latin-1")
            t["width"], t["height"] = struct.unpack_from(">HH", data, entry + 32)
            times, runs, sizes = u32(b"stts")[1:].reshape(-1, 2), u32(b"stsc")[1:].reshape(-1, 3), u32(b"stsz")
            n = int(sizes[1])
            size = np.full(n, sizes[0]) if sizes[0] else sizes[2 : 2 + n]
            chunk = np.frombuffer(data, ">u8", struct.unpack_from(">I", data, t[b"co64"][0] + 4)[0], t[b"co64"][0] + 8).astype(np.int64) if b"co64" in t else u32(b"stco")[1:]
        except KeyError as e:
            raise ValueError(f"a track has no {e.args[0]!r}") from None
        each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
        if each.sum() != n or times[:, 0].sum() != n:
            raise ValueError("the sample tables disagree")
        first = np.cumsum(each) - each
        before = np.cumsum(size) - size
        t["place"] = np.repeat(chunk - before[first], each) + before
        if n and int((t["place"] + size).max()) > len(data):
            raise ValueError("a sample lies beyond the end")
        t["size"], t["timescale"], t["duration"] = size, scale, int((times[:, 0] * times[:, 1]).sum())
        t["key"] = np.isin(np.arange(1, n + 1), u32(b"stss")[1:]) if b"stss" in t else np.ones(n, bool)
    return out


def samples(data, track: dict) -> bytes:
    """The track's samples in order; runs that lie together are copied at once."""
    place, size = track["place"], track["size"]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1] + size[:-1]))
    ends = np.append(cut[1:], len(place)) - 1
    return b"".join(bytes(data[place[a] : place[b] + size[b]]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True))


def feature(track: dict) -> str:
    """codec, frame size, seconds, samples and the byte range of each key frame."""
    key = track["key"]
    spans = ",".join(f"{p}-{p + s}" for p, s in zip(track["place"][key].tolist(), track["size"][key].tolist(), strict=True))
    return f"{track['codec'].strip()};{track['width']}x{track['height']};{track['duration'] / track['timescale']:.2f}s;{len(key)};{spans}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as a container, reads it back and returns its digests and features; with keep_media also the container."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {COLUMNS}" + ", media binary" * keep_media

    def run(batches):
        for (ids,), data, offs in text_chunks(batches, [key], text):
            rows, stored = [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                media = mux(padded(data[a:b].tobytes()))
                (track,) = tracks(media)
                back = samples(media, track)
                rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
                stored.append(media)
            cols = list(zip(*rows, strict=True))
            arrays = [ids, *(pa.array(c, pa.string() if k in (2, 5, 6) else pa.int64()) for k, c in enumerate(cols))]
            if keep_media:
                arrays.append(pa.array(stored, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media])

    return docs.select(key, text).mapInArrow(run, schema)
