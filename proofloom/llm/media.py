"""Media columns: ISO base media containers written from bytes, walked box by box and read back.

``store`` wraps bytes as one 8-bit mono PCM track (QuickTime brand, sample entry ``raw ``). A sample is
one block of 64 bytes, 16 samples make a chunk and the first sample of each chunk is a sync sample.
``tracks`` reads the containers of this family that keep their samples in tables: it descends the nested
boxes track by track, decodes each track's own sample tables and reports codec, duration and the byte range
of every sync sample without touching the media payload. Fragmented files (``moof``) are refused by name.

Null and empty texts are stored as one block of zeros. Rows are independent, so repeated rows repeat, and a
very long text is one container with wide boxes from 4 GB on. A null doc_id stays null, an empty table gives
an empty table, and other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import batches, utf8

BLOCK = 64
SAMPLES_PER_CHUNK = 16
RATE = 8000
#: Boxes that hold only other boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: The unity transform of movie and track headers (fixed value of ISO/IEC 14496-12).
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of the block size."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _sample_tables(samples: int, first_byte: int) -> bytes:
    chunks = -(-samples // SAMPLES_PER_CHUNK)
    last = samples - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    if last != SAMPLES_PER_CHUNK or chunks == 1:
        runs.append((chunks, last, 1))
    starts = np.arange(chunks, dtype=np.uint64) * (BLOCK * SAMPLES_PER_CHUNK) + first_byte
    wide = int(starts[-1]) >= 1 << 32
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    return box(
        b"stbl",
        full_box(b"stsd", 0, struct.pack(">I", 1), entry),
        full_box(b"stts", 0, struct.pack(">III", 1, samples, BLOCK)),
        full_box(b"stss", 0, struct.pack(">I", chunks), (np.arange(chunks) * SAMPLES_PER_CHUNK + 1).astype(">u4").tobytes()),
        full_box(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", 0, struct.pack(">II", BLOCK, samples)),
        full_box(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes()),
    )


def _movie(samples: int, first_byte: int) -> bytes:
    ticks = samples * BLOCK
    wide = ticks >= 1 << 32
    version = 1 << 24 if wide else 0
    times = struct.pack(">QQIQ" if wide else ">IIII", 0, 0, RATE, ticks)
    media = box(
        b"mdia",
        full_box(b"mdhd", version, times, struct.pack(">HH", 0x55C4, 0)),
        full_box(b"hdlr", 0, struct.pack(">I4s12s", 0, b"soun", b""), b"\0"),
        box(
            b"minf",
            full_box(b"smhd", 0, bytes(4)),
            box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1))),
            _sample_tables(samples, first_byte),
        ),
    )
    track = struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, ticks)
    return box(
        b"moov",
        full_box(b"mvhd", version, times, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)),
        box(b"trak", full_box(b"tkhd", version | 7, track, struct.pack(">8xHHHH", 0, 0, 0x100, 0), MATRIX, bytes(8)), media),
    )


def build(payload: bytes) -> bytes:
    """A container for ``payload``, whose length is a positive multiple of the block size."""
    samples = len(payload) // BLOCK
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    wide = len(payload) + 8 >= 1 << 32
    first = len(head) + len(_movie(samples, 0)) + (16 if wide else 8)
    if first + len(payload) >= 1 << 32:  # chunk offsets may need their wide form
        first = len(head) + len(_movie(samples, 1 << 32)) + (16 if wide else 8)
    opening = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return b"".join((head, _movie(samples, first), opening, payload))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the bodies of the boxes between two offsets, one level deep."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, body, start + size
        start += size


def _collect(data: bytes, start: int, end: int, own: dict[bytes, tuple[int, int]], tracks: list[dict[bytes, tuple[int, int]]]) -> None:
    """Bodies of the boxes outside tracks into ``own``, and one such dictionary for each track."""
    for kind, body, stop in boxes(data, start, end):
        if kind == b"trak":
            tracks.append({})
            _collect(data, body, stop, tracks[-1], tracks)
        elif kind in CONTAINERS:
            _collect(data, body, stop, own, tracks)
        else:
            own.setdefault(kind, (body, stop))


def _table(data: bytes, at: int, dtype: str, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, dtype, n * width, at + 8).astype(np.int64).reshape(n, width)


def tracks(data: bytes) -> list[dict]:
    """Kind, codec, timing and the byte ranges of all samples and of the sync samples of each track."""
    movie: dict[bytes, tuple[int, int]] = {}
    found: list[dict[bytes, tuple[int, int]]] = []
    _collect(data, 0, len(data), movie, found)
    if b"moof" in movie:
        raise ValueError("a fragmented file keeps its samples outside tables")
    return [_track(data, own) for own in found]


def _track(data: bytes, own: dict[bytes, tuple[int, int]]) -> dict:
    header, kind, entry, size = (own[k][0] for k in (b"mdhd", b"hdlr", b"stsd", b"stsz"))
    scale, ticks = struct.unpack_from(">IQ", data, header + 20) if data[header] else struct.unpack_from(">II", data, header + 12)
    uniform, count = struct.unpack_from(">II", data, size + 4)
    sizes = np.full(count, uniform, np.int64) if uniform else np.frombuffer(data, ">u4", count, size + 12).astype(np.int64)
    chunks = _table(data, own[b"co64"][0], ">u8") if b"co64" in own else _table(data, own[b"stco"][0], ">u4")
    runs = _table(data, own[b"stsc"][0], ">u4", 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    per_chunk = np.repeat(runs[:, 1], spans)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(chunks[:, 0] - before[first], per_chunk) + before if count else np.zeros(0, np.int64)
    sync = _table(data, own[b"stss"][0], ">u4")[:, 0] - 1 if b"stss" in own else np.arange(count)
    return {
        "kind": data[kind + 8 : kind + 12].decode("latin-1"),
        "codec": data[entry + 12 : entry + 16].decode("latin-1").strip(),
        "timescale": scale,
        "duration": ticks / scale if scale else 0.0,
        "samples": int(count),
        "offsets": offsets,
        "sizes": sizes,
        "keyframes": np.stack([offsets[sync], offsets[sync] + sizes[sync]], axis=1),
    }


def payload_of(data: bytes, track: dict) -> bytes:
    """The samples' bytes in order; neighbouring samples are copied as one run."""
    starts, ends = track["offsets"], track["offsets"] + track["sizes"]
    new = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
    stops = np.append(new[1:], len(starts)) - 1
    return b"".join(data[a:b] for a, b in zip(starts[new].tolist(), ends[stops].tolist()))


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
PARSED = pa.schema([("track", pa.int32()), ("kind", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("samples", pa.int64()), ("keyframes", RANGES)])
_KIND = "array<struct<track:int,kind:string,codec:string,duration:double,samples:long,keyframes:array<struct<start:long,end:long>>>>"


def store(docs: DataFrame) -> DataFrame:
    """One container per document: doc_id, n_bytes of the text in UTF-8, media."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = ((len(t), i, len(t), build(pad(t))) for i, t in zip(part.column(0).to_pylist(), utf8(part.column(1))))
            yield from batches(rows, STORED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _columns(found: list[dict]) -> list[dict]:
    return [
        {"track": k, "kind": t["kind"], "codec": t["codec"], "duration": t["duration"], "samples": t["samples"], "keyframes": [{"start": a, "end": b} for a, b in t["keyframes"].tolist()]}
        for k, t in enumerate(found)
    ]


def media_columns(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (of the first track, read through its sample tables) and a struct for each track."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part):
            for i, n, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                found = tracks(media)
                yield 2 * len(media) + 16 * sum(len(t["keyframes"]) for t in found), i, n, media, payload_of(media, found[0]) if found else b"", _columns(found)

        kind = pa.schema([*STORED, ("payload", pa.binary()), ("tracks", pa.list_(pa.struct(list(PARSED))))])
        for part in parts:
            yield from batches(rows(part), kind)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, tracks {_KIND}")


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the stored and read-back containers of ``docs``, and codec, duration and keyframe ranges."""
    media = media_columns(store(docs))
    own = F.col("tracks")[0]
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%s|%.3f|%d|%d", own["codec"], own["duration"], own["samples"], F.size(own["keyframes"])).alias("feature"),
        own["codec"].alias("codec"),
        own["duration"].alias("duration"),
        own["keyframes"].alias("keyframes"),
    )
