"""Operator 4: media columns from ISO media containers.

``write_container`` stores a payload as the samples of one track; ``read_tracks``
walks the nested boxes of any such container, decodes each track's own sample tables
(time, sync, sample-to-chunk, sizes of both kinds, chunk offsets) and gives codec,
duration and the byte range of every keyframe, without decoding a payload.  Movie
fragments (``moof``) are refused by name, as are tracks that lack a table.

Defined results: null text counts as empty, and an empty payload still has one
sample of padding; null ids and repeated rows give separate rows; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SAMPLE, PAD = 576, 255
#: Samples from one keyframe to the next, samples in a chunk, and ticks a second.
GROUP, CHUNK, RATE = 16, 64, 48_000
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of the sample size."""
    return data + bytes([PAD]) * (SAMPLE - len(data) if not data else -len(data) % SAMPLE)


def write_container(payload: bytes) -> bytes:
    """One track of SAMPLE-byte samples of 8 bits; each GROUP-th is a keyframe.

    Chunk offsets are 64-bit, so a payload may be of any size; ``mdat`` too.
    """
    n = len(payload) // SAMPLE
    chunks, ticks = -(-n // CHUNK), n * SAMPLE
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def moov(at: int) -> bytes:
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        runs = [(1, CHUNK)] if n >= CHUNK else [(1, n)]
        if n > CHUNK and n % CHUNK:
            runs.append((chunks, n % CHUNK))
        sync = np.arange(1, n + 1, GROUP).astype(">u4").tobytes()
        offsets = (at + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE).astype(">u8").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(">I", len(sync) // 4), sync),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7, version=1)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    start = len(head) + len(moov(0)) + 16
    return head + moov(start) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data: memoryview, at: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()):
    """(path of kinds, start and stop of the body) of every box, outer ones first."""
    stop = len(data) if stop is None else stop
    while at < stop:
        if stop - at < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = stop if size == 0 else at + size
        if end < body or end > stop:
            raise ValueError("a box's size is wrong")
        yield (*path, kind), body, end
        if kind in NESTED:
            yield from boxes(data, body, end, (*path, kind))
        at = end


def _rows(data: memoryview, at: int, kind: str, fields: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, kind, n * fields, at + 8).astype(np.int64).reshape(n, fields)


def _half_sizes(data: memoryview, at: int) -> np.ndarray:
    """Sample sizes of a ``stz2`` box, in fields of 4, 8 or 16 bits."""
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if width == 4:
        packed = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12).astype(np.int64)
        return np.stack([packed >> 4, packed & 15], 1).ravel()[:n]
    if width not in (8, 16):
        raise ValueError("a sample size box has fields of an unknown width")
    return np.frombuffer(data, f">u{width // 8}", n, at + 12).astype(np.int64)


def _track(data: memoryview, found: dict[bytes, int]) -> dict:
    """One track from the places of its own boxes."""
    def place(*kinds: bytes) -> int:
        known = [found[k] for k in kinds if k in found]
        if not known:
            raise ValueError(f"a track has no {' or '.join(k.decode() for k in kinds)} box")
        return known[0]

    at = place(b"mdhd")
    scale, ticks = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
    at = place(b"stsd")
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1") if struct.unpack_from(">I", data, at + 4)[0] else ""
    at = place(b"stsz", b"stz2")
    if b"stsz" in found:
        each, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    else:
        sizes = _half_sizes(data, at)
    n = len(sizes)
    chunk = _rows(data, place(b"co64", b"stco"), ">u8" if b"co64" in found else ">u4")[:, 0]
    runs = _rows(data, place(b"stsc"), ">u4", 3)
    first = runs[:, 0] - 1
    if (np.diff(np.append(first, len(chunk))) < 0).any() or len(first) and first[0]:
        raise ValueError("the sample tables disagree")
    held = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunk)))) if len(first) else np.zeros(len(chunk), np.int64)
    times = _rows(data, place(b"stts"), ">u4", 2)
    if held.sum() != n or times[:, 0].sum() != n:
        raise ValueError("the sample tables disagree")
    before = np.cumsum(sizes) - sizes
    some = held > 0
    head = (np.cumsum(held) - held)[some]
    offsets = np.repeat(chunk[some] - before[head], held[some]) + before
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    keys = _rows(data, found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe is no sample")
    handler = bytes(data[found[b"hdlr"] + 8 : found[b"hdlr"] + 12]).decode("latin-1") if b"hdlr" in found else ""
    return {"handler": handler, "codec": codec, "timescale": scale, "ticks": ticks, "table_ticks": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keyframes": keys}


def read_tracks(media: bytes) -> list[dict]:
    """Every track: handler, codec, timescale, ticks, sample offsets and sizes, keyframe numbers from 0."""
    data = memoryview(media)
    found: list[dict[bytes, int]] = []
    for path, body, _ in boxes(data):
        if path[-1] in (b"moof", b"mvex"):
            raise ValueError("movie fragments are not read")
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path:
            found[-1].setdefault(path[-1], body)
    return [_track(data, f) for f in found]


def read_container(media: bytes) -> dict:
    """The first track; see ``read_tracks``."""
    tracks = read_tracks(media)
    if not tracks:
        raise ValueError("there is no track")
    return tracks[0]


def stored_payload(media: bytes, info: dict) -> bytes:
    """The samples' bytes in order, neighbouring ranges read at once."""
    start, stop = info["offsets"], info["offsets"] + info["sizes"]
    if not len(start):
        return b""
    cut = np.flatnonzero(start[1:] != stop[:-1]) + 1
    view = memoryview(media)
    return b"".join(view[a:b] for a, b in zip(start[np.append(0, cut)].tolist(), stop[np.append(cut - 1, len(stop) - 1)].tolist()))


def feature(info: dict) -> str:
    ranges = [(int(info["offsets"][k]), int(info["offsets"][k] + info["sizes"][k])) for k in info["keyframes"]]
    listed = hashlib.sha256(",".join(f"{a}-{b}" for a, b in ranges).encode()).hexdigest()[:16]
    return f"codec={info['codec'].strip()};duration={info['ticks']}/{info['timescale']};samples={len(info['sizes'])};keyframes={len(ranges)};first={ranges[0][0]}-{ranges[0][1]};last={ranges[-1][0]}-{ranges[-1][1]};ranges={listed}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per row of ``docs``: the digests of its container and of what is read back from it.

    ``keep_media`` adds the container and its keyframes' byte ranges.
    """

    def run(batches):
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "keyframes")}
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                media = write_container(pad(data))
                info = read_container(media)
                payload = stored_payload(media, info)
                out["n_bytes"].append(len(data))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(feature(info))
                out["media"].append(media if keep_media else None)
                out["keyframes"].append([{"start": int(info["offsets"][k]), "stop": int(info["offsets"][k] + info["sizes"][k])} for k in info["keyframes"]] if keep_media else None)
            ranges = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), ranges]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["id", *out])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, keyframes array<struct<start:long,stop:long>>"
    out = source.mapInArrow(run, schema)
    return (out if keep_media else out.drop("media", "keyframes")).withColumnRenamed("id", id_col)
