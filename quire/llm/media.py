"""Media columns: ISO media containers (operator 2).

`parse` walks nested boxes and decodes the sample tables (stts, stsc, stsz, stco or co64, stss) of each track into codec, duration and the byte ranges of its keyframes, without reading
payloads. `build` writes a container of 8-bit mono samples, in which a payload of any bytes is stored as it is.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME, RATE, CHUNK_FRAMES = 192, 8000, 256
#: Boxes that hold only boxes.
_NESTS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def build(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A container with one audio track of unsigned 8-bit samples; `frame` of them are a sample of the tables, each one a keyframe."""
    n = len(payload) // frame
    if n * frame != len(payload) or not n:
        raise ValueError("the payload is no positive multiple of the frame")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n * frame, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * frame), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n * frame, 0x55C4, 0))
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
    stsd = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16)))
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    stsc = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK_FRAMES)
    tables = (
        stsd, full(b"stts", struct.pack(">III", 1, n, frame)), full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
        full(b"stsz", struct.pack(">II", frame, n)),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))

    def head(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * frame
        large = at + len(payload) >= 1 << 32
        place = full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes())
        stbl = box(b"stbl", *tables, place)
        return ftyp + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", full(b"smhd", bytes(4)), dinf, stbl))))

    wide = 16 if len(payload) + 8 >= 1 << 32 else 8
    return head(len(head(0 if len(payload) < (1 << 32) - 4096 else 1 << 32)) + wide) + box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes that lie there one after another; a box that doesn't fit ends the walk."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _find(data: memoryview, at: int, end: int, out: dict, depth: int = 0) -> dict:
    for kind, a, b in boxes(data, at, end):
        if kind == b"trak":
            out.setdefault("tracks", []).append(_find(data, a, b, {}, depth + 1))
        elif kind in _NESTS and depth < 16:
            _find(data, a, b, out, depth + 1)
        else:
            out.setdefault(kind, (a, b))
    return out


def _u4(data: memoryview, at: int, end: int, n: int, wide: int = 4) -> np.ndarray:
    n = max(0, min(n, (end - at) // wide))
    return np.frombuffer(data[at : at + n * wide], f">u{wide}").astype(np.int64)


def parse(media: bytes) -> list[dict]:
    """For each track: codec, kind, timescale, duration, n_samples, and the (first byte, end) of each keyframe, neighbours merged in `ranges`. Damaged boxes give what can be read."""
    data = memoryview(media)
    out = []
    for t in _find(data, 0, len(data), {}).get("tracks", []):
        try:
            out.append(_track(data, t))
        except (struct.error, ValueError, IndexError) as e:
            out.append({"codec": None, "kind": None, "timescale": 0, "duration": 0, "n_samples": 0, "keyframes": np.zeros((0, 2), np.int64), "ranges": np.zeros((0, 2), np.int64), "error": str(e)})
    return out


def _track(data: memoryview, t: dict) -> dict:
    count = lambda k: struct.unpack_from(">I", data, t[k][0] + 4)[0] if k in t else 0
    scale = duration = 0
    if b"mdhd" in t:
        a = t[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    kind = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in t else None
    codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1") if count(b"stsd") else None
    sizes = np.zeros(0, np.int64)
    if b"stsz" in t:
        a, b = t[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        sizes = np.full(min(n, len(data) // same), same, np.int64) if same else _u4(data, a + 12, b, n)
    if b"stts" in t:
        s = _u4(data, t[b"stts"][0] + 8, t[b"stts"][1], 2 * count(b"stts"))
        duration = duration or int((s[::2] * s[1::2]).sum())
    place = b"co64" if b"co64" in t else b"stco"
    chunks = _u4(data, t[place][0] + 8, t[place][1], count(place), 8 if place == b"co64" else 4) if place in t else sizes[:0]
    at = sizes[:0]
    if b"stsc" in t and len(chunks) and len(sizes):
        runs = _u4(data, t[b"stsc"][0] + 8, t[b"stsc"][1], 3 * count(b"stsc")).reshape(-1, 3)
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))).clip(0))[: len(chunks)]
        sizes = sizes[: int(per.sum())]
        chunk = np.repeat(np.arange(len(per)), per)[: len(sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = chunks[chunk] + before[:-1] - before[np.concatenate([[0], np.cumsum(per)])[chunk]]
    sizes = sizes[: len(at)]
    key = _u4(data, t[b"stss"][0] + 8, t[b"stss"][1], count(b"stss")) - 1 if b"stss" in t else np.arange(len(at))
    key = key[(key >= 0) & (key < len(at))]
    frames = np.stack([at[key], at[key] + sizes[key]], 1)
    new = np.ones(len(frames), bool)
    new[1:] = frames[1:, 0] != frames[:-1, 1]
    ranges = np.stack([frames[new, 0], frames[np.append(np.flatnonzero(new)[1:], len(frames)) - 1, 1]], 1) if len(frames) else frames
    return {"codec": codec, "kind": kind, "timescale": scale, "duration": duration, "n_samples": len(at), "keyframes": frames, "ranges": ranges}


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec, duration_s, keyframe_ranges, media).

    docs: doc_id, text. Each whole text as UTF-8, blanks appended up to a positive multiple of `frame`, goes into a container; its sample tables are read and the payload taken from the
    keyframes' byte ranges. A null text is empty (one frame of blanks). feature: codec, track kind, rate, duration, samples, keyframes, byte ranges, and mean and spread of the samples. Equal
    texts give equal values; rows are independent, so repeated rows stay, and an empty table gives an empty table.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                rows = [_row(x.as_buffer().to_pybytes() if x.is_valid else b"", frame) for x in b.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True))], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(f, _SCHEMA)


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframe_ranges array<array<long>>, media binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.list_(pa.int64())), pa.binary()]


def _row(text: bytes, frame: int) -> tuple:
    media = build(text + b" " * (-len(text) % frame or (0 if text else frame)), frame)
    track = parse(media)[0]
    payload = b"".join(media[a:b] for a, b in track["ranges"].tolist())
    samples = np.frombuffer(payload, np.uint8)
    seconds = track["duration"] / track["timescale"]
    feature = f"{track['codec'].strip()};{track['kind']};{track['timescale']};{track['duration']};{track['n_samples']};{len(track['keyframes'])};{len(track['ranges'])};{samples.mean():.4f};{samples.std():.4f}"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(text), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), feature, track["codec"], seconds, track["ranges"].tolist(), media)
