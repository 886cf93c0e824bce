"""Media columns in ISO base media containers (boxes of ISO/IEC 14496-12).

`write_container` stores bytes as 8-bit mono samples in frames, with the sample tables a
player needs; `read_container` walks the nested boxes of any such file, decodes stts, stsc,
stsz, stco/co64 and stss, and in fragmented files trex, tfhd and trun, and gives codec, duration and the byte ranges of samples and
keyframes. Payload bytes are never decoded: they are found by their ranges.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import short_batches

#: Bytes a frame holds, frames a chunk holds, frames from one keyframe to the next, samples a second.
FRAME, CHUNK_FRAMES, KEY_EVERY, RATE = 192, 64, 16, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
#: Those of which there may be several, each with boxes of its own, and boxes of values of which there may be several.
LISTED, REPEATED = {b"trak", b"moof", b"traf"}, {b"trex", b"trun"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, frame: int = FRAME) -> bytes:
    """A file with one sound track; payload is a positive multiple of the frame."""
    if not payload or len(payload) % frame:
        raise ValueError("the payload must be a positive multiple of the frame")
    n = len(payload) // frame
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    data_at = len(ftyp) + 8
    chunks = -(-n // CHUNK_FRAMES)
    offsets = data_at + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * frame
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if last == CHUNK_FRAMES else [(1, last, 1)] if chunks == 1 else [(1, CHUNK_FRAMES, 1), (chunks, last, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY)
    wide = bool(offsets[-1] >= 1 << 32)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    duration = n * frame
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, frame)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", frame, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=7)
    mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH", 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
    return ftyp + _box(b"mdat", payload) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def boxes(data: memoryview, start: int, end: int):
    """(kind, from, to) of each box in a range; 64-bit sizes and sizes that reach to the end are followed."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} reaches beyond what holds it")
        yield kind, at + head, at + size
        at += size


def _walk(data: memoryview, start: int, end: int, into: dict) -> None:
    """Boxes by kind: (from, to) of those that hold values, a list of the same for trak, moof and traf (with their own start), the rest flat."""
    at = start
    for kind, a, z in boxes(data, start, end):
        if kind in LISTED:
            own: dict = {b"start": at}
            into.setdefault(kind, []).append(own)
            _walk(data, a, z, own)
        elif kind in NESTED:
            _walk(data, a, z, into)
        elif kind in REPEATED:
            into.setdefault(kind, []).append((a, z))
        else:
            into[kind] = (a, z)
        at = z


def _table(data: memoryview, t: dict, size: int, n: int) -> dict:
    """Samples of a track's own tables: starts, sizes, durations, keys (numbers from 0)."""
    u4 = lambda kind, at, n: np.frombuffer(data, ">u4", n, t[kind][0] + at).astype(np.int64)
    sizes = np.full(n, size, np.int64) if size else u4(b"stsz", 12, n)
    times = u4(b"stts", 8, 2 * int(u4(b"stts", 4, 1)[0])).reshape(-1, 2)
    where = b"stco" if b"stco" in t else b"co64"
    chunks = int(u4(where, 4, 1)[0])
    offsets = np.frombuffer(data, ">u4" if where == b"stco" else ">u8", chunks, t[where][0] + 8).astype(np.int64)
    runs = u4(b"stsc", 8, 3 * int(u4(b"stsc", 4, 1)[0])).reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1)))
    if per.sum() != n or times[:, 0].sum() != n:
        raise ValueError("the sample tables disagree")
    first = np.cumsum(per) - per
    before = np.cumsum(sizes) - sizes
    starts = np.repeat(offsets - before[first] if n else offsets, per) + before
    keys = u4(b"stss", 8, int(u4(b"stss", 4, 1)[0])) - 1 if b"stss" in t else np.arange(n)
    return {"starts": starts, "sizes": sizes, "durations": np.repeat(times[:, 1], times[:, 0]), "keys": keys}


class _Fields:
    """Big-endian 32-bit numbers of a full box, one after the other."""

    def __init__(self, data: memoryview, at: tuple[int, int]):
        self.data, (self.at, self.end) = data, at
        self.flags = self.take() & 0xFFFFFF

    def take(self, kind: str = ">I") -> int:
        if self.at + struct.calcsize(kind) > self.end:
            raise ValueError("a box is cut off")
        out = struct.unpack_from(kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return out


def _fragments(data: memoryview, top: dict) -> dict[int, list[tuple[int, int, int, bool]]]:
    """By track: (start, size, duration, keyframe) of each sample of the file's movie fragments."""
    defaults = {}
    for at in top.get(b"trex", ()):
        f = _Fields(data, at)
        track, _, *rest = (f.take() for _ in range(5))
        defaults[track] = rest
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    for moof in top.get(b"moof", ()):
        end = moof[b"start"]
        for n, traf in enumerate(moof.get(b"traf", ())):
            f = _Fields(data, traf[b"tfhd"])
            track = f.take()
            base = f.take(">Q") if f.flags & 1 else moof[b"start"] if f.flags & 0x20000 or n == 0 else end
            if f.flags & 2:
                f.take()
            length, size, marks = (f.take() if f.flags & bit else d for bit, d in zip((8, 0x10, 0x20), defaults.get(track, (0, 0, 0))))
            end = base
            for at in traf.get(b"trun", ()):
                r = _Fields(data, at)
                count = r.take()
                if r.flags & 1:
                    end = base + r.take(">i")
                first = r.take() if r.flags & 4 else None
                for i in range(count):
                    ticks = r.take() if r.flags & 0x100 else length
                    own = r.take() if r.flags & 0x200 else size
                    mark = r.take() if r.flags & 0x400 else first if i == 0 and first is not None else marks
                    if r.flags & 0x800:
                        r.take()
                    if end < 0 or end + own > len(data):
                        raise ValueError("a sample lies beyond the file")
                    out.setdefault(track, []).append((end, own, ticks, not mark & 0x10000))
                    end += own
    return out


def read_container(raw: bytes) -> list[dict]:
    """Per track: handler, codec, timescale, duration (seconds), offsets and sizes of samples, keyframes (numbers from 0).

    Samples of the track's own tables come first, then those of movie fragments in the order of the file.
    """
    data, out, top = memoryview(raw), [], {}
    _walk(data, 0, len(raw), top)
    extra = _fragments(data, top)
    for t in top.get(b"trak", ()):
        a = t[b"mdhd"][0]
        scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        a = t[b"stsz"][0]
        size, n = struct.unpack_from(">II", data, a + 4)
        own = _table(data, t, size, n)
        a = t[b"tkhd"][0]
        track = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        if more := extra.pop(track, None):
            rows = np.array(more, np.int64)
            own = {"starts": np.append(own["starts"], rows[:, 0]), "sizes": np.append(own["sizes"], rows[:, 1]), "durations": np.append(own["durations"], rows[:, 2]), "keys": np.append(own["keys"], n + np.flatnonzero(rows[:, 3]))}
        codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
        handler = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1")
        ticks = int(own["durations"].sum())
        out.append({"handler": handler, "codec": codec, "timescale": scale, "duration": (max(length, ticks) if more else length) / scale, "ticks": ticks, "starts": own["starts"], "sizes": own["sizes"], "keys": own["keys"]})
    if extra:
        raise ValueError(f"fragments of unknown tracks: {sorted(extra)}")
    return out


def stored_bytes(raw: bytes, track: dict) -> bytes:
    """The track's samples, end to end, from their ranges. Adjoining samples are read at once."""
    a, z = track["starts"], track["starts"] + track["sizes"]
    cut = np.flatnonzero(np.append(True, a[1:] != z[:-1])) if len(a) else np.zeros(0, np.int64)
    return b"".join(raw[s:e] for s, e in zip(a[cut], z[np.append(cut[1:] - 1, len(z) - 1)] if len(cut) else []))


def key_ranges(track: dict) -> list[list[int]]:
    """Byte ranges [from, length] from each keyframe's first byte."""
    return [[int(track["starts"][k]), int(track["sizes"][k])] for k in track["keys"]]


def text_payload(text: str | None, unit: int = FRAME) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


CONTAINER = "n_bytes long, payload_bytes long, media binary"
PROBED = "handler string, codec string, timescale long, duration double, samples long, keyframes array<array<long>>, payload binary, error string"


def to_container(texts: pd.Series) -> pd.DataFrame:
    """Media column from a text column; null texts count as empty."""
    made = [(n, len(p), write_container(p)) for p, n in map(text_payload, texts)]
    return pd.DataFrame(made, columns=["n_bytes", "payload_bytes", "media"])


def probe(media: pd.Series) -> pd.DataFrame:
    """What the first track of each file holds; null or broken files give nulls and an error, not a failure."""
    rows = []
    for raw in media:
        try:
            if raw is None:
                raise ValueError("no file")
            t = read_container(raw)[0]
            rows.append((t["handler"], t["codec"], t["timescale"], t["duration"], len(t["sizes"]), key_ranges(t), stored_bytes(raw, t), None))
        except (ValueError, KeyError, IndexError, struct.error) as e:
            rows.append((None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PROBED.split(", ")])


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(texts: pd.Series) -> pd.DataFrame:
    """Store each text, read the file back, and give digests of both with the features of the track."""
    rows = []
    for text in texts:
        payload, n = text_payload(text)
        media = write_container(payload)
        t = read_container(media)[0]
        back = stored_bytes(media, t)
        feature = {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "keyframes": key_ranges(t)}
        rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, separators=(",", ":"))))
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in DIGESTS.split(", ")])


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `media` (struct: n_bytes, payload_bytes, media) to each row.

    Null and empty texts become one frame of spaces. Other columns, null ids and repeated rows
    pass through; a column named media is replaced. Empty tables give no rows.
    """
    short_batches(docs.sparkSession)
    return docs.withColumn("media", F.pandas_udf(to_container, CONTAINER)(F.col(text)))


def probe_columns(files: DataFrame, media: str = "media") -> DataFrame:
    """Add `track` (struct of `probe`) to each row of a binary column of files.

    Null, empty and broken files give nulls and an error. Other columns, null ids and repeated rows pass
    through; a column named track is replaced. Empty tables give no rows.
    """
    short_batches(files.sparkSession)
    return files.withColumn("track", F.pandas_udf(probe, PROBED)(F.col(media)))


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the digests of `round_trip` for each row, with the edge cases of `media_columns`."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(round_trip, DIGESTS)(F.col(text)).alias("r")).select("doc_id", "r.*")
