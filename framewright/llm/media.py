"""Media columns: MPEG audio that carries bytes.

mpeg_stored() writes a payload as MPEG-1 Layer III (mono, 48 kHz, with checksums): an ID3v2 tag that holds the
payload's size and crc32, a frame with a variable-bitrate table (frames, bytes, 100 seek points), then frames whose
side information declares no audio data, so that a player hears silence and the payload lies in the frames' ancillary
bytes. mpeg_read() parses any such stream: it skips tags, resynchronises on frame headers (a header counts if the
next one follows where it says), verifies the checksums, and returns durations, seek offsets and the payload.

Defined cases: a null text is empty and its payload 64 zero bytes; equal texts give equal values; null and repeated
ids are kept; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, workers_find_package

# Fixed values of the format: kbit/s by bitrate index of Layer III, and samples a second by rate index, for MPEG 1 and 2.
BITRATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
RATE, SAMPLES, SIDE = 48000, 1152, 17
OVERHEAD = 4 + 2 + SIDE
SYNC = re.compile(rb"\xff[\xe0-\xff]")
TAG = b"payload\x00"


def _crc16_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC16 = _crc16_table()


def crc16(data: bytes) -> int:
    """CRC of MPEG audio frames: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFF00) ^ CRC16[c >> 8 ^ x]
    return c


def _prefix(index: int) -> bytes:
    """Header, checksum and empty side information of a frame of our own."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


SIZES = [0] + [144 * 1000 * b // RATE for b in BITRATES[1][1:]]
PREFIXES = [b""] + [_prefix(i) for i in range(1, 15)]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def mpeg_stored(payload: bytes) -> bytes:
    """The stream that carries payload."""
    most = SIZES[14] - OVERHEAD
    frames = [PREFIXES[14] + payload[i : i + most] for i in range(0, len(payload) - len(payload) % most, most)]
    if left := len(payload) % most:
        k = next(i for i in range(1, 15) if SIZES[i] - OVERHEAD >= left)
        frames.append((PREFIXES[k] + payload[-left:]).ljust(SIZES[k], b"\x00"))
    private = TAG + struct.pack("<QI", len(payload), zlib.crc32(payload))
    body = b"PRIV" + _synchsafe(len(private)) + b"\x00\x00" + private
    tag = b"ID3\x04\x00\x00" + _synchsafe(len(body)) + body
    size = sum(map(len, frames)) + SIZES[5]
    ends, at = [], SIZES[5]
    for f in frames:
        ends.append(at)
        at += len(f)
    seek = bytes(min(255, ends[i * len(frames) // 100] * 256 // size) for i in range(100))
    first = (PREFIXES[5] + b"Xing" + struct.pack(">III", 7, len(frames), size) + seek).ljust(SIZES[5], b"\x00")
    return b"".join([tag, first, *frames])


def _header(data: bytes, i: int) -> tuple[int, int, int, int, bool] | None:
    """(frame bytes, samples, rate, side bytes, protected) of a Layer III header at i, None if there is none."""
    if i + 4 > len(data) or data[i] != 255 or data[i + 1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = data[i + 1] >> 3 & 3, data[i + 1] >> 1 & 3, data[i + 2] >> 4, data[i + 2] >> 2 & 3
    if version == 1 or layer != 1 or index in (0, 15) or rate == 3:
        return None
    one, mono, hz = version == 3, data[i + 3] >> 6 == 3, RATES[version][rate]
    n = (144 if one else 72) * 1000 * BITRATES[1 if one else 2][index] // hz + (data[i + 2] >> 1 & 1)
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return n, 1152 if one else 576, hz, side, not data[i + 1] & 1


def mpeg_read(data: bytes) -> dict:
    """frames, samples, rate, seconds, bad_checksums, skipped bytes, seek (byte offsets of frames), table_ok (the
    variable-bitrate table agrees), payload (None if the stream carries none or it is damaged)."""
    i, carried = 0, None
    while data[i : i + 3] == b"ID3" and i + 10 <= len(data):
        n = sum(b << s for b, s in zip(data[i + 6 : i + 10], (21, 14, 7, 0), strict=True))
        at = data.find(TAG, i + 10, i + 10 + n)
        if at >= 0 and at + len(TAG) + 12 <= len(data):
            carried = struct.unpack_from("<QI", data, at + len(TAG))
        i += 10 + n
    start, end = i, len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    frames = samples = bad = skipped = 0
    rate, seek, parts, table, known = 0, [], [], None, {}
    while i + 4 <= end:
        h = known.get(key := data[i : i + 4]) or _header(data, i)
        if h is None or i + h[0] > end or (i + h[0] + 4 <= end and _header(data, i + h[0]) is None):
            m = SYNC.search(data, i + 1, end)  # lost: on to the next place that could be a header
            skipped += (m.start() if m else end) - i
            i = m.start() if m else end
            continue
        known[key] = h
        n, per, rate, side, protected = h
        body = i + 4 + 2 * protected
        if protected:
            covered = data[i + 2 : i + 4] + data[body : body + side]
            if covered not in known:
                known[covered] = crc16(covered)
            bad += known[covered] != int.from_bytes(data[i + 4 : i + 6], "big")
        if not frames and table is None and data[body + side : body + side + 4] in (b"Xing", b"Info"):
            table = struct.unpack_from(">III", data, body + side + 4)
        else:
            frames, samples = frames + 1, samples + per
            seek.append(i - start)
            parts.append(data[body + side : i + n])
        i += n
    payload = b"".join(parts)[: carried[0]] if carried else None
    if payload is not None and (len(payload) != carried[0] or zlib.crc32(payload) != carried[1]):
        payload = None
    table_ok = table is not None and table[1:] == (frames, end - start)
    return {"frames": frames, "samples": samples, "rate": rate, "seconds": samples / rate if rate else 0.0, "bad_checksums": bad, "skipped": skipped, "seek": seek, "table_ok": table_ok, "payload": payload}


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored form of each text."""
    workers_find_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [payload_of(t) for t in part.column("text").to_pylist()]
                media = pa.array([mpeg_stored(p) for _, p in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_frames long, seek_offsets array<long>"


def probed(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back from the column media. feature: duration in samples, rate, frames,
    failed checksums, skipped bytes, whether the table agrees, and a crc32 of the seek offsets."""
    workers_find_package(media.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for doc_id, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                r = mpeg_read(data)
                p = r["payload"] or b""
                seek = struct.pack(f"<{len(r['seek'])}Q", *r["seek"])
                feature = f"samples={r['samples']};rate={r['rate']};frames={r['frames']};bad={r['bad_checksums']};skipped={r['skipped']};table={int(r['table_ok'])};seek={zlib.crc32(seek):08x}"
                out.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, r["seconds"], r["frames"], r["seek"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return media.mapInArrow(tidied(run), SCHEMA)
