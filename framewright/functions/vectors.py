"""The kernels as expressions: one Arrow batch of frames or packets at a time. A null array, or one with a null in it,
gives null."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..workers import workers_find_package
from . import kernels as K
from .format import DELTA_VARINT, FIXED_WIDTH, HEADER_BYTES, MAGIC, MOST_SAMPLES, PACKED4, RICE, STRATEGIES, VERSION

#: Samples that are worked on at once.
MOST_AT_ONCE = 1 << 21


def _frames(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, at, ok) of an array of lists; those that are not ok are empty."""
    values, n = a.flatten(), pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
    ok = np.asarray(a.is_valid()).copy()
    if values.null_count:
        bad = np.repeat(np.arange(len(n)), n)[np.asarray(values.is_null())]
        ok[bad] = False
        values = values.filter(pa.array(np.repeat(ok, n)))
        n = np.where(ok, n, 0)
    return values.to_numpy(zero_copy_only=False).astype(np.int32), K.starts(n), ok


def _some(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames that `which` names."""
    sizes = np.diff(at)
    return values[np.repeat(which, sizes)], K.starts(sizes[which])


def _lists(values: np.ndarray, at: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array(~ok))


def _ints(x: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32), mask=~ok)


def _varints(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of the deltas of frames."""
    return K.varint_encode(K.deltas(values, at).astype(np.int64) & 0xFFFFFFFF, at)


def _packets(values: np.ndarray, at: np.ndarray, sid: int, strict: bool, retry: bool, k: int | None) -> tuple[list[bytes | None], np.ndarray]:
    """(packets, status) of frames."""
    status = np.where(np.diff(at) > MOST_SAMPLES, -2, 0)
    if sid == RICE and k is not None and k not in range(4):
        status[status == 0] = -8
    good = status == 0
    x, own = _some(values, at, good)
    low = np.zeros(len(own) - 1, np.int64)
    if sid == DELTA_VARINT:
        data, ends = _varints(x, own)
    elif sid == PACKED4:
        data, ends = K.packed4_encode(K.deltas(x, own), own)
    else:
        d = K.deltas(x, own)
        z, failed = K.zigzag(d), np.zeros(len(low), np.int64)
        if sid == RICE:
            low = K.rice_k(d, own) if k is None else low + k
            over = K.rice_overflows(z, own, low)
            if retry:
                low = np.where(over, 3, low)
                over = K.rice_overflows(z, own, low)
            failed[over] = -10
        elif strict:
            wide = K.starts(z >= 1 << 15)
            failed[wide[own[1:]] > wide[own[:-1]]] = -1000
        status[good] = failed
        z, own = _some(z, own, failed == 0)
        low = low[failed == 0]
        data, ends = K.rice_encode(z, own, low) if sid == RICE else K.fixed_encode(z, own)
    raw, out = data.tobytes(), [None] * len(status)
    head = bytes.fromhex(MAGIC) + bytes([VERSION])
    for f, n, i, j, m in zip(np.flatnonzero(status == 0).tolist(), np.diff(own).tolist(), ends[:-1].tolist(), ends[1:].tolist(), low.tolist(), strict=True):
        out[f] = head + n.to_bytes(2, "big") + bytes([sid << 2 | m]) + raw[i:j]
    return out, status


def encoded(samples: Column, strategy: str, strict: bool = True, retry: bool = False, k: int | None = None) -> Column:
    """STRUCT(packet, status) of an array of samples. strict, retry and k: see codecs.encode()."""
    sid = STRATEGIES[strategy]

    def run(a: pa.Array) -> pa.Array:
        values, at, ok = _frames(a)
        packets, status = [], [np.empty(0, np.int64)]
        for i, j in K._lots(np.diff(at), MOST_AT_ONCE):
            p, s = _packets(values[at[i] : at[j]], at[i : j + 1] - at[i], sid, strict, retry, k)
            packets += p
            status.append(s)
        packets = [p if good else None for p, good in zip(packets, ok.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(packets, pa.binary()), _ints(np.concatenate(status), ok)], ["packet", "status"])

    return _udf(run, "struct<packet:binary,status:int>")(samples)


def varint_payload(samples: Column) -> Column:
    """BINARY of an array of any number of samples: what follows the header in a packet of delta_varint. A header counts
    65535 samples at most, the integers after it have no such limit."""

    def run(a: pa.Array) -> pa.Array:
        values, at, ok = _frames(a)
        out = []
        for i, j in K._lots(np.diff(at), MOST_AT_ONCE):
            data, ends = _varints(values[at[i] : at[j]], at[i : j + 1] - at[i])
            raw = data.tobytes()
            out += [raw[b:e] for b, e in pairwise(ends.tolist())]
        return pa.array([p if good else None for p, good in zip(out, ok.tolist(), strict=True)], pa.binary())

    return _udf(run, "binary")(samples)


def _status_of_header(p: bytes, asked: int | None) -> int:
    if len(p) < HEADER_BYTES:
        return -6
    if p[:4] != bytes.fromhex(MAGIC):
        return -3
    if p[4] != VERSION:
        return -4
    return -5 if p[7] >> 2 > FIXED_WIDTH or asked not in (None, p[7] >> 2) else 0


DECODERS = {DELTA_VARINT: K.varint_decode, PACKED4: K.packed4_decode, FIXED_WIDTH: K.fixed_decode}


def _deltas(packets: list[bytes], asked: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deltas, at, status) of packets; those that fail are empty."""
    status = np.array([_status_of_header(p, asked) for p in packets], np.int64)
    of = np.array([p[7] >> 2 if s == 0 else -1 for p, s in zip(packets, status, strict=True)], np.int64)
    n = np.array([p[5] << 8 | p[6] if s == 0 else 0 for p, s in zip(packets, status, strict=True)], np.int64)
    found = {}
    for sid in np.unique(of[of >= 0]).tolist():
        rows = np.flatnonzero(of == sid)
        own = [packets[r][HEADER_BYTES:] for r in rows]
        data, at = np.frombuffer(b"".join(own), np.uint8), K.starts(np.array([len(x) for x in own]))
        k = [np.array([packets[r][7] & 3 for r in rows])] if sid == RICE else []
        values, s = (K.rice_decode if k else DECODERS[sid])(data, at, n[rows], *k)
        status[rows] = s
        found[sid] = values
    sizes = np.where(status == 0, n, 0)
    at = K.starts(sizes)
    out = np.zeros(at[-1], np.int32)
    for sid, values in found.items():
        rows = of == sid
        out[np.repeat(rows, sizes)] = values[np.repeat(status[rows] == 0, n[rows])]
    return out, at, status


def decoded(packet: Column, strategy: str | None = None, sums: bool = True) -> Column:
    """STRUCT(values, status) of a packet: its samples, or their deltas without sums. strategy: which it must have."""
    asked = None if strategy is None else STRATEGIES[strategy]

    def run(a: pa.Array) -> pa.Array:
        ok = np.asarray(a.is_valid())
        rows = pc.fill_null(a, b"").to_pylist()
        parts = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))]
        weights = np.array([len(p) + (p[5] << 8 | p[6] if len(p) >= HEADER_BYTES else 0) for p in rows], np.int64)
        for i, j in K._lots(weights, MOST_AT_ONCE):
            d, at, status = _deltas(rows[i:j], asked)
            parts.append((K.prefix_sums(d, at) if sums else d, np.diff(at), status))
        values, sizes, status = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.StructArray.from_arrays([_lists(values, K.starts(sizes), ok & (status == 0)), _ints(status, ok)], ["values", "status"])

    return _udf(run, "struct<values:array<int>,status:int>")(packet)


def prefix_sums(d: Column) -> Column:
    """Samples from an array of deltas, wrapping at 32 bits."""

    def run(a: pa.Array) -> pa.Array:
        values, at, ok = _frames(a)
        return _lists(K.prefix_sums(values, at), at, ok)

    return _udf(run, "array<int>")(d)


#: Reconstruction from deltas as paired 16-bit lanes do it is the same.
prefix_sums_paired = prefix_sums


def blocks_of_width(d: Column, width: Column) -> Column:
    """STRUCT(block, status): deltas of up to 32 samples as one fixed-width block of the given width: a width byte, then
    the values' low bits. -6 for a width above 16, or more samples than a block has."""

    def run(a: pa.Array, w: pa.Array) -> pa.Array:
        values, at, ok = _frames(a)
        ok &= np.asarray(w.is_valid())
        out, status = [], []
        z = K.zigzag(values)
        for i, j, width in zip(at[:-1].tolist(), at[1:].tolist(), pc.fill_null(w, 0).to_pylist(), strict=True):
            bad = not 0 <= width <= 16 or j - i > K.BLOCK
            status.append(-6 if bad else 0)
            bits = 0 if bad else sum((int(v) & (1 << width) - 1) << k * width for k, v in enumerate(z[i:j]))
            out.append(None if bad else bytes([width & 15]) + bits.to_bytes(-(-width * (j - i) // 8), "little"))
        out = [x if good else None for x, good in zip(out, ok.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), _ints(np.array(status, np.int64), ok)], ["block", "status"])

    return _udf(run, "struct<block:binary,status:int>")(d, width)


def _one_varint(data: bytes, at: int) -> tuple[int | None, int | None, int]:
    value = 0
    for k in range(5):
        if at + k >= len(data):
            return None, None, -6
        value |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return value & 0xFFFFFFFF, at + k + 1, 0
    return None, None, -9 if at + 5 < len(data) else -6


def read_varint(packet: Column, at: Column | int, signed: bool = False) -> Column:
    """STRUCT(value, next, status) of the integer at byte `at`: -6 if the bytes end within it, -9 if it has over five.
    signed: with the value's zigzag undone."""

    def run(a: pa.Array, offsets: pa.Array) -> pa.Array:
        rows = [(None, None, None) if data is None or k is None else _one_varint(data, k) for data, k in zip(a.to_pylist(), offsets.to_pylist(), strict=True)]
        value, after, status = zip(*rows, strict=True) if rows else ((), (), ())
        if signed:
            value = [v if v is None else v >> 1 ^ -(v & 1) for v in value]
        return pa.StructArray.from_arrays([pa.array(value, pa.int64()), pa.array(after, pa.int32()), pa.array(status, pa.int32())], ["value", "next", "status"])

    return _udf(run, "struct<value:bigint,next:int,status:int>")(packet, (at if isinstance(at, Column) else F.lit(at)).cast("int"))


def read_zigzag(packet: Column, at: Column | int) -> Column:
    """read_varint() with the value's zigzag undone."""
    return read_varint(packet, at, signed=True)


def bits_to_bytes(bits: Column) -> Column:
    """BINARY of a bit string, the last byte filled with zeros."""

    def run(a: pa.Array) -> pa.Array:
        rows = [None if x is None else np.packbits(np.frombuffer(x.encode(), np.uint8) & 1).tobytes() for x in a.to_pylist()]
        return pa.array(rows, pa.binary())

    return _udf(run, "binary")(bits)


def _udf(run, kind: str):
    if (spark := SparkSession.getActiveSession()) is not None:
        workers_find_package(spark)
    run.__annotations__ = dict.fromkeys(run.__annotations__, pa.Array)  # the types themselves, not their names
    return F.arrow_udf(run, kind)
