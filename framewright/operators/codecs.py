"""Encoding frames to packets and decoding packets to frames.

A frame is a row with `samples ARRAY<INT>`; a packet is a row with `packet BINARY`. All work is within a row, so
nothing is shuffled; whole batches of rows go through numpy, in time proportional to their samples. Each result has a
status; a row that fails has null for its packet or samples. Columns of results replace columns of that name, all other
columns of the input stay as they are.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import vectors as V
from ..functions.format import BLOCK, FIXED_WIDTH, HEADER_BYTES, MOST_SAMPLES, RICE_WINDOW, STRATEGIES
from ..functions.ints import deltas, sum_abs, zigzag

OVERFLOW = ("null", "drop", "retry_k3")


class Strategy(Protocol):
    """What register() takes: a way to encode and decode frames. Its packets start with a header that holds its
    strategy_id, 4 .. 63, so that decode() can tell them."""

    requires_zigzag: bool
    strategy_id: int

    def encode(self, df: DataFrame, **options) -> DataFrame: ...

    def decode(self, df: DataFrame) -> DataFrame: ...


_registered: dict[str, Strategy] = {}


def register(name: str, strategy: Strategy) -> None:
    taken = {s.strategy_id for s in _registered.values()} | set(STRATEGIES.values())
    if name in STRATEGIES or name in _registered or strategy.strategy_id in taken:
        raise ValueError(f"{name} or its id is taken")
    if strategy.strategy_id not in range(64):
        raise ValueError("a strategy's id has six bits")
    _registered[name] = strategy


def registered(name: str) -> Strategy | None:
    return _registered.get(name)


def _staged(df: DataFrame, *columns: Column) -> tuple[DataFrame, list[Column]]:
    """df with helper columns under names that it does not have, and the helpers."""
    stem = "_"
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    names = [f"{stem}{i}" for i in range(len(columns))]
    return df.withColumns(dict(zip(names, columns, strict=True))), [F.col(n) for n in names]


def _done(df: DataFrame, own: list[str], **columns: Column) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in own if c not in columns], *[v.alias(k) for k, v in columns.items()])


def encode(df: DataFrame, strategy: str, parity: str = "strict", on_overflow: str = "null", max_bytes: int | None = None, k: int | None = None) -> DataFrame:
    """df with packet and status.

    Status -2: over 65535 samples. -8: k, the Rice parameter of all frames in place of one by frame, is not 0 .. 3.
    -10: a value is too large for Rice codes; on_overflow 'drop' leaves such rows out, 'retry_k3' tries k = 3 first.
    -1000: a block of fixed_width needs over 15 bits; parity 'lenient' writes the bytes all the same, although they do
    not decode. -1: the packet is larger than max_bytes. Null for a null frame and one with a null sample.
    """
    if strategy in _registered:
        return _registered[strategy].encode(df, parity=parity, on_overflow=on_overflow, max_bytes=max_bytes)
    if strategy not in STRATEGIES or parity not in ("strict", "lenient") or on_overflow not in OVERFLOW:
        raise ValueError(f"unknown strategy, parity or on_overflow: {strategy}, {parity}, {on_overflow}")
    own = df.columns
    d, (r,) = _staged(df, V.encoded(F.col("samples"), strategy, parity == "strict", on_overflow == "retry_k3", k))
    packet, status = r["packet"], r["status"]
    if max_bytes is not None:
        over = F.length(packet) > max_bytes
        packet, status = F.when(~over, packet), F.when(over, -1).otherwise(status)
    out = _done(d, own, packet=packet, status=status)
    return out.filter(~F.col("status").eqNullSafe(-10)) if on_overflow == "drop" else out


def _decoded(df: DataFrame, strategy: str, name: str, sums: bool) -> DataFrame:
    if strategy != "auto" and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    d, (r,) = _staged(df, V.decoded(F.col("packet"), None if strategy == "auto" else strategy, sums))
    return _done(d, df.columns, **{name: r["values"], "status": r["status"]})


def decode_deltas(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """df with deltas and status; see decode()."""
    return _decoded(df, strategy, "deltas", False)


def decode(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """df (packet) with samples and status.

    Statuses, in this order: header (-6, -3, -4, -5), -5 if the packet has another strategy than asked for,
    -9 for a variable-length integer of over five bytes, -6 for a payload that ends too early. 'auto' decodes
    each packet by the strategy that its header names, registered ones included.
    """
    if strategy in _registered:
        return _registered[strategy].decode(df)
    if strategy != "auto" or not _registered:
        return _decoded(df, strategy, "samples", True)
    sid = F.when(C.header_status(F.col("packet")).isin(0, -5), C.header(F.col("packet"))["strategy_id"])
    theirs = F.coalesce(sid.isin([s.strategy_id for s in _registered.values()]), F.lit(False))
    out = _decoded(df.filter(~theirs), "auto", "samples", True)
    for s in _registered.values():
        part = s.decode(df.filter(sid == s.strategy_id))
        out = out.unionByName(part if "status" in part.columns else part.withColumn("status", F.lit(0)))
    return out


def header_packet(n: Column, strategy_id: int, payload: Column) -> Column:
    """BINARY of a header and a payload, for strategies of one's own."""
    return F.concat(F.unhex(C.header_hex(n, strategy_id, 0)), payload)


def inspect(df: DataFrame) -> DataFrame:
    """df (packet) with the header's fields, payload_bytes, and status; failing headers have nulls."""
    h, own = C.header(F.col("packet")), df.columns
    d, (status, head) = _staged(df, C.header_status(F.col("packet")), h)
    ok = lambda c: F.when(status == 0, c)
    return _done(d, own, **{f: ok(head[f]) for f in ("version", "channel_count", "strategy_id", "rice_k")}, payload_bytes=ok(F.length("packet") - HEADER_BYTES), status=status)


def sizes(df: DataFrame) -> DataFrame:
    """df (samples) with the packet's bytes under each strategy, null where it cannot hold the frame, from the
    lengths of the codewords: no packet is made."""
    own = df.columns
    d, (delta,) = _staged(df, F.when(F.size("samples") <= MOST_SAMPLES, deltas(F.col("samples"))))
    d, (z, k) = _staged(d, F.transform(delta, zigzag), C.rice_k(sum_abs(delta, RICE_WINDOW)))
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    bits = total(z, lambda v: F.when(k == 3, F.shiftright(v, 3) + 4).otherwise(F.shiftright(v, 1) + 2))
    n = F.size(delta)
    block = lambda w, b: F.ceil(w * F.least(F.lit(BLOCK), n - b * BLOCK) / 8) + 1
    blocks = F.aggregate(F.transform(C.block_widths(z), block), F.lit(0).cast("long"), lambda s, x: s + x)
    return _done(
        d, own,
        delta_varint=HEADER_BYTES + total(delta, lambda x: C.varint_bytes(F.pmod(x.cast("long"), F.lit(1 << 32)))),
        rice=F.when(~C.rice_overflows(z, k), HEADER_BYTES + F.ceil(bits / 8)),
        packed4=F.when(delta.isNotNull(), HEADER_BYTES + F.ceil(n / 2)),
        fixed_width=F.when(F.coalesce(F.array_max(z), F.lit(0)) < 1 << 15, HEADER_BYTES + blocks),
    )


def best_strategy(df: DataFrame) -> DataFrame:
    """df (samples) with best, the lossless strategy of fewest bytes (of equal ones the first by id), and best_bytes."""
    own = df.columns
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    d = sizes(df.select(packed.alias("own"), "samples"))
    options = [(STRATEGIES[s], s) for s in ("delta_varint", "rice", "fixed_width")]
    d, (least,) = _staged(d, F.array_min(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("n"), F.lit(i).alias("id"), F.lit(s).alias("name"))) for i, s in options])))
    return d.select(*[F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(own) if c not in ("best", "best_bytes")], least["name"].alias("best"), least["n"].alias("best_bytes"))


def compare(df: DataFrame, left: str = "samples", right: str = "decoded") -> DataFrame:
    """df with max_error and differing, over the two arrays' samples by position, and ratio of the packet's bytes to
    four bytes a sample if df has packet."""
    errors = F.transform(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b")), lambda p: F.abs(p["a"].cast("long") - p["b"].cast("long")))
    own = df.columns
    d, (e,) = _staged(df, errors)
    more = {"ratio": F.length("packet") / (F.size(left) * 4)} if "packet" in own else {}
    return _done(d, own, max_error=F.coalesce(F.array_max(e), F.lit(0)), differing=F.size(F.filter(e, lambda x: x != 0)), **more)
