"""The codecs over many frames at once, in numpy: time and memory in proportion to the samples.

Frames are (values, at): all values in one array, and where each frame's begin, with the total last. Payloads are
(bytes, at) likewise. Rice codes run from the most significant bit, fixed-width blocks from the least; the first of two
four-bit values is in the low half; variable-length integers have the low seven bits first. Decoders return (values,
status): n values for each frame, meaningless where its status is not 0.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from .format import BLOCK, MOST_READ_ZEROS, MOST_ZEROS, RICE_LIMIT, RICE_WINDOW

#: Bits that are held apart at once, a byte each.
MOST_BITS = 1 << 26


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive stretches begins, and the total."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def stretches(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] numbers in all, then those from first[1], and so on."""
    at = starts(sizes)
    return np.repeat(first - at[:-1], sizes) + np.arange(at[-1])


def _lots(weights: np.ndarray, most: int):
    """Ranges of consecutive items that weigh `most` together, or a single one that weighs more."""
    upto, i = np.cumsum(weights), 0
    while i < len(weights):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


# Transforms


def deltas(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first sample of each frame, then differences of neighbours, wrapping at 32 bits."""
    wide = x.astype(np.int64)
    d = np.diff(wide, prepend=0)
    first = at[:-1][np.diff(at) > 0]
    d[first] = wide[first]
    return d.astype(np.int32)


def prefix_sums(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Samples from deltas, wrapping at 32 bits."""
    total = starts(d)
    return (total[1:] - np.repeat(total[at[:-1]], np.diff(at))).astype(np.int32)


def zigzag(d: np.ndarray) -> np.ndarray:
    return ((d.astype(np.int64) << 1) ^ (d.astype(np.int64) >> 63)) & 0xFFFFFFFF


def unzigzag(z: np.ndarray) -> np.ndarray:
    return ((z >> 1) ^ -(z & 1)).astype(np.int32)


def sum_abs(d: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of the absolute values of the first n deltas of each frame."""
    size = np.minimum(np.diff(at), n)
    head = starts(np.abs(d[stretches(at[:-1], size)].astype(np.int64)))
    ends = starts(size)
    return head[ends[1:]] - head[ends[:-1]]


# Variable-length integers


def varint_encode(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u: values of 0 .. 2^32 - 1."""
    size = 1 + sum((u >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    first = starts(size)
    out = np.empty(first[-1], np.uint8)
    for k in range(5):
        has = size > k
        out[first[:-1][has] + k] = (u[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, first[at]


def varint_decode(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-9: an integer of over five bytes among those wanted; -6: too few."""
    end = np.flatnonzero(data < 128)
    token = np.searchsorted(end, at)  # a frame's first token, were it alone
    found = np.diff(token)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    has = found > 0
    begin[token[:-1][has]] = at[:-1][has]
    size = end - begin + 1
    long_ = starts(size > 5)
    wanted = np.minimum(found, n)
    over = long_[token[:-1] + wanted] > long_[token[:-1]]
    tail = at[1:] - np.where(has, end[token[1:] - 1] + 1 if len(end) else 0, at[:-1])
    status = np.where(over, -9, np.where(found >= n, 0, np.where(tail > 5, -9, -6)))
    which = stretches(token[:-1], np.where(status == 0, n, 0))
    value = np.zeros(len(which), np.int64)
    for k in range(5):
        more = size[which] > k
        value[more] += (data[begin[which[more]] + k].astype(np.int64) & 127) << 7 * k
    return _placed((value & 0xFFFFFFFF).astype(np.uint32).view(np.int32), status, n), status


def _placed(values: np.ndarray, status: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values of the good frames among n of each frame, 0 in the others."""
    if (status == 0).all():
        return values
    out = np.zeros(int(n.sum()), values.dtype)
    out[np.repeat(status == 0, n)] = values
    return out


# Rice codes


def rice_k(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(sum_abs(d, at, RICE_WINDOW) > RICE_LIMIT, 3, 1)


def rice_overflows(z: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Frames with a value that has more than MOST_ZEROS zeros."""
    over = starts(z >> np.repeat(k, np.diff(at)) > MOST_ZEROS)
    return over[at[1:]] > over[at[:-1]]


def rice_encode(z: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k: 0 .. 3 for each frame; none overflows."""
    low = np.repeat(k, np.diff(at))
    zeros = z >> low
    ends = starts(zeros + 1 + low)
    size = -(-(ends[at[1:]] - ends[at[:-1]]) // 8)
    out = []
    for i, j in _lots(size * 8, MOST_BITS):
        a, b = at[i], at[j]
        base = np.repeat(starts(size[i:j])[:-1] * 8 - ends[at[i:j]], np.diff(at[i : j + 1]))
        bits = np.zeros(int(size[i:j].sum()) * 8, np.uint8)
        one = base + ends[a:b] + zeros[a:b]
        bits[one] = 1
        for m in range(3):
            has = low[a:b] > m
            bits[one[has] + low[a:b][has] - m] = (z[a:b][has] >> m) & 1
        out.append(np.packbits(bits))
    return np.concatenate([np.empty(0, np.uint8), *out]), starts(size)


def _rice_frame(bits: np.ndarray, n: int, k: int) -> np.ndarray | None:
    """n values from the bits of a frame; None if it ends too early or has too many zeros in a row."""
    ones = np.flatnonzero(bits[: max(0, len(bits) - k)])
    if k:  # a codeword's end decides where the next one begins, so its ones are followed from one to the next
        after = [*np.searchsorted(ones, ones + 1 + k).tolist(), len(ones)]
        picked, j = [], 0
        for _ in range(n):
            picked.append(j)
            j = after[j] if j < len(ones) else len(ones)
        if n and picked[-1] >= len(ones):
            return None
        ones = ones[picked]
    elif len(ones) < n:
        return None
    ones = ones[:n]
    zeros = np.diff(ones + 1 + k, prepend=0) - 1 - k
    if n and zeros.max() > MOST_READ_ZEROS:
        return None
    value = zeros << k
    for m in range(k):
        value |= bits[ones + k - m].astype(np.int64) << m
    return value


def rice_decode(data: np.ndarray, at: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-6: too few codewords, or one of over MOST_READ_ZEROS zeros."""
    out, status = [np.empty(0, np.int64)], np.zeros(len(n), np.int64)
    for f, ((i, j), count, low) in enumerate(zip(pairwise(at.tolist()), n.tolist(), k.tolist(), strict=True)):
        z = _rice_frame(np.unpackbits(data[i:j]), count, low)
        if z is None:
            status[f] = -6
            z = np.zeros(count, np.int64)
        out.append(z)
    return unzigzag(np.concatenate(out)), status


# Four-bit codes


def packed4_encode(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (np.clip(d >> 8, -8, 7) & 15).astype(np.uint8)
    sizes = np.diff(at)
    first = starts(-(-sizes // 2))
    k = np.arange(len(d)) - np.repeat(at[:-1], sizes)
    place = np.repeat(first[:-1], sizes) + k // 2
    out = np.zeros(first[-1], np.uint8)
    out[place[k % 2 == 0]] = half[k % 2 == 0]
    out[place[k % 2 == 1]] |= half[k % 2 == 1] << 4
    return out, first


def packed4_decode(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    status = np.where(np.diff(at) < (n + 1) // 2, -6, 0)
    n_good = np.where(status == 0, n, 0)
    k = stretches(np.zeros(len(n), np.int64), n_good)
    half = data[np.repeat(at[:-1], n_good) + k // 2] >> np.where(k % 2 == 0, 0, 4) & 15
    value = (half.astype(np.int32) ^ 8) - 8
    return _placed(value * 256, status, n), status


# Fixed-width blocks


def _block_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each frame, values of each block)."""
    blocks = -(-n // BLOCK)
    number = stretches(np.zeros(len(n), np.int64), blocks)
    return blocks, np.minimum(BLOCK, np.repeat(n, blocks) - number * BLOCK)


def widths(z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit width of the largest value of each block; no block is empty."""
    top = np.maximum.reduceat(z, starts(sizes)[:-1]) if len(sizes) else np.empty(0, np.int64)
    return np.ceil(np.log2(top + 1.0)).astype(np.int64)  # exact: doubles hold 2^32


def fixed_encode(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A width byte and the values' low bits for each block. Widths above 15 do not survive: the byte holds four bits,
    and 16 is the most that is written."""
    blocks, sizes = _block_sizes(np.diff(at))
    w = np.minimum(widths(z, sizes), 16)
    place = starts(1 + -(-w * sizes // 8))
    out = []
    each = starts(sizes)
    for i, j in _lots(np.diff(place) * 8, MOST_BITS):
        a, b = each[i], each[j]
        bits = np.zeros(int(place[j] - place[i]) * 8, np.uint8)
        width = np.repeat(w[i:j], sizes[i:j])
        first = np.repeat((place[i:j] - place[i] + 1) * 8, sizes[i:j]) + width * (np.arange(a, b) - np.repeat(each[i:j], sizes[i:j]))
        for m in range(int(w[i:j].max(initial=0))):
            has = width > m
            bits[first[has] + m] = (z[a:b][has] >> m) & 1
        packed = np.packbits(bits, bitorder="little")
        packed[place[i:j] - place[i]] = w[i:j] & 15
        out.append(packed)
    return np.concatenate([np.empty(0, np.uint8), *out]), place[starts(blocks)]


def fixed_decode(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-6: the payload ends too early. A block's place depends on the widths before it, so blocks are walked one by one."""
    blocks, sizes = _block_sizes(n)
    place, status = np.zeros(len(sizes), np.int64), np.zeros(len(n), np.int64)
    lengths, b, where = sizes.tolist(), 0, []
    for f, ((i, j), count) in enumerate(zip(pairwise(at.tolist()), blocks.tolist(), strict=True)):
        own = data[i:j].tobytes()
        p = 0
        for size in lengths[b : b + count]:
            where.append(i + p)
            if p >= len(own) or (p := p + 1 + ((own[p] & 15) * size + 7) // 8) > len(own):
                status[f] = -6
                break
        where += [i] * (b + count - len(where))
        b += count
    place = np.array(where, np.int64)
    ok = np.repeat(status == 0, blocks)
    place, sizes = place[ok], sizes[ok]
    w = data[place].astype(np.int64) & 15
    z = np.zeros(int(sizes.sum()), np.int64)
    each = starts(sizes)
    width = np.repeat(w, sizes)
    bit = np.repeat((place + 1) * 8, sizes) + width * (np.arange(each[-1]) - np.repeat(each[:-1], sizes))
    for m in range(int(w.max(initial=0))):
        has = width > m
        p = bit[has] + m
        z[has] |= (data[p >> 3].astype(np.int64) >> (p & 7) & 1) << m
    return _placed(unzigzag(z), status, n), status
