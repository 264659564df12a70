"""Cost-balanced packing of documents into sequences.

Each task encodes its documents and packs them in groups of about GROUP tokens as they come: no shuffle, and memory
for one group. A document's cost is linear plus quadratic in its tokens (attention within it). Whole sequences are
cut off documents longer than one; the other pieces, in descending order, each go to the sequence of least cost that
has room for them, and a piece that fits nowhere is cut at the sequence with most room. The sequences of a group
are as many full ones as its tokens fill, and one of each power of two in the remainder; so they end up full.

Defined cases: a null text is empty and has the end id alone; null and repeated ids are packed each; ties go by
order of arrival and of sequences; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, workers_find_package
from .encode import encoder

LENGTH = 4096
#: Tokens that are packed together.
GROUP = 1_000_000
END = 2
#: Cost of a piece of n tokens: n * (1 + n / QUADRATIC), so that at QUADRATIC tokens attention costs as much as the rest.
QUADRATIC = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return n * (1 + n / QUADRATIC)


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, piece's length, sequence, offset) of each piece; documents are numbered as in sizes."""
    total = sum(sizes)
    rest = total % length
    room = np.array([length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    out, pieces, full = [], [], 0
    for doc, n in enumerate(sizes):
        whole = n // length
        for k in range(whole):
            out.append((doc, k * length, length, full, 0))
            used[full], spent[full] = length, cost(length)
            full += 1
        if n % length:
            pieces.append((n % length, doc, whole * length))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    for n, doc, start in pieces:
        while n:
            free = room - used
            fits = np.flatnonzero(free >= n)
            s = int(fits[spent[fits].argmin()]) if len(fits) else int(free.argmax())
            put = min(n, int(free[s]))
            out.append((doc, start, put, s, int(used[s])))
            used[s] += put
            spent[s] += cost(put)
            n, start = n - put, start + put
    return out


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A row for each piece, as SCHEMA has it."""
    workers_find_package(docs.sparkSession)

    def run(batches):
        enc, sequence = encoder(tokenizer, False), TaskContext.get().partitionId() << 36
        ids, names, held = [], [], 0

        def flush():
            nonlocal sequence
            rows = pack([len(x) for x in ids], length)
            cols = [
                [names[d] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows],
                [zlib.crc32(ids[d][a : a + n]) for d, a, n, _, _ in rows],
                [len(ids[d]) for d, *_ in rows], [sequence + r[3] for r in rows], [r[4] for r in rows],
            ]
            sequence += 1 + max((r[3] for r in rows), default=-1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            flat, starts = enc.encode(batch.column("text"), END)
            flat, at = flat.astype("<u4"), starts.tolist()
            for name, i, j in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                ids.append(flat[i:j])
                names.append(name)
                held += j - i
                if held >= group:
                    yield flush()
                    ids, names, held = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), SCHEMA)
