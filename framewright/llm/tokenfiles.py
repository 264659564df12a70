"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, so part files hold ascending ranges. Each row holds the id, the
token ids as an integer list (ORC encodes it in runs), their number and the ids before the document in its file.
Row indexes and a Bloom filter on doc_id are written, so a lookup skips stripes and row groups from metadata alone,
and stripes are read in parallel.

Defined cases: a null text is empty and gives the end id alone; null ids come first; repeated ids are kept, ordered
by a hash of their texts; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, passing, tidied, workers_find_package
from .encode import encoder

END = 0


def write_orc(docs: DataFrame, path: str, tokenizer: str, stripe_mb: int = 16) -> None:
    """Writes (doc_id, ids, n_tokens, before) under path, in ascending order of doc_id over the sorted file names."""
    workers_find_package(docs.sparkSession)

    def encode(batches):
        enc, before = encoder(tokenizer, True), 0
        for batch in batches:
            ids, starts = enc.encode(batch.column("text"), END)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(starts)), pa.array(before + starts[:-1])], names=["doc_id", "ids", "n_tokens", "before"])
            before += int(starts[-1])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows, which may be many, are told apart by where they were, so that they need not all go to one task.
    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"_h": F.xxhash64("text"), "_m": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(n, "doc_id", "_h", "_m").sortWithinPartitions("doc_id", "_h")
    rows = ordered.select("doc_id", "text").mapInArrow(tidied(encode), "doc_id long, ids array<int>, n_tokens long, before long")
    options = {"orc.stripe.size": str(stripe_mb << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    rows.write.options(**options).orc(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with `_part`, the number of the file in their order. Names hold it, but not to be ordered as text."""
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long, before long").orc(path)
    return rows.withColumn("_part", F.regexp_extract(F.col("_metadata.file_name"), "^part-(\\d+)", 1).cast("long"))


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """rows (_part, before, ...) with start, the ids of all documents before it, for both. The table of files has a row
    for each file, so as many as write_orc() had partitions; it is small enough for one task to sum up and is joined as
    Spark sees fit by its size."""
    files = rows_of(rows.sparkSession, path).groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    files = files.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(files, "_part").withColumn("start", F.col("_base") + F.col("before")).drop("_part", "_base", "before")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Each row of the files with start, the ids of all documents before it."""
    return with_start(rows_of(spark, path), path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given documents; the filter reaches the files' indexes and Bloom filters."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files written for it."""
    spark = docs.sparkSession
    path = new_path(spark, "token-orc")
    write_orc(docs, path, tokenizer)
    passing(spark, path)

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_part"), b.column("before"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "_part", "before", "n_tokens", "ids_crc32"])

    # First the digests, a few numbers for each document; no ids are shuffled to learn where their file begins.
    rows = rows_of(spark, path).select("doc_id", "_part", "before", "ids").mapInArrow(tidied(digest), "doc_id long, _part long, before long, n_tokens long, ids_crc32 long")
    return with_start(rows, path).select("doc_id", "start", "n_tokens", "ids_crc32")
