"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import workers_find_package as workers_find_package

#: Characters that separate words, in every operator of this package: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all run in
    one process (tests), else an error: executors would write to their own disks and later reads miss those files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file:///tmp/framewright-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written by this process that may still be read.
_written: list[str] = []


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> str:
    """path, whose files go when the application ends, or with discard()."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    _written.append(path)
    return path


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this process has written between steps. For long sessions: results that have not been
    written or collected yet can't be read afterwards."""
    while _written:
        p, fs = _path(spark, _written.pop())
        fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def tidy() -> None:
    """Hands memory that is no longer used back to the system: worker processes are kept from task to task, and what
    one stage needed would else stay beside what the next one does."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that is tidy() after its last batch."""

    def all_(batches):
        yield from run(batches)
        tidy()

    return all_


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them, where each text's words begin, with the total last), of texts
    of large_string without nulls, ASCII letters in lower case. Arrow splits and numbers them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    names, words, bounds = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:  # before the first word, or after the last
        real = words != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        words = words[real]
    return names, words, bounds.astype(np.int64)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df, stored, with for each of `sums` its total over all rows before, by `order` (which tells all rows apart). Rows
    are dealt to tasks by ranges of the order; only the tasks' totals, a row for each task, are summed up in one place."""
    d = df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()).withColumns({f"_own_{k}": c for k, c in sums.items()})
    d = stored(d, name)
    within = Window.partitionBy("_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_task").agg(*[F.sum(f"_own_{k}").alias(f"_all_{k}") for k in sums])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_task", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums])
    d = d.withColumns({k: F.coalesce(F.sum(f"_own_{k}").over(within), F.lit(0)) for k in sums}).join(totals, "_task")
    return stored(d.select(*df.columns, *[(F.col(k) + F.col(f"_base_{k}")).alias(k) for k in sums]), name)


def fenced(c: Column) -> Column:
    """c, which filters above it are not pushed through: else each mention of it in them would be worked out anew."""
    return F.when(F.spark_partition_id() >= 0, c)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words(text), without building the array: word starts are what is left of the text
    when every run of word characters becomes one mark and the separators go."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, "[^ \\t-\\r]+", "x"), "[ \\t-\\r]+", "")).cast("long")


def held_out(doc_id: Column, folds: int) -> Column:
    """True for rows that learning leaves out: crc32 of the id as text, modulo folds, is 0. A null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, n) of at most per_class documents of each label value, the first by a hash of the id,
    among those that are not held out (modulo 5). Ids labelled twice count once, with the larger label; of rows with
    one id, the one whose text has the smallest hash is taken. So there are 2 * per_class rows at most, and both the
    broadcast of their ids and their collection have that bound.
    n: how many ids have that label value, to weigh the sample back to all labels."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    n = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    picked = known.filter("y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.join(F.broadcast(n), "y")), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")  # partial sums keep one row for each id
    return rows.groupBy("doc_id", "y", "n").agg(first).select("doc_id", F.col("r.text").alias("text"), "y", "n")
