"""Mixing sources to target weights (native).

The words of each source, its documents in a fixed pseudorandom order, form a stream that is cut into blocks of
BLOCK words. A source's target gives the slots that it fills. Output shards have SHARD slots each; the source of each
slot is drawn on its own by the sources' shares, so that the counts of the sources in a shard are a multinomial draw.
All shards together then ask for a little more of one source and less of another than the targets; a residual pass
hands the slots that a source has too many to those that have too few. A source's slots, numbered through all shards,
are mapped to its blocks: whole passes over them, and for the rest of a pass the blocks that a pseudorandom permutation
of its block numbers (a Feistel network over the exact range, so no table and no sort) sends the first ones to. Slots
and blocks are joined by (source, block).

Any number of sources and any share of one: documents meet their source's figures by a salted join, and what is
summed up over all sources or shards is summed by ranges first.

Defined cases: a null text has no words; a null source is a source, the last; documents without words and sources
without words take part with 0; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fenced, n_words, running, stored

BLOCK = 64
#: Slots of an output shard.
SHARD = 1024
#: Documents of a source in a bucket, over which word offsets are summed in one task; shards likewise.
BUCKET, SHARDS = 2000, 4096
#: Parts of a source in the join of documents with sources; slots in one row of the table that draws look sources up in.
SALT, CHUNK = 64, 4096
WEIGHTS = (5, 2, 1)
SEED = 20240607


def permute(df: DataFrame, out: str, i: Column, n: Column, seed: Column) -> DataFrame:
    """df with out, where a pseudorandom permutation of 0 .. n-1 sends i: a Feistel network on a * b >= n cells, walked
    until it lands below n. Fewer than a cells lie at or above n, so a steps always do; nearly all rows need one."""
    df = df.withColumns({"_n0": n.cast("long"), "_i0": i.cast("long"), "_seed": seed.cast("long")})
    df = df.withColumn("_a0", F.greatest(F.floor(F.sqrt(F.col("_n0").cast("double"))) + 1, F.lit(1)))
    df = df.withColumn("_b0", F.greatest(F.ceil(F.col("_n0") / F.col("_a0")), F.lit(1)))
    a, b, keep = F.col("_a0"), F.col("_b0"), df.columns

    def left_round(left: Column, right: Column, k: int) -> Column:
        return F.pmod(left + F.pmod(F.xxhash64(right, F.col("_seed"), F.lit(k)), a), a)

    def right_round(left: Column, right: Column, k: int) -> Column:
        return F.pmod(right + F.pmod(F.xxhash64(left, F.col("_seed"), F.lit(k)), b), b)

    def once(x: Column) -> Column:
        left, right = F.floor(x / b), x % b
        for k in (0, 2):
            left = left_round(left, right, k)
            right = right_round(left, right, k + 1)
        return (left * b + right).cast("long")

    df = df.withColumns({"_l": F.floor(F.col("_i0") / b), "_r": F.col("_i0") % b})
    for k in (0, 2):
        df = df.withColumn("_l", left_round(F.col("_l"), F.col("_r"), k))
        df = df.withColumn("_r", right_round(F.col("_l"), F.col("_r"), k + 1))
    df = df.withColumn("_x", F.col("_l") * b + F.col("_r"))
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), a), F.col("_x"), lambda x, _: F.when(x < F.col("_n0"), x).otherwise(once(x)))
    df = df.withColumn(out, F.when(F.col("_x") < F.col("_n0"), F.col("_x")).otherwise(walk))
    return df.select(*[c for c in keep if c not in ("_n0", "_i0", "_seed", "_a0", "_b0", out)], out)


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, src, source_size, n_docs, target: weights 5, 2, 1, repeating, by code point of the source, null last.

    Sharing an excess again by weight until no target is above its cap is filling to a level: with sources by
    cap / weight ascending, those before the first whose cap / weight reaches the level stay at their caps."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = running(s, [F.col("source").asc_nulls_last()], {"src": F.lit(1)}, "mix-sources").withColumn("src", F.col("src").cast("long") + 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("src") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size")).withColumn("_q", F.col("_cap") / F.col("_w"))
    s = running(s, [F.col("_q").asc(), F.col("src").asc()], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, "mix-levels")
    size, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    s = s.withColumn("_level", (share * size - F.col("_caps")) / (weight - F.col("_ws")))
    first = s.filter(F.col("_level") <= F.col("_q")).agg(F.coalesce(F.min_by("_level", F.struct("_q", "src")), F.lit(0.0))).first()[0]
    return s.select("source", "src", "source_size", "n_docs", F.least(F.col("_cap"), first * F.col("_w")).alias("target"))


def source_slots(sources: DataFrame) -> DataFrame:
    """src, source_size, n (blocks), passes, rest (words beyond whole passes), slots, first (slots of the sources before):
    passes * n slots for the whole passes, then enough for the rest; all but the last block hold BLOCK words."""
    s = sources.filter("source_size > 0").select("src", "source_size", F.round("target").cast("long").alias("_words"))
    s = s.withColumn("n", F.ceil(F.col("source_size") / BLOCK)).withColumn("passes", F.floor(F.col("_words") / F.col("source_size")))
    s = s.withColumn("rest", F.col("_words") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("n") + F.ceil(F.col("rest") / BLOCK)).filter("slots > 0").drop("_words")
    return running(s, [F.col("src").asc()], {"first": F.col("slots")}, "mix-slots")


def shard_draws(slots: DataFrame, shard: int = SHARD) -> DataFrame:
    """src, shard, n: how many slots of each shard fall to each source, drawn slot by slot by the sources' shares of all
    slots. slots: source_slots()."""
    spark = slots.sparkSession
    total = slots.agg(F.coalesce(F.max(F.col("first") + F.col("slots")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    x = F.pmod(F.xxhash64("id", F.lit(SEED).cast("long")), F.lit(max(1, total)))
    draws = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), x.alias("_x")).withColumn("_chunk", F.floor(F.col("_x") / CHUNK))
    last = F.col("first") + F.col("slots")
    table = slots.select("src", "first", last.alias("_end"), F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((last - 1) / CHUNK))).alias("_chunk"))
    return draws.join(table, "_chunk").filter((F.col("_x") >= F.col("first")) & (F.col("_x") < F.col("_end"))).groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"))


def slots_of_shards(slots: DataFrame, draws: DataFrame) -> DataFrame:
    """src, k (0 .. slots - 1), shard: each slot of each source once. draws: shard_draws(), stored."""
    group = F.floor(F.col("shard") / SHARDS)
    d = draws.withColumn("_g", group)
    base = d.groupBy("src", "_g").agg(F.sum("n").alias("_sum"))
    base = base.select("src", "_g", (F.sum("_sum").over(Window.partitionBy("src").orderBy("_g")) - F.col("_sum")).alias("_base"))
    d = d.withColumn("_upto", F.sum("n").over(Window.partitionBy("src", "_g").orderBy("shard"))).join(base, ["src", "_g"])
    d = d.select("src", "shard", (F.col("_base") + F.col("_upto") - F.col("n")).alias("_a"), (F.col("_base") + F.col("_upto")).alias("_b")).join(slots.select("src", "slots"), "src")
    own = d.filter(F.col("_a") < F.col("slots")).select("src", "shard", F.col("_a"), F.least("_b", "slots").alias("_b"))

    # The residual pass: slots that a source has too many, and those that another lacks, each numbered through.
    drawn = draws.groupBy("src").agg(F.sum("n").alias("_drawn"))
    s = slots.select("src", "slots").join(drawn, "src", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    more, less = F.greatest(F.lit(0), F.col("_drawn") - F.col("slots")), F.greatest(F.lit(0), F.col("slots") - F.col("_drawn"))
    s = running(s, [F.col("src").asc()], {"_more": more, "_less": less}, "mix-residual")
    vacant = d.filter(F.col("_b") > F.col("slots")).join(s.select("src", "_more"), "src").withColumn("_from", F.greatest("_a", "slots"))
    vacant = vacant.select("shard", F.explode(F.sequence(F.col("_more") + F.col("_from") - F.col("slots"), F.col("_more") + F.col("_b") - F.col("slots") - 1)).alias("_e"))
    lacking = s.filter(F.col("slots") > F.col("_drawn")).select("src", F.col("_drawn"), F.col("_less"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - F.col("_drawn") - 1)).alias("_i"))
    filled = lacking.select("src", (F.col("_drawn") + F.col("_i")).alias("k"), (F.col("_less") + F.col("_i")).alias("_e")).join(vacant, "_e").select("src", "k", "shard")
    # A number of partitions that is given is kept: rows are few and small before they are exploded.
    tasks = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(tasks, "src", "shard").select("src", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("k"), "shard")
    return own.unionByName(filled)


def mixed(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces). placed: a row for each row of docs, with src, bucket and rn, its key here, `keys`, size,
    source_size and target. pieces: a row for each stretch of a document that a slot takes: the key, pass, shard, and
    the document's words from .. to (after `from`, up to `to`). keys: columns of docs that placed keeps and orders by."""
    names = [f"_k{i}" for i in range(len(keys))]
    sized = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)], "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_h"))
    # Equal rows are counted, then told apart by number, so that no task has to hold all copies of one.
    sized = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    sized = stored(sized.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")).drop("_n"), "mix-sizes")
    sources = stored(source_targets(sized), "mix-targets")
    salt = F.pmod(F.xxhash64(*names, "_h", "_copy"), F.lit(SALT))
    per = sources.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    placed = sized.withColumn("_salt2", salt).join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2"))).drop("_source", "_salt", "_salt2")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*names, "_h", "_copy", F.lit(SEED)), F.floor(F.col("n_docs") / BUCKET) + 1))
    by = Window.partitionBy("src", "bucket").orderBy(*names, "_h", "_copy")
    placed = placed.withColumns({"rn": F.row_number().over(by), "_end": F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    placed = stored(placed.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "size", "src", "source_size", "target", "bucket", "rn", "_end"), "mix-placed")
    base = placed.groupBy("src", "bucket").agg(F.sum("size").alias("_sum"))
    base = base.withColumn("_base", F.sum("_sum").over(Window.partitionBy("src").orderBy("bucket")) - F.col("_sum")).drop("_sum")

    blocks = placed.filter("size > 0").hint("merge").join(base, ["src", "bucket"]).select("src", "bucket", "rn", (F.col("_base") + F.col("_end") - F.col("size")).alias("_a"), (F.col("_base") + F.col("_end")).alias("_b"))
    blocks = blocks.select("*", F.explode(F.sequence(F.floor(F.col("_a") / BLOCK), F.floor((F.col("_b") - 1) / BLOCK))).alias("block"))

    by_source = source_slots(sources)
    slots = stored(slots_of_shards(by_source, stored(shard_draws(by_source, shard), "mix-draws")), "mix-shards")
    figures = by_source.select("src", "n", "passes", "rest").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    slots = slots.withColumn("_salt", F.col("shard") % SALT).join(figures, ["src", "_salt"])
    slots = slots.withColumns({"pass": F.floor(F.col("k") / F.col("n")), "_j": F.col("k") % F.col("n"), "_full": F.col("n") - 1})
    slots = permute(slots, "block", F.col("_j"), F.col("_full"), F.col("src")).withColumn("block", F.when(F.col("_j") < F.col("_full"), F.col("block")).otherwise(F.col("_full")))
    slots = slots.withColumn("_take", F.when(F.col("pass") < F.col("passes"), F.lit(BLOCK)).otherwise(F.least(F.lit(BLOCK), F.col("rest") - F.col("_j") * BLOCK)))

    # Both sides grow with the data once exploded, which the planner can't see from the sizes before: no broadcast.
    pieces = blocks.hint("merge").join(slots.select("src", "block", "pass", "shard", "_take").hint("merge"), ["src", "block"])
    start = F.col("block") * BLOCK
    pieces = pieces.withColumns({"from": F.greatest(F.col("_a"), start) - F.col("_a"), "to": F.least(F.col("_b"), start + F.col("_take")) - F.col("_a")})
    return placed, pieces.filter("to > from").select("src", "bucket", "rn", "pass", "shard", "from", "to")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and shards, the output shards that hold words of the document."""
    placed, pieces = mixed(docs)
    taken = pieces.groupBy("src", "bucket", "rn").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
    out = placed.join(taken, ["src", "bucket", "rn"], "left")
    return out.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "shards")])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each document and pass that takes words of it, its
    text the words taken (verbatim if that is all of them), n_chars its length."""
    own = {c: c if c in ("text", "source", "doc_id") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    # A row's 128-bit key; equal rows share one, and the text that goes with it is the same.
    keyed = d.withColumns({"_h1": F.xxhash64(*d.columns), "_h2": F.xxhash64(F.lit(SEED), *d.columns)})
    placed, pieces = mixed(keyed, ("doc_id", "_h1", "_h2"))
    ranges = pieces.groupBy("src", "bucket", "rn", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_ranges"), F.sum(F.col("to") - F.col("from")).alias("_taken"))
    taken = placed.select("src", "bucket", "rn", "_h1", "_h2", "size").join(ranges, ["src", "bucket", "rn"])
    taken = taken.select("_h1", "_h2", F.when(F.col("_taken") < F.col("size"), F.col("_ranges")).alias("_ranges"))
    out = keyed.dropDuplicates(["_h1", "_h2"]).join(taken, ["_h1", "_h2"])
    # Fenced: within the function of ranges below, words would else be split anew for each range.
    out = out.withColumn("_words", fenced(F.when(F.col("_ranges").isNotNull(), F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))))
    part = F.array_join(F.flatten(F.transform("_ranges", lambda r: F.slice(F.col("_words"), (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    out = out.withColumn("text", F.coalesce(part, "text"))
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length("text").cast("long"))
    return out.select(*[F.col(a).alias(c) for c, a in own.items()])
