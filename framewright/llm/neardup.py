"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are five consecutive words (ASCII letters in lower case; all words of a shorter text). A shingle weighs its
count in the text times an inverse document frequency, 1 + log((1 + n) / (1 + df)) / log(1 + n), which halves towards
shingles that all documents share; rare and common words of a text differ, but no edit outweighs a whole text. df comes
from all documents through a sketch of CELLS cells. It does not count documents but their distinct least shingles, so
that a text's copies, exact or near, count about once and do not take the weight from what they share. It is rounded to
powers of two, so weights take few values.

Equal texts are one node. BANDS * ROWS consistent weighted samples give each node a key in every band; two texts of
similarity 0.8 share a key with probability 1 - (1 - 0.8^4)^16 > 0.9997.

Nodes with a key in common are candidates. Comparing each with one pivot of its bucket takes a pair for each node,
not all pairs. By the triangle inequality of the weighted Jaccard distance, two nodes of a bucket can only be similar
if their distances to the pivot differ by 0.2 at most; so what a pivot leaves open is: nodes that missed it by no
more than that against nodes that met it, and the nodes that missed it among themselves, which get a pivot of their
own, and so on; after PIVOTS rounds what is left is compared in full, save pairs that cannot be similar: shingles
that no other text left has are out of any overlap, and by residues of hashes the lesser weight bounds the rest. For
that, a bucket is cut into squares of LOT by LOT nodes, each a task's business of its own, so no bucket is one task's.
Pairs whose nodes are connected already are skipped. Similarities are exact, from whole texts. Classes are connected components of the links.

Defined cases: documents without words (null, empty or blank texts) are each a class of their own; rows with equal
texts are one class whatever their ids; a class is named by its smallest id; null ids never name one unless all ids
of a class are null; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, split_words, stored, tidied, tidy, workers_find_package

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
CELLS = 1 << 18
#: Bits by which a cell tells how many least shingles it has seen: so many words of 32.
WORDS = 8
#: Rows of the table of random numbers for consistent sampling; a shingle uses the row that its hash names.
RANDOM_ROWS = 1 << 14
#: Weights for which the sampling of all rows is worked out beforehand.
LEVELS = 4
PIVOTS = 2
#: Other nodes of each bucket that close misses meet.
MEETINGS = 3
#: Comparisons with one pivot that share a copy of its text; nodes on a side of a square of a bucket.
SALT, LOT = 256, 256
#: Residues of hashes by which the weight that texts can share is bounded.
PARTS = 64
#: Texts that are split into words together.
TEXTS = 500

U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingles_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted 64-bit hashes, counts) of each text's shingles. Words are split and told apart by Arrow, and each distinct
    word of TEXTS texts is hashed once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for at in range(0, len(texts), TEXTS):
        names, words, bounds = split_words(texts.slice(at, TEXTS))
        words = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), U, len(names))[words]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if i == j:
                yield np.empty(0, U), np.empty(0, np.int64)
                continue
            n = max(1, j - i - SHINGLE + 1)
            h = np.zeros(n, U)
            for k in range(min(SHINGLE, j - i)):
                h = _mixed(h * U(0x9E3779B97F4A7C15) + words[i + k : i + k + n])
            yield np.unique(h, return_counts=True)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return next(shingles_of(pa.array([text], pa.string())))


def weights(counts: np.ndarray, hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[hashes & U(CELLS - 1)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    total = float(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    least = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return least / (total - least)


@functools.cache
def _randoms() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), beta ~ U(0, 1) and log c - r * (1 - beta), c ~ Gamma(2, 1), for each row and sample."""
    random = np.random.Generator(np.random.PCG64(20240101))
    shape = (RANDOM_ROWS, BANDS * ROWS)
    r, c, beta = random.gamma(2, 1, shape), random.gamma(2, 1, shape), random.random(shape)
    return r.astype(np.float32), beta.astype(np.float32), (np.log(c) - r * (1 - beta)).astype(np.float32)


def _sampled(row: np.ndarray | slice, w: np.ndarray) -> np.ndarray:
    """log of c / (y * e^r) of shingles in these rows, with y = e^(r * (t - beta)), t = floor(log(weight) / r + beta)."""
    r, beta, base = (x[row] for x in _randoms())
    return base - r * np.floor(np.log(w).astype(np.float32)[:, None] / r + beta)


class Sampler:
    """Consistent weighted samples of documents under inverse frequencies. The weights that most cells have, for
    shingles that occur once, have their samples worked out for all rows; results do not depend on which these are."""

    def __init__(self, idf: np.ndarray):
        values, number, times = np.unique(idf, return_inverse=True, return_counts=True)
        common = np.argsort(-times, kind="stable")[:LEVELS]
        level = np.full(len(values), -1)
        level[common] = np.arange(len(common))
        self.level = level[number].astype(np.int8)
        self.known = np.concatenate([_sampled(slice(None), np.full(RANDOM_ROWS, values[v])) for v in common])

    def band_keys(self, hashes: np.ndarray, counts: np.ndarray, w: np.ndarray) -> list[int]:
        """BANDS keys of a document. Each sample picks the shingle of least _sampled() and consists of it and its t."""
        k = np.arange(BANDS * ROWS)
        best, pick = np.full(len(k), np.inf, np.float32), np.zeros(len(k), np.int64)
        row = ((hashes >> U(20)) & U(RANDOM_ROWS - 1)).astype(np.int64)
        level = np.where(counts == 1, self.level[hashes & U(CELLS - 1)], -1).astype(np.int64)
        for own, which in ((False, np.flatnonzero(level >= 0)), (True, np.flatnonzero(level < 0))):
            for s in range(0, len(which), 2048):  # long texts, part by part
                at = which[s : s + 2048]
                a = _sampled(row[at], w[at]) if own else self.known[level[at] * RANDOM_ROWS + row[at]]
                i = a.argmin(0)
                least = a[i, k]
                # Of equal ones the smallest hash, whichever part it is in.
                less = (least < best) | ((least == best) & (at[i] < pick))
                best, pick = np.where(less, least, best), np.where(less, at[i], pick)
        r, beta, _ = _randoms()
        t = np.floor(np.log(w[pick]).astype(np.float32) / r[row[pick], k] + beta[row[pick], k])
        sample = _mixed(hashes[pick] ^ _mixed(t.astype(np.int64).astype(U))).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=U)
        for m in range(ROWS):
            key = _mixed(key * U(0x9E3779B97F4A7C15) + sample[:, m])
        return key.astype(np.int64).tolist()


def _bit(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of a sketch that a least shingle sets; a bit is half as likely as the one before."""
    h = _mixed(least ^ U(0x5BF03635))
    low = h >> U(3)
    level = np.minimum(31, np.log2((low & (~low + U(1))).astype(float) + (low == 0)).astype(np.int64))
    return (h & U(WORDS - 1)).astype(np.int64), np.uint32(1) << level.astype(np.uint32)


def distinct_of(sketch: np.ndarray) -> np.ndarray:
    """Distinct numbers that rows of WORDS words have seen, by their set bits: n for which so many are expected."""
    n = 2 ** np.arange(0, 38, 0.125)
    share = 0.5 ** np.minimum(np.arange(1, 33), 31) / WORDS
    expected = WORDS * (1 - (1 - share[None, :]) ** n[:, None]).sum(1)
    return np.interp(np.bitwise_count(sketch).sum(1), [0, *expected], [0, *n])


def idf_of(n: float, df: np.ndarray) -> np.ndarray:
    """1 + log((1 + n) / (1 + df)) / log(1 + n), with df in powers of two: 2 for the rarest, 1 for what all have."""
    df = np.minimum(n, 2 ** np.round(np.log2(np.maximum(df, 1))))
    return (1 + np.log((1 + n) / (1 + df)) / np.log(1 + max(n, 1))).astype(np.float32)


def sketched(texts: pa.Array, table: np.ndarray, every: np.ndarray) -> None:
    """Enters texts into a table of CELLS sketches, and into that of all."""
    for h, _ in shingles_of(texts):
        if len(h):
            word, bit = _bit(h[:1])
            table[(h & U(CELLS - 1)).astype(np.int64), word[0]] |= bit[0]
            every[word[0]] |= bit[0]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf_of() for each cell of the sketch, over all documents. CELLS rows at most reach the driver. Rare shingles share
    cells with others, alike at any size of input; common ones stand out."""

    def run(batches):
        table, every = np.zeros((CELLS, WORDS), np.uint32), np.zeros(WORDS, np.uint32)
        for b in batches:
            sketched(b.column("text"), table, every)
        at = np.flatnonzero(table.any(1))
        rows = np.concatenate([table[at], every[None]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *(pa.array(rows[:, k].copy()) for k in range(WORDS // 2))], names=["cell", *names])

    names = [f"s{k}" for k in range(WORDS // 2)]
    rows = docs.select("text").mapInArrow(tidied(run), ", ".join(["cell long", *(f"{n} long" for n in names)])).groupBy("cell").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()
    cell = rows["cell"].to_numpy()
    seen = np.column_stack([rows[n].to_numpy() for n in names]).astype(np.int64).view(np.uint32)
    count = distinct_of(seen)
    df = np.zeros(CELLS)
    df[cell[cell >= 0]] = count[cell >= 0]
    n = float(count[cell < 0].sum())
    del rows, seen
    tidy()
    return idf_of(n, df)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, h (md5 of the text, null if it has no words), bands. idf: a broadcast of inverse_frequencies()."""

    def run(batches):
        sampler = None
        for b in batches:
            sampler = sampler or Sampler(idf.value)
            bands = [sampler.band_keys(h, n, weights(n, h, idf.value)) if len(h) else None for h, n in shingles_of(b.column("text"))]
            bands = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.if_else(bands.is_valid(), b.column("h"), pa.scalar(None, pa.binary())), bands], names=["doc_id", "h", "bands"])

    md5 = F.unhex(F.md5(F.col("text").cast("binary")))
    return docs.select(F.col("doc_id").cast("long"), md5.alias("h"), "text").mapInArrow(tidied(run), "doc_id long, h binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """pairs (a, pivot) with sim. texts: (nid, text). Pairs of a pivot are dealt to tasks in lots of about SALT,
    each with its own copy of the pivot's text, which comes first; a task streams over its rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        pivot, own = None, None
        for b in batches:
            out = []
            for p, a, (h, n) in zip(b.column("pivot").to_pylist(), b.column("a").to_pylist(), shingles_of(b.column("text")), strict=True):
                vector = (h, weights(n, h, idf.value).astype(np.float64))
                if a is None:
                    pivot, own = p, vector
                else:
                    assert p == pivot
                    out.append((a, p, similarity(vector, own)))
            a, p, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["a", "pivot", "sim"])

    lots = pairs.groupBy("pivot").agg((F.floor(F.count(F.lit(1)) / SALT) + 1).alias("lots"))
    members = pairs.join(lots, "pivot").withColumn("lot", F.pmod(F.xxhash64("a"), F.col("lots"))).join(texts.withColumnRenamed("nid", "a"), "a").select("pivot", "lot", "a", "text")
    pivots = lots.join(texts.withColumnRenamed("nid", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("a"), "text")
    rows = members.unionByName(pivots).repartition("pivot", "lot").sortWithinPartitions("pivot", "lot", F.col("a").asc_nulls_first())
    return stored(rows.select("pivot", "a", "text").mapInArrow(tidied(run), "a long, pivot long, sim double"), "near-verified")


def shareable(texts: DataFrame, idf) -> DataFrame:
    """nid, total (weight of all its shingles), shared (of those that another text of `texts` has as well) and parts
    (shared, by PARTS residues of the shingles' hashes). Two texts have no more weight in common than the lesser
    shared, nor more than the sum of the lesser parts. Counting is by partial sums; no join on shingles."""

    def run(batches):
        for b in batches:
            for nid, (h, n) in zip(b.column("nid").to_pylist(), shingles_of(b.column("text")), strict=True):
                w = weights(n, h, idf.value).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), nid)), pa.array(h.astype(np.int64)), pa.array(w)], names=["nid", "h", "w"])

    rows = texts.select("nid", "text").mapInArrow(tidied(run), "nid long, h long, w double")
    part = F.pmod("h", F.lit(PARTS)).cast("int").alias("part")
    own = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("nid"), F.min("w").alias("w")).filter("n = 1")
    each = rows.select("nid", part, F.col("w").alias("all"), F.col("w").alias("common"))
    each = each.unionByName(own.select("nid", part, F.lit(0.0).alias("all"), (-F.col("w")).alias("common")))
    each = each.groupBy("nid", "part").agg(F.sum("all").alias("all"), F.sum("common").alias("common"))
    by_node = each.groupBy("nid").agg(F.sum("all").alias("total"), F.sum("common").alias("shared"), F.map_from_entries(F.collect_list(F.struct("part", "common"))).alias("_m"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return by_node.select("nid", "total", "shared", parts.alias("parts"))


def _may_be_similar() -> Column:
    """Of two rows of shareable(): whether their bounds leave a similarity of SIMILAR open. The cheap bound comes first."""
    least = (F.col("total") + F.col("total2")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    common = F.aggregate(F.zip_with("parts", "parts2", lambda a, b: F.least(a, b)), F.lit(0.0), lambda a, x: a + x)
    return (F.least("shared", "shared2") >= least) & (common >= least)


def squared(left: DataFrame, right: DataFrame) -> DataFrame:
    """left joined with right (its columns end in 2, save band and key) on band and key. A bucket is cut into squares,
    so that a task joins LOT by LOT nodes at a time; each pair meets in one of them."""
    size = left.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n1")).join(right.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n2")), ["band", "key"])
    size = size.select("band", "key", (F.floor(F.col("_n1") / LOT) + 1).alias("_p"), (F.floor(F.col("_n2") / LOT) + 1).alias("_q"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    a = left.join(size, ["band", "key"]).withColumns({"_i": F.pmod(F.xxhash64("nid"), F.col("_p")), "_j": F.explode(upto("_q"))}).drop("_p", "_q")
    b = right.join(size, ["band", "key"]).withColumns({"_j": F.pmod(F.xxhash64("nid2"), F.col("_q")), "_i": F.explode(upto("_p"))}).drop("_p", "_q")
    return a.join(b, ["band", "key", "_i", "_j"]).drop("_i", "_j")


def components(links: DataFrame) -> DataFrame:
    """(nid, comp) of every node that has a link: the smallest node that it is connected to. Labels go to neighbours
    and are then followed to their own labels, until nothing changes; each round is written, so lineage stays short."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "nid"), "near-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("nid", "b"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        near = labels.join(heard.withColumnRenamed("a", "nid"), "nid").select("nid", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        after = labels.select(F.col("nid").alias("comp"), F.col("comp").alias("further"))
        new = stored(near.join(after, "comp").select("nid", "old", F.least("comp", "further").alias("comp")), "near-labels")
        changed = new.filter("comp <> old").limit(1).count()
        labels = new.select("nid", "comp")
        if not changed:
            return labels


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes). rows: doc_id and h of each document, in any order. nodes: h, comp, rep (the smallest id of its
    text) of each text with words; texts of one class have the same comp."""
    spark = docs.sparkSession
    workers_find_package(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    rows = stored(signatures(docs, idf), "near-signatures")
    nodes = rows.filter(F.col("h").isNotNull()).groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "near-nodes")

    members = nodes.select("nid", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "key")
    members = stored(members.join(buckets, ["band", "key"]), "near-members")
    wanted = nodes.join(members.select("nid").distinct(), "nid").select("nid", "h", "rep")
    keyed = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = keyed.join(wanted, keyed["rep"].eqNullSafe(wanted["rep"])).filter(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("h"))
    texts = stored(texts.select("nid", "text").dropDuplicates(["nid"]), "near-texts")

    links, open_, met = spark.createDataFrame([], "a long, b long"), members, []
    for k in range(PIVOTS):
        pivots = open_.groupBy("band", "key").agg(F.min("nid").alias("pivot"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        at = open_.join(pivots, ["band", "key"]).filter("nid <> pivot")
        sims = verified(at.select(F.col("nid").alias("a"), "pivot").distinct(), texts, idf)
        links = links.union(sims.filter(F.col("sim") >= SIMILAR).select("a", F.col("pivot").alias("b")))
        # A bucket's band is told apart by round, so that both rounds are one table from here on.
        rows_met = at.join(sims.withColumnRenamed("a", "nid"), ["nid", "pivot"]).select((F.col("band") + BANDS * k).alias("band"), "key", "nid", "sim")
        met.append(stored(rows_met, "near-met"))
        open_ = met[-1].filter(F.col("sim") < SIMILAR).select((F.col("band") - BANDS * k).alias("band"), "key", "nid")
        if open_.isEmpty():
            break
    met = functools.reduce(DataFrame.union, met)
    comp = components(links)
    labelled = lambda: met.join(comp, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    merged = lambda found: components(stored(comp.filter("nid <> comp").select(F.col("nid").alias("a"), F.col("comp").alias("b")).union(found), "near-all"))
    # A node that missed its pivot by more than what the triangle inequality leaves open is not similar to one that met it.
    near_miss, last = (F.col("sim") < SIMILAR) & (F.col("sim") >= 2 * SIMILAR - 1 - 1e-9), F.col("band") >= BANDS * (PIVOTS - 1)

    # Before the rest is compared in full: nodes that missed a pivot closely meet MEETINGS other nodes of each bucket they
    # share. A large group whose texts are just about similar falls together here, without its pairs.
    now = stored(labelled(), "near-labelled")
    hosts = now.filter(F.col("sim") >= SIMILAR).groupBy("band", "key")
    hosts = hosts.agg(*[F.min(F.struct(F.xxhash64("nid", "band", F.lit(k)).alias("order"), "nid", F.col("comp").alias("theirs"))).alias(f"h{k}") for k in range(MEETINGS)])
    hosts = hosts.select("band", "key", F.explode(F.array_distinct(F.array(*[F.col(f"h{k}").dropFields("order") for k in range(MEETINGS)]))).alias("h"))
    pairs = now.filter(near_miss).join(hosts, ["band", "key"]).filter(F.col("comp") != F.col("h.theirs")).select(F.col("nid").alias("a"), F.col("h.nid").alias("pivot"))
    pairs = stored(pairs.distinct(), "near-meetings")
    if not pairs.isEmpty():
        comp = merged(verified(pairs, texts, idf).filter(F.col("sim") >= SIMILAR).select("a", F.col("pivot").alias("b")))
        now = stored(labelled(), "near-labelled")

    # The rest: close misses against nodes that met the pivot, and what the last pivot left among itself.
    asked = now.filter(near_miss | last & (F.col("sim") < SIMILAR)).select("band", "key").distinct()
    open_ = now.join(asked, ["band", "key"], "left_semi")
    bound = shareable(texts.join(open_.select("nid").distinct(), "nid"), idf)
    known = stored(open_.join(bound, "nid"), "near-bounds")
    others = known.select("band", "key", *[F.col(c).alias(f"{c}2") for c in ("nid", "sim", "comp", "total", "shared", "parts")])
    close = F.abs(F.col("sim") - F.col("sim2")) <= 1 - SIMILAR + 1e-9
    open_pair = near_miss & (F.col("sim2") >= SIMILAR) | last & (F.col("sim2") < SIMILAR) & (F.col("nid") > F.col("nid2"))
    rest = squared(known.filter(near_miss | last & (F.col("sim") < SIMILAR)), others.filter(last | (F.col("sim2") >= SIMILAR)))
    rest = rest.filter(open_pair & close & (F.col("comp") != F.col("comp2")) & _may_be_similar()).select(F.col("nid").alias("a"), F.col("nid2").alias("pivot"))
    rest = stored(rest.distinct(), "near-rest")
    if not rest.isEmpty():
        comp = merged(verified(rest, texts, idf).filter(F.col("sim") >= SIMILAR).select("a", F.col("pivot").alias("b")))
    nodes = nodes.select("nid", "h", "rep").join(comp, "nid", "left").select("h", "rep", F.coalesce("comp", "nid").alias("comp"))
    return rows.select("doc_id", "h"), stored(nodes, "near-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), class_size of each document."""
    rows, nodes = classes(docs)
    named = nodes.join(nodes.groupBy("comp").agg(F.min("rep").alias("class_id")), "comp")
    sizes = rows.filter(F.col("h").isNotNull()).groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(nodes, "h").groupBy("comp").agg(F.sum("n").alias("class_size"))
    named = named.join(sizes, "comp").select("h", "class_id", "class_size")
    out = rows.join(named, "h", "left")
    return out.select("doc_id", F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with their own columns: of each class the one of smallest id (of equal ids, of the smallest hash
    of its text, one row), and all documents without words."""
    own = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    _, nodes = classes(docs)
    winners = nodes.groupBy("comp").agg(F.min(F.struct(F.coalesce(F.col("rep"), F.lit((1 << 63) - 1)).alias("order"), "h", "rep")).alias("w")).select(F.col("w.h").alias("_h"), F.col("w.rep").alias("_rep"))
    text = F.coalesce(F.col("text"), F.lit(""))
    wordy = text.rlike(f"[^{SPACES}]")
    hashed = docs.filter(wordy).withColumn("_h", F.unhex(F.md5(F.col("text").cast("binary"))))
    # By id as well: the copies of one text, which may be many, do not all go to one task.
    winners = winners.withColumnRenamed("_h", "_won")
    kept = hashed.join(winners, (F.col("_h") == F.col("_won")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_rep"))).dropDuplicates(["_h"])
    return kept.select(*docs.columns).unionByName(docs.filter(~wordy)).select(*[F.col(a).alias(c) for c, a in own.items()])
