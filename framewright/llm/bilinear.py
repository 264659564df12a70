"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Units are the end of a text, the most frequent words, and classes of the other words by their last two bytes; the more
distinct words there are, the more units. The model predicts the vector of a unit from those of the two before it, by a
linear map for each place, and scores each unit by its product with that prediction plus a bias. It is trained on every
token of the training documents: from the counts of neighbouring units, a table, the driver fits starting parameters
with the noise-contrastive objective in full; then each task goes over its own tokens in batches, telling the unit that
comes from units drawn as noise, and the tasks' parameters are averaged, unit by unit, by how often a task has met it.
For scores, one product of matrices normalises all contexts over all units; a word of a class then has its smoothed
share of the class. Log-probabilities of a text's tokens add up to its score.

Counts of all words are gathered and used exactly, however many: those of the HEAD most frequent go to the workers in a
broadcast of bounded size, those of the others are joined by shuffle. Only the number of units has a bound, MOST_UNITS:
it is the size of the neural model.

Defined cases: a null text is empty and consists of its end; a null id is not held out; repeated rows are scored
each; without training documents all counts are 0 and units have equal chances; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, split_words, stored, tidied, tidy, workers_find_package

#: Units are as many as the square root of the distinct words, as a power of two within these bounds.
LEAST_UNITS, MOST_UNITS = 512, 2048
#: Classes of words that are not units; vector length.
CLASSES, SIZE = 255, 24
#: Words whose counts every worker holds.
HEAD = 200_000
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 300_000
#: Tokens of a training step, units drawn as noise for it, first step's length.
STEP, NOISE, RATE = 4096, 64, 0.05
#: Texts that are worked on together.
TEXTS = 2000
END = " "  # no word holds a space


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("text").cast(pa.large_string()), "")


def units_for(distinct: int) -> int:
    return int(min(MOST_UNITS, max(LEAST_UNITS, 2 ** round(np.log2(max(1, distinct)) / 2))))


def class_of(words: pa.Array) -> np.ndarray:
    """Class of each word (large_string) by its last two bytes, so that it is the same in every process."""
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.append(np.frombuffer(data or b"", np.uint8), np.uint8(0))
    last = data[ends[1:] - 1].astype(np.int64)
    before = np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 2, 0)].astype(np.int64), 0)
    return (last * 131 + before * 31) % CLASSES


class Units:
    """Units of words: 0 the end of a text, then words, then classes."""

    def __init__(self, words: list[str], n: int):
        self.words, self.n = words, n  # n: with the end and the classes

    def of(self, words: pa.Array) -> np.ndarray:
        found = pc.fill_null(pc.index_in(words, pa.array(self.words, words.type)), -1).to_numpy().astype(np.int64)
        return np.where(found >= 0, found + 1, self.n - CLASSES + class_of(words))

    def sequence(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """(units of all tokens, each text's end included, and split_words())."""
        names, word, bounds = split_words(texts)
        unit = np.zeros(len(word) + len(texts), np.int64)
        unit[np.arange(len(word)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = self.of(names)[word]
        return unit, names, word, bounds


def contexts(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last unit, and the one before it, for each token; the end before a text's first."""
    last = np.concatenate([[0], unit[:-1]])[: len(unit)]
    before = np.concatenate([[0, 0], unit[:-2]])[: len(unit)]
    return last, np.where(last == 0, 0, before)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over docs; END once a document."""

    def run(batches):
        held, ends = [], 0
        summed = lambda: pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])
        for b in batches:
            ends += b.num_rows
            texts = texts_of(b)
            for at in range(0, len(texts), TEXTS):
                names, word, _ = split_words(texts.slice(at, TEXTS))
                table = pa.table({"word": names.cast(pa.string()), "c": np.bincount(word, minlength=len(names))})
                held.append(table.filter(pc.greater(table["c"], 0)))
                if sum(t.num_rows for t in held) > FLUSH:
                    held = [summed()]
                    if held[0].num_rows > FLUSH:
                        yield from held[0].to_batches()
                        held = []
        if ends:
            held.append(pa.table({"word": [END], "c": [ends]}))
            yield from summed().to_batches()

    return docs.select("text").mapInArrow(tidied(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def pair_counts(docs: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each, over docs; a text starts after END. At most n * n rows reach the driver."""

    def run(batches):
        n = np.zeros(units.n * units.n, np.int64)
        for b in batches:
            texts = texts_of(b)
            for at in range(0, len(texts), TEXTS):
                unit = units.sequence(texts.slice(at, TEXTS))[0]
                n += np.bincount(contexts(unit)[0] * units.n + unit, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units.n * units.n, np.float32)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(units.n, units.n)


def start(n: np.ndarray, size: int = SIZE, noise: int = 10, steps: int = 120, rate: float = 0.08, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters r (unit before), t (unit to come), b, c1, c2, fitted to the pair counts n with context maps c1 = c and
    c2 = 0. Noise-contrastive estimation tells pairs seen from `noise` times as many with the next unit drawn from the
    unigram distribution; both expectations are sums over the table."""
    units, random = len(n), np.random.default_rng(seed)
    unigram = ((n.sum(0) + 0.1) / (n.sum() + 0.1 * units)).astype(np.float32)
    total = max(1.0, float(n.sum()))
    seen = n / np.float32(total)
    last = (n.sum(1) / total).astype(np.float32)
    against = last[:, None] * unigram[None, :] * np.float32(noise)
    p = {"r": random.normal(0, 0.1, (units, size)), "t": random.normal(0, 0.1, (units, size)), "c": np.eye(size), "b": np.log(unigram)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    shift = np.log(np.float32(noise) * unigram)[None, :]
    for step in range(1, steps + 1):
        h = p["r"] @ p["c"]
        s = h @ p["t"].T
        s += p["b"] - shift
        np.clip(s, -30, 30, out=s)
        d = 1 / (1 + np.exp(-s))
        g = against * d - seen * (1 - d)
        gh = g @ p["t"]
        grads = {"r": gh @ p["c"].T, "t": g.T @ h, "c": p["r"].T @ gh, "b": g.sum(0)}
        for k, v in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            p[k] = p[k] - np.float32(rate * (1 - step / (steps + 1))) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + np.float32(1e-10))
    return {"r": p["r"], "t": p["t"], "b": p["b"], "c1": p["c"], "c2": np.zeros((size, size), np.float32), "unigram": unigram}


def _added(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of at, sums of their values)."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation by drawn noise, over batches of tokens. Steps of a parameter's row shrink with the
    squares it has seen."""

    def __init__(self, p: dict[str, np.ndarray], seed: int):
        self.p = {k: p[k].copy() for k in ("r", "t", "b", "c1", "c2")}
        self.square = {"r": np.ones(len(p["r"]), np.float32), "t": np.ones(len(p["t"]), np.float32), "c1": 1.0, "c2": 1.0}
        self.met = {"r": np.zeros(len(p["r"])), "t": np.zeros(len(p["t"]))}
        self.random = np.random.default_rng(seed)
        self.draw, self.shift = np.cumsum(p["unigram"].astype(float)), np.log(NOISE * p["unigram"])
        self.tokens = 0

    def _move(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        g = g / np.float32(STEP / 32)
        self.square[name][rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.p[name][rows] += RATE * g / np.sqrt(self.square[name][rows])[:, None]

    def step(self, last: np.ndarray, before: np.ndarray, unit: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.draw, self.random.random(NOISE) * self.draw[-1]), len(self.draw) - 1)
        r1, r2 = p["r"][last], p["r"][before]
        h = r1 @ p["c1"] + r2 @ p["c2"]
        own, others = p["t"][unit], p["t"][noise]
        seen = np.einsum("ij,ij->i", h, own) + p["b"][unit] - self.shift[unit]
        drawn = h @ others.T + (p["b"][noise] - self.shift[noise])
        up = 1 / (1 + np.exp(np.clip(seen, -30, 30)))
        down = 1 / (1 + np.exp(-np.clip(drawn, -30, 30)))
        gh = up[:, None] * own - down @ others
        b = len(self.draw)
        bias = np.bincount(unit, up, b) - np.bincount(noise, down.sum(0), b)
        rows, g = _added(p["t"], np.concatenate([unit, noise]), np.concatenate([up[:, None] * h, -(down.T @ h)]))
        g1, g2 = r1.T @ gh, r2.T @ gh
        context, gr = _added(p["r"], np.concatenate([last, before]), np.concatenate([gh @ p["c1"].T, gh @ p["c2"].T]))
        scale = np.float32(STEP / 32)
        self._move("t", rows, g)
        p["b"] += (RATE * np.clip(bias / scale, -1, 1)).astype(np.float32)
        for name, gc in (("c1", g1 / scale), ("c2", g2 / scale)):
            self.square[name] += float((gc * gc).mean())
            p[name] += np.float32(RATE / np.sqrt(self.square[name])) * gc
        self._move("r", context, gr)
        self.met["t"] += np.bincount(unit, minlength=b)
        self.met["r"] += np.bincount(last, minlength=b) + np.bincount(before, minlength=b)
        self.tokens += len(unit)

    def over(self, unit: np.ndarray) -> None:
        """All tokens of a sequence, in an order drawn at random."""
        last, before = contexts(unit)
        order = self.random.permutation(len(unit))
        for at in range(0, len(order), STEP):
            k = order[at : at + STEP]
            self.step(last[k], before[k], unit[k])


def refined(docs: DataFrame, units: Units, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """p after every token of docs has been a training example once. A task hands on a row for each unit and each of r
    and t, and the maps'; Spark adds them up, so what reaches the driver is one set of parameters."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(p)
    names = [f"p{i}" for i in range(SIZE + 1)]

    def run(batches):
        trainer = None
        for b in batches:
            trainer = trainer or Trainer(held.value, TaskContext.get().partitionId())
            texts = texts_of(b)
            for at in range(0, len(texts), TEXTS):
                trainer.over(units.sequence(texts.slice(at, TEXTS))[0])
        if trainer is not None and trainer.tokens:
            q, n = trainer.p, len(trainer.p["b"])
            maps = np.vstack([q["c1"], q["c2"]]).astype(float)
            blocks = [np.column_stack([q["r"], np.zeros(n)]), np.column_stack([q["t"], q["b"]]), np.column_stack([maps, np.zeros(2 * SIZE)])]
            weight = [trainer.met["r"], trainer.met["t"], np.full(2 * SIZE, float(trainer.tokens))]
            kind = np.repeat([0, 1, 2], [n, n, 2 * SIZE])
            rows, w = np.vstack(blocks), np.concatenate(weight)
            keep = w > 0
            place = np.concatenate([np.arange(n), np.arange(n), np.arange(2 * SIZE)])[keep]
            rows = rows[keep] * w[keep, None]
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), pa.array(place), pa.array(w[keep]), *(pa.array(rows[:, i].copy()) for i in range(SIZE + 1))], names=["kind", "place", "w", *names])

    schema = ", ".join(["kind long", "place long", "w double", *(f"{n} double" for n in names)])
    sums = docs.select("text").mapInArrow(tidied(run), schema).groupBy("kind", "place").agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names]).toArrow()
    out = {k: v.copy() for k, v in p.items()}
    kind, place, w = (sums[c].to_numpy() for c in ("kind", "place", "w"))
    mean = np.column_stack([sums[n].to_numpy() for n in names]) / w[:, None] if len(w) else np.empty((0, SIZE + 1))
    of = lambda k: (place[kind == k], mean[kind == k].astype(np.float32))
    at, v = of(0)
    out["r"][at] = v[:, :SIZE]
    at, v = of(1)
    out["t"][at], out["b"][at] = v[:, :SIZE], v[:, SIZE]
    at, v = of(2)
    maps = np.vstack([out["c1"], out["c2"]])
    maps[at] = v[:, :SIZE]
    out["c1"], out["c2"] = maps[:SIZE], maps[SIZE:]
    return out


class Scorer:
    """log10 P(unit | the two units before it). A score is a sum of two parts, one for each place of the context, so the
    sum over all units that normalises a context is the product of a row for the last unit and one for the one before:
    one matrix product normalises every context there is."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.last = (p["r"] @ p["c1"]) @ p["t"].T + p["b"]
        self.before = (p["r"] @ p["c2"]) @ p["t"].T
        top, top2 = self.last.max(1), self.before.max(1)
        z = np.exp(self.last - top[:, None]) @ np.exp(self.before - top2[:, None]).T
        self.log_sum = np.log(np.maximum(z, 1e-30)) + top[:, None] + top2[None, :]
        for i, j in np.argwhere(z < 1e-30).tolist():  # parts so far apart that products vanish
            s = self.last[i].astype(float) + self.before[j]
            self.log_sum[i, j] = s.max() + np.log(np.exp(s - s.max()).sum())

    def of(self, unit: np.ndarray) -> np.ndarray:
        last, before = contexts(unit)
        out = self.last[last, unit].astype(np.float64) + self.before[before, unit] - self.log_sum[last, before]
        return out / np.log(10)


@functools.lru_cache(1)
def _scorer(key: str, held) -> Scorer:
    """One for each worker process and model; key names the model."""
    return Scorer(held.value[2])


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """word, c of the words that have at least some count, such that they are `most` at most; by count, then by word. How
    many words each sixteenth of an octave of counts has tells which count: no task has to sort what the others found."""
    words = counts.filter(F.col("word") != END)
    step = F.floor(F.log2(F.col("c")) * 16)
    least, n = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        if (n := n + r.n) > most:
            break
        least = r.step
    found = words.filter(step >= least) if least is not None else words.limit(0)
    return found.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def class_masses(counts: DataFrame, units: Units) -> np.ndarray:
    """For each unit that is a class the smoothed counts of its words, and 0.1 for a word never seen. A row for each
    batch and class reaches the shuffle, one for each class the driver."""

    def run(batches):
        for b in batches:
            words = b.column("word").cast(pa.large_string())
            unit = units.of(words)
            of_class = (unit >= units.n - CLASSES) & np.asarray(pc.not_equal(words, END))
            mass = np.bincount(unit[of_class], b.column("c").to_numpy()[of_class] + 0.1, units.n)
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], names=["unit", "mass"])

    mass = np.full(units.n, 0.1)
    for r in counts.mapInArrow(tidied(run), "unit long, mass double").groupBy("unit").agg(F.sum("mass").alias("mass")).collect():
        mass[r.unit] += r.mass
    return mass


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    workers_find_package(spark)
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 10))
    training = docs.filter(~F.col("held_out"))
    counts = stored(word_counts(training), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = most_frequent(counts, HEAD)
    words, c = head["word"].combine_chunks().cast(pa.large_string()), head["c"].to_numpy()
    n_units = units_for(distinct)
    units = Units(words.slice(0, n_units - CLASSES - 1).to_pylist(), n_units)
    p = refined(training, units, start(pair_counts(training, units)))

    mass = class_masses(counts, units)
    class_log = np.where(np.arange(n_units) >= n_units - CLASSES, np.log10(mass), 0.0)
    base_log = float(np.log10(total + 0.1 * (distinct + 1)))
    # In a broadcast of at most HEAD words: log10(c + 0.1).
    held = spark.sparkContext.broadcast((words, np.log10(c + 0.1), p))
    key = uuid.uuid4().hex
    end_known, end_log = ends > 0, float(np.log10(ends + 0.1))
    tidy()

    def run(batches):
        words, logs, _ = held.value
        scorer = _scorer(key, held)
        for b in batches:
            every = texts_of(b)
            for at in range(0, len(every), TEXTS):
                texts = every.slice(at, TEXTS)
                unit, names, word, bounds = units.sequence(texts)
                n, sizes = len(texts), np.diff(bounds)
                doc, of_all = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), sizes + 1)
                model = np.bincount(of_all, scorer.of(unit) - class_log[unit], n)
                found = pc.fill_null(pc.index_in(names, words), -1).to_numpy()
                known = found >= 0
                lg = np.where(known, logs[found] if len(logs) else 0.0, 0.0)
                other = unit[np.arange(len(word)) + doc] >= units.n - CLASSES
                model += np.bincount(doc, lg[word] * other, n)
                base = np.bincount(doc, lg[word], n) + end_log - base_log * (sizes + 1)
                n_known = np.bincount(doc, known[word], n).astype(np.int64) + int(end_known)
                # Words whose counts are not here: which, and how often, by document.
                far = ~known[word]
                pairs, times = np.unique(doc[far] * max(1, len(names)) + word[far], return_counts=True)
                lists = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(names)), minlength=n))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(lists), names.take(pa.array(pairs % max(1, len(names)))).cast(pa.string()))
                part = b.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(model), rest, pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int64)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest", "times"],
                )

    scored = docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<string>, times array<long>")
    # Words beyond the head: their counts come by a join, and add up for each row. 0.1 where a word has none.
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    rest = scored.filter(F.size("rest") > 0).select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("_add"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("_known")
    )
    add = F.coalesce("_add", F.lit(0.0))
    return scored.drop("rest", "times").join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"), (F.col("model") + add).alias("score"),
    )
