"""Toxicity: a counterfactual-regularised classifier.

A document is the set of its words (ASCII letters in lower case, marks at either end stripped) and of their
beginnings, which catch inflected forms. Features that tell the labels apart are kept, and a sparse logistic model is
fitted in numpy. Wherever a labelled text names a group, a copy with the term swapped for another of its kind is
made, and differences between the two scores are penalised, so that naming a group is not what makes a text toxic.
Terms are known in English, German, French and Spanish; a text that has none takes no part in the penalty.
Arrow splits texts and numbers their words, so that no object is made for a word.

Defined cases: null and empty texts have no features and the score of the bias; a table with no labelled rows of
both values gives every document the score 0; repeated and null ids are scored each (a null id is not held out);
ids labelled twice count once, with the larger label; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, tidied, workers_find_package
from .logistic import fit, gram, sigmoid

#: Labelled documents of each label value to learn from, at most.
PER_CLASS = 2500
#: Features of the model at most, and the beginnings of words, in letters, that are features beside whole words.
MOST_FEATURES, BEGINNINGS = 2000, (4, 5, 6)
#: Texts that are worked on together.
TEXTS = 500
MARKS = ".,;:!?\"'()[]{}*$#%&<>|"
# Terms for groups, by kind.
IDENTITY = [
    ["woman", "man"], ["women", "men"], ["girl", "boy"], ["girls", "boys"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "straight", "bisexual", "queer"], ["transgender", "cisgender"], ["black", "white", "asian", "latino"],
    ["african", "european", "american", "mexican", "chinese", "indian"], ["immigrant", "refugee", "citizen"], ["immigrants", "refugees", "citizens"],
    ["old", "young"], ["elderly", "teenage"], ["disabled", "blind", "deaf"],
    ["frau", "mann"], ["frauen", "männer"], ["mädchen", "junge"], ["muslime", "christen", "juden", "hindus"], ["schwul", "lesbisch", "hetero"],
    ["ausländer", "einheimische"], ["flüchtlinge", "bürger"], ["türken", "deutsche", "polen", "russen"],
    ["femme", "homme"], ["femmes", "hommes"], ["fille", "garçon"], ["musulmans", "chrétiens", "juifs"], ["arabes", "français", "africains"],
    ["étrangers", "citoyens"], ["réfugiés", "habitants"], ["homosexuels", "hétérosexuels"],
    ["mujer", "hombre"], ["mujeres", "hombres"], ["niña", "niño"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos", "gitanos"],
    ["inmigrantes", "ciudadanos"], ["refugiados", "vecinos"], ["homosexuales", "heterosexuales"],
]
SWAP = {a: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, a in enumerate(kind)}


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, word) of each distinct word of each text (of large_string), and the words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, MARKS).dictionary_encode()
    word = bare.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    n = max(1, len(bare.dictionary))
    pairs = np.unique(doc * n + word)
    doc, word = pairs // n, pairs % n
    real = np.asarray(pc.not_equal(bare.dictionary, ""))
    return doc[real[word]], word[real[word]], bare.dictionary


def features_of(words: pa.Array) -> list[pa.Array]:
    """Features of words, a column for each kind, null where a word has none of it: itself, and its beginnings."""
    size = pc.utf8_length(words)
    none = pa.scalar(None, words.type)
    return [pc.binary_join_element_wise(pa.scalar("=", words.type), words, pa.scalar("", words.type)), *(pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(words, 0, n), none) for n in BEGINNINGS)]


def _columns(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct feature among names of each text."""
    doc, word, words = words_of(texts)
    hits = np.column_stack([pc.fill_null(pc.index_in(f, names), -1).to_numpy() for f in features_of(words)]).astype(np.int64)
    found = hits[word]
    n = max(1, len(names))
    pairs = np.unique((doc[:, None] * n + found)[found >= 0])
    return pairs // n, pairs % n


def learn(rows: list[tuple[str | None, int, int]], l1: float = 2e-4, pull: float = 1.0) -> tuple[dict[str, float], float]:
    """(weights of features, bias) from (text, label, documents with that label)."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return {}, -40.0
    texts = pa.array([r[0] for r in rows], pa.large_string())
    # How many documents of each label have a feature: counted part by part, then added up by name.
    counted = []
    for at in range(0, len(rows), TEXTS):
        doc, word, words = words_of(texts.slice(at, TEXTS))
        names = pa.chunked_array(features_of(words)).combine_chunks().dictionary_encode()
        number = pc.fill_null(names.indices, -1).to_numpy().reshape(1 + len(BEGINNINGS), -1).T.astype(np.int64)
        found = number[word]
        k = max(1, len(names.dictionary))
        pairs = np.unique((doc[:, None] * k + found)[found >= 0])
        label = y[at : at + TEXTS][pairs // k]
        counted.append(pa.table({"name": names.dictionary, **{f"n{v}": np.bincount(pairs[label == v] % k, minlength=len(names.dictionary)) for v in (0, 1)}}))
    total = pa.concat_tables(counted).group_by("name", use_threads=False).aggregate([("n0", "sum"), ("n1", "sum")])
    names, count = total["name"].combine_chunks(), np.stack([total[f"n{v}_sum"].to_numpy() for v in (0, 1)]).astype(float)
    n = [float((y == v).sum()) for v in (0, 1)]
    mean = count.sum(0) / (n[0] + n[1])
    strength = np.abs(count[0] / n[0] - count[1] / n[1]) / np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]) + 1e-12)
    term = np.asarray(pc.is_in(names, value_set=pa.array(["=" + t for t in SWAP], names.type)))
    strength[term] = np.inf  # whole terms always take part
    usable = np.flatnonzero((count.sum(0) >= 3) | term)
    kept = usable[np.argsort(-strength[usable], kind="stable")[:MOST_FEATURES]]
    names = names.take(pa.array(kept))
    x = np.zeros((len(rows), len(kept)), np.float32)
    pairs = []
    for at in range(0, len(rows), TEXTS):
        part = texts.slice(at, TEXTS)
        doc, column = _columns(part, names)
        x[at + doc, column] = 1
        doc, word, words = words_of(part)
        named = np.asarray(pc.is_in(words, value_set=pa.array(list(SWAP), words.type)))
        for d in np.unique(doc[named[word]]).tolist():
            own = words.take(pa.array(word[doc == d])).to_pylist()
            swapped = pa.array([" ".join(SWAP.get(w, w) for w in own)], pa.large_string())
            change = x[at + d].copy()
            change[_columns(swapped, names)[1]] -= 1
            where = np.flatnonzero(change)
            pairs.append((where, change[where]))
    share = np.array([r[2] / n[int(r[1])] for r in rows])
    w, bias = fit(x, y, share, l1, gram(pairs, len(kept)) if pairs else None, pull)
    return {name: float(v) for name, v in zip(names.to_pylist(), w, strict=True) if v}, bias


def scores(texts: pa.Array, weights: dict[str, float], bias: float) -> np.ndarray:
    names, values = pa.array(list(weights), pa.large_string()), np.array(list(weights.values()), float)
    texts, out = texts.cast(pa.large_string()), []  # before it is sliced: Arrow casts slices to wrong bytes
    for at in range(0, len(texts), TEXTS):
        part = texts.slice(at, TEXTS)
        doc, column = _columns(part, names)
        out.append(bias + np.bincount(doc, values[column], len(part)))
    return sigmoid(np.concatenate([np.empty(0), *out]))


def scored(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """docs with score."""
    workers_find_package(docs.sparkSession)
    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column("text"), weights, bias))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(tidied(run), out)


def model(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """learn() from the labelled sample. One task does it, whose memory the sample bounds; the driver gets the weights."""
    workers_find_package(docs.sparkSession)
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", PER_CLASS).select("text", "y", "n")

    def run(batches):
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        weights, bias = learn(sorted(rows, key=lambda r: (r[1], r[0] or "")))
        yield pa.RecordBatch.from_arrays([pa.array([None, *weights], pa.string()), pa.array([bias, *weights.values()], pa.float64())], names=["name", "weight"])

    found = sample.coalesce(1).mapInArrow(tidied(run), "name string, weight double").collect()
    return {r.name: r.weight for r in found if r.name is not None}, next((r.weight for r in found if r.name is None), -40.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic) of each document."""
    s = scored(docs.select("doc_id", "text"), *model(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not call toxic, with their own columns."""
    own = {c: c if c == "text" else f"_own_{i}" for i, c in enumerate(docs.columns)}
    s = scored(docs.select(*[F.col(c).alias(a) for c, a in own.items()]), *model(docs, labels))
    return s.filter("score < 0.5").select(*[F.col(a).alias(c) for c, a in own.items()])
