"""Quality classifier: a sparse rule ensemble.

Statistics of a text are Spark expressions. Shallow trees, boosted on a labelled sample in numpy, give their paths as
conjunctive rules over the statistics; a lasso logistic model keeps few of the rules and weighs them; and the rules
kept are compiled into one Spark expression, so scoring needs neither Python nor a join.

Defined cases: null and empty texts have all statistics 0; a table with no labelled rows of both values gives every
document the score 1; repeated and null ids are scored each (a null id is not held out); ids labelled twice count
once, with the larger label; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, held_out, labelled_sample
from .divergence import base_counts
from .logistic import fit, sigmoid

#: Labelled documents of each label value to learn from, at most.
PER_CLASS = 4000
TREES, DEPTH, CUTS, LEAST = 40, 3, 32, 10
STATISTICS = ["words", "word_length", "symbols", "exclamations", "bars", "capitals", "digits", "stops", "repeated_lines", "repeated_words", "distinct_words", "same_as_last", "line_words"]


def statistics(docs: DataFrame) -> DataFrame:
    """docs with STATISTICS, each a double."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = base_counts(docs)
    n, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    count = lambda c: F.length(F.regexp_replace("_rest", f"[^{c}]+", ""))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    d = d.withColumns({
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / size,
        "exclamations": count("!?") / size,
        "bars": count("|") / n,
        "capitals": count("A-ZÀ-Þ") / size,
        "digits": count("0-9") / size,
        "stops": count(".,;:") / size,
        "repeated_lines": F.col("n_dup_lines") / n,
        "repeated_words": F.col("n_repeat_words") / n,
        "distinct_words": F.size(F.array_distinct("_w")) / n,
        "same_as_last": F.expr("size(filter(_w, (x, i) -> i > 0 and x = _w[greatest(i - 1, 0)]))") / n,
        "line_words": F.col("n_words") / (breaks + 1),
    })
    return d.select(*docs.columns, *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in STATISTICS])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold), all of which hold


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, cuts: list[np.ndarray], rules: set[Rule], out: np.ndarray) -> None:
    """Splits rows by the largest gain of second order; adds each path below the root to rules, leaf values to out."""
    if path:
        rules.add(tuple(sorted(path)))
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        for j, at in enumerate(cuts):
            left = x[rows, j][:, None] <= at[None, :]
            n, lg, lh = left.sum(0), g[rows] @ left, h[rows] @ left
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (j, float(at[int(gain.argmax())])))
    if best[1] is None:
        out[rows] = -total_g / (total_h + 1)
        return
    j, c = best[1]
    low = x[rows, j] <= c
    _grow(x, g, h, rows[low], (*path, (j, True, c)), cuts, rules, out)
    _grow(x, g, h, rows[~low], (*path, (j, False, c)), cuts, rules, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, c in rule:
        out &= (x[:, j] <= c) if low else (x[:, j] > c)
    return out


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float = 1e-3) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, bias)."""
    if len(set(y.tolist())) < 2:
        return [], 40.0
    weight = weight / weight.mean()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, CUTS), method="lower")) for j in range(x.shape[1])]
    random, z, rules = np.random.default_rng(7), np.zeros(len(y)), set()
    for _ in range(TREES):
        p, step = sigmoid(z), np.zeros(len(y))
        rows = np.flatnonzero(random.random(len(y)) < 0.7)
        _grow(x, weight * (p - y), weight * p * (1 - p), rows, (), cuts, rules, step)
        z += 0.2 * step
    rules = sorted(rules)
    if not rules:
        return [], float(np.log(max(1e-9, weight @ y) / max(1e-9, weight @ (1 - y))))
    w, bias = fit(np.column_stack([holds(r, x) for r in rules]).astype(np.float32), y, weight, l1)
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if v], bias


def compiled(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score as an expression over STATISTICS."""
    z = F.lit(bias)
    for rule, weight in rules:
        cond = F.lit(True)
        for j, low, c in rule:
            cond = cond & ((F.col(STATISTICS[j]) <= c) if low else (F.col(STATISTICS[j]) > c))
        z = z + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def model(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    rows = statistics(labelled_sample(docs.select("doc_id", "text"), labels, "quality", PER_CLASS)).select("y", "n", *STATISTICS).collect()
    rows = sorted(tuple(r) for r in rows)
    if not rows:
        return [], 40.0
    a = np.array(rows, float)
    share = np.array([1 / max(1, (a[:, 0] == y).sum()) for y in a[:, 0]]) * a[:, 1]
    return learn(a[:, 2:], a[:, 0], share)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score."""
    score = compiled(*model(docs, labels))
    return statistics(docs).withColumn("score", fenced(score))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) of each document."""
    s = scored(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model calls good, with their own columns."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    s = scored(docs.select("doc_id", "text", *[F.col(c).alias(a) for c, a in own.items()]), labels)
    return s.filter("score >= 0.3").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
