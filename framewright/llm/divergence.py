"""Quality rules: distribution divergence from language references (native).

A document's histograms over character classes and over common words are compared with those of each language
by the Jensen-Shannon distance; the nearest language counts. References come from all documents: the shares of
the character classes, and the words that make up at least `common_share` of a language's words. Every language has
one. Those of languages with `least_share` of all words are compared with every document, those of the others, a table
of any size, with the documents of their language, which a join by language brings to them.

How far words can be from a reference depends on what share of the language its common words make up. So the limit
`most_words` is a share of the distance that a text without any common word has. A text stays if one and the same
language is within both limits; a reference without common words has no limit for words.

Defined cases: a null text counts as empty; a text without words fails the base rule (under 10 words); a text of
fewer than `min_words` words gets no verdict by divergence and stays if the base rule lets it; rows with a null or
repeated id, or with equal texts, are judged each on its own; a null language is a language of its own; an empty
table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

#: Character classes by regular expression; characters of none form one more class.
CLASSES = {"small": "[a-zß-ÿ]", "large": "[A-ZÀ-Þ]", "other_letter": "[\\p{L}&&[^a-zA-ZÀ-ÿ]]", "digit": "[0-9]", "space": "[ \\t-\\r]", "stop": "[.,;:?'\"()-]"}


def with_rest(docs: DataFrame) -> DataFrame:
    """docs with word_chars and `_rest`, the text without small letters and spaces. Most characters are one or the
    other, so what is rarer is counted in `_rest`, which is short."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rest = F.regexp_replace(t, f"[{CLASSES['small'][1:-1]}{CLASSES['space'][1:-1]}]+", "")
    return docs.withColumns({"word_chars": F.length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long"), "_rest": rest})


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; `_w` keeps the array
    of words, `_rest` what with_rest() leaves.

    n_repeat_words counts words in five-word windows that occur twice or more in the text. Windows are told
    apart by a 64-bit hash. Sorting (hash, position) brings equal windows together; the windows found start at
    p1 < p2 < ..., and cover sum(min(5, p[k+1] - p[k])) words, the last one 5: time n log n and no comparison of pairs.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = with_rest(docs).withColumn("_w", words(t)).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn(
        "_g",
        F.when(F.size("_h") >= 6, F.expr("transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))")),
    )
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.expr("sort_array(transform(_g, (x, i) -> struct(x, i)))")))
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_s, (e, j) -> (j > 0 and e.x = _s[greatest(j - 1, 0)].x) or e.x = get(_s, j + 1).x), e -> e.i))"))
    repeat = F.expr("aggregate(transform(_p, (x, j) -> least(5, coalesce(get(_p, j + 1), x + 5) - x)), 0L, (a, x) -> a + x)")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return d.withColumns({
        "n_symbols": F.length(F.regexp_replace("_rest", "[^#*$%&|<>]+", "")).cast("long"),
        "_l": lines,
        "n_repeat_words": F.coalesce(repeat, F.lit(0)).cast("long"),
    }).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_h", "_g", "_s", "_p", "_l")


def _letters_only(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), lambda w: w != "")


def with_class_counts(docs: DataFrame) -> DataFrame:
    """docs, from with_rest(), with _c_all (characters of the text) and _c_ and the name of each class."""
    d = docs.withColumn("_c_all", F.length(F.coalesce(F.col("text"), F.lit(""))))
    only = lambda k: "[^\\p{L}]+|[a-zA-ZÀ-ÿ]+" if k == "other_letter" else f"[^{CLASSES[k]}]+"
    counts = {"_c_small": F.col("word_chars") - F.length("_rest"), "_c_space": F.col("_c_all") - F.col("word_chars")}
    counts |= {f"_c_{k}": F.length(F.regexp_replace("_rest", only(k), "")) for k in CLASSES if k not in ("small", "space")}
    return d.withColumns(counts)


def references(docs: DataFrame, common_share: float, least_share: float) -> tuple[list[str], dict, dict, DataFrame]:
    """(common words, language -> shares of the classes, language -> shares of the common words, others), over all documents.

    Bounded but for the last: a language counts if it has least_share of all words, so there are at most 1 / least_share
    of them, each with at most 1 / common_share common words. others: lang, _own_c (shares of the classes) and _own_w
    (common word -> share) of each other language.
    """
    counts = stored(docs.select("lang", F.explode(_letters_only(F.col("text"))).alias("w")).groupBy("lang", "w").count(), "divergence-words")
    by_lang = counts.groupBy("lang").agg(F.sum("count").alias("n"))
    n_all = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = {r.lang: r.n for r in by_lang.filter(F.col("n") >= least_share * n_all).collect()}
    limit = F.coalesce(*[F.when(F.col("lang").eqNullSafe(F.lit(k)), F.lit(common_share * v)) for k, v in totals.items()], F.lit(None).cast("double"))
    top = counts.filter(F.col("count") >= limit).collect() if totals else []
    common = sorted({r.w for r in top})
    shares = {k: dict.fromkeys(common, 0.0) for k in totals}
    for r in counts.filter(F.col("w").isin(common)).filter(limit.isNotNull()).collect() if totals else []:
        shares[r.lang][r.w] = r["count"] / totals[r.lang]
    sums = with_class_counts(with_rest(docs.select("lang", "text"))).groupBy("lang").agg(*[F.sum(f"_c_{k}").alias(k) for k in [*CLASSES, "all"]])
    sums = stored(sums, "divergence-classes")
    classes = {r.lang: [r[k] / max(1, r["all"]) for k in CLASSES] for r in sums.filter(limit.isNotNull()).collect()}

    own = F.array(*[F.col(k) / F.greatest(F.col("all"), F.lit(1)) for k in CLASSES])
    own = F.concat(own, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(own, F.lit(0.0), lambda a, x: a + x))))
    rare, n = counts.filter(limit.isNull()), by_lang.withColumnRenamed("lang", "_lang")
    rare = rare.join(n, F.col("lang").eqNullSafe(F.col("_lang"))).filter(F.col("count") >= common_share * F.col("n"))
    rare = rare.groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("count") / F.col("n")))).alias("_own_w"))
    others = sums.filter(limit.isNull()).join(rare, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    others = others.select("lang", own.alias("_own_c"), F.coalesce("_own_w", F.expr("cast(map() as map<string,double>)")).alias("_own_w"))
    return common, {k: [*v, max(0.0, 1 - sum(v))] for k, v in classes.items()}, shares, stored(others, "divergence-others")


def with_own(docs: DataFrame, large: list, others: DataFrame) -> DataFrame:
    """docs with _own_c and _own_w of their language, null for a large one. Only documents of the others are joined."""
    kinds = dict(others.dtypes)
    in_large = F.coalesce(*[F.when(F.col("lang").eqNullSafe(F.lit(k)), F.lit(True)) for k in large], F.lit(False))
    alone = docs.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("_own_c", "_own_w")})
    if others.isEmpty():
        return alone
    refs = others.withColumnRenamed("lang", "_lang")
    joined = docs.filter(~in_large).join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return alone.filter(in_large).unionByName(joined) if large else joined


def _term(p: Column, q: Column) -> Column:
    """Share of one class in the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2


def _add_term(ref: Column, key: str = "k"):
    """For words a document has; what the others add is half their share in the reference."""
    return lambda a, r: a + _term(r["p"], F.element_at(ref, r[key])) - F.element_at(ref, r[key]) / 2


def _with_shares(d: DataFrame, i: str, to: str) -> DataFrame:
    """d with `to`: struct(w, p) of each distinct word of the sorted array i, from its runs; p is its share of _n words."""
    d = d.withColumn("_e", F.expr(f"filter(transform({i}, (x, j) -> if(x <=> get({i}, j + 1), -1, j)), j -> j >= 0)"))
    runs = f"transform(_e, (e, j) -> struct({i}[e] as w, (e - coalesce(get(_e, j - 1), -1)) / cast(_n as double) as p))"
    return d.withColumn(to, F.expr(runs).cast("array<struct<w:string,p:double>>"))


def _limit(n: Column, most_words: float) -> Column:
    """most_words of the distance of a text without common words, of which the language has a share of n."""
    return F.when(n > 0, most_words * F.sqrt(n / 2 + _term(F.lit(1.0), F.greatest(F.lit(0.0), 1 - n)))).otherwise(1.0)


def divergence(docs: DataFrame, min_words: int = 30, most_chars: float = 0.25, most_words: float = 0.95, common_share: float = 0.005, least_share: float = 0.01) -> DataFrame:
    """docs with the base counts, base_failed, char_distance and word_distance (null under min_words), and kept."""
    common, classes, shares, others = references(docs, common_share, least_share)
    d = with_class_counts(base_counts(with_own(docs, list(shares), others)))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("_c_rest", F.col("_c_all") - sum(F.col(f"_c_{k}") for k in CLASSES))
    judged = F.col("n_words") >= min_words
    if not shares and others.isEmpty():
        return d.withColumns({"char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    p = [F.col(f"_c_{k}") / F.greatest(F.col("_c_all"), F.lit(1)) for k in [*CLASSES, "rest"]]
    char = [F.sqrt(F.greatest(F.lit(0.0), sum(_term(a, F.lit(b)) for a, b in zip(p, q, strict=True)))) for q in classes.values()]
    char.append(F.when(F.col("_own_c").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), sum(_term(a, F.col("_own_c")[k]) for k, a in enumerate(p))))))
    # Common words of the text, sorted, and from their runs (position among all common words, share): each word is
    # looked up once in a set, and only distinct ones in the list.
    d = d.withColumn("_a", _letters_only(F.col("text"))).withColumn("_n", F.size("_a"))
    at = F.array(*[F.lit(w) for w in common]) if common else F.array().cast("array<string>")
    d = _with_shares(d.withColumn("_i", F.sort_array(F.filter("_a", lambda w: w.isin(common)))), "_i", "_r")
    d = d.withColumn("_r", F.transform("_r", lambda r: F.struct(F.array_position(at, r["w"]).cast("int").alias("k"), r["p"].alias("p"))))
    other = lambda i: F.greatest(F.lit(0.0), 1 - F.size(i) / F.greatest(F.col("_n"), F.lit(1)))
    word, limits = [], []
    for q in shares.values():
        ref = F.array(*[F.lit(float(q[w])) for w in common]) if common else F.array().cast("array<double>")
        seen = F.aggregate("_r", F.lit(0.0), _add_term(ref))
        rest = F.lit(max(0.0, 1 - math.fsum(q.values())))
        word.append(F.sqrt(F.greatest(F.lit(0.0), seen + F.lit(math.fsum(q.values()) / 2) + _term(other("_i"), rest))))
        limits.append(_limit(F.lit(math.fsum(q.values())), most_words))
    # The same for the reference of the text's own language, if that is not one of the large ones.
    d = _with_shares(d.withColumn("_j", F.expr("sort_array(filter(_a, w -> map_contains_key(_own_w, w)))")), "_j", "_o")
    d = d.withColumn("_own_n", F.aggregate(F.map_values("_own_w"), F.lit(0.0), lambda a, x: a + x))
    seen = F.aggregate("_o", F.lit(0.0), _add_term(F.col("_own_w"), "w"))
    own = F.sqrt(F.greatest(F.lit(0.0), seen + F.col("_own_n") / 2 + _term(other("_j"), F.greatest(F.lit(0.0), 1 - F.col("_own_n")))))
    word.append(F.when(F.col("_own_w").isNotNull(), own))
    limits.append(_limit(F.col("_own_n"), most_words))
    # By language, so that each distance is worked out once.
    d = d.withColumns({"_cd": F.when(judged, F.array(*char)), "_wd": F.when(judged, F.array(*word))})
    d = d.withColumns({"char_distance": F.array_min("_cd"), "word_distance": F.array_min("_wd")})
    near = [(F.col("_cd")[k] <= most_chars) & (F.col("_wd")[k] <= limit) for k, limit in enumerate(limits)]
    failed = judged & ~functools.reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in near])
    return d.withColumn("kept", ~F.col("base_failed") & ~failed)


def quality_rules(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and both distances, a row for each row of docs."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    d = divergence(docs.select("doc_id", "text", "lang"), **settings)
    return d.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")}).select(*cols)
