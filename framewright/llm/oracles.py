"""SQL that computes, independently, what the operators' results have that SQL can express."""

from __future__ import annotations

SEP = r"[\x20\x09-\x0D]+"
#: Steps of a crc32 over a list of byte values, by its polynomial.
CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), "
    "lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT))"
)
ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SEP}'), lambda x: x <> '')"


BASE = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS x(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SEP}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (r) LEFT JOIN hit USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)"""


def base_counts() -> str:
    return f"WITH {BASE} SELECT * EXCLUDE (r) FROM base"


def _term(p: str, q: str) -> str:
    """Share of one class in the Jensen-Shannon divergence, in bits."""
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"(({half(p)} + {half(q)}) / 2)"


def op1_divergence() -> str:
    """Histograms and distances by joins of long tables: (row, class, share) and (row, word, share) with the references'."""
    kinds = {"c_small": "a-zß-ÿ", "c_large": "A-ZÀ-Þ", "c_digit": "0-9", "c_space": "\\x20\\x09-\\x0D", "c_stop": ".,;:?''\"()-"}
    counts = [f"length(regexp_replace(t, '[^{c}]+', '', 'g')) AS {k}" for k, c in kinds.items()] + ["length(regexp_replace(t, '[^\\p{L}]+|[a-zA-ZÀ-ÿ]+', '', 'g')) AS c_other"]
    names = [*kinds, "c_other"]
    return f"""
WITH {BASE},
c AS (SELECT r, lang, length(t) AS n, {', '.join(counts)} FROM d),
lettered AS (SELECT r, lang, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '')) AS w FROM d),
by_word AS (SELECT lang, w, count(*) AS n FROM lettered GROUP BY ALL),
by_lang AS (SELECT lang, sum(n) AS n, sum(n) >= 0.01 * sum(sum(n)) OVER () AS large FROM by_word GROUP BY lang),
frequent AS (SELECT x.lang, x.w, x.n / l.n AS p, l.large, x.n >= 0.005 * l.n AS own FROM by_word x JOIN by_lang l ON x.lang IS NOT DISTINCT FROM l.lang),
common AS (SELECT DISTINCT w FROM frequent WHERE own AND large),
ref_words AS (SELECT lang, w, p FROM frequent WHERE large AND w IN (FROM common) UNION ALL SELECT lang, w, p FROM frequent WHERE NOT large AND own),
listed AS (SELECT l.lang, c.w FROM by_lang l, common c WHERE l.large UNION ALL SELECT lang, w FROM frequent WHERE NOT large AND own),
ref AS (SELECT s.lang, l.large, coalesce((SELECT sum(p) FROM ref_words x WHERE x.lang IS NOT DISTINCT FROM s.lang), 0) AS covered, {', '.join(f'sum(s.{k}) / greatest(1, sum(s.n)) AS {k}' for k in names)},
  greatest(0, 1 - ({' + '.join(f'sum(s.{k})' for k in names)}) / greatest(1, sum(s.n))) AS rest FROM c s JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang GROUP BY s.lang, l.large),
judged AS (SELECT c.r, c.lang, {', '.join(f'c.{k} / greatest(1, n) AS {k}' for k in names)}, (n - {' - '.join(names)}) / greatest(1, n) AS rest FROM c JOIN base USING (r) WHERE n_words >= 30),
pairs AS (SELECT j.r, f.lang, f.covered, sqrt(greatest(0, {' + '.join(_term(f'j.{k}', f'f.{k}') for k in [*names, 'rest'])})) AS cd FROM judged j JOIN ref f ON f.large OR j.lang IS NOT DISTINCT FROM f.lang),
sizes AS (SELECT r, count(*) AS n FROM lettered GROUP BY r),
of_doc AS (SELECT x.r, x.w, count(*) / any_value(s.n) AS p FROM lettered x JOIN sizes s USING (r) GROUP BY x.r, x.w),
met AS (SELECT p.r, p.lang, sum(o.p) AS mine, sum({_term('o.p', 'coalesce(q.p, 0)')} - coalesce(q.p, 0) / 2) AS seen FROM pairs p JOIN listed l ON l.lang IS NOT DISTINCT FROM p.lang JOIN of_doc o ON o.r = p.r AND o.w = l.w
  LEFT JOIN ref_words q ON q.lang IS NOT DISTINCT FROM p.lang AND q.w = o.w GROUP BY p.r, p.lang),
both_ AS (SELECT p.r, p.cd, p.covered, greatest(0, 1 - coalesce(m.mine, 0)) AS other, greatest(0, 1 - p.covered) AS left_, coalesce(m.seen, 0) AS seen FROM pairs p LEFT JOIN met m ON m.r = p.r AND m.lang IS NOT DISTINCT FROM p.lang),
dist AS (SELECT r, cd, sqrt(greatest(0, seen + covered / 2 + {_term('other', 'left_')})) AS wd, CASE WHEN covered > 0 THEN 0.95 * sqrt(covered / 2 + {_term('1.0', 'left_')}) ELSE 1.0 END AS most FROM both_),
verdict AS (SELECT r, min(cd) AS cd, min(wd) AS wd, bool_or(cd <= 0.25 AND wd <= most) AS near FROM dist GROUP BY r)
SELECT b.* EXCLUDE (r), NOT base_failed AND coalesce(near, n_words < 30) AS kept, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance FROM base b LEFT JOIN verdict USING (r)"""


def source_targets() -> str:
    """The excess is shared again, round by round, until nothing is above its cap."""
    return f"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(len({WORDS})) AS BIGINT) AS size, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM s),
a AS (SELECT sum(size) * CAST(1.5 AS DOUBLE) AS total FROM w),
t AS (
  SELECT 0 AS k, list(struct_pack(source := source, size := size, w := CAST(w AS DOUBLE), got := CAST(NULL AS DOUBLE))) AS st, (SELECT total FROM a) AS remaining FROM w
  UNION ALL
  SELECT k + 1, list_transform(st, lambda x: struct_pack(source := x.source, size := x.size, w := x.w, got := CASE WHEN x.got IS NULL AND remaining * x.w / open_w > 2.0 * x.size THEN 2.0 * x.size ELSE x.got END)),
    remaining - coalesce(list_sum(list_transform(list_filter(st, lambda x: x.got IS NULL AND remaining * x.w / open_w > 2.0 * x.size), lambda x: 2.0 * x.size)), 0)
  FROM (SELECT *, list_sum(list_transform(list_filter(st, lambda x: x.got IS NULL), lambda x: x.w)) AS open_w FROM t)
  WHERE len(list_filter(st, lambda x: x.got IS NULL AND remaining * x.w / open_w > 2.0 * x.size)) > 0
),
f AS (SELECT *, list_sum(list_transform(list_filter(st, lambda x: x.got IS NULL), lambda x: x.w)) AS open_w FROM t ORDER BY k DESC LIMIT 1),
u AS (SELECT unnest(st) AS x, remaining, open_w FROM f)
SELECT x.source AS source, x.size AS source_size, round(coalesce(x.got, remaining * x.w / open_w), 6) AS target FROM u"""


def unigram_scores() -> str:
    words = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_append({words}, ' ') AS w, coalesce({CRC.format(ID_BYTES)} % 10 = 0, false) AS held_out FROM documents),
tok AS (SELECT r, doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 4) AS base_score
FROM tok LEFT JOIN c USING (w), n GROUP BY r, doc_id, held_out"""


def media_payloads() -> str:
    tail = "list_transform(range(0, 64), lambda i: CAST(CAST('0x' || substr(h, CAST(length(h) - 127 + 2 * i AS BIGINT), 2) AS INT) AS BIGINT))"
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n_bytes, b || repeat('\\x00'::BLOB, CAST(greatest(64, 64 * ceil(octet_length(b) / 64.0)) - octet_length(b) AS BIGINT)) AS p FROM d),
q AS (SELECT *, hex(p) AS h FROM p)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_sha256, {CRC.format(tail)} AS tail_crc32 FROM q"""


def all_() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_divergence, base_counts, source_targets, unigram_scores, media_payloads)}
