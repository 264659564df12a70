"""Small cases of every operator: brute force, round trips, nulls, empty tables, ties, clashing columns."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("framewright.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows], SCHEMA)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 40)), (5, prose(2, 40)), (5, prose(2, 40)), (7, prose(3, 30_000)), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).withColumns({c: F.lit(1) for c in ("score", "size", "word", "h", "comp", "pass")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_copies_in_a_large_group(spark):
    from framewright.llm.neardup import near_duplicates

    # A third of the rows are copies of one text, each with another word changed: any two have a plain similarity of
    # 0.84. That so many share their shingles must not take the weight from these.
    base = prose(77, 120).split()
    rows = [(i, " ".join([*base[: 5 + i], f"changed{i}", *base[6 + i :]])) for i in range(100)]
    rows += [(1000 + i, prose(3000 + i, 100)) for i in range(200)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(100)) and all(got[1000 + i] == 1000 + i for i in range(200))


def test_tables_between_steps_go(spark, monkeypatch):
    import os

    from framewright.llm import common as C

    monkeypatch.setattr(C, "_written", [])
    d = C.stored(spark.range(5), "passing")
    (path,) = C._written
    local = path.removeprefix("file://")
    assert d.count() == 5 and os.path.isdir(local)
    C.discard(spark)
    assert not os.path.exists(local) and C._written == []


def base_of(text):
    t = text or ""
    w = t.encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark, odd, empty):
    from framewright.llm.divergence import quality_rules

    rows = [*ODD, (9, "a b c d e f a b c d e g\na\na\n\n \n#x |<é"), (10, "x " * 50)]
    got = quality_rules(docs(spark, rows)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(base_of(r[1]) for r in rows)
    assert quality_rules(odd).count() == len(ODD) and quality_rules(empty).count() == 0


def test_divergence_keeps_prose_and_drops_symbols(spark):
    from framewright.llm.divergence import quality_rules

    rows = [(i, prose(i % 7, 60) + f" end{i}") for i in range(60)] + [(99, "@@@ === +++ ^^^ ~~~ ` " * 3 + prose(5, 1) + " ".join("=" * k for k in range(1, 30)))]
    kept = {r.doc_id: r.kept for r in quality_rules(docs(spark, rows)).collect()}
    assert all(kept[i] for i in range(60)) and not kept[99]


def test_divergence_has_references_of_rare_languages(spark):
    from framewright.llm.divergence import quality_rules

    # A language of under 1 % of all words in another script, beside one without a name.
    russian = "и в не на что дом лес река поле город утро вечер дорога ветер снег книга слово окно мост берег".split()
    random = np.random.default_rng(3)
    cyrillic = [(1000 + k, " ".join(russian[j] for j in random.integers(0, 20, 40)), "ru") for k in range(3)]
    latin = [prose(k, 1) + "abcdefghijklmnopqrst"[k] for k in range(20)]
    rows = [(k, " ".join(latin[j] for j in random.integers(0, 20, 60)), "en") for k in range(400)] + cyrillic + [(2000, cyrillic[0][1], None), (2001, "@ # = " * 30, "en")]
    table = docs(spark, rows).withColumn("lang", F.col("source"))
    got = {r.doc_id: r for r in quality_rules(table).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept and got[k].char_distance < 0.1 and got[k].word_distance < 0.3 for k in (1000, 1001, 1002, 2000))
    assert not got[2001].kept
    # The same distances as when the language is a large one.
    large = {r.doc_id: r for r in quality_rules(table.filter("lang is not null"), least_share=0.0).collect()}
    assert all(got[k].word_distance == pytest.approx(large[k].word_distance, abs=1e-6) and got[k].char_distance == pytest.approx(large[k].char_distance, abs=1e-6) for k in (1000, 1001, 1002))


def test_divergence_drops_texts_without_common_words(spark):
    from framewright.llm.divergence import quality_rules

    # 20 common words make up a quarter of the language; the others are rare.
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdefghij"), 8))
    text = lambda share: " ".join(f"w{'abcdefghijklmnopqrst'[random.integers(20)]}" if random.random() < share else word() for _ in range(120))
    rows = [(k, text(0.26)) for k in range(200)] + [(1000, text(0.0)), (1001, text(0.1))]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows)).collect()}
    assert not got[1000].base_failed and got[1000].char_distance < 0.25 and got[1000].word_distance < 0.5
    assert not got[1000].kept and got[1001].kept and all(got[k].kept for k in range(200))


def test_distances_by_brute_force(spark):
    import math
    import re

    from framewright.llm.divergence import quality_rules

    rows = [(i, (prose(i % 9, 45) + f" X{i}, 12. ÀÈ é!").capitalize(), "a" if i % 3 else "b") for i in range(60)] + [(90, "== " * 40, "a"), (91, "a b c", "b"), (92, None, "a")]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows).withColumn("lang", F.col("source")), least_share=0.0).collect()}
    kinds = [r"[a-zß-ÿ]", r"[A-ZÀ-Þ]", None, r"[0-9]", r"[ \t-\r]", r"[.,;:?'\"()-]"]

    def classes(text):
        n = [len(re.findall(k, text)) if k else sum(c.isalpha() and not re.match("[a-zA-ZÀ-ÿ]", c) for c in text) for k in kinds]
        return [*n, len(text) - sum(n)]

    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())

    def js(p, q):
        half = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) / 2
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, half(p, m) + half(q, m)))

    share = lambda n: [x / max(1, sum(n)) for x in n]
    refs, common = {}, set()
    for lang in "ab":
        count = collections.Counter(w for r in rows if r[2] == lang for w in letters(r[1]))
        total = sum(count.values())
        refs[lang] = (share([sum(x) for x in zip(*(classes(r[1] or "") for r in rows if r[2] == lang), strict=True)]), {w: n / total for w, n in count.items()})
        common |= {w for w, n in count.items() if n >= 0.005 * total}
    order = sorted(common)
    with_rest = lambda p: [*p, max(0.0, 1 - sum(p))]
    for i, text, _ in rows:
        n, own = len((text or "").split()), collections.Counter(letters(text))
        if n < 30:
            assert got[i].char_distance is None and got[i].word_distance is None and got[i].kept == (not got[i].base_failed)
            continue
        size = max(1, sum(own.values()))
        assert got[i].char_distance == pytest.approx(min(js(share(classes(text)), c) for c, _ in refs.values()), abs=1e-6)
        mine = with_rest([own[w] / size for w in order])
        assert got[i].word_distance == pytest.approx(min(js(mine, with_rest([w.get(x, 0.0) for x in order])) for _, w in refs.values()), abs=1e-6)


def targets(sizes):
    """By sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    out, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark, odd, empty):
    from framewright.llm.mixing import mix, mixed_documents

    rows = [(i, prose(i, 20 + i * 7 % 90), [None, "a", "b", "c", "d"][min(4, i % 9)]) for i in range(90)] + [(200, None, "a"), (201, "", "zz")]
    d = docs(spark, rows)
    got = mix(d).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(r[0], len((r[1] or "").split())) for r in rows]
    source = {r[0]: r[2] for r in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size
    want = targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(got) == sorted(mix(d.repartition(7)).collect())
    mixed = collections.Counter()
    for r in mixed_documents(d).collect():
        mixed[r.doc_id] += len(r.text.split())
    assert mixed == {r.doc_id: r.taken for r in got if r.taken}
    assert mix(odd).count() == len(ODD) and mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_shard_draws_are_multinomial(spark):
    import struct

    import xxhash

    from framewright.llm import mixing as M
    from framewright.llm.common import stored

    # Seven sources of very different sizes, 400 shards of 16 slots: each slot's source by brute force.
    sizes = {1: 90_000, 2: 200_000, 3: 64, 4: 7_001, 5: 40_000, 6: 1, 7: 60_000}
    sources = spark.createDataFrame([(None, s, n, 1, 1.0 * n) for s, n in sizes.items()], "source string, src long, source_size long, n_docs long, target double")
    slots = M.source_slots(sources)
    rows = sorted(slots.collect(), key=lambda r: r.src)
    assert [r.slots for r in rows] == [-(-n // 64) for n in sizes.values()] and [r.first for r in rows] == [sum(r.slots for r in rows[:i]) for i in range(7)]
    total = sum(r.slots for r in rows)
    draws = stored(M.shard_draws(slots, 16), "draws")
    got = {(r.shard, r.src): r.n for r in draws.collect()}
    want = collections.Counter()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for i in range(total):
        h = xxhash.xxh64_intdigest(struct.pack("<q", M.SEED), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        x = signed(h) % total
        want[i // 16, next(r.src for r in reversed(rows) if r.first <= x)] += 1
    assert got == want
    per = collections.Counter()
    for (shard, _), n in got.items():
        per[shard] += n
    assert len(per) == -(-total // 16) and all(n == 16 for k, n in per.items() if k < total // 16)
    # Counts of a source vary from shard to shard as binomial ones do.
    for r in rows:
        p = r.slots / total
        n = np.array([got.get((k, r.src), 0) for k in range(total // 16)])
        assert abs(n.mean() - 16 * p) < 5 * np.sqrt(16 * p * (1 - p) / len(n))
        if r.slots >= 100:  # a source of one slot is drawn too seldom to have a variance
            assert 0.7 < n.var() / (16 * p * (1 - p)) < 1.4
    # After the residual pass each slot of each source has one shard, and shards keep their sizes.
    placed = M.slots_of_shards(slots, draws).collect()
    assert sorted((r.src, r.k) for r in placed) == [(r.src, k) for r in rows for k in range(r.slots)]
    assert collections.Counter(r.shard for r in placed) == per


def test_mixing_repeated_rows_and_clashing_columns(spark):
    from framewright.llm.mixing import mix, mixed_documents

    # One row repeated until it is a third of the table; two ids with one text; a column for every helper's name.
    rows = [(1, prose(1, 100), "a")] * 30 + [(2, prose(1, 100), "a")] + [(i, prose(i, 30), "bc"[i % 2]) for i in range(3, 60)]
    d = docs(spark, rows).withColumns({c: F.lit(7) for c in ("size", "pass", "src", "bucket", "rn", "_h1", "_own_3", "shard", "from", "target", "_words", "_ranges")})
    out = mix(d).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows) and all(r.taken <= 2 * r.size for r in out)
    mixed = mixed_documents(d)
    assert mixed.columns == d.columns
    got, words = mixed.collect(), collections.Counter()
    assert all(r["size"] == 7 and r["_ranges"] == 7 and r.n_chars == len(r.text) for r in got)
    for r in got:
        words[r.doc_id] += len(r.text.split())
    want = collections.Counter()
    for r in out:
        want[r.doc_id] += r.taken
    assert words == +want
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed_documents(d.repartition(5)).collect()))


def test_permutation(spark):
    from framewright.llm.mixing import permute

    for n in (1, 2, 3, 5, 100, 1009):
        got = [r.p for r in permute(spark.range(n), "p", F.col("id"), F.lit(n), F.lit(3)).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


TRICKY = ["", " a", "a  b", "a\n\nb", "x.\nY, z", "don't it's", "a\t \tb", "é ́b", "<|endoftext|> q", "12.5, 3.", "a\x1cb", "\x01 b", "a\n \nb ", "wörter, ñandú."]


def test_encoders_equal_a_fresh_tokenizer():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from framewright.llm.encode import ChunkEncoder

    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, <|startoftext|>.", "a\n<|endoftext|> b <|endoftext|>\n", "x\n<|endoftext|>", "<|startoftext|>a"]
    texts = [*special, *TRICKY, "\n", "\n\n", "\n\n\n", "a\n", "..", ". ,", "é. É,\nÈ", "ªº µ İx ß × a×b", "日本 語, テ.", "ſ ǆ ẞ. Å Å", prose(4, 300), None]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        fresh = Tokenizer.from_file(path)
        ids, starts = ChunkEncoder(path, keeps).encode(pa.array(texts, pa.string()), 7)
        for t, i, j in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[i:j].tolist() == [*fresh.encode(t or "", add_special_tokens=False).ids, 7], t
        if keeps:
            assert fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
        assert ChunkEncoder(path, keeps).encode(pa.array([], pa.string()), 7)[1].tolist() == [0]


def test_encoder_batches_do_not_matter(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from framewright.llm import encode

    texts = pa.array([*TRICKY, *(prose(k, 200) for k in range(20)), "x" * 3000])
    whole = encode.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), True).encode(texts, 7)
    monkeypatch.setattr(encode, "BYTES", 500)
    monkeypatch.setattr(encode, "JOINED", 7)
    monkeypatch.setattr(encode, "MOST_WORDS", 300)
    cut = encode.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), True).encode(texts, 7)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_labelled_sample_is_bounded(spark):
    from framewright.llm.common import labelled_sample

    d = docs(spark, [(1, f"text {k}") for k in range(300)] + [(k, "x") for k in range(2, 40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    rows = labelled_sample(d, labels, "toxic", 5).collect()
    assert len(rows) == 10 and len({r.doc_id for r in rows}) == 10


def test_token_files(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from framewright.llm.common import new_path
    from framewright.llm.tokenfiles import lookup, token_files, write_orc

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, prose(i, i)) for i in range(30)]
    want, at = [], 0
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files(docs(spark, rows).repartition(3), path).collect())) == want
    assert token_files(odd, path).count() == len(ODD) and token_files(empty, path).count() == 0
    write_orc(docs(spark, rows), p := new_path(spark, "orc"), path)
    assert [len(r.ids) for r in lookup(spark, p, [3, 99]).collect()] == [want[3][2]]


def test_packing(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from framewright.llm.packing import pack, packed

    for sizes in ([], [1], [4096], [5000, 1, 7, 4095, 12_000], [3] * 3000):
        room, seen = collections.Counter(), collections.Counter()
        for d, start, n, s, offset in pack(sizes):
            assert offset == room[s] and n > 0 and start + n <= sizes[d]
            room[s] += n
            seen[d] += n
        assert [seen[i] for i in range(len(sizes))] == sizes
        assert all(n == 4096 or n & (n - 1) == 0 for n in room.values())
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, prose(i, 50 * i)) for i in range(25)]
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in rows}
    covered = collections.Counter()
    for r in packed(docs(spark, rows), path, group=20_000).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert packed(odd, path).groupBy("doc_id").count().count() == 7 and packed(empty, path).count() == 0


def test_media(spark, odd, empty):
    from framewright.llm.media import encoded, mpeg_read, mpeg_stored, payload_of, probed

    for text in (None, "", "a" * 64, prose(3, 900), "é" * 33):
        n, p = payload_of(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and p[:n] == (text or "").encode()
        media = mpeg_stored(p)
        r = mpeg_read(media)
        assert r["payload"] == p and r["bad_checksums"] == 0 and r["skipped"] == 0 and r["table_ok"]
        assert r["samples"] == 1152 * r["frames"] and len(r["seek"]) == r["frames"]
    hurt = bytearray(media)
    hurt[-20] ^= 1
    assert mpeg_read(bytes(hurt))["payload"] is None
    more = mpeg_read(b"junk\xff" + mpeg_stored(payload_of(prose(1, 900))[1])[70:])
    assert more["skipped"] > 0 and more["frames"] > 0
    assert probed(encoded(odd)).count() == len(ODD) and probed(encoded(empty)).count() == 0


def test_toxicity(spark, odd, empty):
    from framewright.llm.toxicity import learn, not_toxic, toxicity

    rows = [(i, prose(i, 40) + (" nastyword here" if i % 3 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs(spark, rows), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.doc_id % 3 == 0) for r in got)
    assert sorted(r.doc_id for r in not_toxic(docs(spark, rows), labels).collect()) == [i for i in range(240) if i % 3]
    assert toxicity(odd, labels).count() == len(ODD) and toxicity(empty, labels).count() == 0
    assert toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert set(not_toxic(odd, labels).columns) == set(odd.columns)
    # Groups that toxic texts name more often than others do: neutral mentions of them are called toxic less often when
    # a swap that changes the score is penalised. Half of the toxic texts have no other sign.
    import pyarrow as pa

    from framewright.llm.toxicity import scores

    group = lambda i: ["muslims", "juifs", "ausländer", "gitanos"][i % 4]
    train = [(f"{prose(i, 12)} {group(i)} {'nastyword' if i % 2 else ''}", 1, 300) for i in range(300)]
    train += [(f"{prose(i, 12)} {'christians chrétiens einheimische blancos'.split()[i % 4] if i % 3 else group(i)}", 0, 300) for i in range(300, 600)]
    neutral = pa.array([f"{prose(i, 12)} {group(i)}" for i in range(1000, 1200)])
    toxic = pa.array([f"{prose(i, 12)} nastyword" for i in range(2000, 2200)])
    rates = {pull: [(scores(t, *learn(train, pull=pull)) >= 0.5).mean() for t in (neutral, toxic)] for pull in (0.0, 20.0)}
    assert rates[0.0][0] > 0.3 and rates[20.0][0] < rates[0.0][0] / 2 and rates[20.0][1] > 0.9, rates  # 0.38 and 0.14
    # A group's name that only toxic texts have weighs less when its swap is penalised.
    named = [(prose(i, 20) + " muslim" + " nastyword" * (i % 2), 1, 50) for i in range(50)] + [(prose(i, 20), 0, 50) for i in range(50, 100)]
    free, held = (learn(named, pull=p)[0] for p in (0.0, 20.0))
    assert abs(held.get("=muslim", 0.0)) < abs(free.get("=muslim", 0.0))


def test_quality(spark, odd, empty):
    from framewright.llm.rules import compiled, good, holds, learn, quality, statistics, STATISTICS
    from framewright.llm.logistic import sigmoid

    rows = [(i, "WORDS!! " * 40 if i % 4 == 0 else prose(i, 50)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in quality(docs(spark, rows), labels).collect())
    assert sorted(r.doc_id for r in good(docs(spark, rows), labels).collect()) == [i for i in range(300) if i % 4]
    assert quality(odd, labels).count() == len(ODD) and quality(empty, labels).count() == 0
    assert good(odd, labels.limit(0)).count() == len(ODD) and set(good(odd, labels).columns) == set(odd.columns)
    x = np.random.default_rng(1).random((200, len(STATISTICS)))
    rules, bias = learn(x, (x[:, 2] > 0.5).astype(float), np.ones(200))
    z = bias + sum(w * holds(r, x) for r, w in rules)
    got = [r.s for r in spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in STATISTICS)).select(compiled(rules, bias).alias("s")).collect()]
    assert np.allclose(sorted(got), sorted(sigmoid(z))) and ((z > 0) == (x[:, 2] > 0.5)).mean() > 0.95
    assert statistics(empty).count() == 0


def test_most_frequent_words(spark):
    from framewright.llm.bilinear import most_frequent

    rows = [(f"w{i}", 1 + 2000 // (i + 1)) for i in range(300)] + [(" ", 10_000)]
    counts = spark.createDataFrame(rows, "word string, c long")
    assert most_frequent(counts, 1000).num_rows == 300
    some = most_frequent(counts, 60).to_pylist()
    order = sorted(rows[:300], key=lambda r: (-r[1], r[0]))
    assert 40 <= len(some) <= 60 and [(r["word"], r["c"]) for r in some] == order[: len(some)]
    assert most_frequent(counts, 0).num_rows == 0 and most_frequent(counts.limit(0), 5).num_rows == 0


def test_language_model(spark, odd, empty, monkeypatch):
    import math

    from framewright.llm.bilinear import END, lm_scores

    rows = [(i, "The cat sat on the mat " * (i % 4) + prose(i % 11, 10)) for i in range(80)]
    got = {r.doc_id: r for r in lm_scores(docs(spark, rows)).collect()}
    counts = collections.Counter()
    tok = {i: [w.decode() for w in t.encode().lower().split()] + [END] for i, t in rows}
    for i, t in tok.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in counts for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    # The scores by brute force, one token at a time: the unit's probability, and a word's share of its class.
    import pyarrow as pa

    from framewright.llm import bilinear as M

    seen = {}
    monkeypatch.setattr(M, "refined", lambda *a, f=M.refined: seen.setdefault("p", f(*a)))
    monkeypatch.setattr(M, "units_for", lambda _: 280)  # 24 words and the classes
    got = {r.doc_id: r for r in lm_scores(docs(spark, rows)).collect()}
    p = {k: x.astype(float) for k, x in seen["p"].items()}
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w != END][:24]
    raw = lambda w: w.encode()
    unit_of = lambda w: 0 if w == END else words.index(w) + 1 if w in words else 25 + (raw(w)[-1] * 131 + (raw(w)[-2] if len(raw(w)) > 1 else 0) * 31) % 255
    mass = collections.Counter()
    for w, n in counts.items():
        mass[unit_of(w)] += n + 0.1
    for i, t in tok.items():
        u, want = [0, 0, *map(unit_of, t)], 0.0
        for k, w in enumerate(t):
            s = (p["r"][u[k + 1]] @ p["c1"] + p["r"][u[k]] @ p["c2"]) @ p["t"].T + p["b"]
            want += (s[u[k + 2]] - np.log(np.exp(s).sum())) / np.log(10)
            if u[k + 2] >= 25:
                want += math.log10((counts[w] + 0.1) / (mass[u[k + 2]] + 0.1))
        assert got[i].score == pytest.approx(want, rel=1e-4)
    monkeypatch.undo()
    assert lm_scores(odd).count() == len(ODD) and lm_scores(empty).count() == 0


def test_statistics_by_brute_force(spark):
    import re

    from framewright.llm.rules import STATISTICS, statistics

    rows = [*ODD, (9, "One two, two! THREE| 4 5; é: two\none two\none two\n\nx x x x x x x x ? . ,"), (10, prose(5, 60).upper()), (11, "|" * 9)]
    got = sorted(tuple(round(r[s], 9) for s in STATISTICS) for r in statistics(docs(spark, rows)).collect())
    want = []
    for _, text in rows:
        t = text or ""
        n, word_chars, symbols, lines, repeated = base_of(text)
        w = t.encode().split()
        words, size = max(1, n), max(1, len(t))
        count = lambda c: len(re.findall(f"[{c}]", t))  # noqa: E731, B023
        x = [n, word_chars / words, symbols / size, count("!?") / size, count("|") / words, count("A-ZÀ-Þ") / size, count("0-9") / size, count(".,;:") / size]
        x += [lines / words, repeated / words, len(set(w)) / words, sum(a == b for a, b in zip(w, w[1:], strict=False)) / words, n / (t.count("\n") + 1)]
        want.append(tuple(round(float(v), 9) for v in x))
    assert got == sorted(want)


def test_log_bilinear_model():
    from framewright.llm import bilinear as M

    # A language of 40 units in which the second last decides: only a context of two can tell.
    random = np.random.default_rng(4)
    unit = random.integers(1, 40, 60_000)
    for k in range(2, len(unit)):
        if k % 3:
            unit[k] = (unit[k - 2] * 7) % 39 + 1
    n = np.zeros((40, 40), np.float32)
    last, before = M.contexts(unit)
    np.add.at(n, (last, unit), 1)
    p = M.start(n)
    trainer = M.Trainer(p, 0)
    for _ in range(6):
        trainer.over(unit)
    found = {name: M.Scorer(q).of(unit) for name, q in (("pairs", p), ("both", p | trainer.p))}
    assert found["both"].mean() > found["pairs"].mean() + 0.1
    # Normalised: over all units of a context, by brute force.
    q = p | trainer.p
    for a, b in ((0, 0), (3, 9), (39, 1)):
        s = (q["r"][a] @ q["c1"] + q["r"][b] @ q["c2"]) @ q["t"].T + q["b"]
        want = (s - np.log(np.exp(s.astype(float)).sum())) / np.log(10)
        got = [M.Scorer(q).of(np.array([b, a, u]))[2] for u in range(40)] if a else [M.Scorer(q).of(np.array([u]))[0] for u in range(40)]
        assert np.allclose(got, want, atol=1e-4) and np.isclose((10.0 ** np.array(got)).sum(), 1, atol=1e-4)
    wide = {k: v.astype(np.float32) * (40 if k in ("r", "t") else 1) for k, v in q.items()}  # scores far apart
    assert np.isclose((10.0 ** np.array([M.Scorer(wide).of(np.array([3, 9, u]))[2] for u in range(40)])).sum(), 1, atol=1e-3)
    assert M.contexts(np.array([5, 6, 0, 7, 8]))[1].tolist() == [0, 0, 5, 0, 0] and M.units_for(10) == 512 and M.units_for(10**12) == M.MOST_UNITS


def test_main_text(spark):
    from framewright.llm.maintext import extract, main_text, min_cut

    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies on this site to do all manner of things</div><article><h1>Title &amp; more</h1><p>First  paragraph\nhere<br>now.<p><b>Second</b> one &lt;3.</p><section class=comments><p>Nice article, I did like it very much</p></section></article><aside>Other things to read</aside><form>Your name please</form><footer>&copy; us</footer></body>"
    assert extract(page) == "Title & more\nFirst paragraph here now.\nSecond one <3."
    df = spark.createDataFrame([(1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<p unfinished"), (4, "u", "<div><p>" + "word " * 50)], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in main_text(df).collect()} == {1: 53, None: 0, 2: 0, 3: 0, 4: 249}
    assert main_text(df.limit(0)).count() == 0
    r = np.random.default_rng(2)
    for _ in range(30):
        n = int(r.integers(1, 8))
        odds = r.normal(0, 1, n).tolist()
        edges = [(int(a), int(b), float(r.random())) for a, b in r.integers(0, n, (6, 2)) if a != b]
        cost = lambda side: sum(max(0, z) if not s else max(0, -z) for z, s in zip(odds, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(min_cut(odds, edges)) == pytest.approx(best)


def test_main_text_by_the_cut():
    from framewright.llm import maintext as M

    # Markup says nothing here: the classifier judges, fitted on pages whose markup does.
    long_ = lambda k: (prose(k, 45) + ", " + prose(k + 50, 20) + ".").capitalize()
    links = "".join(f"<li><a href=/{k}>{prose(k, 2)}</a></li>" for k in range(8))
    pages = [f"<nav><ul>{links}</ul></nav><article><h1>{prose(k, 5)}</h1><p>{long_(k)}</p><p>{long_(k + 9)}</p></article><footer>{prose(k, 4)} <a href=x>us</a></footer>" for k in range(40)]
    weights = M.fitted(pages)
    texts = [long_(300), "Really so?", long_(301), long_(302), "Perhaps.", long_(303)]
    page = f"<div><ul>{links}</ul></div><div>{''.join(f'<p>{t}</p>' for t in texts)}</div><div><ul>{links}</ul></div>"
    blocks = M.blocks_of(page)
    odds = M.log_odds(blocks, weights)
    assert all(abs(z) <= M.TEXT for z in odds) and M.extract(page, weights) == "\n".join(texts)
    # Without the edges, a block of unsure odds falls out; with them it stays with its neighbours.
    unsure = [2.0, -0.9, 2.0, -2.0]
    assert M.min_cut(unsure, []) == [True, False, True, False]
    edges = [(0, 1, M.NEXT), (0, 1, M.SIBLING), (1, 2, M.NEXT), (1, 2, M.SIBLING), (2, 3, M.NEXT)]
    assert M.min_cut(unsure, edges) == [True, True, True, False]
    plain = "<div>" + "".join(f"<div>{t}</div>" for t in texts) + "</div>"
    alone = "\n".join(b.text for b, z in zip(M.blocks_of(plain), M.log_odds(M.blocks_of(plain), M.STATED), strict=True) if z > 0)
    assert "Really so?" not in alone and M.extract(plain) == "\n".join(texts)  # by the stated weights, where nothing can be learnt
    assert (M.fitted([]) == M.STATED).all() and (M.fitted(["<p>a</p>"]) == M.STATED).all()


def test_main_text_of_broken_long_and_deep_pages():
    import time

    from framewright.llm.maintext import extract

    tail = "<article><p>" + "word " * 40 + "</p></article>"
    want = ("word " * 40).strip()
    for tag in ("svg", "math", "object", "canvas", "audio", "video", "select", "button"):
        assert extract(f"<{tag}>" + tail).endswith(want), tag
        assert extract(f"<{tag}>hidden</{tag}>" + tail) == want, tag
    assert extract("<script>" + tail) == "" and extract("<p>a</p><script>var x = '<p>b</p>';</script>" + tail).endswith(want)
    t = time.time()
    deep = "<div>" * 20_000 + tail + "</section>" * 20_000
    assert extract(deep) == want
    assert extract("<article>" + "<p>" + "word " * 30 + "</p>" * 1 + ("<p>" + "word " * 30 + "</p>") * 5_000 + "</article>").count("\n") == 5_000
    assert time.time() - t < 30


def brute_classes(rows):
    from framewright.llm import neardup as N

    import pyarrow as pa

    sh = [N.shingles(t) for _, t in rows]
    # Distinct least shingles by cell, counted by brute force, must be what the sketch tells of them, as it rounds.
    seen = collections.defaultdict(set)
    for h, _ in sh:
        for c in (h & np.uint64(N.CELLS - 1)).tolist():
            seen[c].add(int(h[0]))
    table, every = np.zeros((N.CELLS, N.WORDS), np.uint32), np.zeros(N.WORDS, np.uint32)
    N.sketched(pa.array([t for _, t in rows], pa.string()), table, every)
    df = N.distinct_of(table)
    for c, x in seen.items():
        assert 0.4 * len(x) <= df[c] <= 2 * len(x) + 0.5
    idf = N.idf_of(float(N.distinct_of(every[None])[0]), df)
    v = [(h, N.weights(n, h, idf).astype(float)) for h, n in sh]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(v[i][0]) and len(v[j][0]) and (rows[i][1] == rows[j][1] or N.similarity(v[i], v[j]) >= 0.8):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}


def near_rows():
    r = np.random.default_rng(9)
    rows = []
    for g in range(12):
        base = prose(100 + g, 120).split()
        for _ in range(1 + 5 * (g % 3)):
            t = list(base)
            for k in r.integers(0, len(t), int(r.integers(0, 4))):
                t[k] = "changed" + str(int(r.integers(0, 1000)))
            rows.append((len(rows), " ".join(t)))
    return rows + [(500, rows[3][1]), (501, "short text"), (502, "short text"), (503, "Short text here")]


def test_near_duplicates(spark, odd, empty):
    from framewright.llm.neardup import near_duplicates, one_of_each

    rows = near_rows()
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == want
    assert sorted(r.doc_id for r in one_of_each(docs(spark, rows)).collect()) == sorted(set(want.values()))
    out = near_duplicates(odd).collect()
    assert len(out) == len(ODD) and sorted(r.class_size for r in out) == [1] * 6 + [2] * 2
    assert one_of_each(odd).count() == len(ODD) - 1 and set(one_of_each(odd).columns) == set(odd.columns)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_pipeline_over_odd_rows(spark, tmp_path, odd, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for d in (spark.read.parquet(str(tmp_path / "documents.parquet")), empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            path = str(tmp_path / f"out{k}{len(d.columns)}")
            out.write.parquet(path)
            if k < 4:
                assert out.columns == d.columns
            d = spark.read.schema(out.schema).parquet(path)


def test_pipeline_stages(spark, tmp_path, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(i % 60, 50) + (" nastyword here" if i % 6 == 0 else "") + f" end{i % 60}") for i in range(200)] + [(300 + i, "WORDS!! " * 40 + prose(i, 2)) for i in range(40)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), int(i < 200 and i % 6 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id for r in d.select("doc_id").collect()})
        if k < 4:
            assert d.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    clean = {i for i, _ in rows if i >= 300 or i % 6}
    assert seen[0] == clean and seen[1] == {i for i in clean if i < 300} and len(seen[2]) == len({i % 60 for i in seen[1]})
    assert seen[3] <= seen[2] and seen[4] == seen[3]
