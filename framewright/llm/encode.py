"""Whole-text encoding with a public tokenizer, fast on text whose words recur.

A tokenizer of these two kinds never joins characters across a single space between words, so a text is the sum of its
space-separated chunks. Arrow splits a batch of texts and numbers its distinct chunks, the tokenizers library encodes
each of those once, and numpy puts the ids of all chunks in their places. Texts with other runs of white space go
through the library whole. A word of Latin letters is one pretoken of either tokenizer, so such words go to the
tokenizer's own model, many in one call, without the search for pretokens; a worker remembers some of them, as arrays.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are encoded together, and the most bytes of them (a longer text comes alone). Bounds memory.
ROWS, BYTES = 20_000, 1 << 22
#: Words that are encoded by one call of the library, and that a worker remembers, in some 30 bytes each, before it
#: starts afresh with those of a batch; neither has an effect on results.
JOINED, MOST_WORDS = 16_384, 300_000
#: What stands before the first chunk of a text, before that of a later line, and for the end of a text. No other
#: chunk holds a line's end but at its start.
FIRST, LINE, LAST = "\n\n", "\n", "\n\n\n"
#: A chunk of letters that normalisation leaves as they are, whatever the version of Unicode, and a mark that either
#: tokenizer splits from a letter before it.
PLAIN = r"^(?P<start>\n*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?)$"


def _byte_alphabet() -> dict[int, str]:
    """The byte-level tokenizers' letter for each byte: printable ones stand for themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] numbers in all, then those from starts[1], and so on."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(len(ends) and int(ends[-1]))


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


class ChunkEncoder:
    """Encodes texts to their ids.

    keeps_space: the tokenizer keeps white space, and " word" is encoded apart from "word" (byte-level BPE).
    Otherwise white space only separates, and letters are made small (word-level BPE).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.keeps_space = keeps_space
        alphabet = _byte_alphabet()
        self.space = alphabet[ord(" ")] if keeps_space else ""
        self.between = alphabet[ord("\n")]
        self.as_bytes = {ord(bytes([b]).decode("latin-1")): c for b, c in alphabet.items()}
        # Where the ids of a word begin (byte-level, after a space) or end (word-level).
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[k for t, k in vocabulary.items() if (t[0] == self.space if keeps_space else t.endswith("</w>"))]] = True
        self.known = {led: (pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.uint32)) for led in (False, True)}
        self.marks = {m: int(self._whole([m])[0][0]) for m in ".,"}
        self.line = int(self._whole(["\n"])[0][0]) if keeps_space else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: pa.Array, led: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by word) of words of letters, by the tokenizer's model alone. led: a space goes before each."""
        ids, sizes = [], []
        lead = self.space if led else ""
        told_apart = led or not self.keeps_space
        between = f" {lead}" if told_apart else f" {self.between} "
        for at in range(0, len(words), JOINED):
            part = words.slice(at, JOINED)
            joined = lead + between.join(x if x.isascii() else x.encode().decode("latin-1").translate(self.as_bytes) for x in part.to_pylist())
            x = np.asarray(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            if not told_apart:
                edge = x == self.line
                at_edges = np.concatenate([[-1], np.flatnonzero(edge), [len(x)]])
                ids.append(x[~edge])
                sizes.append(np.diff(at_edges) - 1)
            else:
                at_edges = np.flatnonzero(self.edge[x])
                ids.append(x)
                sizes.append(np.diff(at_edges, append=len(x)) if self.keeps_space else np.diff(at_edges, prepend=-1))
            if len(sizes[-1]) != len(part):
                raise ValueError("words of letters do not keep apart in this tokenizer")
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64)

    def _words(self, words: pa.Array, led: bool) -> tuple[np.ndarray, np.ndarray]:
        """_encoded() of distinct words, those of earlier batches from memory."""
        seen, sizes, ids = self.known[led]
        found = pc.index_in(words, seen)
        missing = np.asarray(found.is_null())
        new = words.filter(pa.array(missing))
        new_ids, new_sizes = self._encoded(new, led)
        sizes, ids = np.concatenate([sizes, new_sizes]), np.concatenate([ids, new_ids])
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        at[missing] = len(seen) + np.arange(len(new))
        n = sizes[at]
        own = ids[_ragged((np.cumsum(sizes) - sizes)[at], n)]
        total = len(seen) + len(new)
        self.known[led] = (pa.concat_arrays([seen, new]), sizes, ids) if total <= MOST_WORDS else (words, n, own)
        return own, n

    def _chunks(self, chunks: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by chunk) of distinct chunks; the number is -1 for one that makes its text irregular."""
        found = pc.extract_regex(chunks, PLAIN)
        plain = np.asarray(found.is_valid())
        at = np.flatnonzero(plain)
        start, word, mark = (found.take(pa.array(at)).field(k) for k in range(3))
        if not self.keeps_space:
            word = pc.utf8_lower(word)
        size = np.zeros(len(chunks), np.int64)
        word_at, word_size, pool, held = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [], 0
        led = np.asarray(pc.equal(start, "")) if self.keeps_space else np.ones(len(at), bool)
        for which, lead in ((led, True), (~led, False)):
            coded = word.filter(pa.array(which)).dictionary_encode()
            ids, n = self._words(coded.dictionary, lead)
            k = coded.indices.to_numpy()
            word_at[at[which]], word_size[at[which]] = held + (np.cumsum(n) - n)[k], n[k]
            pool.append(ids)
            held += len(ids)
        before, after = np.zeros(len(chunks), bool), np.zeros(len(chunks), np.uint32)
        if self.keeps_space:
            before[at] = np.asarray(pc.equal(start, LINE))
        after[at] = sum(np.where(np.asarray(pc.equal(mark, m)), np.uint32(i + 1), np.uint32(0)) for m, i in self.marks.items())
        # The others: with the line's end that stands before them, if the tokenizer keeps it.
        odd, asked, names = [], [], []
        rest = np.flatnonzero(~plain)
        for k, c in zip(rest.tolist(), chunks.take(pa.array(rest)).to_pylist(), strict=True):
            name = c.lstrip("\n")
            first = c[: len(c) - len(name)]
            if c == LAST:
                word_at[k], word_size[k] = held, 1
                pool.append(np.array([end], np.uint32))
                held += 1
            elif name and not any(map(str.isspace, name)):
                before[k] = self.keeps_space and first == LINE
                asked.append(k)
                names.append(name if first or not self.keeps_space else " " + name)
            elif c != FIRST:
                odd.append(k)
        for k, ids in zip(asked, self._whole(names), strict=True):
            word_at[k], word_size[k] = held, len(ids)
            pool.append(ids)
            held += len(ids)
        size = before + word_size + (after > 0)
        ends = np.cumsum(size)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        ids[_ragged(ends - size + before, word_size)] = np.concatenate(pool)[_ragged(word_at, word_size)]
        ids[(ends - size)[before]] = self.line or 0
        ids[ends[after > 0] - 1] = after[after > 0] - 1
        size[odd] = -1
        return ids, size

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of all texts, each followed by `end`, and where each text's begin, with the total last.
        A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy())
        ids, sizes, at = [np.empty(0, np.uint32)], [], 0
        while at < len(texts):
            before = int(upto[at - 1]) if at else 0
            n = min(ROWS, max(1, int(np.searchsorted(upto, before + BYTES, "right")) - at))
            x, each = self._batch(texts.slice(at, n), end)
            ids.append(x)
            sizes.append(each)
            at += n
        return np.concatenate(ids), np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)

    def _batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.binary_join_element_wise(_text(FIRST), pc.replace_substring(texts, "\n", " \n"), _text(" " + LAST), _text(""))
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        flat, size = self._chunks(coded.dictionary, end)
        each = np.maximum(size, 0)
        chunk, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        n = each[chunk]
        ids = flat[_ragged((np.cumsum(each) - each)[chunk], n)]
        upto = np.concatenate([[0], np.cumsum(n)])[bounds]
        sizes = np.diff(upto)
        if (size < 0).any():
            rows = np.unique(np.searchsorted(bounds, np.flatnonzero(size[chunk] < 0), "right") - 1)
            pieces, done = [], 0
            for k, x in zip(rows.tolist(), self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
                pieces += [ids[done : upto[k]], x, np.array([end], np.uint32)]
                done, sizes[k] = upto[k + 1], len(x) + 1
            ids = np.concatenate([*pieces, ids[done:]])
        return ids, sizes


@functools.cache
def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One for each worker process."""
    return ChunkEncoder(path, keeps_space)
