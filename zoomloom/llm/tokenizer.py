"""Byte-pair encoding of whole corpora: batched numpy merge rounds over the distinct words of a batch.

Plan
1. Texts of a batch become one array of code points. A table of character classes gives the word boundaries of
   the public pattern ('s|'t|... | ?letters| ?numbers| ?others|blanks) in array operations.
2. Words not seen before by this worker are encoded together: their symbols lie in one flat array; each round looks up all
   neighbouring pairs by binary search over sorted pair keys, finds the lowest rank of every word and merges it
   everywhere, until no word has a known pair left. Words of more than LONG bytes would need very many rounds and are merged by a heap.
3. Ids of a text are gathered from its words' ids. Nothing is shuffled; the vocabulary file is read on each node from a path
   that is a parameter.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoomloom.operators.balance import expand_ranges
from zoomloom.session import check_names, widen

FOLDER = "/opt/tokenizers"
CHUNK = 1_000_000  # characters worked on at once
LONG = 8_192  # bytes of a word that is merged by itself
WORDS = 400_000  # distinct words kept by a worker
_SHIFT = 20
_NONE = np.int64(2**62)
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def word_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which the words of the public pattern start, in concatenated texts whose non-empty texts start at doc_starts."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = character_classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = cls == BLANK
    space = cp == 32
    start = run.copy()
    # a blank at the end of a run that a word follows stands alone, or, if it is a space, opens that word
    ends = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:n])
    start[ends] = True
    start[ends[space[ends]] + 1] = False
    # contractions: an apostrophe that starts a word takes the letters that follow
    q = np.flatnonzero((cp == 39) & start)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    one = np.isin(cp[q + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(q), dtype=bool)
    long = q + 2 < n
    ok = np.flatnonzero(long & ~one)
    ok = ok[~first[q[ok] + 2]]
    pair = cp[q[ok] + 1].astype(np.int64) << 32 | cp[q[ok] + 2]
    two[ok] = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    for hit, size in ((one, 2), (two, 3)):
        at = q[hit]
        start[at + 1] = False
        after = at + size
        after = after[after < n]
        start[after[cls[after] == LETTER]] = True
    return np.flatnonzero(start)


class BytePairs:
    """A byte-level BPE vocabulary given as ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << _SHIFT | b)
                    values.append(rank)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], values[order]

    @functools.cached_property
    def lettered(self) -> np.ndarray:
        """Of each id, whether its bytes hold a letter or only part of a character."""
        out = np.zeros(max(self.bytes_of, default=0) + 1, dtype=bool)
        for i, t in self.bytes_of.items():
            out[i] = any(c.isalpha() or c == "\ufffd" for c in t.decode("utf-8", "replace"))
        return out

    @functools.cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one very long word: pairs wait in a heap by rank and place, so the work does not grow with rounds times length."""
        sym = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        size, table = len(sym), self.table
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of = lambda i: table.get(sym[i] << _SHIFT | sym[after[i]]) if sym[i] >= 0 and after[i] < size else None
        heap = [(r, i) for i in range(size - 1) if (r := rank_of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if rank_of(i) != rank:
                continue  # one of the two is part of another symbol by now
            j = after[i]
            sym[i], sym[j], after[i] = rank, -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_of(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [s for s in sym if s >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the words, flat and in order."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            own = {i: np.array(self.merge_one(words[i]), dtype=np.int64) for i in long}
            ids, sizes = self.merge([w for i, w in enumerate(words) if i not in own])
            every, ends = np.zeros(len(words), dtype=np.int64), np.cumsum(sizes)
            short = np.array([i for i in range(len(words)) if i not in own], dtype=np.int64)
            every[short] = sizes
            every[long] = [len(own[i]) for i in long]
            parts = dict(zip(short.tolist(), np.split(ids, ends[:-1]) if len(ends) else []))
            return np.concatenate([own[i] if i in own else parts[i] for i in range(len(words))]), every
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            pair = sym[:-1] << _SHIFT | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(sym), _NONE)
            rank[:-1] = np.where((self.keys[at] == pair) & (word[1:] == word[:-1]), self.ranks[at], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff([*starts, len(sym)]))
            live = each < _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            hit = np.flatnonzero(live & (rank == each))
            if not len(hit):
                break
            # overlapping hits (aaa): every second one of a chain, from its left end
            chain = np.concatenate([[True], np.diff(hit) != 1])
            begin = hit[chain][np.cumsum(chain) - 1]
            hit = hit[(hit - begin) % 2 == 0]
            sym = sym.copy()
            sym[hit] = rank[hit]
            live[hit + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


class Encoder:
    """Texts to ids by one or more vocabularies that share the word pattern. Keeps words seen, within bounds."""

    def __init__(self, *names: str, folder: str = FOLDER):
        self.models = [load_vocabulary(os.path.join(folder, f"{n}.tiktoken")) for n in names]
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.flat = [np.zeros(0, dtype=np.int32) for _ in self.models]
        self.size = [np.zeros(0, dtype=np.int64) for _ in self.models]
        self.offset = [np.zeros(0, dtype=np.int64) for _ in self.models]
        self.letters = [np.zeros(0, dtype=np.int64) for _ in self.models]  # of each word, its ids with letters

    def _learn(self, words) -> None:
        if len(self.index) > WORDS:
            self._forget()
        new = [w for w in words if w not in self.index]
        if not new:
            return
        for w in new:
            self.index[w] = len(self.index)
        raw = [w.encode() for w in new]
        for m, model in enumerate(self.models):
            ids, sizes = model.merge(raw)
            self.offset[m] = np.concatenate([self.offset[m], len(self.flat[m]) + np.cumsum(sizes) - sizes])
            self.flat[m] = np.concatenate([self.flat[m], ids.astype(np.int32)])
            self.size[m] = np.concatenate([self.size[m], sizes])
            upto = np.concatenate([[0], np.cumsum(model.lettered[ids])])
            ends = np.cumsum(sizes)
            self.letters[m] = np.concatenate([self.letters[m], upto[ends] - upto[ends - sizes]])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, first word of each text and the end) of the texts."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        starts = word_starts(cp, (ends - lengths)[lengths > 0])
        stops = [*starts[1:].tolist(), len(cp)] if len(starts) else []
        words = [whole[a:b] for a, b in zip(starts.tolist(), stops)]
        distinct = set(words)
        self._learn(distinct)
        found = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return found, np.concatenate([[0], np.searchsorted(starts, ends, "left")])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets by text) by the first vocabulary."""
        found, edge = self.words(texts)
        begin, size = self.offset[0][found], self.size[0][found]
        _, at = expand_ranges(begin, begin + size)
        return self.flat[0][at], np.concatenate([[0], np.cumsum(size)])[edge]

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """Number of ids of each text, by each vocabulary, and then of those with letters, by each vocabulary."""
        found, edge = self.words(texts)
        return [np.diff(np.concatenate([[0], np.cumsum(s[found])])[edge]) for s in [*self.size, *self.letters]]


@functools.cache
def load_vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


@functools.cache
def _encoder(names: tuple[str, ...], folder: str) -> Encoder:
    return Encoder(*names, folder=folder)


def _chunks(texts: list[str | None]):
    """Slices (lo, hi) of about CHUNK characters; a text is never cut."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_corpus(df: DataFrame, ident: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(ident, ids): the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list. Special-token strings in a text are ordinary text. Every row comes out once, with its
    own id, also where ids repeat or are null; other columns are ignored. Texts of any length are encoded whole.
    """
    out = [ident, "ids"]
    check_names(*out)

    def run(batches):
        enc = _encoder((vocabulary,), folder)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in _chunks(texts.to_pylist()) if b.num_rows else ():
                flat, offsets = enc.encode([t or "" for t in texts[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], names=out)

    kind = df.schema[ident].dataType.simpleString()
    return widen(df.select(F.col(ident), F.col(text).cast("string"))).mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, ident: str, text: str, vocabularies: list[str], folder: str = FOLDER) -> DataFrame:
    """(ident, n_<vocabulary>..., letters_<vocabulary>...): the number of ids of each row's text by each vocabulary, and of those that
    hold a letter (or part of a character) rather than blanks, digits or punctuation alone; 0 for null and empty texts."""
    out = [ident, *[f"{what}_{v}" for what in ("n", "letters") for v in vocabularies]]
    check_names(*out)

    def run(batches):
        enc = _encoder(tuple(vocabularies), folder)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in _chunks(texts.to_pylist()) if b.num_rows else ():
                counts = enc.counts([t or "" for t in texts[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *[pa.array(c.astype(np.int64)) for c in counts]], names=out)

    kind = df.schema[ident].dataType.simpleString()
    return widen(df.select(F.col(ident), F.col(text).cast("string"))).mapInArrow(run, f"`{ident}` {kind}, " + ", ".join(f"`{c}` long" for c in out[1:]))
