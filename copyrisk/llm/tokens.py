"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import xxhash

from .shingles import mix

#: Words that a Python worker remembers; the table starts anew beyond that.
REMEMBERED = 500_000
#: Words encoded at a time, bytes hashed at a time, and bytes of a word that has a polynomial for a hash.
LEARNED, BLOCK, LONGEST = 20_000, 1 << 18, 64

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Letters with at most one sign after them, which is a pre-token of its own.
_PLAIN = re.compile(rb"([a-z\x80-\xff]+)([.,;:!?]?)")
NEVER = 1 << 30


class Table:
    """Numbers by 64-bit keys other than 0, many at a time: open addressing in two arrays."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it would stand."""
        last = np.uint64(len(self.keys) - 1)
        slot = (mix(keys) & last).astype(np.int64)
        off = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0))
        while len(off):
            slot[off] = slot[off] + 1 & int(last)
            held = self.keys[slot[off]]
            off = off[(held != keys[off]) & (held != 0)]
        return slot

    def get(self, keys: np.ndarray, absent: int) -> np.ndarray:
        slot = self._find(keys)
        return np.where(self.keys[slot] == keys, self.values[slot], absent)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't held yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys != 0
            held = self.keys[old], self.values[old]
            self.__init__((2 * (self.used + len(keys))).bit_length())
            self.put(*held)
        self.used += len(keys)
        while len(keys):
            slot = self._find(keys)
            self.keys[slot], self.values[slot] = keys, values  # of those for one slot, the last stays
            rest = self.keys[slot] != keys
            keys, values = keys[rest], values[rest]


class LetterMerges:
    """Byte-pair merges of many lower-case words at once, for a vocabulary with marked word ends.

    In each round every word joins the leftmost pair of its least rank, as the tokenizer does.
    """

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in printable}
        signs |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in signs)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)])
        self.last = np.array([vocab[signs[b] + end] for b in range(256)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.joined = np.array([vocab[a + b] for a, b in pairs])
        self.ranks = Table(18)
        self.ranks.put(self._keys(*(np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))), np.arange(len(pairs)))

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        at, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        at[ends] = self.last[raw[ends]]
        done_at, done_word = [], []
        rank = np.full(len(at), NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks.get(self._keys(at[inside], at[inside + 1]), NEVER)
        while len(at):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            many = np.diff(np.append(first, len(at)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NEVER, many)
            if over.any():
                done_at.append(at[over]), done_word.append(word[over])
                at, word, rank = at[~over], word[~over], rank[~over]
                many, least = many[least < NEVER], least[least < NEVER]
                if not len(at):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, many))
            i = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            at[i] = self.joined[rank[i]]
            keep = np.ones(len(at), bool)
            keep[i + 1] = False
            i -= np.arange(len(i))
            at, word, rank = at[keep], word[keep], rank[keep]
            for k in (i, i[i > 0] - 1):
                follows = np.append(word, -1)[k + 1] == word[k]
                rank[k] = NEVER
                k = k[follows]
                rank[k] = self.ranks.get(self._keys(at[k], at[k + 1]), NEVER)
        if not done_at:
            return np.zeros(0, np.int64), sizes
        at, word = np.concatenate(done_at), np.concatenate(done_word)
        return at[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class WordTokens:
    """Encodes texts word by word, for tokenizers that ignore case, whose pre-tokens never cross
    ASCII white space nor join a letter with a sign after it.

    Words of letters, most of all words, are merged side by side if the vocabulary marks the ends
    of words; all others, and those of other vocabularies, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = LetterMerges(model) if model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges") else None
        self.powers, self.inverse = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(BLOCK, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        self._clear()

    def _clear(self) -> None:
        self.index, self.n = Table(20), 0
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _library(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain, tails, odd = [], [], []
        for k, w in enumerate(words):
            m = _PLAIN.fullmatch(w) if self.merges else None
            # letters below U+0250 have one form each, so normalising changes none that is lower case
            if m and (m[1].isascii() or (t := m[1].decode()).isalpha() and max(t) < "ɐ" and t.lower() == t):
                plain.append((k, m[1]))
                if m[2]:
                    tails.append((k, m[2]))
            else:
                odd.append(k)
        sizes = np.zeros(len(words), np.int64)
        found = self._library([words[k] for k in odd])
        sizes[odd] = [len(x) for x in found]
        ids, own = self.merges([w for _, w in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.array([k for k, _ in plain], np.int64)
        sizes[at] = own
        kinds = sorted({s for _, s in tails})
        signs = dict(zip(kinds, self._library(kinds)))
        after = [(k, signs[s]) for k, s in tails]
        for k, x in after:
            sizes[k] += len(x)
        first = self.used + np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        if odd:
            many = sizes[odd]
            self.ids[np.repeat(first[odd] - (np.cumsum(many) - many), many) + np.arange(many.sum())] = np.fromiter(chain.from_iterable(found), np.uint32, int(many.sum()))
        self.ids[np.repeat(first[at] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        for k, x in after:
            end = first[k] + sizes[k]
            self.ids[end - len(x) : end] = x
        self.start[self.n : self.n + len(words)], self.length[self.n : self.n + len(words)] = first, sizes
        self.n += len(words)
        self.used += total

    def _hashes(self, data: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word, whatever its place: a polynomial of its bytes, or for long words the digest of them."""
        h = np.empty(len(first), np.uint64)
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends, first[i] + BLOCK, "right")))
            start, n = first[i], int(min(ends[j - 1] - first[i], BLOCK))  # a longer word has its digest
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data[start : start + n]] * self.powers[:n], out=sums[1:])
            at, to = first[i:j] - start, np.minimum(ends[i:j] - start, n)
            h[i:j] = mix((sums[to] - sums[at]) * self.inverse[at] + (to - at).astype(np.uint64))
            i = j
        for k in np.flatnonzero(ends - first > LONGEST).tolist():
            h[k] = xxhash.xxh3_64_intdigest(data[first[k] : ends[k]].tobytes())
        return np.maximum(h, np.uint64(1))

    def encode(self, raws: list[bytes], end: int) -> list[np.ndarray]:
        """Of each text in UTF-8, its ids with ``end`` after them."""
        if self.n > REMEMBERED:
            self._clear()
        raws = [raw if b"<|" in raw else raw.lower() for raw in raws]  # special tokens keep their case
        joined = b" ".join(raws) + b" "
        data = np.frombuffer(joined, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        first, ends = edge[::2], edge[1::2]
        h = self._hashes(data, first, ends)
        at = self.index.get(h, -1)
        new, one = np.unique(h[at < 0], return_index=True)
        if len(new):
            one = np.flatnonzero(at < 0)[one]
            for i in range(0, len(new), LEARNED):
                part = one[i : i + LEARNED]
                self.index.put(new[i : i + LEARNED], self.n + np.arange(len(part)))
                self._learn([joined[a:b] for a, b in zip(first[part].tolist(), ends[part].tolist())])
            at[at < 0] = self.index.get(h[at < 0], -1)
        sizes = self.length[at]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.start[at] - before, sizes) + np.arange(int(sizes.sum()))]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        cuts = np.append(before, len(ids))[np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]))].tolist()
        tail = np.array([end], np.uint32)
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(cuts, cuts[1:])]


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's encoder for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
