"""Byte-level BPE for operators 1, 7 and 9: split into chunks, then look chunks up.

A *chunk* is an optional space and a run of other characters than white space, or a run of white space that stops one short of a word.
The split pattern of the vocabularies never lets a pre-token go on from such a chunk into the next, so a chunk's tokens don't depend on
what stands around it. In texts with single spaces only, ``str.split(" ")`` finds the chunks.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Unicode's White_Space, fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries that a worker's cache holds at most; it starts anew when full.
CACHE = 400_000
LONG = 64


def split(text: str) -> tuple[bool, list[str]]:
    """The text's chunks in order. (True, parts): all parts but the first follow a space that isn't written; (False, chunks): as they stand."""
    if not text:
        return False, []
    parts = text.split(" ")
    return (False, CHUNK.findall(text)) if "" in parts else (True, parts)


@lru_cache(4)
def library(path: str):
    """The tokenizers library's tokenizer, once a worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in library(path).get_added_tokens_decoder().values())


# --- Operator 9's own merges, from a rank file -------------------------------------------------------------------------


def _ranges(kind: str) -> str:
    """Regex ranges of all code points of a class, as the regex engine of tiktoken has it: a tokenizer of bytes that matches single characters of the class alone gives just those back."""
    import tiktoken

    single = tiktoken.Encoding(f"class {kind}", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    points = np.fromiter(map(ord, single.decode_bytes(single.encode_ordinary(every)).decode()), np.int64)
    gaps = np.flatnonzero(np.diff(points) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, gaps + 1]], points[np.r_[gaps, len(points) - 1]], strict=True))


@lru_cache(1)
def pieces_pattern() -> re.Pattern:
    """public_tokenizers.PATTERN for Python's own re, with the classes of letters and numbers written out."""
    letter, number = _ranges(r"\p{L}"), _ranges(r"\p{N}")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Ranks:
    """The ranks of a .tiktoken file, and the merge replay."""

    #: Symbols that one replay holds at most (more only where a single word is longer).
    SYMBOLS = 1 << 20

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank of the token that a and b make together; -1: none."""
        key = a << 24 | b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            r = self.pairs[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after the other): the words of a part of the corpus, in groups of bounded size, which words never cross."""
        counts, ids, group, size = [], [], [], 0
        for w in words:
            if group and size + len(w) > self.SYMBOLS:
                self._add(group, counts, ids)
                group, size = [], 0
            group.append(w)
            size += len(w)
        self._add(group, counts, ids)
        return np.concatenate(counts), np.concatenate(ids)

    def _add(self, group: list[bytes], counts: list[np.ndarray], ids: list[np.ndarray]) -> None:
        word, sym = self.replay(group)
        counts.append(np.bincount(word, minlength=len(group)))
        ids.append(sym)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word's number, id) of all symbols that are left, in order, when all merges have been applied to all words.

        The inverted index leads from a pair (by the rank of the token that it makes) to the positions where it starts, in all words. Merges are applied in rank order, each at
        all its positions from left to right; only the pairs with the two neighbours of a merged pair are looked up anew. Should a merge give rise to a
        pair of lower rank in a word, that word's later positions wait until the lower rank has been applied, as word-by-word encoding would have it.
        """
        pair = self.pair
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word_at = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(raw)
        # -1 stands where a symbol has been merged into the one before; neighbours of another word are none
        sym, word = np.array(self.byte, np.int32)[raw].tolist(), word_at.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = np.cumsum(lengths)
        for e in set(ends.tolist()) - {0}:
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        index = self._first(raw, word_at)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places, waits, again = index.pop(r), set(), []
            places.sort()
            for i in places:
                a = sym[i]
                if a < 0:
                    continue
                j = after[i]
                if j < 0 or pair(a, sym[j]) != r:
                    continue
                if word[i] in waits:
                    again.append(i)
                    continue
                sym[i], sym[j] = r, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := pair(r, sym[k])) >= 0:
                        if q not in index:
                            index[q] = [i]
                            heapq.heappush(heap, q)
                        else:
                            index[q].append(i)
                        if q < r:
                            waits.add(word[i])
                h = before[i]
                if h >= 0 and (q := pair(sym[h], r)) >= 0:
                    if q not in index:
                        index[q] = [h]
                        heapq.heappush(heap, q)
                    else:
                        index[q].append(h)
                    if q < r:
                        waits.add(word[i])
            if again:
                if r in index:
                    index[r] += again
                else:
                    index[r] = again
                    heapq.heappush(heap, r)
        out = np.array(sym, np.int32)
        left = np.flatnonzero(out >= 0)
        return word_at[left], out[left]

    def _first(self, raw: np.ndarray, word: np.ndarray) -> dict[int, list[int]]:
        """The index of the words' bytes: positions by rank."""
        if not hasattr(self, "_bytes"):
            self._bytes = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        if len(raw) < 2:
            return {}
        found = np.where(word[:-1] == word[1:], self._bytes[raw[:-1].astype(np.int32) << 8 | raw[1:]], -1)
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        ranks, first = np.unique(found[at], return_index=True)
        return {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, first[1:]), strict=True)} if len(at) else {}


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def forget() -> None:
    """Drop a worker's vocabularies."""
    for f in (library, special_strings, ranks):
        f.cache_clear()
