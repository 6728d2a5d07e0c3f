"""The coder of operator 7: adaptive context mixing over token ids, in blocks that start anew.

Each block of ids is coded for itself: its contexts start empty, so any block can be read alone, with the sequence's *table*. Blocks are coded side by side: every step codes one symbol of every block (a *lane*), in numpy
arrays over the lanes.

A symbol is an id or two neighbouring ids of a block that are frequent together. The table holds the distinct ids, the pairs, and a rounded frequency of each symbol: order 0. Order-2 and order-1 contexts (the last two symbols, the last
one) each predict one symbol, with a confidence from 0 to 3. How likely the surer prediction holds is mixed from three adaptive estimates (by both confidences and whether the predictions agree, by order-2's, by order-1's):
their logits are added, and each learns from the error. The rest of the probability is order 0's. Both parts of a symbol narrow the range at once; the range coder has a window of 56 bits and writes 16 at a time, carries
going to the words before. All is computed in whole numbers, so it reads back alike everywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
#: Times that two ids stand together, from which they can become a symbol, and bits of the hash that they are counted by.
PAIR, PAIR_BITS = 24, 19
#: Ids that are looked at together there.
_CHUNK = 1 << 17
_U = np.uint64
#: The range is this at least before a step; words are cut off from here.
_LOW_BITS = _U(40)
_BOTTOM, _MASK = _U(1 << 40), _U((1 << 40) - 1)
_SHIFT = _U(16)
_S1_BITS, _S2_BITS = 9, 10
#: Probabilities of predictions are fractions of 2**12; logits are whole numbers, 1024 a unit.
_Q = 12
_EDGE = 8 << 10
_SQUASH = np.array([min(4064, max(8, int(4096 / (1 + np.exp(-z / 1024))))) for z in range(-_EDGE, _EDGE + 1)], np.int32)
#: What a prediction's confidence becomes: by whether it held (4) and what it was.
_SURE = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)
#: First logits, by order 2's confidence, order 1's, and whether they agree.
_LOGITS = np.array([[[-3500 + 1100 * max(a - 1, b - 1, 0) + 1500 * agree for agree in range(2)] for b in range(4)] for a in range(4)], np.int32).reshape(-1)


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places start, start + 1, ... of each of these runs, one after the other; where each run ends among them)."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), ends


def _planes(values: np.ndarray) -> bytes:
    """Values as byte planes, which are zero where values are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


class _Table:
    """Order 0: distinct ids in order, then pairs (of places among the ids) in order; all symbols' frequencies in 2**bits, and what stands before each."""

    def __init__(self, ids: np.ndarray, pairs: np.ndarray, classes: np.ndarray):
        self.ids, self.pairs, self.bits = ids, pairs, max(16, len(classes).bit_length() + 4)
        # a class is a count rounded to a quarter of a power of two
        weight = np.array([16, 19, 23, 27], np.int64)[classes & 3] << (classes >> 2)
        # weights of up to 46 bits are cut to 30 for the product
        weight = np.maximum(1, weight >> max(0, int(weight.max(initial=1)).bit_length() - 30))
        # every symbol has a place; what rounding leaves goes to all by their weight, and the rest to the most frequent
        freq = np.maximum(1, weight * ((1 << self.bits) - len(classes)) // weight.sum())
        freq += freq * ((1 << self.bits) - freq.sum()) >> self.bits
        freq[np.argmax(freq)] += (1 << self.bits) - freq.sum()
        self.freq, self.before = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)

    def symbols(self, value: np.ndarray) -> np.ndarray:
        """The symbol that each value (under 2**bits) falls to."""
        if self.bits > 20:
            return np.searchsorted(self.before, np.minimum(value, _U((1 << self.bits) - 1)), "right") - 1
        if not hasattr(self, "_place"):
            self._place = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._place.take(value.view(np.int64), mode="clip")

    @staticmethod
    def of(ids: np.ndarray, block: int) -> tuple[_Table, bytes, np.ndarray, np.ndarray]:
        """(the table of these ids, its bytes, their symbols, the place among all ids where each symbol begins)."""
        if int(ids.max()) < 1 << 20:
            n = np.bincount(ids)
            distinct = np.flatnonzero(n)
            place = (np.cumsum(n > 0, dtype=np.int32) - 1).take(ids)
        else:
            distinct, place = np.unique(ids, return_inverse=True)
        symbols, at, pairs = _paired(place.astype(np.int32), len(distinct), block)
        # ids that stand in pairs alone keep a symbol, counted once
        counts = np.maximum(1, np.bincount(symbols, minlength=len(distinct) + len(pairs)))
        whole = np.frexp(counts.astype(float))[1] - 1
        quarter = ((counts.astype(np.int64) << 2 >> whole) & 3) if int(whole.max()) < 61 else np.zeros_like(whole)
        classes = (whole << 2 | quarter).astype(np.uint8)
        raw = _planes(np.diff(distinct.astype(np.int64), prepend=-1) - 1) + _planes(np.diff(pairs[:, 0], prepend=0)) + _planes(pairs[:, 1]) + classes.tobytes()
        return _Table(distinct.astype(np.uint32), pairs, classes), struct.pack("<I", len(distinct)) + zlib.compress(raw, 6), symbols, at

    @staticmethod
    def read(data: bytes) -> _Table:
        n, raw = struct.unpack_from("<I", data)[0], np.frombuffer(zlib.decompress(data[4:]), np.uint8)
        m = (len(raw) - 5 * n) // 9
        gaps, left, right = (_unplaned(raw[a:b]) for a, b in ((0, 4 * n), (4 * n, 4 * (n + m)), (4 * (n + m), 4 * (n + 2 * m))))
        return _Table((np.cumsum(gaps + 1) - 1).astype(np.uint32), np.stack([np.cumsum(left), right], 1), raw[4 * (n + 2 * m) :])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of these symbols."""
        n = len(self.ids)
        both = np.zeros((n + len(self.pairs), 2), np.uint32)
        both[:n, 0], both[n:] = self.ids, self.ids[self.pairs]
        two = np.ones((len(symbols), 2), bool)
        np.greater_equal(symbols, n, out=two[:, 1])
        return both.take(symbols, axis=0)[two]


def _bins(keys: np.ndarray) -> np.ndarray:
    return (keys.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - PAIR_BITS)).view(np.int64)


def _paired(place: np.ndarray, n: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, where each begins, the pairs in order): of neighbours within a block that stand together PAIR times, the first two, the next two, and so on become one symbol."""

    def keys() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(part of the sequence, key of each two neighbours there or -1, their bins)"""
        for a in range(0, len(place) - 1, _CHUNK):
            some = place[a : a + _CHUNK + 1].astype(np.int64)
            key = some[:-1] * n + some[1:]
            key[(block - 1 - a) % block :: block] = -1
            yield slice(a, a + len(key)), key, _bins(key)

    # a bin is the pair's that came last, which is a frequent one more often than not
    owner, counts, own = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, np.int64), np.zeros(len(place), bool)
    for _, key, bins in keys():
        owner[bins] = key
    for part, key, bins in keys():
        own[part] = (owner.take(bins) == key) & (key >= 0)
        counts += np.bincount(bins[own[part]], minlength=1 << PAIR_BITS)
    often = counts >= PAIR
    for part, _, bins in keys():
        own[part] &= often.take(bins)
    pairs = np.sort(owner[often])
    # in a run of such pairs every second one is taken
    at = np.arange(len(place), dtype=np.int32 if len(place) < 1 << 31 else np.int64)
    start = np.where(own, 0, at + 1)
    np.maximum.accumulate(start, out=start)
    at -= start
    own &= at & 1 == 0
    del at, start
    taken = np.flatnonzero(own)
    number = np.zeros(1 << PAIR_BITS, np.int32)
    number[_bins(pairs)] = np.arange(n, n + len(pairs))
    symbols, keep = place.copy(), np.ones(len(place), bool)
    symbols[taken] = number.take(_bins(place.take(taken).astype(np.int64) * n + place.take(taken + 1)))
    keep[1:] = ~own[:-1]
    return symbols[keep], np.flatnonzero(keep), np.stack([pairs // n, pairs % n], 1)


class _Writer:
    """Lanes' words grow side by side, in rows that all have room for the steps to come."""

    def __init__(self, lanes: int, steps: int, table: _Table):
        self.table, self.low, self.range = table, np.zeros(lanes, _U), np.full(lanes, 1 << 56, _U)
        # a step leaves 2**-40 of the range at least: three words; one that is written before its time is written over
        self.room = steps * 3 + 8
        self.out, self.at = np.zeros(lanes * self.room, np.uint32), np.arange(lanes, dtype=np.int64) * self.room
        self.start = self.at.copy()

    def code(self, n: int, first: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code x, of which ``first`` is predicted with probability q; (x, whether the prediction holds)."""
        hit, low, r, at = x == first, self.low[:n], self.range[:n], self.at[:n]
        part = (r >> _U(_Q)) * q.astype(_U)
        rest = (r - part) >> _U(self.table.bits)
        low += np.where(hit, _U(0), part + rest * self.table.before.take(x))
        r = np.where(hit, part, rest * self.table.freq.take(x))
        # bit 16 of a word is a carry to the one before
        short = r < _BOTTOM
        self.out[at] = low >> _LOW_BITS
        np.copyto(low, (low & _MASK) << _SHIFT, where=short)
        at += short
        r <<= short * _SHIFT
        short = np.flatnonzero(r < _BOTTOM)
        while len(short):
            l, to = low.take(short), at.take(short)
            self.out[to] = l >> _LOW_BITS
            at[short], low[short] = to + 1, (l & _MASK) << _SHIFT
            r[short] = r.take(short) << _SHIFT
            short = short[r.take(short) < _BOTTOM]
        self.range[:n] = r
        return x, hit

    def finish(self) -> list[bytes]:
        # the range is 2**40 at least, so one word, rounded up, lies within it; the reader goes on with zeros
        self.out[self.at] = (self.low + _MASK) >> _LOW_BITS
        carry = np.flatnonzero(self.out > 0xFFFF)
        while len(carry):
            self.out[carry] &= 0xFFFF
            self.out[carry - 1] += 1
            carry = carry[self.out[carry - 1] > 0xFFFF] - 1
        return [self.out[a : b + 1].astype(">u2").tobytes() for a, b in zip(self.start.tolist(), self.at.tolist(), strict=True)]


class _Reader:
    def __init__(self, blocks: list[bytes], table: _Table):
        sizes = np.fromiter(map(len, blocks), np.int64, len(blocks)) // 2 + 5
        self.table, lanes = table, len(blocks)
        # a byte before each block, so that words begin behind the window of 7 bytes, and zeros after it
        self.data = np.frombuffer(b"".join([p for b in blocks for p in (b"\0", b[: len(b) // 2 * 2], bytes(9))]), ">u2").astype(_U)
        self.at = np.cumsum(sizes) - sizes
        # how far the code lies above the range's low end is all that counts
        self.range, self.beyond = np.full(lanes, 1 << 56, _U), np.zeros(lanes, _U)
        for _ in range(4):
            self.beyond = self.beyond << _SHIFT | self.data.take(self.at, mode="clip")
            self.at += 1

    def code(self, n: int, first: np.ndarray, q: np.ndarray, x: None) -> tuple[np.ndarray, np.ndarray]:
        beyond, r, at = self.beyond[:n], self.range[:n], self.at[:n]
        part = (r >> _U(_Q)) * q.astype(_U)
        rest = (r - part) >> _U(self.table.bits)
        hit = beyond < part
        x = np.where(hit, first, self.table.symbols((beyond - part) // rest))
        beyond = np.where(hit, beyond, beyond - part - rest * self.table.before.take(x))
        r = np.where(hit, part, rest * self.table.freq.take(x))
        short = r < _BOTTOM
        np.copyto(beyond, beyond << _SHIFT | self.data.take(at, mode="clip"), where=short)
        at += short
        r <<= short * _SHIFT
        short = np.flatnonzero(r < _BOTTOM)
        while len(short):
            to = at.take(short)
            beyond[short] = beyond.take(short) << _SHIFT | self.data.take(to, mode="clip")
            at[short], r[short] = to + 1, r.take(short) << _SHIFT
            short = short[r.take(short) < _BOTTOM]
        self.beyond[:n], self.range[:n] = beyond, r
        return x, hit


def _run(coder: _Writer | _Reader, lengths: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    """Code symbols (steps x lanes), or read and return them if None. Lengths fall from lane to lane."""
    lanes, steps = len(lengths), int(lengths.max(initial=0))
    out = np.zeros((steps, lanes), np.int32) if given is None else given
    # order 1 in the first row, order 2 in the second; an entry is the predicted symbol and its confidence
    known = np.zeros(lanes * ((1 << _S1_BITS) + (1 << _S2_BITS)), np.int32)
    base = np.stack([np.arange(lanes) << _S1_BITS, (lanes << _S1_BITS) + (np.arange(lanes) << _S2_BITS)])
    logits = np.tile(np.r_[_LOGITS, np.zeros(8, np.int32)], lanes)
    lane = np.arange(lanes) * 40
    h1, h2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    counts = np.searchsorted(-lengths, -np.arange(steps)).tolist()  # lanes that are longer than each step
    slots = np.empty((2, lanes), np.int64)
    for t, n in enumerate(counts):
        h1, h2, s = h1[:n], h2[:n], slots[:, :n]
        np.add(h1 >> np.uint32(32 - _S1_BITS), base[0, :n], out=s[0])
        np.add((h1 ^ h2) >> np.uint32(32 - _S2_BITS), base[1, :n], out=s[1])
        e = known.take(s)
        place, sure = e >> 2, e & 3
        (p1, p2), (c1, c2) = place, sure
        first = np.where(c2 >= c1, p2, p1)
        own = lane[:n]
        k0, k1, k2 = own + (c2 << 3 | c1 << 1 | (p1 == p2)), own + (c2 + 32), own + (c1 + 36)
        l0, l1, l2 = logits.take(k0), logits.take(k1), logits.take(k2)
        q = _SQUASH.take(l0 + l1 + l2 + _EDGE, mode="clip")
        x, hit = coder.code(n, first, q, None if given is None else given[t, :n])
        if given is None:
            out[t, :n] = x
        error = (hit.astype(np.int32) << _Q) - q >> 6
        logits[k0], logits[k1], logits[k2] = l0 + error, l1 + error, l2 + error
        state = sure + ((place == x) << 2)
        known[s] = np.where(state > 1, e - sure, x << 2) + _SURE.take(state)
        h2, h1 = h1 * np.uint32(0x2545F491), x.astype(np.uint32) * np.uint32(0x9E3779B1)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], bytes]:
    """(the coded blocks of a sequence of ids under 2**32, each after its number of symbols; the table that they are read with)."""
    if not len(ids):
        return [], b""
    table, data, symbols, at = _Table.of(ids, block)
    lengths = np.bincount(at // block)
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros((len(lengths), int(lengths.max())), np.int32)
    padded[np.arange(padded.shape[1]) < lengths[:, None]] = symbols
    w = _Writer(*padded.shape, table)
    _run(w, lengths[order], np.ascontiguousarray(padded[order].T))
    blocks = [b""] * len(lengths)
    for i, coded in zip(order.tolist(), w.finish(), strict=True):
        blocks[i] = struct.pack("<I", lengths[i]) + coded
    return blocks, data


def decode(blocks: list[bytes], n: int, table: bytes, block: int = BLOCK) -> np.ndarray:
    """The n ids of coded blocks, as uint32."""
    if not n:
        return np.empty(0, np.uint32)
    lengths = np.array([struct.unpack_from("<I", b)[0] for b in blocks], np.int64)
    if lengths.max() > block:
        raise ValueError("a block's number of symbols is damaged")
    order = np.argsort(-lengths, kind="stable")
    known = _Table.read(table)
    found = _run(_Reader([blocks[i][4:] for i in order.tolist()], known), lengths[order], None)
    padded = np.empty(found.shape[::-1], np.int32)
    padded[order] = found.T
    ids = known.expand(padded[np.arange(padded.shape[1]) < lengths[:, None]])
    if len(ids) != n:
        raise ValueError("a block is damaged")
    return ids
