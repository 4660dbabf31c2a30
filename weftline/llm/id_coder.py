"""An adaptive context-mixing range coder for token ids, many blocks at a time.

What is coded are symbols: single ids, and phrases (runs of ids, such as the pieces that a tokenizer cuts) that occur often
enough. A table of both and of their frequencies stands before the blocks; by it each block can be decoded alone, from fresh
statistics. Blocks are coded side by side, one numpy lane each: step t codes the t-th symbol of every block. The last block is
filled up with symbol 0.

A symbol is predicted from the two before it (order 2), from the one before it (order 1) and from the frequencies of
the table (order 0). What is coded first is whether it is the order-2 prediction, the order-1 prediction or neither. Three
experts give the chances of that, by how often the order-2 prediction held lately, by the same for order 1, and overall; their
chances are mixed with weights that follow how well each has done. Any other symbol is coded by its frequency.
Predictions change with every symbol; chances and weights are renewed at fixed steps from what was counted since, for all
states at once, so that a step only looks them up. Chances are multiples of 1/4096, frequencies of 1/2^20; the coder
keeps 64 bits and emits 32 at a time, once a symbol at most. All of it is whole numbers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

_BITS = 12
_ONE = 1 << _BITS
_LOW32 = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)
_SHIFT = np.uint64(_BITS)
_TOTAL = 20
_ALL = 1 << _TOTAL  # of the frequencies of a table
_SHIFT0 = np.uint64(_TOTAL)
_FREQ = np.uint64(_ALL - 1)
_LEAST = 256  # the chance of neither prediction: 4 bits, so that its symbol's 20 fit before 32 are emitted
_SLOTS = 1024  # of the tables of predictions, for each block
_BLOCK = 1 << 19  # symbols of a block at most: counts times 4096 stay within 31 bits
IDS = 65536  # ids are below, phrases are numbered from here on
_NONE = _ALL  # predicted where nothing is known yet: no symbol
_PRIOR = np.array([5, 3, 8], np.int32)[:, None]  # counts in sixteenths: order 2, order 1, neither
_OFTEN, _LONG, _PHRASES = 3, 255, 1 << 18  # a phrase of a table: times it occurs at least, ids and phrases at most
_HEAD = struct.Struct("<IIIII")
Phrases = tuple[np.ndarray, np.ndarray]  #: their ids one after the other, and how many each has
NO_PHRASES: Phrases = (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def spread(numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of entries one after the other; ids and lengths are those of all entries."""
    if len(ids) == len(lengths) and (lengths == 1).all():
        return ids.take(numbers)
    ids = np.ascontiguousarray(ids)
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) * ids.itemsize
    entries = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
    found = entries.take(pa.array(numbers))
    return np.frombuffer(found.buffers()[2], ids.dtype) if len(found) and found.buffers()[2] else ids[:0]


def expand(numbers: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Numbers with the ids of phrases in their place."""
    ids, lengths = np.concatenate([np.arange(IDS, dtype=np.uint32), phrases[0]]), np.concatenate([np.ones(IDS, np.int64), phrases[1]])
    return spread(numbers, ids, lengths)


class _Table:
    """Symbols of a file: what ids each stands for, and its frequency in 2^20."""

    def __init__(self, singles: np.ndarray, phrases: Phrases, freq: np.ndarray):
        self.singles, self.phrases, self.freq = singles, phrases, freq.astype(np.uint32)
        self.range = (np.cumsum(freq, dtype=np.uint64) - freq.astype(np.uint64)) << _SHIFT0 | freq.astype(np.uint64) - np.uint64(1)

    @classmethod
    def of(cls, numbers: np.ndarray, phrases: Phrases) -> tuple[_Table, np.ndarray]:
        """The table of a file, and its symbols."""
        ids, lengths = phrases
        count = np.bincount(numbers, minlength=IDS + len(lengths))
        stay = (count[IDS:] >= _OFTEN) & (lengths > 1) & (lengths <= _LONG)
        if stay.sum() > _PHRASES:
            rank = np.lexsort((np.arange(len(stay)), -count[IDS:] * (lengths - 1) * stay))
            stay[rank[_PHRASES:]] = False
        kept, first = np.flatnonzero(stay), np.cumsum(lengths) - lengths
        body, keep = ids.astype(np.int32), ~np.repeat(stay, lengths)  # phrases that stay have one number, others their ids
        body[first[kept]] = IDS + np.arange(len(kept))
        keep[first[kept]] = True
        numbers = spread(numbers, np.concatenate([np.arange(IDS, dtype=np.int32), body[keep]]), np.concatenate([np.ones(IDS, np.int64), np.where(stay, 1, lengths)]))
        phrases = spread(kept, ids, lengths), lengths[kept]
        count = np.bincount(numbers, minlength=IDS + len(kept))
        used = np.flatnonzero(count)
        place = np.zeros(len(count), np.int32)
        place[used] = np.arange(len(used))
        freq = 1 + count[used] * (_ALL - len(used)) // len(numbers)
        freq[int(freq.argmax())] += _ALL - int(freq.sum())
        return cls(used[used < IDS].astype(np.uint32), phrases, freq), place.take(numbers)

    def symbols(self) -> Phrases:
        """Ids of all symbols, and how many each has."""
        return np.concatenate([self.singles, self.phrases[0].astype(np.uint32)]), np.concatenate([np.ones(len(self.singles), np.int64), self.phrases[1]])

    def places(self) -> np.ndarray:
        """The symbol of each value below 2^20."""
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)

    def words(self, steps: int) -> np.ndarray:
        """As numbers of 32 bits: sizes, then all else, bytes of one weight together, deflated."""
        parts = np.diff(self.singles, prepend=0).astype("<u2"), self.phrases[1].astype("u1"), self.phrases[0].astype("<u2"), (self.freq - 1).astype("<u4")
        body = zlib.compress(b"".join(x.view("u1").reshape(len(x), x.itemsize).T.tobytes() for x in parts), 1)
        head = _HEAD.pack(steps, len(self.singles), len(self.phrases[1]), len(self.phrases[0]), len(body))
        return np.frombuffer(head + body + bytes(-len(body) % 4), "<u4")

    @classmethod
    def read(cls, words: np.ndarray) -> tuple[_Table, int]:
        data = words.astype("<u4").tobytes()
        steps, singles, many, flat, size = _HEAD.unpack_from(data)
        body = np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + size]), "u1")
        out, at = [], 0
        for n, kind in ((singles, "<u2"), (many, "u1"), (flat, "<u2"), (singles + many, "<u4")):
            wide = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(body[at : at + n * wide].reshape(wide, n).T).reshape(-1).view(kind))
            at += n * wide
        single, lengths, ids, freq = out
        return cls(np.cumsum(single, dtype=np.uint32), (ids, lengths.astype(np.int64)), freq.astype(np.int64) + 1), steps


def _renewals(steps: int) -> set[int]:
    """Steps at which chances are renewed: often at first."""
    return {4, 8, 16, 32, 64, *range(128, steps, 128)}


class _Model:
    """States are 5 * 10: how often the order-2 prediction held lately (0 to 4), and order 1's, plus 5 where
    both predict one symbol. Arrays by state have the lanes last."""

    def __init__(self, lanes: int):
        self.row = np.arange(lanes)
        self.lanes, self.slot = lanes, self.row * _SLOTS
        self.pred = [np.full(lanes * _SLOTS, _NONE << 3, np.int32) for _ in range(2)]  # symbol, and how often it held
        self.hits = np.zeros((5, 10, 3, lanes), np.int32)
        self.chance = np.empty((5, 10, 3, lanes), np.int32)  # the two bounds, at outcome 0
        self.n = [np.zeros((states, 3, lanes), np.int32) for states in (5, 10, 1)]
        self.w = np.full((3, lanes), _ONE // 3, np.int32)
        self.one = self.two = np.zeros(lanes, np.int64)
        self.mix()

    def _shares(self) -> list[np.ndarray]:
        return [((n + _PRIOR) << _BITS) // (n + _PRIOR).sum(1, keepdims=True) for n in self.n]

    def mix(self) -> None:
        """New chances from the outcomes counted since the last time."""
        new = [self.hits.sum(1, dtype=np.int32), self.hits.sum(0, dtype=np.int32)]
        new.append(new[0].sum(0, dtype=np.int32)[None])
        steps = int(new[2][:, :, 0].sum())
        if steps:
            got = np.stack([(n * q).sum((0, 1), dtype=np.int32) // steps for n, q in zip(new, self._shares(), strict=True)])
            self.w = np.maximum(self.w + ((got - self.w) >> 1), 64)
            self.n = [n - (n >> 2) + 16 * m for n, m in zip(self.n, new, strict=True)]
            self.hits[:] = 0
        q, w = self._shares(), (self.w << _BITS) // self.w.sum(0, dtype=np.int32)
        first, second = (((w[0] * q[0][:, s])[:, None] + (w[1] * q[1][:, s] + w[2] * q[2][0, s])[None]) >> _BITS for s in (0, 1))
        a = 1 + (first * (_ONE - _LEAST - 2) >> _BITS)
        self.chance[:, :, 0] = a | (a + 1 + (second * (_ONE - _LEAST - 2) >> _BITS)) << 16

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predictions of order 2 and 1, and the bounds of the two chances."""
        one = self.one
        self.at = self.slot + ((one * 40503 + self.two * 10007 >> 2) & (_SLOTS - 1)), self.slot + (one & (_SLOTS - 1))
        e2, e1 = self.pred[0].take(self.at[0]), self.pred[1].take(self.at[1])
        c2, c1, self.held = e2 >> 3, e1 >> 3, (e2 & 7, e1 & 7)
        self.same = c1 == c2
        state = self.held[0] * 10 + self.held[1] + self.same * np.int32(5)
        self.state = state * np.int64(3 * self.lanes) + self.row
        ab = self.chance.reshape(-1).take(self.state).astype(np.uint64)
        return c2, c1, ab & np.uint64(0xFFFF), ab >> np.uint64(16)

    def learn(self, x: np.ndarray, first: np.ndarray, upto: np.ndarray) -> None:
        """x: the symbols of this step; first, upto: whether the outcome was 0, was 0 or 1."""
        hits, at = self.hits.reshape(-1), self.state + (2 * self.lanes - first * self.lanes - upto * self.lanes)
        hits.put(at, hits.take(at) + np.int32(1))
        id8 = (x << 3) + np.int32(1)
        for k, right in enumerate((first, upto & (self.same | ~first))):
            self.pred[k].put(self.at[k], id8 + np.minimum(self.held[k], 3) * right)
        self.two, self.one = self.one, x.astype(np.int64)


def _lanes(total: int, block: int) -> tuple[int, int]:
    """Number of blocks, and the steps that code them all."""
    n = -(-total // block)
    return n, block if n > 1 else total


def encode(ids: np.ndarray, block: int, phrases: Phrases = NO_PHRASES) -> tuple[np.ndarray, np.ndarray]:
    """The words of the table and of all blocks one after the other, and their number in each block. Ids are below 65536;
    65536 + k stands for the k-th phrase."""
    if not len(ids):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    if int(ids.max()) >= IDS + len(phrases[1]) or len(phrases[0]) and int(phrases[0].max()) >= IDS:
        raise ValueError("ids of more than 16 bits")
    if not 0 < block <= _BLOCK:
        raise ValueError(f"blocks of 1 to {_BLOCK} ids")
    table, symbols = _Table.of(ids, phrases)
    lanes, steps = _lanes(len(symbols), block)
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    model, mixes = _Model(lanes), _renewals(block)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    room = block + 8
    out, at = np.zeros(lanes * room, "<u4"), np.arange(lanes) * room
    for t in range(steps):
        if t in mixes:
            model.mix()
        x = grid[t]
        c2, c1, a, b = model.look()
        first = x == c2
        upto = first | (x == c1)
        r = span >> _SHIFT
        a, b = r * a, r * b
        e = table.range.take(x)
        r = (span - b) >> _SHIFT0
        low += np.where(first, np.uint64(0), np.where(upto, a, b + r * (e >> _SHIFT0)))
        span = np.where(first, a, np.where(upto, b - a, r * ((e & _FREQ) + np.uint64(1))))
        tight = np.flatnonzero(span <= _LOW32)
        if len(tight):
            lo, sp, to = low.take(tight), span.take(tight), at.take(tight)
            split = (lo ^ (lo + sp - np.uint64(1))) >> _S32 != 0
            sp = np.where(split, (~lo & _LOW32) + np.uint64(1), sp)
            out[to] = lo >> _S32
            at[tight] = to + 1
            low[tight] = lo << _S32
            span[tight] = np.minimum(sp, _LOW32) << _S32
        model.learn(x, first, upto)
    for half in (low >> _S32, low & _LOW32):
        out[at] = half
        at += 1
    words = at - np.arange(lanes) * room
    keep = np.arange(room) < words[:, None]
    return np.concatenate([table.words(len(symbols)), out.reshape(lanes, room)[keep]]), words


def decode(data: np.ndarray, words: np.ndarray, total: int, block: int) -> np.ndarray:
    """The ids back from what encode gave."""
    if not total:
        return np.zeros(0, "<u4")
    before = len(data) - int(words.sum())
    table, many = _Table.read(data[:before])
    lanes, steps = _lanes(many, block)
    place = table.places()
    data = np.append(data[before:].astype(np.uint64), np.zeros(2, np.uint64))
    at = np.cumsum(words) - words
    grid = np.zeros((block, lanes), np.int32)
    model, mixes = _Model(lanes), _renewals(block)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    low = np.zeros(lanes, np.uint64)
    code = (data[at] << _S32) | data[at + 1]
    at = at + 2
    last = len(data) - 1
    for t in range(steps):
        if t in mixes:
            model.mix()
        c2, c1, a, b = model.look()
        r = span >> _SHIFT
        a, b, d = r * a, r * b, code - low
        first, upto = d < a, d < b
        r = (span - b) >> _SHIFT0
        v = np.minimum((d - b) // r, _FREQ).astype(np.int64)  # no value where the symbol was predicted
        x = np.where(first, c2, np.where(upto, c1, place.take(v)))
        e = table.range.take(x)
        low += np.where(first, np.uint64(0), np.where(upto, a, b + r * (e >> _SHIFT0)))
        span = np.where(first, a, np.where(upto, b - a, r * ((e & _FREQ) + np.uint64(1))))
        tight = np.flatnonzero(span <= _LOW32)
        if len(tight):
            lo, sp, to = low.take(tight), span.take(tight), at.take(tight)
            split = (lo ^ (lo + sp - np.uint64(1))) >> _S32 != 0
            sp = np.where(split, (~lo & _LOW32) + np.uint64(1), sp)
            code[tight] = (code.take(tight) << _S32) | data.take(np.minimum(to, last))
            at[tight] = to + 1
            low[tight] = lo << _S32
            span[tight] = np.minimum(sp, _LOW32) << _S32
        grid[t] = x
        model.learn(x, first, upto)
    return spread(grid.T.reshape(-1)[:many], *table.symbols()).astype("<u4")
