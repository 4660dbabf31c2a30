"""Routing of repeated passages: what must meet to tell which windows of a corpus occur twice.

A window is a fixed number of units (words or bytes) of one document. Of the short runs of units
("grams") in a window the one with the smallest hash is its anchor, so equal windows have equal anchors
at equal places, and only a few hundredths of all grams are anchors. A gram that is an anchor once in
the whole corpus proves its windows unique. Every other gram gets a cell, and documents send the runs of
windows whose anchors have one cell, as pieces of text, to that cell's task: all windows with one anchor
meet there. Grams whose first holder is the same share a cell, so neighbours mostly stay in one piece; a
cell that would be too large is dealt again by gram. Only a gram that by itself is too much for one task
is dealt by document, over several tasks, whose undecided windows are settled by their 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing


@dataclass(frozen=True)
class Unit:
    window: int
    gram: int
    words: bool  # else bytes
    #: Anchors whose windows one task takes, about.
    load: int


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive values."""
    s = 1
    while s * 2 <= n:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (n - s)], x[n - s :]) if n > s else x


def run_hashes(units: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each n consecutive units, from one running sum."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    upto = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * hashing.powers(base, len(units)), out=upto[1:])
    return hashing.mixed((upto[n:] - upto[:-n]) * hashing.powers(pow(base, -1, 1 << 64), len(units) + 1)[: len(units) - n + 1])


class Texts:
    """The units of texts that lie one after the other. first: each text's first unit, and the end."""

    def __init__(self, b: np.ndarray, bounds: np.ndarray, unit: Unit):
        self.b, self.unit = b, unit
        if unit.words:
            self.starts, self.ends, self.first = hashing.words(b, bounds)
            self.units = hashing.word_hashes(b, self.starts, self.ends)
        else:
            self.first = bounds
            self.units = hashing.mixed(hashing._BYTE)[b]

    def slice(self, lo: int, hi: int) -> bytes:
        if self.unit.words:
            return self.b[self.starts[lo] : self.ends[hi - 1]].tobytes()
        return self.b[lo:hi].tobytes()

    def whole(self, n: int) -> np.ndarray:
        """Whether the n units from each place on are of one text, as far as a run of n exists."""
        end = np.repeat(self.first[1:], np.diff(self.first))[: max(0, len(self.units) - n + 1)]
        return np.arange(len(end)) + n <= end

    def window_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window's anchor, 0 where no window fits, and the hashes of all grams."""
        w, g = self.unit.window, self.unit.gram
        fits = self.whole(w)
        if not fits.any():
            return np.zeros(len(fits), np.uint64), np.zeros(0, np.uint64)
        hashes = run_hashes(self.units, g) | np.uint64(1)
        return np.where(fits, _slide(hashes, w - g + 1, np.minimum), np.uint64(0)), hashes

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all anchors."""
        least, hashes = self.window_anchors()
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        width = self.unit.window - self.unit.gram + 1
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)
        return at, hashes[at]


def _in_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys of so many bits. Values sort faster than places do, so where both fit into
    64 bits they are sorted as one number."""
    wide = np.uint64(max(1, len(keys) - 1).bit_length())
    if bits + int(wide) > 64:
        return np.argsort(keys, kind="stable")
    packed = (keys << wide) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << wide) - np.uint64(1))).view(np.int64)


def ordered(ranks: np.ndarray) -> np.ndarray:
    """The stable order of dense ranks."""
    return _in_order(ranks, int(ranks.max(initial=0)).bit_length())


def ranks(units: np.ndarray, n: int) -> np.ndarray:
    """The rank of each n consecutive units among all such runs, in order of their units, by doubling:
    equal runs, and only those, have equal ranks. Units are unsigned; for bytes the first step takes five."""

    def dense(keys: np.ndarray, bits: int) -> np.ndarray:
        order = _in_order(keys, bits)
        keys = keys[order]
        out = np.empty(len(keys), np.uint64)
        out[order] = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        return out

    if len(units) < n:
        return np.zeros(0, np.uint64)
    size = 5 if units.dtype == np.uint8 and n >= 5 else 1
    keys = units.astype(np.uint64)
    for k in range(1, size):
        keys = (keys[:-1] << np.uint64(8)) | units[k:]
    at = dense(keys, int(keys.max()).bit_length())
    while size < n:
        step, wide = min(size, n - size), int(at.max()).bit_length()
        at = dense((at[:-step] << np.uint64(wide)) | at[step:], 2 * wide)
        size += step
    return at


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, a key for (id, text) and the id's place in order: equal rows have one key, and equal results."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("order"))


def _postings(docs: DataFrame, unit: Unit) -> DataFrame:
    """gram, key, n (1, or 2 for more) for each anchor and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(0))
            key = batch.column(1).to_numpy()
            for lo, hi in hashing.chunks(bounds):
                texts = Texts(b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], unit)
                at, h = texts.anchors()
                of = np.searchsorted(texts.first, at, "right") - 1
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                place = np.flatnonzero(new)
                n = np.minimum(2, np.diff(np.append(place, len(h))))
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(key[lo:hi][of[place]]), pa.array(n.astype(np.int32))], ["gram", "key", "n"])

    return docs.select("text", "key").mapInArrow(common.lean(run), "gram long, key long, n int")


_PIECE = "cell long, salt int, salts int, key long, id long, start long, piece binary"


def _pieces(docs: DataFrame, unit: Unit) -> DataFrame:
    """For each cell of each document the windows whose anchor has that cell, neighbours in one piece."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["cell", "salt", "salts", "key", "id", "start", "piece"])

    def pieces_of(texts: Texts, route: pa.StructArray, key: int, order: int) -> Iterator[tuple]:
        want, cell, salts = route.field("gram").to_numpy().view(np.uint64), route.field("cell").to_numpy(), route.field("salts").to_numpy()
        by_hash = np.argsort(want)
        want, cell, salts = want[by_hash], cell[by_hash], salts[by_hash]
        _, kind = np.unique(cell, return_inverse=True)
        least, _ = texts.window_anchors()
        place = np.minimum(np.searchsorted(want, least), len(want) - 1)
        home = np.where(want[place] == least, kind[place], -1)
        cut = np.flatnonzero(np.diff(home)) + 1
        for a, z in zip(np.append(0, cut).tolist(), np.append(cut, len(home)).tolist(), strict=True):
            if z > a and home[a] >= 0:
                n = int(salts[place[a]])
                yield int(cell[place[a]]), key % n, n, key, order, a, texts.slice(a, z - 1 + unit.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(0))
            keys, orders, routes = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                texts = Texts(b[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]), unit)
                for piece in pieces_of(texts, routes[i].values, keys[i], orders[i]):
                    out.append(piece)
                    size += len(piece[-1])
                    if size > 1 << 20 or len(out) >= 2000:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return docs.select("text", "key", "order", "routes").mapInArrow(common.lean(run), _PIECE)


class Pieces:
    """What one task of a cell has: its pieces in order of document and place, each text once. distinct:
    the texts as Texts of bytes, in order of first appearance; code: the text of each row; times: how
    often each text is there, rows repeated counted; rows repeated under one key and place are one row."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("key", "ascending"), ("start", "ascending")])
        self.key, self.id, self.start = (table[c].to_numpy() for c in ("key", "id", "start"))
        self.salted = bool(table.num_rows) and table["salts"][0].as_py() > 1
        pieces = pa.concat_arrays(table["piece"].chunks) if table["piece"].num_chunks else pa.array([], pa.binary())
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        self.times = np.bincount(code, minlength=len(coded.dictionary))
        new = np.ones(len(code), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.start[1:] != self.start[:-1]) | (self.id[1:] != self.id[:-1])
        self.key, self.id, self.start, self.code = self.key[new], self.id[new], self.start[new], code[new]
        self.b, self.bounds = hashing.text_bytes(coded.dictionary)
        self.first = np.zeros(len(self.times), np.int64)  # the first row of each text
        self.first[self.code[::-1]] = np.arange(len(self.code))[::-1]

    def rows_of(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray | None = None) -> tuple:
        """Spans inside texts, as rows of FOUND for each of the given rows (all, if none are) that has the text."""
        rows = np.arange(len(self.code)) if rows is None else rows
        many = np.bincount(text, minlength=len(self.times))
        begin = np.cumsum(many) - many
        count = many[self.code[rows]]
        at = np.repeat(begin[self.code[rows]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        rows = np.repeat(rows, count)
        zero = np.zeros(len(rows), np.int64)
        return self.key[rows], self.id[rows], self.start[rows] + lo[at], self.start[rows] + hi[at], zero, zero, zero

    def undecided(self, text: np.ndarray, place: np.ndarray, window: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple:
        """Windows at places of texts, as rows of FOUND for the first row of their text."""
        row = self.first[text]
        return self.key[row], self.id[row], self.start[row] + place, self.start[row] + place + window, a.view(np.int64), b.view(np.int64), n.astype(np.int64)


#: What a cell's task says: units [lo, hi) of a document go; or, where a and b are set, that in one of
#: several tasks of a cell the window at lo with this hash is still undecided, n: its occurrences there.
FOUND = "key long, id long, lo long, hi long, a long, b long, n int"


def found_table(rows: list[tuple]) -> pa.Table:
    flat = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 7
    hidden = flat[6] == 0
    return pa.table([*[pa.array(c, pa.int64()) for c in flat[:4]], pa.array(flat[4], pa.int64(), mask=hidden), pa.array(flat[5], pa.int64(), mask=hidden), pa.array(flat[6].astype(np.int32), pa.int32())], ["key", "id", "lo", "hi", "a", "b", "n"])


def routed(docs: DataFrame, unit: Unit, task: Callable[[pa.Table], pa.Table], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, what the cells' tasks found)."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    posted = common.store(_postings(keyed, unit), "anchors")
    grams = common.store(posted.groupBy("gram").agg(F.min("key").alias("home"), F.sum("n").alias("n")).filter("n > 1"), "grams")
    shards = max(4 * common.partitions(spark), (grams.agg(F.sum("n")).first()[0] or 0) // unit.load)
    hot = F.col("n") > unit.load
    grams = grams.withColumn("shard", F.when(hot, F.lit(-1)).otherwise(F.pmod("home", F.lit(shards))))
    large = grams.filter(~hot).groupBy("shard").agg(F.sum("n").alias("all")).filter(F.col("all") > 2 * unit.load).select("shard", F.ceil(F.col("all") / unit.load).alias("parts"))
    part = F.when(hot, F.xxhash64("gram")).otherwise(F.coalesce(F.pmod(F.xxhash64("gram"), F.col("parts")), F.lit(0)))
    salts = F.when(hot, F.ceil(F.col("n") / unit.load)).otherwise(1).cast("int")
    cells = grams.join(large, "shard", "left").select("gram", F.xxhash64("shard", part).alias("cell"), salts.alias("salts"))
    routes = posted.select("gram", "key").join(cells, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "cell", "salts")).alias("routes"))
    routes = common.store(routes, "routes")
    near = common.with_keys(keyed, common.store(routes.select("key"), "keys"), "key")
    pieces = _pieces(near.join(routes, "key"), unit)
    return keyed, common.store(pieces.groupBy("cell", "salt").applyInArrow(common.tidy(task), FOUND), "found")


def by_document(keyed: DataFrame, found: DataFrame, run: Callable, schema: str, untouched: DataFrame) -> DataFrame:
    """A row for each document. Those with spans to remove are joined to them, as id, text, spans, and go
    through run; for all others untouched has the row, with key and order, so that no text is moved."""
    spans = common.store(found.groupBy("key", F.col("id").alias("order")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    keys = common.store(spans.select("key").distinct(), "keys")
    cut = common.with_keys(keyed, keys, "key").join(spans, ["key", "order"]).select("id", "text", "spans").mapInArrow(common.lean(run), schema)
    cut = common.store(cut, "cut")
    return cut.union(untouched.join(spans.select("key", "order"), ["key", "order"], "left_anti").drop("key", "order"))


def removed(spans, n: int) -> np.ndarray:
    """Which of n units the spans of one document cover; spans: a scalar list of lo, hi."""
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, spans.values.field("lo").to_numpy(), 1)
    np.add.at(out, spans.values.field("hi").to_numpy(), -1)
    return np.cumsum(out)[:n] > 0


def merged(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at places of texts, in order, as (text, lo, hi) with neighbours put together."""
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] > at[:-1] + window)
    first = np.flatnonzero(new)
    return text[first], at[first], at[np.append(first[1:], len(at)) - 1] + window
