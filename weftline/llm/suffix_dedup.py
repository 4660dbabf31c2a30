"""Substring dedup by a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, repeats


#: Suffixes of each array whose strings are in memory at a time while two arrays are scanned.
BLOCK = 1 << 15


class Level:
    """A text and places in it, in the order of the strings that start there."""

    def __init__(self, text: np.ndarray, places: np.ndarray):
        self.text, self.places = text, places

    def strings(self, lo: int, hi: int, depth: int) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, depth)[self.places[lo:hi]]).view(f"S{depth}").ravel()


class Family:
    """Suffix arrays, each at least twice as large as the next. An array has the places of suffixes, in
    order of their first `depth` bytes, as no longer match is asked for, and of each such string the
    first place only."""

    def __init__(self, depth: int):
        self.depth = depth
        self.levels: list[Level] = []

    def add(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Takes in the suffixes at the places of a batch; True where the string came before, in the
        batch or in a batch before it. b has no zero bytes, as numpy's strings end in those."""
        rank = repeats.ranks(b, self.depth)[at]
        order = repeats.ordered(rank)
        first = np.append(True, np.diff(rank[order]) != 0)[: len(at)]
        group = np.cumsum(first) - 1
        new = Level(b, at[order][first])
        old = np.zeros(len(new.places), bool)
        for level in self.levels:
            for place, again in self._scan(level, new):
                old[place[again & (place >= 0)]] = True
        before = np.empty(len(at), bool)
        before[order] = ~first | old[group]
        self._insert(Level(b, new.places[~old]))
        return before

    def _scan(self, x: Level, y: Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both arrays from start to end, merged block by block: which suffix comes next (of y from 0 on,
        of x from -1 downwards), and whether its string is that of the suffix before it."""
        i = j = 0
        while i < len(x.places) or j < len(y.places):
            u, v = x.strings(i, i + BLOCK, self.depth), y.strings(j, j + BLOCK, self.depth)
            ends = [s[-1] for s, more in ((u, i + BLOCK < len(x.places)), (v, j + BLOCK < len(y.places))) if more]
            if ends:  # beyond the lesser end of a block the next one may have more
                upto = min(ends)
                u, v = u[: np.searchsorted(u, upto, "right")], v[: np.searchsorted(v, upto, "right")]
            both = np.concatenate([u, v])
            order = np.argsort(both, kind="stable")  # two runs in order: one merge
            both = both[order]
            yield np.where(order < len(u), -1 - i - order, j + order - len(u)), np.append(False, both[1:] == both[:-1])[: len(both)]
            i, j = i + len(u), j + len(v)

    def _insert(self, new: Level) -> None:
        while self.levels and len(self.levels[-1].places) < 2 * len(new.places):
            old = self.levels.pop()
            order = np.concatenate([place for place, _ in self._scan(old, new)])
            of_old, places = order < 0, np.empty(len(order), np.int64)
            places[of_old] = old.places[-1 - order[of_old]]
            places[~of_old] = len(old.text) + new.places[order[~of_old]]
            new = Level(np.concatenate([old.text, new.text]), places)
        if len(new.places):
            self.levels.append(new)


def _index(unit: repeats.Unit, batch: int):
    def run(table: pa.Table) -> pa.Table:
        """One task of a cell: its texts in order, by batches into the family. A text that came before
        goes as a whole."""
        pieces, w = repeats.Pieces(table), unit.window
        b = pieces.b + np.uint8(1)  # UTF-8 has no byte 255
        family, rows = Family(w), []
        size = np.diff(pieces.bounds)
        every = np.arange(len(size))
        later = np.ones(len(pieces.code), bool)
        later[pieces.first] = False
        rows.append(pieces.rows_of(every, np.zeros(len(size), np.int64), size, np.flatnonzero(later)))
        for lo, hi in hashing.chunks(pieces.bounds, batch):
            part = b[pieces.bounds[lo] : pieces.bounds[hi]]
            inside = repeats.Texts(part, pieces.bounds[lo : hi + 1] - pieces.bounds[lo], unit)
            at = np.flatnonzero(inside.whole(w))
            if not len(at):
                continue
            before = family.add(part, at)
            text = np.searchsorted(inside.first, at, "right") - 1
            place = at - inside.first[text]
            rows.append(pieces.rows_of(*repeats.merged(lo + text[before], place[before], w), np.sort(pieces.first[lo:hi])))
            if pieces.salted:
                left = ~before
                one, two = (repeats.run_hashes(inside.units, w, base)[at[left]] for base in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407))
                rows.append(pieces.undecided(lo + text[left], place[left], w, one, two, np.ones(int(left.sum()), np.int64)))
        return repeats.found_table(rows)

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = 32, load: int = 4000, batch: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) for each row of docs.

    A byte goes if a string of `window` bytes of its text covers it that also starts earlier: in a text
    of smaller id, or earlier in its own. Strings are judged on the input. Passages that may recur are
    brought together by repeats.py; a task puts them by batches, in order of id, into a family of suffix
    arrays. Each batch gets its own array, is merge-scanned against the existing levels for matches of
    the whole window, and arrays of like size merge. Only one task's passages are in memory. Where one
    anchor is too much for a task, strings that come first in a task are settled over all tasks by the
    first place of their 128-bit hash.

    Null texts count as empty. A null id comes after all others. Rows repeated under one id and text
    count as one text; different texts under one id are documents one after the other, in the order of a
    hash of their text. Texts shorter than the window lose
    nothing. An empty table gives no rows; other columns are ignored.
    """
    unit = repeats.Unit(window, gram, False, load)
    keyed, found = repeats.routed(docs, unit, _index(unit, batch), id_col, text_col)
    decided = found.filter("n = 0").select("key", "id", "lo", "hi")
    place = F.struct("id", "key", "lo")
    first = found.filter("n > 0").groupBy("a", "b").agg(F.min(place).alias("first"))
    settled = found.filter("n > 0").join(first, ["a", "b"]).filter(place > F.col("first")).select("key", "id", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            for text, spans in zip(pc.fill_null(some.column(1), ""), some.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_py()) else np.zeros(0, np.uint8)
                out = repeats.removed(spans, len(data))
                stay = data[~out].tobytes()
                n.append(len(data))
                gone.append(int(out.sum()))
                runs.append(int((out[1:] & ~out[:-1]).sum()) + int(len(out) > 0 and out[0]))
                sha.append(hashlib.sha256(stay).hexdigest())
                if with_text:
                    kept.append(stay)
            cols = [some.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, runs)], pa.array(sha, pa.string()), *[pa.array(kept, pa.binary())] * with_text]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_text])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    text, nothing = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    untouched = keyed.select("key", "order", "id", F.octet_length(text).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *[F.encode(text, "utf-8").alias("kept_bytes")] * with_text)
    return repeats.by_document(keyed, decided.union(settled), run, schema, untouched).withColumnRenamed("id", id_col)
