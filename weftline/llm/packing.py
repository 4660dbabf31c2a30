"""Packing of documents into sequences by patterns of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common
from .tokens import tokenizer, with_end

_PIECES = "id {kind}, piece int, start long, length long, ids_crc32 long, pid int, turn long"


def patterns(counts: dict[int, int], capacity: int, per_length: int = 8, most: int = 6, seed: int = 1) -> list[tuple[int, ...]]:
    """Few-document patterns that nearly fill a sequence: for each length its best partner, and fills
    with lengths drawn as often as they occur, closed by the longest length that fits."""
    lengths = sorted(counts)
    weight = np.cumsum([counts[n] for n in lengths]).astype(float)
    draw = np.random.default_rng(seed)
    found = set()
    for n in lengths:
        if n == capacity:
            found.add((n,))
        for trial in range(per_length):
            rest, parts = capacity - n, [n]
            while rest >= lengths[0] and len(parts) < most:
                upto = bisect.bisect_right(lengths, rest)
                if trial == 0 or len(parts) == most - 1 or draw.random() < 0.3:
                    part = lengths[upto - 1]
                else:
                    part = lengths[min(upto - 1, int(np.searchsorted(weight[:upto], draw.random() * weight[upto - 1], "right")))]
                parts.append(part)
                rest -= part
            if rest <= capacity // 256:
                found.add(tuple(sorted(parts, reverse=True)))
    return sorted(found, reverse=True)


def fit(found: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 300) -> np.ndarray:
    """How often each pattern is used: non-negative least squares to the histogram, by multiplicative
    updates, which keep every entry at 0 or above."""
    place = {n: i for i, n in enumerate(sorted(counts))}
    h = np.array([counts[n] for n in sorted(counts)], float)
    cells = Counter((k, place[n]) for k, p in enumerate(found) for n in p)
    col, row = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    many = np.array(list(cells.values()), float)
    x = np.full(len(found), h.sum() / max(1, many.sum()))
    to = np.bincount(col, many * h[row], len(found))
    for _ in range(rounds):
        made = np.bincount(row, many * x[col], len(h))
        x *= to / np.maximum(np.bincount(col, many * made[row], len(found)), 1e-12)
    return x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram. The fit is rounded down and never uses more than
    there is; what is left goes longest first, each time with the longest lengths that still fit, and
    such a fill is repeated until one of its lengths runs out. Work is by length, not by document."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    found = patterns(left, capacity) if left else []
    if found:
        x = fit(found, left)
        for k in np.argsort(-x, kind="stable"):
            need = Counter(found[k])
            times = min(int(x[k]), min(left[n] // m for n, m in need.items()))
            if times:
                out.append((found[k], times))
                for n, m in need.items():
                    left[n] -= m * times
    lengths = sorted(n for n, c in left.items() if c)
    while lengths:
        rest, parts, used = capacity, [], Counter()
        upto = len(lengths)
        while upto:
            n = lengths[upto - 1]
            m = min(rest // n, left[n])
            parts += [n] * m
            used[n] += m
            rest -= n * m
            upto = min(upto - 1, bisect.bisect_right(lengths, rest))
        times = min(left[n] // m for n, m in used.items() if m)
        out.append((tuple(parts), times))
        for n, m in used.items():
            left[n] -= m * times
            if m and not left[n]:
                lengths.remove(n)
    return out


class _Places:
    """Where the r-th piece of a length goes: as many rows as the plan has (pattern, length) pairs. A plan has
    at most per_length + 1 fitted patterns for each of `capacity` lengths, and each fill of the rest uses up
    a length; so its size is bounded by the capacity, whatever the corpus, and it is sent to all tasks."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        rows, given, first = [], Counter(), 0
        spots: list[int] = []
        for pattern, times in made:
            at, offsets = 0, {}
            for n in pattern:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, where in offsets.items():
                rows.append((n, given[n], first, len(where), len(spots)))
                spots += where
                given[n] += times * len(where)
            first += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        self.key, self.rank, self.first, self.many, self.spot = (cols[0] << 44) + cols[1], *cols[1:]
        self.spots = np.array(spots, np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        k = rank - self.rank[row]
        return self.first[row] + k // self.many[row], self.spots[self.spot[row] + k % self.many[row]]


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pid, seen = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, bounds = with_end(*tok.encode(batch.column(1)), end)
            size = np.diff(bounds)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = bounds[doc] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            of = length[order]
            new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            turn = np.empty(len(of), np.int64)
            turn[order] = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of)))) + seen[of]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid), pa.int32()), pa.array(turn)], ["id", "piece", "start", "length", "ids_crc32", "pid", "turn"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), _PIECES.format(kind=kind))


def pack(docs: DataFrame, path: str, end: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Each document's ids and the end id are cut into pieces of `capacity` where they are longer. The
    histogram of lengths (at most `capacity` rows, whatever the corpus) goes to the driver, which plans
    sequences by length alone; a piece finds its place from its rank among the pieces of its length:
    the rank inside its partition plus the counts of the partitions before.

    Null and empty texts are packed as their end id; rows repeated under one id are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    made = common.store(token_pieces(docs, path, end, capacity, id_col, text_col), "pieces")
    counts = made.groupBy("pid", "length").agg(F.count("*").alias("n"))
    counts = common.store(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = W.Window.partitionBy("length").orderBy("pid").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(counts, ["pid", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("turn") + F.col("before")).alias("rank"))
    places = docs.sparkSession.sparkContext.broadcast(_Places(plan(histogram, capacity)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(put, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
