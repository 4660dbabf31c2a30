"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, hashing, repeats

#: Every byte as a lower-case letter, digit or part of a character beyond ASCII, or else a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


class Words:
    """The folded words of texts that lie one after the other, with their hashes."""

    def __init__(self, b: np.ndarray, bounds: np.ndarray):
        self.b = _FOLD[b]
        self.starts, self.ends, self.first = hashing.words(self.b, bounds)
        self.hashes = hashing.word_hashes(self.b, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def prints(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place the winnowed fingerprint of the window of so many words that starts there: the least hash
        of its runs of `gram` words; and whether such a window is there, in one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        least = repeats._slide(repeats.run_hashes(self.hashes, gram), size - gram + 1, np.minimum)
        return least, self.text[:n] == self.text[size - 1 :]

    def words_of(self, at: int, size: int) -> str:
        return b" ".join(self.b[s:e].tobytes() for s, e in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist(), strict=True)).decode()


def _gram(size: int, gram: int) -> int:
    return min(gram, size)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def benchmark_windows(items: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """item, size, print, words for each window of each item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(1))
            for lo, hi in hashing.chunks(bounds):
                w = Words(b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                count = np.diff(w.first)
                rows = []
                for size in np.unique(np.minimum(window, count[count > 0])).tolist():
                    least, fits = w.prints(size, _gram(size, gram))
                    fits &= (np.minimum(window, count) == size)[w.text[: len(fits)]]
                    rows += [(lo + int(w.text[p]), size, int(least[p : p + 1].view(np.int64)[0]), w.words_of(p, size)) for p in np.flatnonzero(fits).tolist()]
                for k in range(0, len(rows), 10_000):
                    item, size, least, words = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), pa.array(size, pa.int32()), pa.array(least, pa.int64()), pa.array(words)], ["item", "size", "print", "words"])

    return items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), "item string, size int, print long, words string")


def _fingerprints(docs: DataFrame, sizes: list[int], gram: int) -> DataFrame:
    """a, b, size, print: the fingerprints of each document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(0))
            for lo, hi in hashing.chunks(bounds):
                w = Words(b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for size in sizes:
                    least, fits = w.prints(size, _gram(size, gram))
                    at = np.flatnonzero(fits)
                    of, least = w.text[at], least[at]
                    order = np.lexsort((least, of))
                    of, least = of[order], least[order]
                    new = np.append(True, (np.diff(of) != 0) | (least[1:] != least[:-1]))[: len(of)]
                    row = pa.array(lo + of[new])
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(row), batch.column(2).take(row), pa.array(np.full(len(row), size, np.int32)), pa.array(least[new].view(np.int64))], ["a", "b", "size", "print"])

    return docs.select("text", "key.a", "key.b").mapInArrow(common.lean(run), "a long, b long, size int, print long")


_HITS = "array<struct<start:int,size:int,words:string>>"


def _extended(docs: DataFrame, sizes: list[int], gram: int, shared: dict[int, np.ndarray] | None) -> DataFrame:
    """id, key, n_words, hits for each document: the windows whose fingerprint is shared, with their words. shared:
    fingerprints by window size; where there are none, docs has its own in the column `prints`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(1))
            n_words, counts, starts, lengths, words = [], [], [], [], []
            for lo, hi in hashing.chunks(bounds):
                w = Words(b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                n_words.append(np.diff(w.first))
                found = [np.zeros((2, 0), np.int64)]
                for size in sizes:
                    least, fits = w.prints(size, _gram(size, gram))
                    if shared is not None:
                        hit = np.flatnonzero(fits & _among(least, shared[size]))
                    else:
                        hit = [np.zeros(0, np.int64)]
                        for i in range(lo, hi):  # each document has fingerprints of its own
                            own = batch.column(4)[i].values
                            mine = own.field("print").to_numpy().view(np.uint64)[own.field("size").to_numpy() == size]
                            span = slice(w.first[i - lo], w.first[i - lo + 1])
                            hit.append(span.start + np.flatnonzero(fits[span] & _among(least[span], np.sort(mine))))
                        hit = np.concatenate(hit)
                    found.append(np.stack([hit, np.full(len(hit), size)]))
                at, size = np.concatenate(found, 1)
                order = np.lexsort((size, at))
                at, size = at[order], size[order]
                counts.append(np.bincount(w.text[at], minlength=hi - lo))
                starts.append(at - w.first[w.text[at]])
                lengths.append(size)
                words += [w.words_of(p, s) for p, s in zip(at.tolist(), size.tolist(), strict=True)]
            if not n_words:
                continue
            structs = pa.StructArray.from_arrays([pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(lengths), pa.int32()), pa.array(words, pa.string())], ["start", "size", "words"])
            hits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(counts))), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.concatenate(n_words), pa.int64()), hits], ["id", "a", "b", "n_words", "hits"])

    columns = ["id", "text", "key.a", "key.b"] + ["prints"] * (shared is None)
    return docs.select(*columns).mapInArrow(common.lean(run), f"id {docs.schema['id'].dataType.simpleString()}, a long, b long, n_words long, hits {_HITS}")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, in_memory: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated (and spans, the runs of words [lo, hi) that are hit)
    for each row of docs.

    Words are runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. A window is `window`
    consecutive words of an item, or all of an item that has fewer. A word of a document is hit if an
    occurrence of a window covers it. A window's fingerprint is the least hash among its runs of `gram`
    words, so every shared window has its fingerprint in both texts. Fingerprints of both sides are joined; of a
    shared one the windows it stands for are extended to all their words and joined with the windows of
    items on these words. Up to `in_memory` different fingerprints of items (8 bytes each) go to the tasks
    that read the documents, and the join happens there, without fingerprints of documents being
    moved; beyond, both sides are tables that are joined by key. Results are the same. Documents with the same
    set of windows look their items up once.

    Null texts have no words; documents and items without words are never hit. Repeated rows have results of
    their own; items repeated under one id count once, different texts under one id are windows of one item;
    a null item id is listed as an empty string. Empty tables give no rows, or rows without hits. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    windows = common.store(benchmark_windows(items, window, gram, item_col, item_text_col), "item-windows")
    prints = windows.select("size", "print").distinct()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # window of them at most
    known = common.store(windows.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    listed = common.store(windows.join(known, "words").select("w", F.coalesce("item", F.lit("")).alias("item")).distinct(), "items-of-windows")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Two hashes of id and text stand for a document; equal rows have one key and equal results.
    d = d.withColumn("key", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(1), "id", "text").alias("b")))
    if prints.count() <= in_memory:
        table = prints.toPandas()
        shared = {s: np.sort(table["print"][table["size"] == s].to_numpy().view(np.uint64)) for s in sizes}
        scanned = _extended(d, sizes, gram, shared)
    else:
        posted = common.store(_fingerprints(d, sizes, gram), "fingerprints")
        met = posted.join(prints, ["size", "print"]).groupBy("a", "b").agg(F.collect_set(F.struct("size", "print")).alias("prints"))
        d = d.select("id", "text", "key", "key.a", "key.b").join(met, ["a", "b"], "left")
        none = F.array().cast("array<struct<size:int,print:bigint>>")
        scanned = _extended(d.withColumn("prints", F.coalesce("prints", none)), sizes, gram, None)
    scanned = common.store(scanned, "scanned")
    open_ = scanned.filter(F.size("hits") > 0)
    seen = open_.dropDuplicates(["a", "b"]).select("a", "b", F.explode("hits").alias("h")).select("a", "b", "h.*")
    hits = common.store(seen.join(known, "words").select("a", "b", "start", (F.col("start") + F.col("size")).alias("end"), "w"), "hits")

    before = W.Window.partitionBy("a", "b").orderBy("start", "end").rowsBetween(W.Window.unboundedPreceding, -1)
    reach = hits.select("a", "b", "start", "end").withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = reach.groupBy("a", "b").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("n_hit"))
    sets = hits.groupBy("a", "b").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    once = sets.select("ws").distinct().select("ws", F.explode("ws").alias("w")).join(listed, "w")
    names = once.groupBy("ws").agg(F.sort_array(F.collect_set("item")).alias("items"))
    names = names.select("ws", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = covered.join(sets, ["a", "b"]).join(names, "ws").drop("ws")
    extra = []
    if with_spans:
        new = F.sum((F.col("start") > F.col("reach")).cast("int")).over(W.Window.partitionBy("a", "b").orderBy("start", "end"))
        spans = reach.withColumn("run", new).groupBy("a", "b", "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
        spans = spans.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        found, extra = found.join(spans, ["a", "b"]), ["spans"]
    out = ["id", "n_words", "n_hit", "n_items", "items_sha256", *extra]
    base = open_.drop("hits").join(found, ["a", "b"], "left").select(*out)
    base = base.union(scanned.filter(F.size("hits") == 0).select("id", "n_words", *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in out[2:]]))
    no_span = F.filter(F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))), lambda _: F.lit(False))
    fill = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256), "spans": no_span}
    filled = [F.coalesce(c, fill[c]).alias(c) if c in fill else F.col(c) for c in out]
    return base.select(*filled[:5], (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *filled[5:]).withColumnRenamed("id", id_col)
