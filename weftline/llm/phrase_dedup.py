"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing, repeats

#: Passages that are compiled into one automaton, which has about as many nodes for each as it has words.
PASSAGES = 2048
#: Code points that stand for words, from 0x10000 on; with more distinct words an automaton takes numbers.
LETTERS = 0x100000


def word_codes(texts: repeats.Texts) -> np.ndarray:
    """A number for each word; equal words, and only those, have equal numbers."""
    size = texts.ends - texts.starts
    inside = np.zeros(len(texts.b) + 1, np.int32)
    np.add.at(inside, texts.starts, 1)
    np.add.at(inside, texts.ends, -1)
    solid = texts.b[np.cumsum(inside)[:-1] > 0]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy().astype(np.uint64)


def compiled(passages: list):
    """An automaton of passages, each a string or a tuple of numbers."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_STRING if isinstance(passages[0], str) else ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        automaton.add_word(passage)
    automaton.make_automaton()
    return automaton


def occurrences(codes: np.ndarray, anchors: np.ndarray, passages: np.ndarray, n: int) -> np.ndarray:
    """Where the passages, n words from these places on, occur. anchors: for each place that of the n
    words there, 0 where they aren't of one text. Passages with one anchor are in one automaton, with
    those of neighbouring anchors; all words whose anchors an automaton has are streamed through it."""
    if not len(passages):
        return passages
    if int(codes.max()) < LETTERS:
        letters = (codes + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
    else:
        letters = tuple(codes.tolist())
    passages = np.sort(passages)
    kinds, first, kind = np.unique(anchors[passages], return_index=True, return_inverse=True)
    order, many = np.argsort(first), np.bincount(kind)
    turn = np.empty(len(kinds), np.int64)
    turn[order] = (np.cumsum(many[order]) - many[order]) // PASSAGES
    place = np.minimum(np.searchsorted(kinds, anchors), len(kinds) - 1)
    needs = np.where(kinds[place] == anchors, turn[place], -1)
    cut = np.flatnonzero(np.diff(needs)) + 1
    runs = np.stack([np.append(0, cut), np.append(cut, len(needs))], 1)
    needs = needs[runs[:, 0]]
    found = []
    for k in np.unique(turn).tolist():
        automaton = compiled([letters[p : p + n] for p in passages[turn[kind] == k].tolist()])
        for a, z in runs[needs == k].tolist():
            text = letters[a : z + n - 1]
            found += [a + end for end, _ in automaton.iter(text)]
    return np.sort(np.array(found, np.int64)) - (n - 1)


def _automata(unit: repeats.Unit):
    def run(table: pa.Table) -> pa.Table:
        """One task of a cell: confirms the windows that recur, word by word, compiles them into
        automata and streams the cell's texts through those; the windows that go are their hits."""
        pieces, w = repeats.Pieces(table), unit.window
        texts = repeats.Texts(pieces.b, pieces.bounds, unit)
        at = np.flatnonzero(texts.whole(w))
        if not len(at):
            return repeats.found_table([])
        codes = word_codes(texts)
        text = np.searchsorted(texts.first, at, "right") - 1
        rank = repeats.ranks(codes, w)[at].astype(np.int64)
        _, pick, back = np.unique(rank, return_index=True, return_inverse=True)
        count = np.bincount(back, pieces.times[text])
        hits = occurrences(codes, texts.window_anchors()[0], at[pick[count > 1]], w)
        of = np.searchsorted(texts.first, hits, "right") - 1
        rows = [pieces.rows_of(*repeats.merged(of, hits - texts.first[of], w))]
        if pieces.salted:
            # A window may lie in pieces for other cells, too; what counts is how often it is in this one.
            cell = hashing.mixed(table["cell"].to_numpy()[:1].view(np.uint64))
            a, b = (repeats.run_hashes(texts.units, w, base)[at[pick]] for base in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407))
            rows.append(pieces.undecided(text[pick], (at - texts.first[text])[pick], w, a, b ^ cell, np.minimum(count, 2)))
        return repeats.found_table(rows)

    return run


def remove_repeated(docs: DataFrame, window: int = 35, gram: int = 10, load: int = 4000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (and kept_text) for each row of docs.

    A word goes if a window of `window` consecutive words of its document covers it whose words also
    start anywhere else, in this or another document; what is kept is joined by one space. Windows are
    judged on the input. repeats.py brings together all passages whose anchor phrase of `gram` words
    recurs anywhere; a task confirms the windows among them that recur, on the words themselves,
    compiles these into automata and streams its passages through them to locate every occurrence.
    Texts without a recurring phrase have nothing to be streamed for. Where one phrase is too much for
    a task, windows that occur once in a task are settled over all tasks by 128 bits.

    Null and empty texts have no words. Rows repeated under one id and text are further occurrences, so
    whole texts go. Texts with fewer words than a window lose nothing. An empty table gives no rows;
    other columns are ignored.
    """
    unit = repeats.Unit(window, gram, True, load)
    keyed, found = repeats.routed(docs, unit, _automata(unit), id_col, text_col)
    decided = found.filter("n = 0").select("key", "id", "lo", "hi")
    again = found.filter("n > 0").groupBy("a", "b").agg(F.sum("n").alias("all")).filter("all > 1").select("a", "b")
    settled = found.filter("n = 1").join(again, ["a", "b"]).select("key", "id", "lo", "hi")

    def results(ids: pa.Array, words: list[list[bytes]], out: list[np.ndarray | None]) -> tuple[list, list[str]]:
        stay = [b" ".join(w if o is None else compress(w, (~o).tolist())) for w, o in zip(words, out, strict=True)]
        cols = [ids, pa.array([len(w) for w in words], pa.int64()), pa.array([0 if o is None else int(o.sum()) for o in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stay], pa.string())]
        return cols + [pa.array([x.decode() for x in stay], pa.string())] * with_text, ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t.as_py() or "").encode().split() for t in batch.column(1)]
            out = [repeats.removed(spans, len(w)) for spans, w in zip(batch.column(2), words, strict=True)]
            yield pa.RecordBatch.from_arrays(*results(batch.column(0), words, out))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, names = results(batch.column(0), [(t or "").encode().split() for t in batch.column(1).to_pylist()], [None] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], ["key", "order", *names])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    untouched = keyed.select("id", "text", "key", "order").mapInArrow(common.lean(whole), "key long, order long, " + schema)
    return repeats.by_document(keyed, decided.union(settled), run, schema, untouched).withColumnRenamed("id", id_col)
