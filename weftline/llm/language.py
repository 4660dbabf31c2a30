"""Language identification of mixed-language text: scripts, scores of words, best path over words."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

#: First and last code point of blocks of scripts that letters come from.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0531, 0x058F, "Armenian"), (0x0591, 0x05F4, "Hebrew"), (0x0600, 0x06FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
_FIRST = [s[0] for s in SCRIPTS]
GRAMS = 1 << 16  # cells of hashed three-byte runs
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_FAR = np.arange(256) >= 0xC9  # lead bytes beyond the Latin blocks; words with one are looked at by character


def script(word: str) -> str | None:
    for c in word:
        if c.isalpha():
            k = bisect_right(_FIRST, ord(c)) - 1
            return SCRIPTS[k][2] if k >= 0 and ord(c) <= SCRIPTS[k][1] else "other"
    return None


def _grams(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a word the cell of the three bytes around it, white space outside, and the
    word's first place in that list."""
    pad = np.full(len(b) + 2, 32, np.uint32)
    pad[1:-1] = hashing._LOWER[b]
    pad[1:-1][np.isin(b, (9, 10, 11, 12, 13))] = 32
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int32) - np.repeat((first - starts).astype(np.int32), size)
    left, right = pad[at], pad[at + 2]
    left[first], right[first + size - 1] = 32, 32
    sum_ = left * np.uint32(0x3779B9) + pad[at + 1] * np.uint32(0x85EBCB) + right * np.uint32(0x2C1B3D)
    return ((sum_ >> np.uint32(5)) % np.uint32(GRAMS)).astype(np.int32), first


class Model:
    """table: for each cell and language the log chance against the languages' mean. scripts: of each
    language those in which at least a hundredth of its words are."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: list[set[str]], common_lang: int, penalty: float):
        self.langs, self.table, self.scripts, self.common, self.penalty = langs, table.astype(np.float32), scripts, common_lang, penalty

    def scores(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words by language, and which words have letters of a script that some language
        has; 0 for others."""
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, bool)
        cells, first = _grams(b, starts, ends)
        out = np.stack([np.add.reduceat(self.table[:, k][cells], first) for k in range(len(self.langs))], 1)
        upto = np.concatenate([[0], np.cumsum(_LETTER[b])])
        lettered = upto[ends] > upto[starts]
        latin = np.array(["Latin" in s for s in self.scripts])
        lettered &= latin.any()
        out[:, ~latin] -= 50.0
        far = np.concatenate([[0], np.cumsum(_FAR[b])])
        for i in np.flatnonzero(far[ends] > far[starts]):
            kind = script(bytes(b[starts[i] : ends[i]]).decode("utf-8", "replace"))
            allowed = np.array([kind in s for s in self.scripts])
            out[i] += np.where(latin, 0.0, 50.0)
            out[i] = np.where(allowed, out[i], -50.0)
            lettered[i] = allowed.any()
        out[~lettered] = 0
        return out, lettered

    def path(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language of each word on the best way through each text, where a change of language costs
        the penalty. first: each text's first word and the end of the last. All texts go in step, the
        longest first, so that those still running are a prefix."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
        langs = len(self.langs)
        best = np.zeros((len(size), langs), np.float32)
        stays = np.ones((len(scores), langs), bool)
        came = np.zeros(len(scores), np.int16)
        for t in range(longest):
            n = running[t]
            word, own = begin[:n] + t, best[:n]
            if t:
                top = own.argmax(1)
                other = own[np.arange(n), top] - self.penalty
                stay = own >= other[:, None]
                stays[word] = stay
                came[word] = top
                own = np.where(stay, own, other[:, None])
            best[:n] = own + scores[word]
        label = np.zeros(len(scores), np.int16)
        now = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = running[t]
            word = begin[:n] + t
            label[word] = now[:n]
            now[:n] = np.where(stays[word, now[:n]], now[:n], came[word])
        return label


def threshold(docs_per_lang: int, size: int) -> int:
    """Below which a 62-bit hash of a document of a language with so many documents must be."""
    return (1 << 62) if size <= docs_per_lang else docs_per_lang * (1 << 62) // size


def train(labelled: DataFrame, docs_per_lang: int, penalty: float) -> Model:
    """Counts of cells by language over about docs_per_lang documents of each, picked by the hash of
    text and id; smaller languages in full. labelled: lang, text, id. The driver receives a row for each
    language and used cell."""
    rows = labelled.select("lang", F.coalesce("text", F.lit("")).alias("text"), "id")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        raise ValueError("no document has a language to learn")
    langs = sorted(sizes)
    if len(langs) > 1000:
        raise ValueError("more than 1000 languages")
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, threshold(docs_per_lang, sizes[n]))])
    rows = rows.filter(F.xxhash64("text", "id").bitwiseAND((1 << 62) - 1) < share[F.col("lang")]).select("lang", "text")
    place = {n: i for i, n in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        scripts: dict[tuple[int, str], int] = {}

        def found() -> pa.RecordBatch:
            used = {k: np.flatnonzero(x) for k, x in cells.items()}
            lang = [np.full(len(at), k) for k, at in used.items()] + [np.array([k for k, _ in scripts], np.int64)]
            cell = [*used.values(), np.full(len(scripts), -1)]
            n = [x[used[k]] for k, x in cells.items()] + [np.array([*scripts.values()], np.int64)]
            kind = [None] * sum(map(len, used.values())) + [s for _, s in scripts]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(lang), pa.int32()), pa.array(np.concatenate(cell), pa.int32()), pa.array(kind, pa.string()), pa.array(np.concatenate(n), pa.int64())], ["lang", "cell", "script", "n"])

        for batch in batches:
            if len(cells) > 64:  # with many languages, counts so far go on
                yield found()
                cells, scripts = {}, {}
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            b, bounds = hashing.text_bytes(batch.column(1))
            for lo, hi in hashing.chunks(bounds):
                part, own = b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                starts, ends, first = hashing.words(part, own)
                if not len(starts):
                    continue
                at, _ = _grams(part, starts, ends)
                lang = np.repeat(np.repeat(of[lo:hi], np.diff(first)), ends - starts)
                for k in np.unique(of[lo:hi]).tolist():
                    cells[k] = cells.get(k, 0) + np.bincount(at[lang == k], minlength=GRAMS)
                far, letter = (np.concatenate([[0], np.cumsum(x[part])]) for x in (_FAR, _LETTER))
                word = np.repeat(of[lo:hi], np.diff(first))
                plain = (far[ends] == far[starts]) & (letter[ends] > letter[starts])
                for k, n in enumerate(np.bincount(word[plain], minlength=len(langs)).tolist()):
                    scripts[k, "Latin"] = scripts.get((k, "Latin"), 0) + n
                for i in np.flatnonzero(far[ends] > far[starts]):
                    kind = script(bytes(part[starts[i] : ends[i]]).decode("utf-8", "replace"))
                    if kind:
                        scripts[int(word[i]), kind] = scripts.get((int(word[i]), kind), 0) + 1
        yield found()

    found = rows.mapInArrow(common.lean(count), "lang int, cell int, script string, n long").groupBy("lang", "cell", "script").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((GRAMS, len(langs)))
    grams = found[found["cell"] >= 0]
    table[grams["cell"].to_numpy(), grams["lang"].to_numpy()] = grams["n"].to_numpy()
    table = np.log((table + 0.5) / (table.sum(0) + 0.5 * GRAMS))
    table -= table.mean(1, keepdims=True)
    scripts: list[set[str]] = []
    for k in range(len(langs)):
        own = found[(found["cell"] < 0) & (found["lang"] == k)]
        scripts.append({s for s, n in zip(own["script"], own["n"], strict=True) if n * 100 >= own["n"].sum()})
    return Model(langs, table, scripts, max(range(len(langs)), key=lambda k: sizes[langs[k]]), penalty)


def label(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """All columns of docs and more at the end, under names that are free: the language, the score (and the
    spans), row by row without a shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)
    lettered_, lang_, score_, spans_ = common.free(docs.columns, "lettered", "lang", "score", "spans")
    rows = docs.withColumn(lettered_, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    runs = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            b, bounds = hashing.text_bytes(batch.column(text_at))
            pred, score, parts = [], [], []
            for lo, hi in hashing.chunks(bounds):
                part, own = b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                starts, ends, first = hashing.words(part, own)
                points, lettered = m.scores(part, starts, ends)
                word_lang = m.path(points, first)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                votes = np.bincount(text[lettered] * len(m.langs) + word_lang[lettered], minlength=(hi - lo) * len(m.langs)).reshape(hi - lo, -1)
                total = votes.sum(1)
                top = np.where(total > 0, votes.argmax(1), m.common)
                pred += [m.langs[k] for k in top.tolist()]
                score += (votes.max(1) / np.maximum(1, total)).tolist()
                if spans:
                    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(word_lang[a:z])) + 1]).astype(int) if z > a else np.zeros(0, int)
                        many = np.diff(np.append(cut, z - a))
                        parts.append([{"first": int(c), "words": int(n), "lang": m.langs[word_lang[a + c]]} for c, n in zip(cut, many, strict=True)])
            some = batch.column(batch.num_columns - 1).to_pylist()
            pred = [p if s else "und" for p, s in zip(pred, some, strict=True)]
            score = [p if s else 0.0 for p, s in zip(score, some, strict=True)]
            cols = [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array(parts, runs))
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], lang_, score_, *[spans_] * spans])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_, T.StringType()), T.StructField(score_, T.DoubleType())])
    if spans:
        span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())])
        schema = schema.add(spans_, T.ArrayType(span))
    return rows.mapInArrow(common.lean(run), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """id_col, lang_pred, score (and spans: first word, words, language) for each row of docs.

    The language is the one that labels the most words with letters, the earlier name on ties; the
    score is its share of them. Null texts, and texts without a letter, are `und` with score 0. Texts
    whose letters are in no learned script get the commonest language with score 0. Every word of a
    text counts; rows repeated are judged alike; an empty table gives no rows; other columns are ignored.
    """
    return label(docs.select(id_col, text_col), model, text_col, spans).drop(text_col).toDF(id_col, "lang_pred", "score", *["spans"] * spans)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 4000, penalty: float = 12.0) -> Model | None:
    """A model from the labelled rows that aren't held out (crc32 of the id modulo 5 is 0; a null id is
    not); None where there are none. docs_per_lang bounds what is learned from."""
    labelled = docs.filter(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang is not null")
    return None if labelled.isEmpty() else train(labelled, docs_per_lang, penalty)


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """learn() and identify(); without a label to learn from all rows are `und` with score 0."""
    model = learn(docs, id_col, text_col, **options)
    if model is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return identify(docs, model, id_col, text_col)


def drop_unknown(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are mostly in one language (score of `least` or more), the language filled
    in where it was null. Without a label to learn from nothing can be told and all rows stay. Null texts,
    and texts without a letter, go; rows repeated are judged alike; a share of exactly `least` stays; an
    empty table gives no rows; other columns are kept as they are, whatever their names."""
    model = learn(docs, id_col, text_col, lang_col)
    if model is None:
        return docs
    found = label(docs, model, text_col)
    lang, score = found.columns[-2:]
    kept = found.filter((F.col(lang) != "und") & (F.col(score) >= least))
    return kept.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col(lang))).select(*[F.col(f"`{c}`") for c in docs.columns])
