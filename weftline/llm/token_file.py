"""Token-id files: written in order of id by all tasks, read back block by block.

Format of a file, all numbers little-endian:
  magic "WEFTIDS3"; u32 CRC-32 of what follows up to the blocks; u64 documents, u64 ids; u32 block, blocks, words of the table of
  symbols, CRC-32 of all ids; i64 document ids; u8 1 where the document id isn't null; u32 ids of each document;
  u32 words of each block; u32 CRC-32 of each block's words; the table of symbols; then the blocks' 32-bit words.
Blocks of `block` symbols run across documents and are coded by id_coder, each on its own behind the table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, id_coder
from .tokens import tokenizer, with_end

MAGIC = b"WEFTIDS3"
_HEAD = struct.Struct("<QQIIII")


def _checks(words: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Of each block's words."""
    ends = np.cumsum(sizes).tolist()
    return [zlib.crc32(words[b:c]) for b, c in zip([0, *ends], ends, strict=False)]


def pack_file(doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int, phrases: id_coder.Phrases = id_coder.NO_PHRASES) -> bytes:
    """ids may hold numbers of phrases, which stand for their ids; counts are of ids."""
    words, sizes = id_coder.encode(ids, block, phrases)
    words = words.astype("<u4")
    symbols = len(words) - int(sizes.sum())
    all_ids = zlib.crc32(id_coder.expand(ids, phrases).astype("<u4"))
    table = _HEAD.pack(len(doc_ids), int(counts.sum()), block, len(sizes), symbols, all_ids) + doc_ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + counts.astype("<u4").tobytes()
    table += sizes.astype("<u4").tobytes() + np.array(_checks(words[symbols:], sizes), "<u4").tobytes() + words[:symbols].tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(table)) + table + words[symbols:].tobytes()


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, which are not null, ids of each document, all ids); ValueError where a checksum fails."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, total, block, blocks, symbols, all_ids = _HEAD.unpack_from(data, 12)
    at = 12 + _HEAD.size
    out = []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("<u4", blocks), ("<u4", symbols)):
        if at + n * np.dtype(kind).itemsize > len(data):
            raise ValueError("the tables of a token-id file are damaged")
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    if zlib.crc32(data[12:at]) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("the tables of a token-id file are damaged")
    doc_ids, valid, counts, sizes, checks, table = out
    sizes = sizes.astype(np.int64)
    if len(data) - at != 4 * int(sizes.sum()):
        raise ValueError("a token-id file is cut")
    words = np.frombuffer(data, "<u4", int(sizes.sum()), at)
    if _checks(words, sizes) != checks.tolist():
        raise ValueError("a block of a token-id file is damaged")
    ids = id_coder.decode(np.concatenate([table, words]), sizes, total, block)
    if len(ids) != total or total and zlib.crc32(ids) != all_ids:
        raise ValueError("the ids of a token-id file are damaged")
    return doc_ids, valid.astype(bool), counts.astype(np.int64), ids


def _merged(numbers: list[np.ndarray], phrases: list[id_coder.Phrases]) -> tuple[np.ndarray, id_coder.Phrases]:
    """The numbers of several batches by one list of phrases, each there once."""
    ids, lengths = (np.concatenate(x) for x in zip(*phrases, strict=True))
    if not len(lengths):
        return np.concatenate(numbers), (ids, lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths)]) * 4
    every = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))]).dictionary_encode()
    name = np.concatenate([np.arange(id_coder.IDS, dtype=np.int32), id_coder.IDS + every.indices.to_numpy()])
    at, moved = 0, []
    for n, (_, own) in zip(numbers, phrases, strict=True):
        moved.append(name.take(np.where(n < id_coder.IDS, n, n + at)))
        at += len(own)
    one = every.dictionary
    width = np.diff(np.frombuffer(one.buffers()[1], np.int64)[: len(one) + 1]) // 4
    return np.concatenate(moved), (np.frombuffer(one.buffers()[2], "<u4", int(width.sum())), width)


def _save(uri: str, data: bytes) -> None:
    """Under its final name only when complete; a task that runs again writes the same bytes. What an
    attempt that died has left has another name, which read_tokens doesn't look at."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    where.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{TaskContext.get().taskAttemptId()}.part"
    with where.open_output_stream(part, compression=None) as f:
        f.write(data)
    try:
        where.move(part, path)
    except OSError:  # not all stores rename onto a file, and an earlier attempt may have written it
        if where.get_file_info(path).type != fs.FileType.File:
            raise
        where.delete_file(part)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", block: int = 2048, file_ids: int = 4_000_000) -> DataFrame:
    """Writes the ids of all documents in ascending order of id (null last, equal ids by their text)
    and returns a row for each file: pid, turn, docs, ids, start (ids before it in its partition).

    folder: a URI that driver and executors share and pyarrow can write (file:, s3:, gs:, hdfs:). Null
    and empty texts give their end id; an empty table gives no file; other columns are ignored. Files
    end after file_ids ids, at the end of a document.
    """
    spark = docs.sparkSession
    text = common.text_or_empty(text_col)
    order = [F.col("id").asc_nulls_last(), F.col("mix")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mix"))
    rows = rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order, "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pid = tokenizer(path), TaskContext.get().partitionId()
        held: list[tuple] = []
        turn = start = pending = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn, start, pending
            numbers, phrases, counts, doc_ids, valid = zip(*held, strict=True)
            merged, phrases = _merged(numbers, phrases)
            counts, doc_ids, valid = (np.concatenate(x) for x in (counts, doc_ids, valid))
            n = int(counts.sum())
            _save(f"{folder}/{pid:06d}-{turn:06d}.ids", pack_file(doc_ids, valid, counts, merged, block, phrases))
            row = [[pid], [turn], [len(doc_ids)], [n], [start]]
            held.clear()
            turn, start, pending = turn + 1, start + n, 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], ["pid", "turn", "docs", "ids", "start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, pieces, counts, phrases = tok.pieces(batch.column(1))
            numbers, counts = with_end(numbers, pieces, end)[0], counts + 1
            key = batch.column(0)
            held.append((numbers, phrases, counts, key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False)))
            pending += int(counts.sum())
            if pending >= file_ids:
                yield flush()
        if held:
            yield flush()

    return common.store(rows.mapInArrow(common.lean(run), "pid long, turn long, docs long, ids long, start long"), "files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, id_name: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id_name, start, n_tokens, ids_crc32 (and ids) for each document, from the files alone; `files` is
    what write_tokens returned. Every checksum is checked. The driver holds a number for each partition."""
    if files.isEmpty():
        return spark.createDataFrame([], f"{id_name} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    totals = sorted((r["pid"], r["n"]) for r in files.groupBy("pid").agg(F.sum("ids").alias("n")).collect())
    before, at = {}, 0
    for pid, n in totals:
        before[pid] = at
        at += n
    base = spark.sparkContext.broadcast(before)
    name = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select(F.split(name, "-")[0].cast("long").alias("pid"), F.split(name, "-")[1].cast("long").alias("turn"), "content")
    found = found.join(files.select("pid", "turn", "start"), ["pid", "turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, valid, counts, ids = unpack_file(row["content"])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                start = base.value[row["pid"]] + row["start"] + bounds[:-1]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64(), mask=~valid), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                whole = pa.RecordBatch.from_arrays(cols, [id_name, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                for k in range(0, whole.num_rows, 10_000):
                    yield whole.slice(k, 10_000)

    return found.mapInArrow(common.lean(run), f"{id_name} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
