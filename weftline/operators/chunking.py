"""Cutting ordered hunks by load: units within a file, chunks of a whole sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import MESSAGES, unit_id
from ..options import ChunkStrategy
from . import kernels


def _cut(rows: DataFrame, keys: list[str], order: str, load: str, limit: int, name: str, whole: bool = True) -> DataFrame:
    """All columns of rows and the bin (kernels.bins) of each row in its sequence. A sequence goes to Python as two
    arrays of numbers; what else the rows have is joined to the bins inside the JVM. Unless `whole`, sequences with a row beyond
    the limit are left out."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in others if c != order]))).alias("_rows"))
    if not whole:
        packed = packed.filter(_within("_rows", load, limit))
    packed = packed.withColumn("_loads", F.transform("_rows", lambda r: F.coalesce(r[load].cast("long"), F.lit(0)))).withColumn("_bins", _bins(limit)("_loads"))
    zipped = F.arrays_zip(F.col("_rows").alias("r"), F.col("_bins").alias("b"))
    return packed.select(*keys, F.explode(zipped).alias("_z")).select(*keys, "_z.r.*", F.col("_z.b").alias(name))


def _within(rows: str, load: str, limit: int) -> Column:
    """Whether no element of an array is beyond the limit."""
    return ~F.exists(rows, lambda r: F.coalesce(r[load] > limit, F.lit(False)))


def _bins(limit: int):
    @F.arrow_udf("array<int>")
    def run(loads: pa.Array) -> pa.Array:
        bounds = loads.offsets.to_numpy()
        flat = loads.values.to_numpy()
        out = [kernels.bins(flat[a:z], limit) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))

    return run


def partition_units(hunks: DataFrame, max_loc: int) -> DataFrame:
    """Runs of hunks of a file up to max_loc changed lines, numbered through the change."""
    rows = hunks.select("change_id", "file_ord", "file_path", "hunk_index", (F.col("added") + F.col("removed")).cast("long").alias("loc"))
    cut = _cut(rows, ["change_id", "file_ord", "file_path"], "hunk_index", "loc", max_loc, "bin")
    units = cut.groupBy("change_id", "file_ord", "file_path", "bin").agg(F.sort_array(F.collect_list("hunk_index")).alias("hunk_indices"), F.sum("loc").alias("loc"))
    order = W.Window.partitionBy("change_id").orderBy("file_ord", "bin")
    first, last = F.get("hunk_indices", F.lit(0)), F.element_at("hunk_indices", -1)
    return units.select("change_id", (F.row_number().over(order) - 1).alias("position"), unit_id(F.col("file_path").cast("string"), first, last).alias("unit_id"), "file_path", "hunk_indices", "loc")


def oversize(seq: DataFrame, budget: int) -> DataFrame:
    """Hunks that no chunk can hold, with the message."""
    rows = seq.filter(F.col("token_estimate") > budget)
    return rows.select("change_id", "file_path", "hunk_index", "token_estimate", F.format_string(MESSAGES["hunk_too_large"], F.col("hunk_index"), F.col("file_path").cast("string"), F.col("token_estimate"), F.lit(budget)).alias("detail"))


def chunk(seq: DataFrame, budget: int, strategy: str | ChunkStrategy = ChunkStrategy.DYNAMIC_PROGRAMMING) -> DataFrame:
    """change_id, seq, file_path, hunk_index, token_estimate, chunk. Changes with an oversize hunk have
    no chunks; oversize() tells why."""
    good = seq.select("change_id", "seq", "file_path", "hunk_index", "token_estimate")
    if ChunkStrategy(strategy) == ChunkStrategy.GREEDY:
        return _cut(good, ["change_id"], "seq", "token_estimate", budget, "chunk", whole=False)

    def run(bounds: np.ndarray, rows: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
        _, starts = _best(bounds, rows, budget)
        upto = np.cumsum(starts)
        number = upto - np.repeat(upto[bounds[:-1][np.diff(bounds) > 0]], np.diff(bounds)[np.diff(bounds) > 0])
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), [*rows.flatten(), pa.array(number, pa.int32())]

    kinds = dict(good.dtypes)
    columns = ["seq", "file_path", "hunk_index", "token_estimate"]
    return _by_batch(good, columns, budget, run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", chunk int")


def chunk_costs(seq: DataFrame, budget: int) -> DataFrame:
    """change_id, cost, chunks of the cheapest cut."""
    def run(bounds: np.ndarray, rows: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
        cost, starts = _best(bounds, rows, budget)
        upto = np.concatenate([[0], np.cumsum(starts)])
        return np.arange(len(cost)), [pa.array(cost), pa.array(np.diff(upto[bounds]), pa.int32())]

    return _by_batch(seq, ["seq", "file_path", "token_estimate"], budget, run, "cost double, chunks int")


def _best(bounds: np.ndarray, rows: pa.StructArray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    if rows.field("token_estimate").null_count:
        raise ValueError("a hunk without token_estimate")
    files = rows.field("file_path").dictionary_encode("encode").indices.to_numpy()
    return kernels.best_chunks_of(bounds, files, rows.field("token_estimate").to_numpy().astype(np.int64), budget)


def _by_batch(seq: DataFrame, columns: list[str], budget: int, run: Callable[[np.ndarray, pa.StructArray], tuple[np.ndarray, list[pa.Array]]], schema: str) -> DataFrame:
    """run over whole batches of changes without an oversize hunk: bounds of the changes and their hunks in order of
    `columns`, as arrays; it gives the change of each result row, and the columns. No join looks for oversize hunks."""
    packed = seq.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")).filter(_within("rows", "token_estimate", budget))
    full = f"change_id {seq.schema['change_id'].dataType.simpleString()}, {schema}"
    parsed = to_arrow_schema(_parse_datatype_string(full))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for given in batches for part in kernels.slices(given)):
            held = batch.column(1)
            bounds = held.offsets.to_numpy().astype(np.int64)
            change, out = run(bounds - bounds[0], held.flatten())
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(0).take(pa.array(change)), *out], parsed, strict=True)], schema=parsed)
            for k in range(0, whole.num_rows, 10_000):
                yield whole.slice(k, 10_000)

    return packed.mapInArrow(work, full)


def chunk_stats(chunks: DataFrame, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Of each chunk: files, added, removed and all lines, tokens, and hunks of each file in the chunk."""
    rows = chunks.join(hunks.select("change_id", "file_path", "hunk_index", "added", "removed"), ["change_id", "file_path", "hunk_index"])
    by_file = rows.groupBy("change_id", "chunk", "file_path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("hunk_count"), F.sum("token_estimate").alias("tokens"))
    by_file = by_file.join(files.select("change_id", "file_path", "file_ord"), ["change_id", "file_path"])
    return by_file.groupBy("change_id", "chunk").agg(
        F.count("*").alias("total_files"), F.sum("added").alias("total_added"), F.sum("removed").alias("total_removed"), F.sum(F.col("added") + F.col("removed")).alias("total_loc"),
        F.sum("hunk_count").alias("hunks"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("file_ord", "file_path", "added", "removed", "hunk_count"))).alias("file_summaries"),
    )


def chunk_diffs(chunks: DataFrame, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """The labelled diff of each chunk: only its hunks, and only files that have any."""
    from .stats import labelled_diff

    key = F.struct("change_id", "chunk")
    own = chunks.select("change_id", "chunk", "file_path", "hunk_index").join(hunks, ["change_id", "file_path", "hunk_index"])
    body = own.withColumn("change_id", key).drop("chunk")
    heads = files.join(chunks.select("change_id", "chunk", "file_path").distinct(), ["change_id", "file_path"]).withColumn("change_id", key)
    return labelled_diff(heads, body).select("change_id.change_id", "change_id.chunk", "text")
