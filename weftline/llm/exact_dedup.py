"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import common

_FIRST, _LAST = 1, 2  # bits of `edge`: the run touches the start or the end of its partition


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each text with the one before it in full. Only id, digest and run number of a
    partition's rows are held; the texts pass through."""
    pid = TaskContext.get().partitionId()
    before = None
    ids, shas, numbers, run = [], [], [], -1
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        new = np.ones(len(norm), dtype=bool)
        if len(norm) > 1:
            new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new[0] = before is None or norm[0].as_py() != before
        number = run + np.cumsum(new)
        run, before = int(number[-1]), norm[-1].as_py()
        ids.append(batch.column("id"))
        shas.append(batch.column("sha"))
        numbers.append(number)
    if not ids:
        return
    number = np.concatenate(numbers)
    sizes = np.bincount(number)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    edge = np.where(number == 0, _FIRST, 0) | np.where(number == run, _LAST, 0)
    id_all, sha_all = pa.chunked_array(ids), pa.chunked_array(shas)
    lead = np.zeros(len(number), dtype=bool)
    lead[starts] = True
    for at in range(0, len(number), 10_000):
        cut = slice(at, at + 10_000)
        some = number[cut]
        yield pa.RecordBatch.from_arrays(
            [
                id_all.slice(at, len(some)).combine_chunks(),
                id_all.take(pa.array(starts[some])).combine_chunks(),
                pa.array(sizes[some], pa.int64()),
                pa.array(lead[cut]),
                sha_all.slice(at, len(some)).combine_chunks(),
                pa.array(np.full(len(some), pid), pa.int32()),
                pa.array(edge[cut].astype(np.int32)),
            ],
            ["id", "keep", "size", "lead", "sha", "pid", "edge"],
        )


def _stitched(edges: list) -> list[tuple]:
    """Runs that go on in the next partition become one: (pid, edge, keep, size, lead) of each piece.
    edges: two rows for each partition at most."""
    out, chain = [], []

    def close() -> None:
        if len(chain) > 1:
            size = sum(e["n"] for e in chain)
            out.extend((e["pid"], e["edge"], chain[0]["keep"], size, k == 0) for k, e in enumerate(chain))

    for e in sorted(edges, key=lambda e: (e["pid"], not e["edge"] & _FIRST)):
        if chain and e["edge"] & _FIRST and chain[-1]["edge"] & _LAST and chain[-1]["sha"] == e["sha"]:
            chain.append(e)
        else:
            close()
            chain = [e]
    close()
    return out


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after white space is deleted. Rows are dealt by sampled range
    splitters over (first 64 normalised bytes, digest, length, id), sorted on disk by Spark, and each
    text is compared in full with its neighbour. The id is part of the splitters, so a text that a
    third of all rows share is cut over many partitions; the pieces of a run are put together from two
    rows for each partition, matched by SHA-256.

    The row with the most code points stays, then the smallest id, a null id last. Null texts count as
    empty; empty texts are one group. Of rows repeated with the same id and text one is kept. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = common.text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n"), F.encode(F.translate(text, common.SPACES, ""), "utf-8").alias("norm"))
    keyed = keyed.withColumns({"head": F.substring("norm", 1, 64), "sha": F.unhex(F.sha2("norm", 256))})
    order = [F.col("head"), F.col("sha"), F.col("n").desc(), F.col("id").asc_nulls_last()]
    dealt = keyed.repartitionByRange(common.partitions(spark), *order)
    sorted_ = dealt.sortWithinPartitions(order[0], order[1], F.col("norm"), *order[2:]).select("id", "norm", "sha")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("keep", kind), T.StructField("size", T.LongType()), T.StructField("lead", T.BooleanType()), T.StructField("sha", T.BinaryType()), T.StructField("pid", T.IntegerType()), T.StructField("edge", T.IntegerType())])
    runs = common.store(sorted_.mapInArrow(common.lean(_runs), schema), "runs")
    edges = runs.filter("edge > 0").groupBy("pid", "edge").agg(F.min("sha").alias("sha"), F.first("keep").alias("keep"), F.count("*").alias("n")).collect()
    fixes = _stitched(edges)
    if fixes:
        fix = spark.createDataFrame(fixes, T.StructType([schema["pid"], schema["edge"], T.StructField("keep_all", kind), T.StructField("size_all", T.LongType()), T.StructField("lead_all", T.BooleanType())]))
        runs = runs.join(F.broadcast(fix), ["pid", "edge"], "left")
        runs = runs.withColumns({"keep": F.when(F.col("size_all").isNotNull(), F.col("keep_all")).otherwise(F.col("keep")), "size": F.coalesce("size_all", "size"), "lead": F.col("lead") & F.coalesce("lead_all", F.lit(True))})
    return runs.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("lead").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that content_sort keeps, with all their columns, whatever their names. Null and
    empty texts are one group, of which one row stays; of rows repeated one stays; of the texts of a group
    under one id the longest; an empty table gives no rows."""
    id_, sha_, turn_ = common.free(docs.columns, "id", "sha", "turn")
    text = common.text_or_empty(text_col)
    kept = content_sort(docs, id_col, text_col).filter("kept").select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(id_), F.col("text_sha256").alias(sha_))
    rows = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("string"), F.lit("")), sha_: F.sha2(F.translate(text, common.SPACES, ""), 256)})
    # The join and the window go by the same two columns, so texts move once.
    turn = W.Window.partitionBy(id_, sha_).orderBy(F.length(text).desc(), text, common.tag(docs))
    return rows.join(kept, [id_, sha_], "left_semi").withColumn(turn_, F.row_number().over(turn)).filter(F.col(turn_) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
