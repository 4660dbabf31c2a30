"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common


class Forest:
    """Trees of hyperplanes over unit vectors, fitted to a bounded sample. Node i of a tree has
    direction way[i], threshold cut[i] and children kids[i]; a child c < 0 is leaf -c - 1, numbered
    through all trees."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 5):
        self.draw, self.leaf, self.leaves = np.random.default_rng(seed), leaf, 0
        self.way: list[np.ndarray] = []
        self.cut: list[float] = []
        self.kids: list[list[int]] = []
        self.roots = [self._grow(sample, np.arange(len(sample))) for _ in range(trees)]
        self.way_, self.cut_, self.kids_ = np.array(self.way).reshape(-1, sample.shape[1]), np.array(self.cut), np.array(self.kids, np.int64).reshape(-1, 2)
        del self.way, self.cut, self.kids, self.draw

    def _grow(self, sample: np.ndarray, rows: np.ndarray) -> int:
        if len(rows) > self.leaf:
            for _ in range(3):  # a split may fail where many vectors are equal
                way = self.draw.standard_normal(sample.shape[1])
                way /= np.linalg.norm(way)
                at = sample[rows] @ way
                cut = float(np.median(at))
                right = at > cut
                if right.any() and not right.all():
                    i = len(self.way)
                    self.way.append(way)
                    self.cut.append(cut)
                    self.kids.append([0, 0])
                    self.kids[i] = [self._grow(sample, rows[~right]), self._grow(sample, rows[right])]
                    return i
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            inner = np.flatnonzero(at >= 0)
            while len(inner):
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.way_[node]) > self.cut_[node]
                at[inner] = self.kids_[node, side.astype(np.int64)]
                inner = inner[at[inner] >= 0]
            out[:, t] = -at - 1
        return out

    def search(self, x: np.ndarray, probes: int) -> Iterator[list[int]]:
        """For each row the leaves to look into: one queue for all trees, best first, by the smallest
        margin on the way (below 0 once a branch on the other side of a plane is taken)."""
        for margins in x @ self.way_.T - self.cut_:
            queue = [(-np.inf, root) for root in self.roots]
            heapq.heapify(queue)
            found: list[int] = []
            while queue and len(found) < probes:
                worst, node = heapq.heappop(queue)
                if node < 0:
                    found.append(-node - 1)
                    continue
                m = float(margins[node])
                heapq.heappush(queue, (max(worst, m), int(self.kids_[node, 0])))
                heapq.heappush(queue, (max(worst, -m), int(self.kids_[node, 1])))
            yield found


def _by_id(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by id, and where in it each id starts."""
    order = np.argsort(ids, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(ids[order]) != 0)[: len(ids)])


def fit(vectors: np.ndarray, ids: np.ndarray, k: int, trees: int, leaf: int, recall: float, tries: int = 200) -> tuple[Forest, int]:
    """A forest and the number of leaves that a query looks into: the least, by steps of a quarter, that
    reaches the recall on the sample itself. Ids are counted, each by its nearest vector, but for the
    query's own."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = Forest(unit, trees, leaf)
    order, first = _by_id(ids)
    if len(first) <= k + 1:
        return forest, forest.leaves
    rows = np.random.default_rng(9).choice(len(unit), min(tries, len(unit)), replace=False)
    near = unit[rows] @ unit.T
    near[ids[rows][:, None] == ids] = -2
    best = np.partition(np.maximum.reduceat(near[:, order], first, axis=1), -k, axis=1)[:, -k]
    homes = forest.route(unit)
    probes = trees
    while probes < forest.leaves:
        got = total = 0
        for i, leaves in enumerate(forest.search(unit[rows], probes)):
            seen = np.isin(homes, leaves).any(1)
            true = near[i] >= best[i]
            got += min(k, len(np.unique(ids[seen & true])))
            total += min(k, len(np.unique(ids[true])))
        if got >= recall * total:
            break
        probes += max(1, probes // 4)
    return forest, min(probes, forest.leaves)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; a row's value doesn't depend on the rows around it."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, their largest entry from a half up to one: cosines are the same to the last bit, and no
    square is too large or too small for a double."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _matrix(col, width: int) -> np.ndarray:
    """A list column as rows of doubles, scaled."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return _scaled(np.asarray(col.flatten()).astype(np.float64).reshape(len(col), width))


def _best(left: pa.Table, right: pa.Table, k: int, width: int) -> pa.Table:
    """The k best ids of one block of rows for each query of one block, each id by its nearest vector."""
    names = ["query_id", "vec_id", "score"]
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
    qid, vid = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
    q, v = _matrix(left["vector"], width), _matrix(right["vector"], width)
    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    near[qid[:, None] == vid] = -2
    by_id, first = _by_id(vid)
    top = np.maximum.reduceat(near[:, by_id], first, axis=1) if len(first) < len(vid) else near
    least = np.partition(top, -min(k, len(first)), axis=1)[:, -min(k, len(first))]
    row, col = np.nonzero((near >= least[:, None] - 1e-9) & (near > -1.5))
    score = np.concatenate([cosine(q[row[a : a + 20000]], v[col[a : a + 20000]]) for a in range(0, len(row), 20000)]) if len(row) else np.zeros(0)
    if len(first) < len(vid):
        order = np.lexsort((-score, vid[col], row))
        row, col, score = row[order], col[order], score[order]
        once = np.append(True, (np.diff(row) != 0) | (np.diff(vid[col]) != 0))[: len(row)]
        row, col, score = row[once], col[once], score[once]
    order = np.lexsort((vid[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return pa.table([pa.array(qid[row[keep]]), pa.array(vid[col[keep]]), pa.array(score[keep])], names)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 8, leaf: int = 32, sample: int = 8192, recall: float = 0.95, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors by cosine,
    without the row of its own id.

    The forest and the number of leaves to search are fitted to at most `sample` vectors (those whose
    ids hash smallest); every vector is then put into its leaf of every tree. A query looks into the
    leaves that a queue over all trees gives first, and all their vectors are ranked exactly. Leaves
    meet their queries by key; a leaf with more than `block` vectors or queries is cut into blocks of
    both, so equal vectors, however many, never meet in one task. Results of blocks are merged by query.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those of
    another length than most. Ties go to the smaller id; a vector repeated under one id counts once, and
    of different vectors under one id the nearest counts.
    Fewer candidates than k give fewer rows; empty tables give none; other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector_col)
        v = v if df.schema[vector_col].dataType.simpleString() == "array<float>" else v.cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias(name), v.alias("vector")).filter(f"vector is not null and {name} is not null")
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.filter(fine & F.exists("vector", lambda x: x != 0)).distinct()

    rows, asked = common.store(usable(vectors, "vec_id"), "vectors"), usable(queries, "query_id")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    out = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], out)
    width = widths["width"]
    rows, asked = rows.filter(F.size("vector") == width), asked.filter(F.size("vector") == width)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).toPandas()
    forest, probes = fit(_scaled(np.array(picked["vector"].tolist(), np.float64).reshape(-1, width)), picked["vec_id"].to_numpy(), k, trees, leaf, recall)
    shared = spark.sparkContext.broadcast(forest)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            at = shared.value.route(x / np.linalg.norm(x, axis=1, keepdims=True))
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(at[:, t]), *batch.columns], ["leaf", "vec_id", "vector"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            found = list(shared.value.search(x / np.linalg.norm(x, axis=1, keepdims=True), probes))
            leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)), pa.array([i for f in found for i in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([leaves, *batch.columns], ["leaves", "query_id", "vector"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shared.value.leaves, np.int64)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            seen += np.bincount(shared.value.route(x / np.linalg.norm(x, axis=1, keepdims=True)).ravel(), minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["leaf", "n"])

    placed = rows.mapInArrow(homes, f"leaf long, vec_id long, vector {kind}")
    going = common.store(asked.mapInArrow(visits, f"leaves array<long>, query_id long, vector {asked.schema['vector'].dataType.simpleString()}"), "visits")
    going = going.withColumn("leaf", F.explode("leaves")).drop("leaves")

    def blocks(df: DataFrame) -> dict[int, int]:
        """By leaf, of which the sample bounds the number."""
        return {r["leaf"]: -(-r["n"] // block) for r in df.groupBy("leaf").agg(F.sum("n").alias("n")).collect() if r["n"] > block}

    def spread(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str, key: str) -> DataFrame:
        def many(cuts: dict[int, int]):
            if not cuts:
                return F.lit(1)
            table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
            return F.coalesce(F.try_element_at(table, F.col("leaf")), F.lit(1))

        df = df.withColumn(mine, F.pmod(F.xxhash64(key), many(own)).cast("int"))
        return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), many(other) - 1)))

    by_row, by_query = blocks(rows.mapInArrow(tally, "leaf long, n long")), blocks(going.select("leaf", F.lit(1).alias("n")))
    right = spread(placed, by_row, by_query, "r", "q", "vec_id").groupBy("leaf", "r", "q")
    left = spread(going, by_query, by_row, "q", "r", "query_id").groupBy("leaf", "r", "q")
    found = left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, k, width), "query_id long, vec_id long, score double")
    # Equal pairs from several trees have equal scores, so they fall together before the k best are taken.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    turn = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
