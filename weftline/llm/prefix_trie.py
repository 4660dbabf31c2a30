"""The prefix trie of conversations, summed up by peeling leaves."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Names of prefixes are sums of turns times powers of odd bases, in two lanes of 62 bits.
_MASK = np.uint64((1 << 62) - 1)
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A node: its depth and name.
NODE = ["depth", "na", "nb"]


def lent_turns(conv_id: np.ndarray, most: int = 5) -> np.ndarray:
    """Turns that a conversation takes from the first of its hundred: crc32 of the decimal id, modulo most + 1."""
    return np.array([zlib.crc32(str(c).encode()) % (most + 1) for c in conv_id.tolist()], np.int64)


def _at_last(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of key: each row's first row of its run, and the first rows."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return np.repeat(first, np.diff(np.append(first, len(key)))), first


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), a, b, chars for each turn: 128 bits of role and text, and code points.

    Turns are range-sorted, so one conversation may lie in many partitions; each numbers its own, and the sizes
    of a conversation's earlier parts are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            here = np.arange(len(conv))
            own, first = _at_last(conv)
            k = here - own + np.where(own == 0, count if conv[0] == last else 0, 0)
            last, count = conv[-1], int(k[-1]) + 1
            names, chars = [], []
            for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                said = role.encode()
                names.append(hashlib.blake2b(b"%d:%b%b" % (len(said), said, text.encode()), digest_size=16).digest())
                chars.append(len(text))
            a, b = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, np.full(len(conv), part, np.int32), k, a.copy(), b.copy(), np.array(chars, np.int64))], ["conv_id", "part", "k", "a", "b", "chars"])

    order = ["conv_id", "turn", "role", "text"]
    rows = turns.repartitionByRange(common.partitions(turns.sparkSession), "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    kept = common.store(rows.select("conv_id", "role", "text").mapInArrow(common.lean(run), "conv_id long, part int, k long, a long, b long, chars long"), "turns")
    # Only conversations that cross partitions have an offset, at most two for each partition.
    sizes = kept.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    crossing = sizes.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    before = W.Window.partitionBy("conv_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    ahead = sizes.join(crossing, "conv_id").select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ahead = common.store(ahead, "offsets")
    return kept.join(ahead, ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("ahead", F.lit(0))).alias("turn_no"), "a", "b", "chars")


def _named(turns: DataFrame) -> DataFrame:
    """conv_id, depth, na, nb, pa, pb, chars: for each turn, in a conversation numbered by depth, the name of the prefix
    that ends there and of the one before it; again over range-sorted parts whose sums are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, sums = TaskContext.get().partitionId(), None, [np.uint64(0)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, _ = _at_last(conv)
            cols = []
            for lane, base in enumerate(_LANES):
                term = batch.column(2 + lane).to_numpy().view(np.uint64) * _power(base, depth)
                upto = np.cumsum(term)
                carry = np.where((own == 0) & (conv[0] == last), sums[lane], np.uint64(0))
                now = upto - (upto[own] - term[own]) + carry
                sums[lane] = now[-1]
                cols += [now & _MASK, (now - term) & _MASK]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), *[pa.array(cols[i].view(np.int64)) for i in (0, 2, 1, 3)], batch.column(4), pa.array(np.full(len(conv), part, np.int32))], ["conv_id", "depth", "na", "nb", "pa", "pb", "chars", "part"])

    rows = turns.repartitionByRange(common.partitions(turns.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    kept = common.store(rows.select("conv_id", "depth", "a", "b", "chars").mapInArrow(common.lean(run), "conv_id long, depth long, na long, nb long, pa long, pb long, chars long, part int"), "prefixes")
    ends = kept.groupBy("conv_id", "part").agg(F.max_by(F.struct("na", "nb"), "depth").alias("end"))
    crossing = ends.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    before = W.Window.partitionBy("conv_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    modulus = F.lit(1 << 62).cast("decimal(20,0)")
    lane = lambda c: F.coalesce((F.sum(F.col(f"end.{c}").cast("decimal(20,0)")).over(before) % modulus).cast("long"), F.lit(0)).alias(f"{c}_")
    ahead = common.store(ends.join(crossing, "conv_id").select("conv_id", "part", lane("na"), lane("nb")), "sums")
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).bitwiseAND(F.lit(int(_MASK))).alias(c)
    return kept.join(ahead, ["conv_id", "part"], "left").select("conv_id", "depth", added("na", "na_"), added("nb", "nb_"), added("pa", "na_"), added("pb", "nb_"), "chars")


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2 ** 64, by squaring."""
    out, square, left = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        left = left >> np.uint64(1)
        square = np.uint64(int(square) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return out


def rebuilt(turns: DataFrame, most: int = 5, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns of each rebuilt conversation; its turns as conv_id, depth, a, b, chars): the first h turns of
    the first conversation of its hundred, then its own turns after its first h."""

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lent_turns(batch.column(0).to_numpy(), most))], ["conv_id", "own", "h"])

    numbered = common.store(_numbered(turns), "numbered")
    convs = numbered.groupBy("conv_id").agg((F.max("turn_no") + 1).alias("own")).mapInArrow(common.lean(lent), "conv_id long, own long, h long")
    convs = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % group)
    had = convs.select(F.col("conv_id").alias("first"), F.col("own").alias("had"))
    convs = convs.join(had, "first", "left").withColumn("m", F.least("h", F.coalesce("had", F.lit(0)))).drop("had")
    convs = common.store(convs.withColumn("n_turns", F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    own = numbered.join(convs, "conv_id").filter("turn_no >= h").select("conv_id", (F.col("m") + F.col("turn_no") - F.col("h") + 1).alias("depth"), "a", "b", "chars")
    # The first conversation of a hundred lends at most `most` turns to at most `group`.
    heads = numbered.filter((F.col("turn_no") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "first")
    lent_ = heads.join(convs, "first").filter("turn_no < m").select("conv_id", (F.col("turn_no") + 1).alias("depth"), "a", "b", "chars")
    return convs.select("conv_id", "n_turns"), own.unionByName(lent_)


def _digests(ends: DataFrame) -> DataFrame:
    """For each node the hash of the ids that end there, in order, comma-joined. Ids are range-sorted and joined to
    strings of thousands; one task then hashes a node's strings one after the other, as the hash asks for."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, na, nb, conv = (c.to_numpy() for c in batch.columns)
            new = np.append(True, (np.diff(depth) != 0) | (np.diff(na) != 0) | (np.diff(nb) != 0))
            at = np.flatnonzero(new)
            ids = [",".join(map(str, conv[a:z].tolist())) for a, z in zip(at, np.append(at[1:], len(conv)), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in (depth, na, nb, conv)], pa.array(ids)], [*NODE, "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    out += [(*node, state.hexdigest())] if node else []
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield _batch(out)
        if node:
            yield _batch([(*node, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*NODE, "ends_sha256"])

    n = common.partitions(ends.sparkSession)
    key = "depth long, na long, nb long"
    runs = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id").mapInArrow(common.lean(joined, 5000), f"{key}, conv_id long, ids string")
    runs = common.store(runs, "ends").repartition(n, *NODE).sortWithinPartitions(*NODE, "conv_id")
    return runs.select(*NODE, "ids").mapInArrow(common.lean(hashed), f"{key}, ends_sha256 string")


_PIECE = "owner long, block long, up_owner long, up_block long, up_depth long, open long, nodes array<struct<depth:long,leaves:long,saved:long>>"


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the nodes of pieces that wait for no child: what each has itself and was sent, summed from the lowest
    up. The top one of each piece says where its own totals go."""
    for batch in batches:
        nodes = batch.column(6)
        flat, bounds = nodes.flatten(), nodes.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        depth, leaves, saved = (flat.field(f).to_numpy() for f in ("depth", "leaves", "saved"))
        piece = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort((-depth, piece))
        depth, piece = depth[order], piece[order]
        sums = []
        for x in (leaves[order], saved[order]):
            upto = np.cumsum(x)
            begin = bounds[:-1][piece]
            sums.append(upto - (upto[begin] - x[begin]))
        new = np.append((np.diff(piece) != 0) | (np.diff(depth) != 0), True)  # the last row of each depth has all of it
        last = np.append(np.diff(piece) != 0, True)[new]
        rows = pa.array(piece[new])
        sent = pa.array(last)
        up = [pc.if_else(sent, batch.column(c).take(rows), pa.scalar(None, pa.int64())) for c in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(depth[new]), *[pa.array(s[new]) for s in sums], sent, *up], ["owner", "depth", "n_leaves", "saved_tokens", "top", "up_owner", "up_block", "up_depth"])


def peeled(nodes: DataFrame, span: int) -> DataFrame:
    """owner, depth, n_leaves, saved_tokens: totals over the subtree of each node, by peeling.

    nodes: owner, depth, up_owner (the parent's), leaves and saved of its own. Nodes of one owner lie below each other
    and form a piece, cut every `span` depths, that a task holds at once. A piece counts the children that it
    still waits for. Those that wait for none are complete: their nodes get totals and the top sends
    its own to the parent, whose counter falls; until only the root is left, and finishes."""
    spark = nodes.sparkSession
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    top = F.min_by(F.struct("up_owner", (F.col("depth") - 1).alias("up_depth")), "depth")
    pieces = nodes.withColumn("block", block("depth")).groupBy("owner", "block").agg(top.alias("up"), F.collect_list(F.struct("depth", F.col("leaves").cast("long").alias("leaves"), F.col("saved").cast("long").alias("saved"))).alias("nodes"))
    pieces = pieces.select("owner", "block", "up.up_owner", F.when(F.col("up.up_owner").isNotNull(), block("up.up_depth")).alias("up_block"), "up.up_depth", "nodes")
    pieces = common.store(pieces, "pieces")
    waits = pieces.filter("up_owner is not null").groupBy(F.col("up_owner").alias("owner"), F.col("up_block").alias("block")).agg(F.count("*").alias("open"))
    waiting = common.store(pieces.join(waits, ["owner", "block"], "left").select("owner", "block", "up_owner", "up_block", "up_depth", F.coalesce("open", F.lit(0)).alias("open"), "nodes"), "waiting")
    done = []
    while True:
        ready = waiting.filter("open = 0")
        totals = common.store(ready.mapInArrow(common.lean(_completed), "owner long, depth long, n_leaves long, saved_tokens long, top boolean, up_owner long, up_block long, up_depth long"), "totals")
        done.append(totals)
        sent = totals.filter("top and up_owner is not null")
        if sent.isEmpty():
            break
        inbox = sent.groupBy("up_owner", "up_block", "up_depth").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        inbox = inbox.groupBy(F.col("up_owner").alias("owner"), F.col("up_block").alias("block")).agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("up_depth").alias("depth"), "leaves", "saved")).alias("mail"))
        rest = waiting.filter("open > 0").join(inbox, ["owner", "block"], "left")
        mail = F.coalesce("mail", F.array().cast("array<struct<depth:bigint,leaves:bigint,saved:bigint>>"))
        waiting = common.store(rest.select("owner", "block", "up_owner", "up_block", "up_depth", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.concat("nodes", mail).alias("nodes")), "waiting")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("owner", "depth", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, most: int = 5, group: int = 100, span: int = 4096, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the
    trie of rebuilt conversations (rebuilt()); a node is a distinct sequence of first turns, the root that of none.

    A node's name is a 124-bit sum over 128-bit digests of its turns, so texts are moved once. Every node is owned by one
    of its members, the one whose id hashes smallest: owners change about ln(n) times on a way to the root, whatever
    the order of ids, and so often at most do complete parts of the trie send their totals up (peeled()).

    Turns are taken in order of (turn, role, text), nulls first; null roles and texts are empty. Rows without an
    id are of no conversation and take no part. Rows repeated are turns repeated. c % 100 has the sign of c. An empty table has
    no nodes; other columns are ignored.
    """
    spark = conversations.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).filter("conv_id is not null")
    convs, rows = rebuilt(turns, most, group)
    named = common.store(_named(rows), "named")
    draw = lambda c: F.struct(F.xxhash64(c).alias("draw"), F.col(c).alias("c"))
    nodes = named.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(draw("conv_id")).alias("owner"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(draw("conv_id")).alias("owner")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", "owner", zero.alias("chars"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    nodes = common.store(nodes.union(root).withColumn("owner", F.col("owner.c")), "nodes")

    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("na"), F.col("pb").alias("nb")]
    below = nodes.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("up_owner"))
    nothing = F.lit(None).cast("long")
    linked = nodes.filter("depth > 1").join(above, ["depth", "pa", "pb"])
    top = nodes.filter("depth = 0").first()  # all of depth 1 are below the one root
    at_root = {"parent_conv_id": F.lit(top and top["conv_id"]).cast("long"), "up_owner": F.lit(top and top["owner"]).cast("long")}
    linked = linked.unionByName(nodes.filter("depth = 1").withColumns(at_root))
    linked = linked.unionByName(nodes.filter("depth = 0").withColumns({"parent_conv_id": nothing, "up_owner": nothing}))
    linked = linked.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    linked = common.store(linked.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "owner", "up_owner", "chars"), "trie")

    own = linked.select("owner", "depth", "up_owner", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = peeled(own, span)
    ended = named.join(convs, "conv_id").filter("depth = n_turns").select(*NODE, "conv_id")
    ended = ended.union(convs.filter("n_turns = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    out = linked.join(totals, ["owner", "depth"]).join(_digests(ended), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
