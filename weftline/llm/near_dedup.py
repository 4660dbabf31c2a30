"""Near-duplicate documents: MinHash signatures joined through an inverted index of coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

#: A signature has COORDS coordinates, each made of MINIMA minima, so two sets of similarity s agree in
#: one with s ** 3. A pair needs MATCHES equal coordinates: at 0.8 all but 6 of 100 million linked pairs have them.
COORDS, MINIMA, MATCHES = 32, 3, 3
#: A list of postings up to this length is compared in full, a longer one against one member at first.
SHORT = 16
#: Documents of a block, where long lists are compared in blocks; parts into which the blocks of a list are dealt.
BLOCK, PARTS = 256, 8
_ODD = np.random.default_rng(77).integers(1, 1 << 63, COORDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in order: runs of n words, or the whole of a shorter text."""
    b, bounds = hashing.text_bytes(texts)
    for lo, hi in hashing.chunks(bounds):
        part, own = b[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        starts, ends, first = hashing.words(part, own)
        h = hashing.word_hashes(part, starts, ends, lower=True)
        run = hashing.runs(h, n)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= n:
                yield np.unique(run[a : z - n + 1])
            elif z > a:
                yield np.array([hashing.sequence(h[a:z])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(COORDS * MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, np.multiply.outer(_ODD, found[at : at + 2048]).min(1), out=low)
    low = low.reshape(COORDS, MINIMA)
    return (hashing.mixed((low * hashing.powers(0xD6E8FEB86659FD93, MINIMA)).sum(1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """id, n_shingles, digest of the set, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for found in shingle_sets(batch.column(1), n):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found) if len(found) else np.zeros(COORDS, np.int32))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * COORDS), flat)], ["id", "n_shingles", "digest", "sig"])

    return docs.select("id", "text").mapInArrow(common.lean(run), "id long, n_shingles long, digest binary, sig array<int>")


def _same(x: str, y: str) -> Column:
    """How many coordinates two signatures share."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id, hashes: the whole sets of the wanted documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n)], pa.binary())], ["id", "hashes"])

    wanted = common.store(wanted.distinct(), "wanted")
    return common.store(common.with_keys(docs, wanted, "id").select("id", "text").mapInArrow(common.lean(make), "id long, hashes binary"), "sets")


def _confirmed(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs a < b, met: collisions counted so far, those whose whole sets are similar enough.
    Pairs that have enough collisions are candidates; for the others all coordinates are probed, those of
    the lists that were skipped, too. Sets are made only for candidates."""
    short_of = pairs.filter(F.col("met") < MATCHES)
    short_of = short_of.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    short_of = short_of.filter(_same("sig_a", "sig_b") >= MATCHES)
    pairs = common.store(pairs.filter(F.col("met") >= MATCHES).select("a", "b").union(short_of.select("a", "b")), "candidates")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    sets = _sets(docs, wanted, n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) < len(q) else (q, p)
                if 100 * len(p) < percent * len(q):
                    keep.append(False)
                    continue
                at = np.searchsorted(q, p)
                shared = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.withColumnsRenamed({"id": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "hashes": "y"}), "b")
    return common.store(full.select("a", "b", "x", "y").mapInArrow(common.lean(compare), "a long, b long"), "confirmed")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, for the pairs that are wanted at least."""
    out = np.zeros(wanted.shape, np.int64)
    if wanted.mean() < 0.05:
        for i, j in zip(*np.nonzero(wanted), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def cells(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        flat = np.zeros((len(sets), len(part)), np.float32)
        row, item = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(part, item), len(part) - 1)
        hit = part[at] == item
        flat[row[hit], at[hit]] = 1
        return flat

    for k in range(0, len(both), 8192):
        part = both[k : k + 8192]
        out += (cells(left, part) @ cells(right, part).T).astype(np.int64)
    return out


def _compare_blocks(percent: int):
    """Links between two blocks of documents, or within one: all pairs of different components whose
    signatures agree enough are compared on their whole sets, and as many links are told as connect
    what is linked."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, roots, sigs, sets = [], [], [], []
        for t in (left, right):
            ids.append(t["node"].to_numpy())
            roots.append(t["root"].to_numpy())
            sigs.append(np.array(t["sig"].to_pylist(), np.int32).reshape(-1, COORDS))
            sets.append([np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]])
        found: list[tuple[int, int]] = []
        if len(ids[0]) and len(ids[1]):
            same = np.zeros((len(ids[0]), len(ids[1])), np.uint8)
            for c in range(COORDS):
                same += sigs[0][:, c][:, None] == sigs[1][:, c]
            wanted = (same >= MATCHES) & (roots[0][:, None] != roots[1])
            if left["block"][0] == right["block"][0]:
                wanted &= ids[0][:, None] < ids[1]
            if wanted.any():
                shared = _overlaps(sets[0], sets[1], wanted)
                n, m = (np.array([len(s) for s in x]) for x in sets)
                link = wanted & (100 * shared >= percent * (n[:, None] + m - shared))
                top: dict[int, int] = {}

                def find(x: int) -> int:
                    while top.setdefault(x, x) != x:
                        top[x] = top[top[x]]
                        x = top[x]
                    return x

                for i, j in zip(*np.nonzero(link), strict=True):
                    x, y = find(int(roots[0][i])), find(int(roots[1][j]))
                    if x != y:
                        top[x] = y
                        found.append((int(ids[0][i]), int(ids[1][j])))
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return run


def _parts() -> Column:
    """A row for each part into which what belongs to one list is dealt."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")


def _linked_in_blocks(rows: DataFrame, sigs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that are still missing in lists (node, root, key, length) with several components.

    Each node has a block: a share of BLOCK nodes of the longest list it is in. A component with that many
    nodes in a list has blocks of its own, and of a list's largest one no two blocks are paired: only
    what is outside it meets the list's blocks. Rows grow with the number of block pairs, never with that
    of node pairs, and a task holds two blocks."""
    homes = rows.groupBy("node", "root").agg(F.max(F.struct("length", "key"))["key"].alias("home"))
    sizes = homes.groupBy("home", "root").agg(F.count("*").alias("many"))
    sizes = sizes.withColumn("own", F.when(F.col("many") >= BLOCK, F.col("root")))  # null: with other small components
    room = sizes.groupBy("home", "own").agg(F.ceil(F.sum("many") / BLOCK).alias("blocks"))
    sizes = sizes.alias("s").join(room.alias("r"), (F.col("s.home") == F.col("r.home")) & F.col("s.own").eqNullSafe(F.col("r.own"))).select("s.home", "root", "s.own", "blocks")
    placed = homes.join(sizes, ["home", "root"])
    placed = placed.select("node", "root", "own", F.xxhash64("home", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    placed = common.store(placed, "blocks")
    meets = rows.select("key", "node").join(placed.select("node", "block", "own"), "node").groupBy("key", "block", "own").agg(F.count("*").alias("many"))
    meets = common.store(meets, "meetings")
    top = meets.filter("own is not null").groupBy("key", "own").agg(F.sum("many").alias("many")).groupBy("key").agg(F.max(F.struct("many", "own"))["own"].alias("top"))
    outside = meets.join(top, "key", "left").filter("own is null or own <> top").select("key", F.col("block").alias("x"), F.pmod(F.xxhash64("block"), F.lit(PARTS)).alias("part"))
    others = meets.select("key", F.col("block").alias("y"), _parts())
    pairs = outside.join(others, ["key", "part"]).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = common.store(pairs, "block-pairs")
    sets = _sets(docs, placed.select(F.col("node").alias("id")), n).groupBy("id").agg(F.min("hashes").alias("hashes"))
    full = common.store(placed.join(sigs, "node").join(sets.withColumnRenamed("id", "node"), "node"), "members")

    def side(key: str):
        own = full.select(F.col("block").alias(key), *[F.col(c).alias(c) for c in ("block", "node", "root", "sig", "hashes")])
        return pairs.select(*[F.col(c).alias(c) for c in ("x", "y")]).join(own, key).groupBy("x", "y")

    left, right = side("x"), side("y")
    return common.store(left.cogroup(right).applyInArrow(common.tidy(_compare_blocks(percent)), "a long, b long"), "confirmed")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes_and_links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(sketches of all documents, class of each digest: digest, node, size; node, root of linked classes)."""
    sketched = common.store(sketches(docs, n), "sketches")
    whole = sketched.filter("n_shingles > 0 and id is not null")
    picked = whole.groupBy("digest").agg(F.min(F.struct("id", "sig")).alias("least"))
    nodes = common.store(picked.select("digest", F.col("least.id").alias("node"), F.col("least.sig").alias("sig")), "classes")
    sigs = nodes.select("node", "sig")
    prefix = COORDS - MATCHES + 1  # a pair with enough matches has one among the first
    posts = sigs.select("node", F.posexplode(F.slice("sig", 1, prefix)).alias("coord", "value"))
    posts = posts.select("node", "coord", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("length"), F.min(F.struct(F.xxhash64("node", "key"), "node"))["node"].alias("center")).filter("length > 1")
    members = common.store(posts.join(lists, "key"), "postings")
    short = members.filter(F.col("length") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    both = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = short.select(F.explode(both).alias("p")).select("p.a", "p.b", F.lit(1).alias("met"))
    long_ = members.filter(F.col("length") > SHORT)
    star = long_.groupBy("node").agg(F.max(F.struct("length", "key", "center"))["center"].alias("center"))
    pairs = pairs.union(star.select(*_ordered("node", "center"), F.lit(0))).filter("a <> b").groupBy("a", "b").agg(F.sum("met").alias("met"))
    links = _confirmed(pairs, sigs, docs, n, percent)
    if long_.isEmpty():
        return sketched, nodes, (None if links.isEmpty() else components(links))

    def labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def open_lists(roots: DataFrame | None) -> DataFrame:
        """Postings of the long lists whose members aren't all of one component. A list is dealt over parts."""
        rows = labelled(long_, roots)
        mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", _parts())
        return common.store(rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).join(mixed, ["key", "part"]).drop("part"), "open")

    roots = None if links.isEmpty() else components(links)
    rows = open_lists(roots)
    if not rows.isEmpty():
        links = links.union(_linked_in_blocks(rows, sigs, docs, n, percent))
        roots = None if links.isEmpty() else components(links)
    return sketched, nodes, roots


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs.

    Documents whose sets are equal are one class and its smallest id stands for it. Classes are posted
    under every (coordinate, value) of the signature's prefix; coordinates beyond it are skipped, as two
    classes with MATCHES equal ones have one in the prefix. Lists up to SHORT are merged: collisions are
    counted for each pair in them. Longer lists are skipped, too: each member is first compared with one
    that the list's hash picks, and where members then still are in different components, those outside
    the largest are compared with all, in blocks. Skipped lists are probed for pairs that are short of
    MATCHES, those that reach it are compared on their whole sets. Every link is
    confirmed on the whole sets; a link whose ends are in one component already isn't looked for.

    Null and empty texts have no shingles, are linked with nothing and are kept. Rows repeated under one
    id are one node; a null id is linked with nothing, is its own component and kept. An empty table
    gives no rows; other columns are ignored. percent must be 80 or more, as the signature is made for that.
    """
    if percent < 80:
        raise ValueError("signatures are made for similarities of 80 percent and more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched, nodes, roots = classes_and_links(rows, shingle_words, percent)
    if roots is not None:
        nodes = nodes.join(roots.hint("merge"), "node", "left").withColumn("node", F.coalesce("root", "node"))
    out = sketched.select("id", "n_shingles", "digest").join(nodes.select("digest", "node").hint("merge"), "digest", "left")  # a row for each document: nothing for the driver
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("node", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns, whatever their names: one
    document of each group. Null and empty texts and rows with a null id stay; rows repeated under one id
    stay or go together; an empty table gives no rows."""
    id_, key_ = common.free(docs.columns, "id", "key")
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(F.col(id_col).alias(id_)).distinct()
    rows = docs.withColumn(key_, F.col(id_col).cast("long"))
    return rows.join(kept, F.col(key_).eqNullSafe(F.col(id_)), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
