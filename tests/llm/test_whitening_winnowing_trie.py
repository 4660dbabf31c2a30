from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import common, prefix_trie, queries, whitening, winnowing

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- whitening


def fitted(x):
    d = np.unique(x, axis=0)
    mean = d.mean(0)
    cov = (d - mean).T @ (d - mean) / len(d)
    e, v = np.linalg.eigh(cov)
    return len(d), mean, e[::-1], v[:, ::-1]


VECTORS = "vec_id long, embedding array<double>, label int, n long, x string, component int"


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 6)) * [9, 5, 3, 1, 1, 0.5] + 1e5  # a large common part
    rows = [(i, v.tolist(), 1, 2, "n", 3) for i, v in enumerate([*base, *[base[7]] * 40, base[3]])]  # one vector many times
    rows += [(101, None, 1, 2, "", 0), (102, [1.0] * 5 + [None], 1, 2, "", 0), (103, [float("nan")] + [0.0] * 5, 1, 2, "", 0), (104, [float("inf")] + [0.0] * 5, 1, 2, "", 0), (105, [1.0], 1, 2, "", 0), (106, [], 1, 2, "", 0), (None, base[0].tolist(), 1, 2, "", 0), (5, base[5].tolist(), 1, 2, "", 0)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    x = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, *_ in rows if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)}
    n, mean, e, v = fitted(np.array(list(x.values())))
    assert len(got) == 4 * (len(x) + 1) and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-6 for r in got)
    exact = np.array(sorted({tuple(map(int, u)) for u in x.values()}), object)
    for row in got:
        u, c = x[row["vec_id"]], row["component"] - 1
        assert abs(row["whitened"]) == pytest.approx(abs((u - mean) @ v[:, c]) / np.sqrt(e[c]), abs=1e-6)
        assert row["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-7)
        assert int(row["deviation"]) == int(((n * u.astype(object) - exact.sum(0)) ** 2).sum())


def test_whitening_of_little(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, None), (2, [])]).collect() == []
    one = make([(1, [0.5, -0.5, 0.25])]).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    two = make([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])]).collect()
    assert len(two) == 6 and sorted(round(r["whitened"]) for r in two if r["component"] == 1) in ([-1, -1, 1], [-1, 1, 1]) and all(r["whitened"] is None for r in two if r["component"] == 2)
    wide = make([(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [0.0, 0.0])]).collect()  # beyond 64 bits when squared
    assert {int(r["deviation"]) for r in wide if r["vec_id"] == 1} == {(3 * int(np.floor(256 * np.float32(1e15).astype(float)))) ** 2}
    with pytest.raises(Exception, match="too large"):
        make([(1, [3e38])]).collect()


def test_double_doubles_are_exact(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=100) * 10.0 ** r.integers(-8, 8, 100), r.normal(size=100)
    from fractions import Fraction

    for op, exact in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = op(a, b)
        assert all(Fraction(h) + Fraction(lo) == exact(Fraction(x), Fraction(y)) for h, lo, x, y in zip(high, low, a, b, strict=True))
    high, low = whitening.total((a, np.zeros(100)))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - sum(map(Fraction, a))) < abs(Fraction(float(high))) * Fraction(1, 2**90)
    # Parts of 600 tasks are merged in three levels' worth of steps, the small one isn't lost beside the large.
    parts = spark.createDataFrame([(0, p, [1e16 if p == 3 else -1e16 if p == 580 else 1.0], [0.0]) for p in range(600)], "i int, part int, high array<double>, low array<double>")
    assert whitening.merged(parts).first()["high"] == [598.0]


# ---- decontamination


def contaminated(docs, items, window=10):
    known = defaultdict(set)
    for i, text in items:
        w = tuple(WORDS.findall((text or "").translate(LOWER)))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            known[w[k : k + n]].add("" if i is None else str(i))
    sizes, out = {len(k) for k in known}, []
    for d, text in docs:
        w = tuple(WORDS.findall((text or "").translate(LOWER)))
        at = [(k, n) for n in sizes for k in range(len(w) - n + 1) if w[k : k + n] in known]
        names = set().union(*[known[w[k : k + n]] for k, n in at])
        hit = {x for k, n in at for x in range(k, k + n)}
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def said(r, n, words=60):
    return " ".join(r.choice(("w", "É", "x")) + str(r.randint(0, words)) for _ in range(n))


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(7)
    hot = said(r, 25, 500)  # in a third of all items and documents
    items = [(i, f"{said(r, 3)} {hot} {said(r, 8)}" if i % 3 == 0 else said(r, r.randint(11, 40), 400)) for i in range(60)]
    items += [(60, None), (61, ""), (62, " -- \n"), (63, "Only Three WORDS"), (64, "one"), (64, "two other texts of one item"), (None, said(r, 12)), (65, "x0 x1 x2 x3 x4 x5 x6 x7 x8"), (3, items[3][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, "ONLY-three words"), (4, "only three, wordsy"), (5, "one"), (6, "é" * 300), (7, said(r, 20_000, 30) + " one " + hot)]
    for k in range(8, 150):
        i, t = r.choice(items)
        w = (t or "").split()
        a = r.randint(0, max(0, len(w) - 1))
        cut = " ".join(w[a : a + r.choice((5, 9, 10, 11, 30))])
        docs.append((k, f"{said(r, r.randint(0, 30))}, {cut.upper() if k % 2 else cut}! {hot if k % 3 == 0 else ''} {said(r, r.randint(0, 30))}"))
    docs += [docs[9]] * 3 + [(None, items[0][1])]
    make = lambda rows, key: spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], f"{key} long, text string, words string, size int, w int").repartition(3)
    return docs, items, make(docs, "doc_id"), make(items, "item_id")


def ordered(rows):
    return sorted((tuple(r)[:6] for r in rows), key=repr)


@pytest.mark.parametrize("in_memory", [1 << 21, 0])
def test_contamination_against_all_windows(leaks, in_memory):
    docs, items, d, i = leaks
    got = winnowing.contamination(d, i, in_memory=in_memory, with_spans=True).collect()
    assert ordered(got) == ordered(contaminated(docs, items))
    assert all(sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_hit"] and all(x["hi"] < y["lo"] or x["hi"] <= y["lo"] for x, y in zip(r["spans"], r["spans"][1:])) for r in got)


def test_contamination_of_nothing(spark, leaks):
    docs, _, d, i = leaks
    assert winnowing.contamination(d.limit(0), i).collect() == []
    none = winnowing.contamination(d, i.limit(0)).collect()
    assert len(none) == len(docs) and all((r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (0, 0, sha(""), False) for r in none)


def test_shared_windows_share_a_fingerprint():
    r = random.Random(2)
    for size in (3, 9, 10, 24):
        passage = said(r, size)
        texts = [f"{said(r, r.randint(0, 9))} {passage} {said(r, 7)}".encode() for _ in range(2)]
        found = []
        for t in texts:
            w = winnowing.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            window = min(10, size)
            least, fits = w.prints(window, winnowing._gram(window, 5))
            at = [k for k in range(len(least)) if fits[k] and w.words_of(k, window) in " ".join(WORDS.findall(passage.translate(LOWER)))]
            found.append({int(least[k]) for k in at})
        assert found[0] and found[0] == found[1]


def test_op12_on_tables(spark, leaks, tmp_path):
    docs, items, d, i = leaks
    d.write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert ordered(queries.QUERIES["op12_decontamination"](spark, str(tmp_path)).collect()) == ordered(contaminated(docs, items))


# ---- prefix trie


def trie(rows):
    spoken = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            spoken[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in spoken.items()}
    member, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            member[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in member:
        if n:
            kids[n[:-1]] += 1
    for n in sorted(member, key=len, reverse=True):
        leaves[n] += not kids[n]
        saved[n] += (len(member[n]) - 1) * (len(n[-1][1]) if n else 0)
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    nodes = [(min(m), len(n), min(member[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(map(str, ends[n])))) for n, m in member.items()]
    return sorted(nodes, key=lambda r: r[:2])


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string, depth int, owner string"


@pytest.fixture(scope="module")
def talk():
    r = random.Random(3)
    rows = [(c, t, r.choice(("user", "bot", None)), r.choice(("", "a", "ü" * 5, "long " * 30, None))) for c in range(450) if c % 97 and c != 100 for t in range(r.choice((1, 2, 3, 5, 9)))]
    rows += [(7, None, "user", "first"), (7, 0, "user", "twin"), (7, 0, "user", "twin"), (None, 0, "user", "of no conversation")]
    rows += [(500 + c, t, "user", f"t{t}") for c in range(150) for t in range(8)]  # a hot path of copies
    rows += [(700, t, "user", f"t{t}") for t in range(900)]  # a very long one
    rows += [(800 + c, t, "user", "s" if t < c else "e") for c in range(60) for t in range(c + 1)]  # a spine with a leaf at each node
    return rows


def test_trie_of_short_pieces_against_all_prefixes(spark, talk):
    df = spark.createDataFrame([(*r, 1, "x") for r in talk], TURNS).repartition(7)
    got = prefix_trie.prefix_trie(df, span=64)
    assert listed(got) == trie(talk)


def test_one_conversation_over_all_partitions(spark):
    rows = [(100, t, "user", f"t{t % 3}") for t in range(700)] + [(101, 0, "user", "t0"), (199, 0, "x", "y")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    assert listed(prefix_trie.prefix_trie(df)) == trie(rows)


def test_turnless_and_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    lone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6][:3]  # their own first turns go and there is no conversation 0
    rows = [(c, 0, "user", "x") for c in lone]
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)).collect()]
    assert got == trie(rows) == [(lone[0], 0, None, 3, 0, 1, 0, sha(",".join(map(str, lone))))]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A spine of 120 nodes with a leaf at each is done in far fewer rounds than it is deep."""
    stored = []
    store = common.store
    monkeypatch.setattr(common, "store", lambda df, label: (stored.append(label), store(df, label))[1])
    rows = [(1000 * (c + 1), t, "user", "s" if t < c else f"e{c}") for c in range(120) for t in range(c + 1)]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS))
    root = got.filter("depth = 0").collect()[0]
    assert root["n_leaves"] == 120 and root["n_convs"] == 120 and stored.count("totals") < 25


def test_op13_on_tables(spark, talk, tmp_path):
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert listed(got) == trie(talk)
