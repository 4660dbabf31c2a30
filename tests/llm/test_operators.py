from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, common, exact_dedup, id_coder, language, mixing, near_dedup, packing, phrase_dedup, queries, repeats, suffix_dedup, token_file, url_filter
from weftline.llm.tokens import PieceTokenizer

SPACES = r"[\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, id string"


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, odd texts, a very long one, repeats; with ids."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghiéü", k=r.randint(2, 8))) for _ in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, body = say(60), say(120)
    out = ["", None, " \t\n", "one", "One", "Two words", "it's 'Twas don't", "x\x00y \x00", "中文 текст ελ", "a" * 300, "ab " * 200]
    out += [" ".join(body)] * 6 + ["  " + " \n".join(body)] * 2
    for k in range(20):
        near = list(body)
        near[k * 5] = f"edit{k}"
        out.append(" ".join(near))
        out.append(" ".join(say(r.randint(1, 60)) + passage + say(r.randint(1, 60))))
        out.append(" ".join(say(r.randint(5, 90))))
    out.append(" ".join(say(9000)))
    ids = list(range(len(out)))
    r.shuffle(ids)
    return sorted(zip(ids, out, strict=True))


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """With columns whose names clash with those used inside, and one hot source."""
    rows = [(i, t, "en" if i % 3 else "fr", None if i % 9 == 0 else f"s{i % 4 if i % 2 else 0}", len(t or ""), "k", 1, "x") for i, t in texts]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t):
    return (t or "").encode().split()


def test_mixing(spark, docs, texts, none):
    got = table(mixing.mix(docs))
    source = table(docs.select("doc_id", "source"))
    size = {i: len(words(t)) for i, t in texts}
    by = Counter()
    for i in size:
        by[source[i]["source"]] += size[i]
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(by.values()) - sum(2 * by[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * by[s] if s in full else left * weight[s] / rest for s in order}
        more = {s for s in order if target[s] > 2 * by[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and 0 <= r["taken"] <= 2 * size[i]
        assert math.isclose(r["target"], target[source[i]["source"]], rel_tol=1e-12)
        assert (r["position"] is None) == (r["taken"] == 0) and all(0 <= p <= 1 for p in r["positions"])
        taken[source[i]["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert {i: r["taken"] for i, r in table(mixing.mix(docs.repartition(5))).items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_mixing_stage_keeps_texts_whole(spark, docs, texts):
    import corpus_pipeline

    text, size = dict(texts), {r["doc_id"]: r["taken"] for r in mixing.mix(docs).filter("size(copies) > 0").collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert mixed and all(r["text"] == text[r["doc_id"]] for r in mixed) and {r["doc_id"] for r in mixed} == set(size)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    assert sum(len(words(r["text"])) for r in mixed) > sum(size.values())


def test_schedule_is_inverted(spark):
    knots = [(0.0, 1.0), (0.5, 3.0), (1.0, 3.0)]
    whole = mixing.integral(knots)
    for t in (0.0, 0.2, 0.5, 0.9, 1.0):
        done = t + 2 * t * t if t <= 0.5 else 1.0 + 3 * (t - 0.5)
        assert spark.range(1).select(mixing._invert(knots, F.lit(done / whole))).first()[0] == pytest.approx(t, abs=1e-9)


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(900, None, "c"), (901, [0.0] * 16, "c"), (902, [float("nan")] + [1.0] * 15, "c"), (903, [1.0], "c"), (904, [None] + [1.0] * 15, "c"), (3, x[3].tolist(), "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    found = ann.neighbours(vectors, vectors.filter("vec_id % 50 = 0"), block=16, recall=0.99).collect()
    x = x.astype(float)
    n = np.sqrt((x * x).sum(1))
    hits = total = 0
    for q in range(0, 400, 50):
        score = (x * x[q]).sum(1) / (n * n[q])
        score[q] = -9
        best = np.lexsort((np.arange(400), -score))[:5]
        own = sorted((f for f in found if f["query_id"] == q), key=lambda f: f["rank"])
        assert [f["rank"] for f in own] == [1, 2, 3, 4, 5] and all(f["score"] == score[f["vec_id"]] for f in own)
        hits += len({f["vec_id"] for f in own} & set(best.tolist()))
        total += 5
    assert hits >= 0.9 * total and {f["query_id"] for f in found} == set(range(0, 400, 50))
    empty = vectors.filter("vec_id < 0")
    assert ann.neighbours(empty, empty).count() == 0
    assert ann.neighbours(vectors.filter("vec_id in (1, 2)"), vectors.filter("vec_id = 1")).count() == 1


def test_nearest_with_repeated_rows(spark):
    r = np.random.default_rng(12)
    x = r.standard_normal((40, 6))
    x[1] = x[0] + 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[1].tolist())] * 30 + [(0, x[0].tolist())] * 30
    rows += [(1, (x[1] + e).tolist()) for e in r.standard_normal((30, 6)) * 1e-3]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = {}
    for i, v in rows:
        if i:
            near[i] = max(near.get(i, -9), float(x[0] @ v / np.linalg.norm(x[0]) / np.linalg.norm(v)))
    want = sorted(near, key=lambda i: -near[i])[:5]
    found = sorted(ann.neighbours(vectors, vectors.filter("vec_id = 0"), leaf=200).collect(), key=lambda f: f["rank"])
    assert [f["vec_id"] for f in found] == want and [f["score"] for f in found] == pytest.approx([near[i] for i in want])


def test_recall_is_fitted_without_the_own_rows():
    r = np.random.default_rng(13)
    x = r.standard_normal((300, 16))
    again = np.repeat(np.arange(300), 6)
    copies = x[again] + r.standard_normal((1800, 16)) * 1e-9
    forest, probes = ann.fit(copies, again, 5, 4, 32, 0.95)
    unit = copies / np.linalg.norm(copies, axis=1, keepdims=True)
    homes, hits = forest.route(unit), 0
    for i, leaves in zip(range(0, 1800, 18), forest.search(unit[::18], probes), strict=True):
        near = unit @ unit[i]
        near[again == again[i]] = -2
        best = set(again[np.argsort(-near)[:30]].tolist())
        hits += len(best & set(again[np.isin(homes, leaves).any(1)].tolist()))
    assert hits >= 0.9 * 500


@pytest.mark.parametrize("load", [4000, 5])
def test_phrases(docs, texts, none, load):
    got = table(phrase_dedup.remove_repeated(docs, load=load, with_text=True))
    all_ = {i: words(t) for i, t in texts}
    seen = Counter(tuple(w[k : k + 35]) for w in all_.values() for k in range(len(w) - 34))
    for i, w in all_.items():
        out = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                out[k : k + 35] = True
        kept = b" ".join(x for x, o in zip(w, out, strict=True) if not o)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), out.sum(), kept.decode())
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    if load == 5:
        assert phrase_dedup.remove_repeated(none).count() == 0


@pytest.mark.parametrize("load", [4000, 5])
def test_suffixes(docs, texts, none, load):
    got = table(suffix_dedup.remove_repeated_bytes(docs, load=load, batch=2000, with_text=True))
    seen = set()
    for i, t in texts:
        b = (t or "").encode()
        out = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                out[k : k + 100] = True
            seen.add(b[k : k + 100])
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(b), out.sum())
        assert got[i]["kept_bytes"] == np.frombuffer(b, np.uint8)[~out].tobytes()
        assert got[i]["n_spans"] == len(re.findall("1+", "".join("01"[int(o)] for o in out)))
    if load == 5:
        assert suffix_dedup.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("letters", [phrase_dedup.LETTERS, 3])
def test_automata_locate_every_occurrence(letters, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "LETTERS", letters)
    monkeypatch.setattr(phrase_dedup, "PASSAGES", 2)
    r = np.random.default_rng(15)
    codes, bounds = r.integers(0, 4, 200).astype(np.uint64), np.array([0, 60, 60, 63, 200])
    passages = np.array([120, 0, 10, 70, 100])
    anchors = np.array([1 + min(codes[k : k + 4]) if any(a <= k and k + 4 <= z for a, z in zip(bounds, bounds[1:], strict=False)) else 0 for k in range(197)], np.uint64)
    wanted = {tuple(codes[p : p + 4]) for p in passages}
    at = [k for a, z in zip(bounds, bounds[1:], strict=False) for k in range(a, z - 3) if tuple(codes[k : k + 4]) in wanted]
    assert phrase_dedup.occurrences(codes, anchors, passages, 4).tolist() == at
    assert not len(phrase_dedup.occurrences(codes, anchors, passages[:0], 4))


def test_phrases_go_by_the_automata_alone(spark, monkeypatch):
    import pyarrow as pa

    unit = repeats.Unit(5, 2, True, 100)
    text = b"a b c d e f g"
    table = pa.table({"cell": [1, 1], "salt": pa.array([0, 0], pa.int32()), "salts": pa.array([1, 1], pa.int32()), "key": [7, 8], "id": [1, 2], "start": [0, 4], "piece": [text, b"x " + text]})
    assert sorted(zip(*[c.to_pylist() for c in phrase_dedup._automata(unit)(table).columns[:4]], strict=True)) == [(7, 1, 0, 7), (8, 2, 5, 12)]
    monkeypatch.setattr(phrase_dedup, "compiled", lambda passages, make=phrase_dedup.compiled: make([p[:1] * 99 for p in passages]))
    assert phrase_dedup._automata(unit)(table).num_rows == 0


@pytest.mark.parametrize("load", [4000, 5])
def test_different_texts_under_one_id(spark, load):
    r = random.Random(16)
    body = " ".join("".join(r.choices("abcdef", k=5)) for _ in range(60))
    rows = [(1, body), (1, "x " + body), (1, body[40:]), (2, body), (2, body), (None, body)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(x["doc_id"], x["text"]): x["k"] for x in d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_repeated_bytes(d, load=load).collect())
    want, seen = Counter(), set()
    for i, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0], keys[x])):
        out, new = np.zeros(len(t), bool), set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen | new:
                out[k : k + 100] = True
            new.add(t[k : k + 100])
        seen |= new
        want[i, len(t), int(out.sum())] += rows.count((i, t))
    assert got == want
    assert all(x["n_removed"] == x["n_words"] for x in phrase_dedup.remove_repeated(d, load=load).filter("n_words = 60").collect())


def test_many_repeated_rows_stay_linear(spark):
    text = " ".join(f"w{k}" for k in range(80))
    d = spark.createDataFrame([(1, text)] * 300 + [(2, "y " + text)], "doc_id long, text string")
    unit = repeats.Unit(35, 6, True, 100)
    keyed, found = repeats.routed(d, unit, phrase_dedup._automata(unit), "doc_id", "text")
    assert found.filter("n = 0").count() <= 20
    assert {(x["doc_id"], x["n_removed"]) for x in phrase_dedup.remove_repeated(d).collect()} == {(1, 80), (2, 80)}
    assert {(x["doc_id"], x["n_removed"]) for x in suffix_dedup.remove_repeated_bytes(d).collect()} == {(1, 0), (2, len(text))}


def test_repeated_rows_and_null_ids(spark):
    long_ = " ".join(f"w{k}" for k in range(50))
    d = spark.createDataFrame([(1, long_), (1, long_), (None, long_), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in phrase_dedup.remove_repeated(d).collect()) == [(0, 50), (1, 50), (1, 50), (2, 0)]
    size = len(long_)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.remove_repeated_bytes(d).collect()) == [(0, size), (1, 0), (1, 0), (2, 0)]
    kept = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.content_sort(d).collect()]
    assert sorted(kept, key=str) == sorted([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True)], key=str)
    near = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d).collect()]
    assert sorted(near, key=str) == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True)], key=str)
    assert exact_dedup.drop_copies(d).count() == 2


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_family_of_suffix_arrays(block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    family, seen = suffix_dedup.Family(4), set()
    for _ in range(30):
        b = r.integers(1, 4, 60).astype(np.uint8)
        at = np.arange(57)
        want = []
        for k in at:
            want.append(bytes(b[k : k + 4]) in seen)
            seen.add(bytes(b[k : k + 4]))
        assert family.add(b, at).tolist() == want
        assert all(len(x.places) >= 2 * len(y.places) for x, y in zip(family.levels, family.levels[1:], strict=False))
    for level in family.levels:
        strings = level.strings(0, len(level.places), 4).tolist()
        assert strings == sorted(set(strings)) and len(level.places) == len(strings)
    assert sum(len(x.places) for x in family.levels) == len(seen)


def test_ranks_are_those_of_sorted_runs():
    r = np.random.default_rng(14)
    for units, n in ((r.integers(0, 3, 300).astype(np.uint8), 100), (r.integers(0, 2, 200).astype(np.uint8), 5), (r.integers(0, 3, 200).astype(np.uint64), 35), (np.zeros(9, np.uint8), 9), (np.zeros(8, np.uint8), 9)):
        runs = [bytes(units[k : k + n].astype(np.uint8)) for k in range(len(units) - n + 1)]
        place = {x: k for k, x in enumerate(sorted(set(runs)))}
        assert repeats.ranks(units, n).tolist() == [place[x] for x in runs]


def test_anchors_are_in_every_window():
    r = np.random.default_rng(5)
    unit = repeats.Unit(20, 4, False, 10)
    t = repeats.Texts(r.integers(97, 100, 400).astype(np.uint8), np.array([0, 10, 29, 29, 400]), unit)
    at, h = t.anchors()
    assert len(at) == len(h)
    for a, z in ((10, 29), (29, 400)):
        if z - a >= 20:
            for k in range(a, z - 19):
                assert ((at >= k) & (at <= k + 16)).any()
    assert not ((at < 29) & (at >= 0)).any() or 29 - 10 >= 20


def test_language(spark, docs, none):
    r = random.Random(6)
    sound = {"aa": ["la", "mi", "so"], "bb": ["krk", "zz", "vst"]}
    talk = lambda lang, n: " ".join("".join(r.choices(sound[lang], k=3)) for _ in range(n))
    rows = [(i, talk(x, 12), x) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(200, None, "aa"), (201, "12 ... 9", "bb"), (202, "", None), (203, talk("aa", 30) + " " + talk("bb", 10), None), (204, "кот", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = table(language.identify(d, language.learn(d), spans=True))
    assert [found[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and found[200]["score"] == 0
    assert all(found[i]["lang_pred"] == x and found[i]["score"] > 0.9 for i, _, x in rows[:120])
    assert [(s["lang"], s["words"]) for s in found[203]["spans"]] == [("aa", 30), ("bb", 10)] and found[203]["score"] == 0.75
    assert found[204]["lang_pred"] in sound and found[204]["score"] == 0
    assert language.drop_unknown(d).filter("doc_id in (200, 201, 202)").count() == 0
    assert language.learn_and_identify(none).count() == 0
    alone = d.filter("doc_id = 201")
    assert language.learn_and_identify(alone.withColumn("lang", F.lit(None).cast("string"))).first()["lang_pred"] == "und"


def test_best_path():
    r = np.random.default_rng(8)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), [set()] * 3, 0, 2.0)
    first = np.array([0, 5, 5, 8, 9])
    scores = r.standard_normal((9, 3)).astype(np.float32) * 2
    label = model.path(scores, first)
    import itertools

    for a, z in zip(first[:-1], first[1:], strict=True):
        worth = lambda p, a=a: sum(scores[a + k, x] for k, x in enumerate(p)) - 2 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        if z > a:
            assert worth(label[a:z]) == pytest.approx(max(worth(p) for p in itertools.product(range(3), repeat=z - a)), abs=1e-4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_what_the_library_says(name):
    r = random.Random(9)
    tok = PieceTokenizer(queries.vocabulary(name))
    assert tok.rule in ("byte", "word")
    texts = ["".join(r.choices(list("abcsStTmdDreEvlL''''  \n\t0129!?-.éüÉßñ×÷İŉ«中\u0301\x1c\x85"), k=r.randint(0, 30))) for _ in range(2000)] + ["", None, "<|endoftext|> it's", "''ve 'LL"]
    import pyarrow as pa

    ids, counts = tok.encode(pa.array(texts))
    want = [e.ids for e in tok.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_one_id(name, tmp_path):
    import pyarrow as pa
    from tokenizers import AddedToken, Tokenizer

    more = Tokenizer.from_file(queries.vocabulary(name))
    more.add_tokens([AddedToken("Total Sum", normalized=True), AddedToken("xyzé", normalized=False), AddedToken("end", single_word=True, lstrip=True, normalized=False)])
    more.save(str(tmp_path / "more.json"))
    for path in (queries.vocabulary(name), str(tmp_path / "more.json")):
        library, tok, r = Tokenizer.from_file(path), PieceTokenizer(path), random.Random(10)
        parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "a", " b", "  ", "\n", "it's", "total \n sum", "Total Sum", "xyzé", "XYZÉ", " end", "ends", "é", "中", "7"]
        texts = ["".join(r.choices(parts, k=r.randint(0, 8))) for _ in range(1500)] + ["a <|endoftext|> b", None, ""]
        for some in (texts, texts[5:], texts[-3:-2]):
            ids, counts = tok.encode(pa.array(some))
            want = [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert library.token_to_id("<|endoftext|>") in tok.encode(pa.array(["a <|endoftext|> b"]))[0]


def test_token_files_and_packing_keep_added_tokens(spark):
    from tokenizers import Tokenizer

    said = [(1, "a <|endoftext|> b"), (2, "c"), (3, "<|startoftext|>x<|endoftext|>"), (4, "<|endoftext|>")]
    d = spark.createDataFrame(said, "doc_id long, text string")
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)):
        path = queries.vocabulary(name)
        library, at = Tokenizer.from_file(path), 0
        folder = common.new_path(spark, "ids-added")
        read, packed = table(token_file.read_tokens(spark, folder, token_file.write_tokens(d, folder, path, end=end), with_ids=True)), table(packing.pack(d, path, end=end))
        for i, t in said:
            ids = [*library.encode(t, add_special_tokens=False).ids, end]
            assert (read[i]["start"], read[i]["n_tokens"], read[i]["ids"]) == (at, len(ids), ids)
            assert (packed[i]["length"], packed[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)


def test_coder_round_trip():
    r = np.random.default_rng(4)
    for n, block in ((0, 16), (1, 16), (16, 16), (17, 16), (3000, 300), (2000, 4096)):
        for ids in (r.integers(0, 65536, n), r.integers(0, 3, n), np.zeros(n, int), r.zipf(1.3, n) % 50257):
            data, sizes = id_coder.encode(ids.astype("<u4"), block)
            assert (id_coder.decode(data, sizes, n, block) == ids).all()
    with pytest.raises(ValueError):
        id_coder.encode(np.array([70000]), 16)
    with pytest.raises(ValueError):
        id_coder.encode(np.array([1]), (1 << 19) + 1)
    hot = r.permutation(np.tile(np.array([7, 7, 7, 7, 40000]), 5_000))  # one block longer than usual
    data, sizes = id_coder.encode(hot, len(hot))
    assert (id_coder.decode(data, sizes, len(hot), len(hot)) == hot).all()
    ids = (r.zipf(1.5, 20000) % 500).astype("<u4")
    assert len(id_coder.encode(ids, 4096)[0]) * 4 < 0.6 * 2 * len(ids)


def test_token_files(spark, docs, texts, none):
    folder = common.new_path(spark, "ids-test")
    files = token_file.write_tokens(docs, folder, queries.vocabulary("byte_bpe_50k.json"), end=0, block=64, file_ids=3000)
    got = table(token_file.read_tokens(spark, folder, files, with_ids=True))
    tok, at = PieceTokenizer(queries.vocabulary("byte_bpe_50k.json")).tokenizer, 0
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (at, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert files.count() > 3
    empty = common.new_path(spark, "ids-none")
    assert token_file.read_tokens(spark, empty, token_file.write_tokens(none, empty, queries.vocabulary("byte_bpe_50k.json"), end=0)).count() == 0
    whole = token_file.pack_file(np.array([5]), np.array([True]), np.array([3]), np.array([1, 2, 3], "<u4"), 2)
    for k in (8, 20, len(whole) - 1):
        with pytest.raises(ValueError):
            token_file.unpack_file(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :])


def test_exact_groups(spark, docs, texts, none):
    got = table(exact_dedup.content_sort(docs))
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(SPACES, "", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.content_sort(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {min(m)[1] for m in groups.values()}


def test_runs_over_partitions_are_stitched():
    e = lambda pid, edge, sha, keep, n: {"pid": pid, "edge": edge, "sha": sha, "keep": keep, "n": n}
    fixes = exact_dedup._stitched([e(0, 1, b"a", 1, 2), e(0, 2, b"b", 3, 4), e(1, 3, b"b", 7, 5), e(3, 1, b"b", 8, 1), e(3, 2, b"c", 9, 1)])
    assert fixes == [(0, 2, 3, 10, True), (1, 3, 3, 10, False), (3, 1, 3, 10, False)]


def test_url_rules(spark):
    urls = ["http://a.example.com/en/7x", "HTTP://EXAMPLE.COM/en/8?x#y", "https://example.net/de/8", "http://b.net/de/", "http://xcom/en/", "http://x.org/es/1", "ftp://y.org", "no url", "", None, "http://example.com/en/7", "http://example.com/en/7", "a://b?c://d/en/", "://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    for bits in (12, 1):  # few bits: many false positives, many levels, the same verdicts
        got = table(url_filter.filter_urls(pages, rules, bits_per_key=bits, hashes=2), "page_id")
        for i, u in enumerate(urls):
            m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            fits = [(h + p, a) for h, p, a in queries.URL_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
            rule, action = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action), u
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("rule is not null").count() == 0


def near_truth(texts, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(SPACES, (t or "").translate(low)) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("short", [16, 2])
def test_near_copies(docs, texts, none, short, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = table(near_dedup.near_duplicates(docs, shingle_words=4))
    for i, (n, root) in near_truth(texts, 4).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, i == root)
    if short == 16:
        assert near_dedup.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(none, percent=70)


def test_a_list_with_one_large_component(spark, monkeypatch):
    """Blocks of the largest component aren't paired with each other; links to what is outside are found."""
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(17)
    body = [r.choice("abcdefgh") + str(k) for k in range(60)]
    texts = []
    for k in range(60):  # one edit more each time, so far ones are linked through others only
        near = list(body)
        for e in range(k % 12):
            near[5 * e] = f"e{e}"
        texts.append((k, " ".join(near) + (" end" if k % 2 else "")))
    texts += [(100 + k, " ".join(f"x{k}y{n}" for n in range(30))) for k in range(5)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = table(near_dedup.near_duplicates(d, shingle_words=4))
    for i, (n, root) in near_truth(texts, 4).items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (n, root)


def test_leftovers_of_dead_attempts_are_not_read(spark):
    import os

    d = spark.createDataFrame([(k, f"text {k} more") for k in range(20)], "doc_id long, text string")
    folder, path = common.new_path(spark, "ids-left"), queries.vocabulary("byte_bpe_50k.json")
    files = token_file.write_tokens(d, folder, path, end=0)
    place = folder.removeprefix("file://")
    name = sorted(os.listdir(place))[0]
    with open(f"{place}/{name}", "rb") as f:
        data = f.read()
    for left, part in ((f"_{name}.77.part", data), (f"{name}.78.part", data[: len(data) // 2]), ("_x.ids.1.part", b"")):
        with open(f"{place}/{left}", "wb") as f:
            f.write(part)
    got = table(token_file.read_tokens(spark, folder, files))
    assert sorted(got) == list(range(20)) and got[0]["start"] == 0


def test_a_retry_may_find_its_file(monkeypatch, tmp_path):
    from pyarrow import fs

    class Store:
        """Doesn't rename onto a file."""

        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, a, b):
            if self.inner.get_file_info(b).type == fs.FileType.File:
                raise OSError("there is one")
            self.inner.move(a, b)

    class There:
        @staticmethod
        def from_uri(uri):
            return Store(), uri

    class Turn:
        @staticmethod
        def get():
            return Turn

        @staticmethod
        def taskAttemptId():
            return 5

    monkeypatch.setattr(fs, "FileSystem", There)
    monkeypatch.setattr(token_file, "TaskContext", Turn)
    for _ in range(2):
        token_file._save(f"{tmp_path}/f/1.ids", b"abc")
    assert [p.name for p in (tmp_path / "f").iterdir()] == ["1.ids"] and (tmp_path / "f" / "1.ids").read_bytes() == b"abc"


def test_language_sample_and_folds(spark, monkeypatch):
    assert language.threshold(4000, 4000) == 1 << 62 and 0 < language.threshold(4000, 10**13) < (1 << 62) // 10**9
    r = random.Random(18)
    sound = {"aa": ["la", "mi", "so"], "bb": ["krk", "zz", "vst"]}
    talk = lambda lang: " ".join("".join(r.choices(sound[lang], k=3)) for _ in range(8))
    rows = [(i, talk(x), x) for i, x in enumerate(["aa", "bb"] * 100)]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = d.filter("lang = 'aa'")
    assert language.drop_unknown(alone).count() == 100 and language.learn_and_identify(alone).filter("score = 1").count() == 100
    kept = d.select("doc_id", language.held_out().alias("h")).filter("h").collect()
    assert [x["doc_id"] for x in kept] == held
    # What is held out is never learned: with wrong labels there the model is the same.
    wrong = [(i, t, "cc" if i in held else x) for i, t, x in rows]
    a, b = language.learn(d), language.learn(spark.createDataFrame(wrong, d.schema))
    assert a.langs == b.langs == ["aa", "bb"] and (a.table == b.table).all()
    assert (language.learn(d, docs_per_lang=20).table != a.table).any()
    # The table against plain counting.
    grams = {x: Counter() for x in sound}
    for i, t, x in rows:
        if i not in held:
            by = np.frombuffer(t.encode(), np.uint8)
            from weftline.llm import hashing

            starts, ends, _ = hashing.words(by, np.array([0, len(by)]))
            grams[x].update(language._grams(by, starts, ends)[0].tolist())
    for k, x in enumerate(a.langs):
        for cell in set(grams["aa"]) | set(grams["bb"]):
            logs = [math.log((grams[y][cell] + 0.5) / (sum(grams[y].values()) + 0.5 * language.GRAMS)) for y in a.langs]
            assert a.table[cell, k] == pytest.approx(logs[k] - sum(logs) / 2, abs=1e-4)


def test_word_scores_are_sums_over_their_cells():
    r = np.random.default_rng(19)
    model = language.Model(["a", "b"], r.standard_normal((language.GRAMS, 2)), [{"Latin"}, {"Latin", "Cyrillic"}], 0, 1.0)
    said = ["Ab", "12", "кот", "中", "é"]
    by = np.frombuffer(" ".join(said).encode(), np.uint8)
    from weftline.llm import hashing

    starts, ends, _ = hashing.words(by, np.array([0, len(by)]))
    got, lettered = model.scores(by, starts, ends)
    assert lettered.tolist() == [True, False, True, False, True] and (got[1] == 0).all() and (got[3] == 0).all()
    for i in (0, 4):
        w = said[i].lower().encode() if said[i].isascii() else said[i].encode()
        pad = b" " + w + b" "
        cells = [((pad[k] * 0x3779B9 + pad[k + 1] * 0x85EBCB + pad[k + 2] * 0x2C1B3D) % (1 << 32) >> 5) % language.GRAMS for k in range(len(w))]
        assert got[i] == pytest.approx(sum(model.table[c] for c in cells), abs=1e-4)
    assert got[2][0] == -50 and got[2][1] > -50


def test_whole_row_stages_with_clashing_names(spark):
    import corpus_pipeline

    extra = ["_lang", "_score", "lang_pred", "lettered", "score", "id", "sha", "turn", "_id", "_sha", "key", "a", "b", "at", "copy", "tag", "text_taken", "node", "root", "size", "A_"]
    r = random.Random(20)
    rows = [(k, " ".join(r.choices(["la", "mi", "so", "fa", "re"], k=30)), "aa", f"s{k % 2}", 7, *["v"] * len(extra)) for k in range(12)]
    rows += [rows[3], (None, rows[5][1] + " ", None, None, 7, *["v"] * len(extra)), (50, None, "aa", None, 7, *["v"] * len(extra)), (51, "", "aa", "s0", None, *["v"] * len(extra))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:4]:
        d = common.store(stage(spark, d, ""), "clash")
        assert d.columns[5:] == extra and d.count() and all(x[c] == "v" for x in d.collect() for c in extra)
    assert {x["doc_id"] for x in d.collect()} <= {*range(12), None}


def test_pipeline_of_nothing(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_are_the_same_in_reruns(spark):
    r = random.Random(21)
    rows = [(k % 5, " ".join(r.choices("abcdef", k=10)), "s", n) for k in range(30) for n in (1, 2)] + [(1, "w x y z", "s", 1)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    key = lambda m: sorted(map(tuple, m.collect()), key=str)
    one = key(mixing.mixed_documents(d))
    assert one == key(mixing.mixed_documents(d.repartition(7)))
    assert sum(len(words(x[1])) for x in one) == sum(x["taken"] for x in mixing.mix(d).collect())


def test_stored_tables_and_options(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = common.store(spark.range(3), "kept")
    assert kept.count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert spark.sparkContext.applicationId in common.new_path(spark, "x")

    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            common.shared_dir(Cluster)


def test_block_overlaps():
    r = np.random.default_rng(1)
    left, right = ([np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(n)] for n in (5, 7))
    for wanted in (np.ones((5, 7), bool), np.arange(35).reshape(5, 7) == 8):
        got = near_dedup._overlaps(left, right, wanted)
        for i, j in zip(*np.nonzero(wanted), strict=True):
            assert got[i, j] == len(np.intersect1d(left[i], right[j]))


def test_packing(docs, texts, none):
    got = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), end=1, capacity=512).collect()
    tok = PieceTokenizer(queries.vocabulary("word_bpe_49k.json")).tokenizer
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    total = 0
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 512)):
            r = pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes()))
    assert not pieces
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    free: list[int] = []  # first fit, longest first
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(512 - n)
        else:
            free[k] -= n
    assert math.ceil(total / 512) <= len(by) <= len(free) + 1
    assert packing.pack(none, queries.vocabulary("word_bpe_49k.json"), end=1).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_up_the_histogram(seed):
    r = np.random.default_rng(seed)
    counts = Counter(np.minimum(1000, r.geometric(1 / 150, 3000)).tolist())
    made = packing.plan(dict(counts), 1000)
    used = Counter()
    for pattern, times in made:
        assert sum(pattern) <= 1000 and times > 0
        for n in pattern:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in made) <= 1.01 * math.ceil(sum(n * c for n, c in counts.items()) / 1000) + 2


def test_places_are_bounded_by_the_capacity():
    small, large = ({n: 1 + n * k % 7 for n in range(1, 257)} for k in (1, 1_000_003))
    sizes = []
    for counts in (small, {n: c * 10_000 for n, c in large.items()}):
        made = packing.plan(counts, 256)
        assert len(made) <= 10 * 256
        sizes.append(len(packing._Places(made).key))
    assert max(sizes) <= 10 * 256 * 6


def test_registered_queries(spark, docs, texts, tmp_path):
    """What each contract returns, by the queries themselves."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids, size = [i for i, _ in texts], {i: len(words(t)) for i, t in texts}
    run = {name: table(f(spark, str(tmp_path))) for name, f in queries.QUERIES.items() if name in ("op1_mixing", "op3_phrase_dedup", "op4_language", "op5_suffix_dedup", "op6_token_file", "op7_exact_dedup", "op9_near_dedup")}
    assert all(sorted(rows) == ids for rows in run.values())
    for i, t in texts:
        assert run["op3_phrase_dedup"][i]["n_words"] == size[i] == run["op1_mixing"][i]["size"]
        assert run["op5_suffix_dedup"][i]["n_bytes"] == len((t or "").encode())
        language_ = run["op4_language"][i]
        assert language_["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and (language_["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert language_["lang_pred"] in ("en", "fr", "und") and 0 <= language_["score"] <= 1
    found = near_truth(texts, 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in run["op9_near_dedup"].items()} == found
    packed = queries.op10_packing(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids) and sum(r["length"] for r in packed) > sum(size.values()) / 2
    at = 0
    for i in sorted(ids):
        assert run["op6_token_file"][i]["start"] == at
        at += run["op6_token_file"][i]["n_tokens"]


def test_pipeline(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = common.store(stage(spark, kept, str(tmp_path)), "test")
        assert after.columns == docs.columns, name
        before, ids = {r["doc_id"]: r["text"] for r in kept.collect()}, {r["doc_id"] for r in after.collect()}
        if name == "exact dedup":
            assert len(ids) == len({re.sub(SPACES, "", t or "") for t in before.values()})
        if name == "near dedup":
            assert ids == {i for i, (_, root) in near_truth(before.items(), 5).items() if i == root}
        kept = after
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {r["doc_id"] for r in kept.collect()} and packed
