from __future__ import annotations

import numpy as np
import pytest

from weftline.llm import ann, queries


def test_vectors_of_any_magnitude(spark):
    directions = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.5], [3.0, -1.0, 0.5], [1.0, 0.0, 0.0]]
    rows = [(k, [c * 10.0**e for c in directions[k % 4]]) for k, e in enumerate((0, 200, -200, 0, 300, -300, 150, 0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df, k=2).collect()
    unit = {i: np.array(directions[i % 4]) / np.linalg.norm(directions[i % 4]) for i, _ in rows}
    assert len(got) == 16
    for r in got:
        assert r["score"] == pytest.approx(unit[r["query_id"]] @ unit[r["vec_id"]], abs=1e-12)
    assert all(r["score"] == pytest.approx(1.0) and abs(r["query_id"] - r["vec_id"]) == 4 for r in got if r["rank"] == 1)


def test_scaling_keeps_every_bit():
    x, y = np.random.default_rng(1).normal(size=(2, 200, 16)) * 37.0
    assert (ann.cosine(x, y) == ann.cosine(ann._scaled(x), ann._scaled(y))).all()


def test_op2_on_tables(spark, tmp_path):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(150, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op2_ann"](spark, str(tmp_path)).collect()
    v = vectors.astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    want = {(q, int(c)) for q in (0, 50, 100) for c in np.argsort(-np.where(np.arange(150) == q, -2, unit @ unit[q]))[:5]}
    assert len(got) == 15 and len(found & want) >= 14
