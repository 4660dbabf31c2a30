from __future__ import annotations

import datetime

import pytest

from tests.conftest import rows
from weftline.operators import status
from weftline.streaming import poll

STATE = "change_id string, group_id string, state string, review_decision string, is_draft boolean, ts timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def stores(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def polled(spark, tmp_path, levels, *rounds):
    """Each round of (change, group, state, review, draft, seconds) is a run of the query on its own, from the checkpoint."""
    got = []
    for k, states in enumerate(rounds):
        made = [(c, g, s, r, d, START + datetime.timedelta(seconds=at)) for c, g, s, r, d, at in states]
        spark.createDataFrame(made, STATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(STATE).parquet(str(tmp_path / "in"))
        out = poll.merge_stream(stream, levels)
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120), k
    return sorted(got)


def test_batches_are_merged_in_order(spark, stores, tmp_path):
    levels = spark.createDataFrame([("c", "a", 0), ("c", "b", 0), ("c", "d", 1), ("c", "e", 2), ("t", "x", 0), ("t", "y", 1), ("u", "p", 0), ("u", "q", 1)], "change_id string, group_id string, level int")
    open_, done = ("OPEN", None, False), ("MERGED", None, False)
    got = polled(
        spark, tmp_path, levels,
        [("c", "a", *open_, 0), ("c", "b", "OPEN", "REVIEW_REQUIRED", False, 0), ("c", "d", *open_, 0), ("t", "x", *open_, 0), ("u", "p", *open_, 0)],
        [("c", "a", *done, 10), ("t", "x", *open_, 10), ("u", "p", "CLOSED", None, False, 10)],
        [("c", "d", *done, 20), ("c", "e", "OPEN", None, True, 20), ("t", "x", *open_, 20)],
        [("c", "e", "OPEN", None, True, 700)],
    )
    walked = {(c, g): (level, o) for c, g, level, o, _ in got}
    assert walked == {
        ("c", "a"): (0, "merged"), ("c", "b"): (0, "skip: review required"), ("c", "d"): (1, "merged"), ("c", "e"): (2, "skip: draft"),
        ("t", "x"): (0, "timeout"), ("t", "y"): (1, "not reached"), ("u", "p"): (0, "closed"), ("u", "q"): (1, "not reached"),
    }
    assert {(c, g): n for c, g, *_, n in got}["t", "x"] == 3
    assert len(got) == len(walked)  # nothing is said twice, though each round was a query of its own


def test_stream_ends_where_the_walk_on_final_states_does(spark, stores, tmp_path):
    names = [f"g{k}" for k in range(6)]
    groups = spark.createDataFrame([("c", n, names[k - 2 : k - 1] if k > 1 else []) for k, n in enumerate(names)], "change_id string, group_id string, depends_on array<string>")
    prs = spark.createDataFrame([("c", n, k) for k, n in enumerate(names)], "change_id string, group_id string, pr_number int")
    final = [("MERGED", None, False), ("OPEN", "CHANGES_REQUESTED", False), ("CLOSED", None, False), ("OPEN", None, True), ("MERGED", "APPROVED", False), ("MERGED", None, False)]
    live = spark.createDataFrame([(k, *s) for k, s in enumerate(final)], "pr_number int, state string, review_decision string, is_draft boolean")
    want = {r["group_id"]: (r["level"], r["outcome"]) for r in rows(status.merge_walk(groups, prs, live))}
    from weftline.operators import graph

    first = [("c", n, *(("OPEN", None, False) if s[0] == "MERGED" else s), 0) for n, s in zip(names, final, strict=True)]
    got = polled(spark, tmp_path, graph.levels(groups), first, [("c", n, *s, 30) for n, s in zip(names, final, strict=True)])
    assert {g: (level, o) for _, g, level, o, _ in got} == want
