"""Tables that go to the driver and all tasks stay small while others are written."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from weftline.llm import common

KEY = "spark.sql.autoBroadcastJoinThreshold"


@pytest.mark.parametrize(("said", "held"), [("10485760b", str(1 << 20)), ("10m", str(1 << 20)), ("1G", str(1 << 20)), ("256k", "256k"), ("-1", "-1"), ("1000", "1000")])
def test_broadcasts_are_small_while_a_table_is_written(spark, said, held):
    before, seen = spark.conf.get(KEY), []
    df = spark.range(3)

    def parquet(path):
        seen.append(spark.conf.get(KEY))
        df.write.parquet(path)

    spark.conf.set(KEY, said)
    try:
        got = common.store(SimpleNamespace(sparkSession=spark, schema=df.schema, write=SimpleNamespace(parquet=parquet)), "held")
        assert (seen, spark.conf.get(KEY), got.count()) == ([held], said, 3)
    finally:
        spark.conf.set(KEY, before)


def test_broadcasts_are_small_where_the_session_sets_none(spark):
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    try:
        assert common._broadcasts(spark) == {KEY: str(1 << 20)}
        with common._options(spark, common._broadcasts(spark)):
            assert spark.conf.get(KEY) == str(1 << 20)
        assert spark.conf.get(KEY, None) is None
    finally:
        spark.conf.set(KEY, before)
