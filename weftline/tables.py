"""Tables written between steps, where a plan would otherwise make them again for each of its uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Where this application's tables are: below spark.checkpoint.dir, which driver and executors share. Only where that is
    unset on one machine, as in tests, a temporary folder stands in; on a cluster it is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="weftline-plans-")
        said = _own["dir"]
    return f"{said.rstrip('/')}/weftline-plans/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: it is made once, lineage ends there, and a lost executor costs the reading of a file."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Removes what this application has stored, once results that depend on it are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
