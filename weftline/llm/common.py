"""What the corpus operators share: the shared folder, written tables, the word pattern."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this package, [\x20\x09-\x0D], and a word between such.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset on one
    machine, as in tests, a temporary folder of this process. On a cluster it has to be set."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="weftline-")
    return f"file://{_own['dir']}"


def run_dir(spark: SparkSession) -> str:
    """Where this application's tables are, apart from those of others."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def free(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def tag(docs: DataFrame) -> Column:
    """128 bits for a row, from all its columns but maps: rows with equal tags are interchangeable."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().startswith("map")]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Session options while a table is written: small Arrow batches, so that Python workers stay small whatever
#: texts come; runtime Bloom filters from 64 MB of input on, not from 10 GB.
_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64m"}


#: Bytes up to which a table is sent to all tasks while a table is written. Spark goes by the bytes of files and shuffles, and
#: compressed postings or links take many times those in the driver's heap, for several joins at once.
BROADCAST = 1 << 20
_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def _broadcasts(spark: SparkSession) -> dict[str, str]:
    """The session's thresholds, lowered to BROADCAST where they are above. The first has a default of Spark's, which
    conf.get() with a default of its own doesn't tell; the adaptive one follows the first where it isn't set."""
    out = {}
    for key in _BROADCAST:
        said = spark.conf.get(key) if key == _BROADCAST[0] else spark.conf.get(key, None)
        found = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", said or "", re.IGNORECASE)  # a ban, -1, stays
        if found and int(found[1]) << 10 * " kmgtp".index(found[2].lower() or " ") > BROADCAST:
            out[key] = str(BROADCAST)
    return out


@contextlib.contextmanager
def _options(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and a lost executor costs
    the reading of a file. The table stays until drop_stored() or the folder's owner removes it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _options(spark, _WRITING | _broadcasts(spark)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Removes every table that this application's store() wrote. Call it when results that depend on
    them have been saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit deal: the session's number, which its owner fits to cluster and data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_keys(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is among the stored, distinct keys; for a table that store() writes. Where Spark
    shuffles both sides and the keys are few it first builds a Bloom filter of them and drops most other
    rows, with their texts, at the scan; it does so only if the keys come through a comparison, so there
    is one that always holds."""
    return rows.join(keys.filter(F.col(name) >= F.lit(-(1 << 63))), name)


def give_back() -> None:
    """Returns freed memory to the system: workers are kept for later tasks, and what they hold on to counts
    beside those."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
        if trim:
            trim(0)


def tidy(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run over a group's tables (one, or two of a cogroup), what it has freed given back after each."""
    import inspect

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return two if len(inspect.signature(run).parameters) == 2 else one


def lean(run: Callable[[Iterator], Iterator], rows: int = 1000) -> Callable[[Iterator], Iterator]:
    """run over batches of so many rows at most, whatever the session's batches are; at the end of a task
    what it has freed is given back."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        give_back()

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
