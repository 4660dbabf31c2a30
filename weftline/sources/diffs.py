"""Unified diffs as tables of files and hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..options import PlanError
from ..tables import stored

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_FIELDS = "file_ord int, file_path string, source_file string, target_file string, is_new boolean, is_deleted boolean, is_renamed boolean, hunk_index int, source_start int, source_length int, target_start int, target_length int, added int, removed int, hunk_text string, error string"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _clean(name: str) -> str:
    name = name.split("\t")[0].rstrip("\r")
    if len(name) > 1 and name[0] == name[-1] == '"':
        name = name[1:-1]
    return name


def parse(text: str) -> Iterator[dict]:
    """A row for each hunk, and one with hunk_index null for a file without hunks. A hunk's header says
    how many lines follow, so a removed line that looks like a header is read as what it is."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    at, ord_ = 0, -1
    file: dict | None = None
    hunks: list[dict] = []

    def close() -> Iterator[dict]:
        nonlocal file, hunks
        if file is not None:
            src, tgt = file["source_file"], file["target_file"]
            bare = [n[2:] if n[:2] in ("a/", "b/") else n for n in (src, tgt)]
            file["is_new"] = file["is_new"] or src == "/dev/null"
            file["is_deleted"] = file["is_deleted"] or tgt == "/dev/null"
            file["file_path"] = bare[0] if tgt == "/dev/null" else bare[1]
            file["is_renamed"] = file["is_renamed"] or not (file["is_new"] or file["is_deleted"]) and bare[0] != bare[1]
            yield from ({**file, **h} for h in hunks or [dict.fromkeys(_NAMES[7:])])
        file, hunks = None, []

    def open_(src: str, tgt: str) -> None:
        nonlocal file, ord_
        ord_ += 1
        file = {"file_ord": ord_, "source_file": src, "target_file": tgt, "is_new": False, "is_deleted": False, "is_renamed": False}

    while at < len(lines):
        line = lines[at]
        if line.startswith("diff --git "):
            yield from close()
            m = re.match(r'diff --git ("?a/.*?"?) ("?b/.*"?)$', line)
            half = line[11:]
            mid = len(half) // 2
            same = half[:mid][2:] == half[mid + 1 :][2:]  # one name twice, spaces or not
            src, tgt = (half[:mid], half[mid + 1 :]) if same else (m.groups() if m else ("a/?", "b/?"))
            open_(_clean(src), _clean(tgt))
        elif file is not None and not hunks and line.startswith("new file mode"):
            file["is_new"] = True
        elif file is not None and not hunks and line.startswith("deleted file mode"):
            file["is_deleted"] = True
        elif file is not None and not hunks and line.startswith(("rename from ", "rename to ")):
            file["is_renamed"] = True
            file["source_file" if line[7] == "f" else "target_file"] = ("a/" if line[7] == "f" else "b/") + line.split(" ", 2)[2]
        elif line.startswith("--- ") and at + 1 < len(lines) and lines[at + 1].startswith("+++ "):
            if file is None or hunks:
                yield from close()
                open_("", "")
            file["source_file"], file["target_file"] = _clean(line[4:]), _clean(lines[at + 1][4:])
            at += 1
        elif m := _HUNK.match(line):
            if file is None:
                raise PlanError(f"line {at + 1}: a hunk without a file")
            s, sl, t, tl = (int(x) if x is not None else 1 for x in m.groups())
            body, src, tgt, plus, minus = [line], sl, tl, 0, 0
            while src or tgt or at + 1 < len(lines) and lines[at + 1].startswith("\\"):
                at += 1
                if at >= len(lines):
                    raise PlanError(f"a hunk of {file['target_file']} ends early")
                x = lines[at]
                kind = x[:1] or " "
                if kind == "+":
                    tgt, plus = tgt - 1, plus + 1
                elif kind == "-":
                    src, minus = src - 1, minus + 1
                elif kind in (" ", "\r"):
                    src, tgt = src - 1, tgt - 1
                elif kind != "\\":
                    raise PlanError(f"line {at + 1}: {x[:40]!r} isn't part of a hunk")
                if src < 0 or tgt < 0:
                    raise PlanError(f"line {at + 1}: a hunk is longer than its header says")
                body.append(x)
            hunks.append({"hunk_index": len(hunks), "source_start": s, "source_length": sl, "target_start": t, "target_length": tl, "added": plus, "removed": minus, "hunk_text": "\n".join(body) + "\n", "error": None})
        at += 1
    yield from close()


def parse_diffs(changes: DataFrame) -> DataFrame:
    """change_id, raw_diff -> a row for each hunk and for each file without one; a diff that can't be
    read gives one row with its error and nothing else. Null and empty diffs give no rows."""
    kind = changes.schema["change_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for change, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [{"change_id": change, **r} for r in list(parse(text or ""))]
                except PlanError as bad:
                    out.append({"change_id": change, **dict.fromkeys(_NAMES), "error": str(bad)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"change_id {kind}, {_FIELDS}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return changes.select("change_id", "raw_diff").mapInArrow(run, ddl)


def files_of(parsed: DataFrame) -> DataFrame:
    whole = ["change_id", "file_ord", "file_path", "source_file", "target_file", "is_new", "is_deleted", "is_renamed"]
    return parsed.filter("error is null").groupBy(*whole).agg(F.coalesce(F.sum("added"), F.lit(0)).cast("int").alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).cast("int").alias("removed"), F.count("hunk_index").cast("int").alias("hunk_count"))


def hunks_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("hunk_index is not null").select("change_id", "file_ord", "file_path", "hunk_index", "source_start", "source_length", "target_start", "target_length", "added", "removed", "hunk_text")


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("change_id", "error")


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """changes from a folder of diff files: the file's name is the change."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("change_id"), F.col("value").alias("raw_diff"))


def parse_files(spark: SparkSession, path: str) -> DataFrame:
    """What parse_diffs(read_diffs()) gives, for files of any size: a file is read in splits and cut before each line that
    begins with "diff --git ", which no line of a hunk can, so a task holds the section of one changed file at a time. Line numbers
    in errors count within a section."""
    raw = spark.read.option("lineSep", "\ndiff --git ").text(path)
    name, start = F.element_at(F.split("_metadata.file_path", "/"), -1), F.col("_metadata.file_block_start")
    pieces = stored(raw.select(F.url_decode(name).alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"), "value"), "sections")
    heads = pieces.groupBy("file").agg(F.min(F.struct("start", "at")).alias("head"))
    # What stands before the first such line, and a first line itself, has lost nothing to the cut.
    whole = (F.struct("start", "at") == F.col("head")) | F.col("value").startswith("diff --git ")
    text = F.when(whole, F.col("value")).otherwise(F.concat(F.lit("diff --git "), "value"))
    key = F.struct("file", "start", "at")
    parsed = stored(parse_diffs(pieces.join(heads, "file").select(key.alias("change_id"), text.alias("raw_diff"))), "parsed")
    parsed = parsed.select("change_id.*", *_NAMES)
    sections = parsed.groupBy("file", "start", "at").agg((F.max("file_ord") + 1).alias("n"), F.min("error").alias("wrong"))
    turn = W.Window.partitionBy("file").orderBy("start", "at")
    first_wrong = F.first("wrong", ignorenulls=True).over(turn.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))
    places = sections.select("file", "start", "at", F.coalesce(F.sum("n").over(turn.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("ahead"), first_wrong.alias("wrong"))
    fine = parsed.join(places.filter("wrong is null").drop("wrong"), ["file", "start", "at"])
    fine = fine.withColumn("file_ord", F.col("file_ord") + F.col("ahead")).withColumnRenamed("file", "change_id").select("change_id", *_NAMES)
    wrong = places.filter("wrong is not null").select(F.col("file").alias("change_id"), F.col("wrong").alias("error")).distinct()
    return fine.unionByName(wrong, allowMissingColumns=True)


def lines_of(hunks: DataFrame) -> DataFrame:
    """Lines of hunks: change_id, file_path, hunk_index, line_no, kind (added, removed, context), text."""
    body = F.slice(F.split(F.regexp_replace("hunk_text", "\n$", ""), "\n"), 2, 1 << 30)
    rows = hunks.select("change_id", "file_path", "hunk_index", F.posexplode(body).alias("line_no", "raw")).filter("raw not like '\\\\\\\\%'")
    mark = F.substring("raw", 1, 1)
    return rows.select("change_id", "file_path", "hunk_index", "line_no", F.when(mark == "+", "added").when(mark == "-", "removed").otherwise("context").alias("kind"), F.expr("substring(raw, 2)").alias("text"))
