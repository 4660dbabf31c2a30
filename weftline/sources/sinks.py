"""Outputs as tables and files; side effects on hosts and repositories are left to whoever reads them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import markdown_cell
from ..options import PlanError


def write_plan(plans: DataFrame, path: str) -> None:
    """A line of JSON for each plan, in as many files as the table has partitions; overwritten."""
    plans.write.mode("overwrite").json(path)


def write_files(made: DataFrame, root: str) -> DataFrame:
    """Writes the contents of files of groups (change_id, group_id, file_path, content) below
    root/change/group, removing those with null content, and returns a row for each: path, bytes (null:
    removed). root: a URI that all executors share and pyarrow can write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            told = []
            for change, group, name, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ".." in name.split("/") or name.startswith("/"):
                    raise PlanError(f"{name} is outside its folder")
                path = f"{top}/{change}/{group}/{name}"
                if content is None:
                    if where.get_file_info(path).type == fs.FileType.File:
                        where.delete_file(path)
                    told.append((path, None))
                else:
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    with where.open_output_stream(path, compression=None) as f:
                        f.write(content.encode())
                    told.append((path, len(content.encode())))
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64())], ["path", "bytes"])

    rows = made.select(F.col("change_id").cast("string"), F.col("group_id").cast("string"), "file_path", "content")
    return rows.mapInArrow(run, "path string, bytes long")


@dataclass
class _Staged(WriterCommitMessage):
    """What one task has staged: (file below the root, its number in the task's folder, or null where it is to be removed)."""

    folder: str
    files: list[tuple[str, int | None]]


class GroupFiles(DataSource):
    """Files of groups as a sink: `spark.dataSource.register(GroupFiles)`, then
    `made.write.format("group_files").option("root", uri).mode("append").save()` for rows change_id, group_id, file_path, content (null:
    removed). Tasks write below root/_staged; only when all have ended are the files moved to their names and removals done, so
    readers never see part of a plan's files, and what dead attempts have staged is removed and never named."""

    @classmethod
    def name(cls) -> str:
        return "group_files"

    def schema(self) -> str:
        return "change_id string, group_id string, file_path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "root" not in self.options:
            raise PlanError("group_files needs the option root")
        return _GroupFilesWriter(self.options["root"], schema.names)


class _GroupFilesWriter(DataSourceWriter):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names, self.job = root, names, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(self.root)
        return where, top.rstrip("/"), f"{top.rstrip('/')}/_staged/{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        where, _, staged = self._open()
        folder, files = uuid.uuid4().hex, []
        where.create_dir(f"{staged}/{folder}", recursive=True)
        for row in iterator:
            change, group, name, content = (row[c] for c in ("change_id", "group_id", "file_path", "content"))
            if ".." in name.split("/") or name.startswith("/"):
                raise PlanError(f"{name} is outside its folder")
            at = None if content is None else len(files)
            if at is not None:
                with where.open_output_stream(f"{staged}/{folder}/{at}", compression=None) as f:
                    f.write(content.encode())
            files.append((f"{change}/{group}/{name}", at))
        return _Staged(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top, staged = self._open()
        for m in messages:
            for name, at in m.files if isinstance(m, _Staged) else ():
                if at is not None:
                    where.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                    where.move(f"{staged}/{m.folder}/{at}", f"{top}/{name}")
                elif where.get_file_info(f"{top}/{name}").is_file:
                    where.delete_file(f"{top}/{name}")
        where.delete_dir(staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        where, _, staged = self._open()
        if where.get_file_info(staged).type == fs.FileType.Directory:
            where.delete_dir(staged)


def plan_json(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true"})


def action_outputs(values: DataFrame) -> DataFrame:
    """name, value -> lines name=value; all other columns are kept."""
    return values.select(*[c for c in values.columns if c not in ("name", "value")], F.concat_ws("=", "name", F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("value"))


def score_comment(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """change_id, body: the table of measures and a row for each group, in Markdown.

    groups: change_id, group_ord, id, title, estimated_loc. scores: change_id, total_files, total_loc,
    total_groups, objective, should_split."""
    line = F.format_string("| %s | %s | %s |", markdown_cell(F.col("id")), markdown_cell(F.col("title")), F.format_number("estimated_loc", 0))
    rows = groups.withColumn("line", line).groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_ord", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    head = F.concat_ws(
        "\n",
        F.lit("| Measure | Value |"), F.lit("| --- | --- |"),
        *[F.concat(F.lit(f"| {label} | "), F.format_number(c, 0) if c != "should_split" else F.col(c).cast("string"), F.lit(" |")) for label, c in (("Files", "total_files"), ("Lines", "total_loc"), ("Groups", "total_groups"), ("Objective", "objective"), ("Split", "should_split"))],
    )
    return scores.join(rows, "change_id", "left").select("change_id", F.concat_ws("\n\n", head, F.when(F.col("rows").isNotNull(), F.concat(F.lit("| Group | Title | Lines |\n| --- | --- | --- |\n"), F.col("rows")))).alias("body"))


def upsert_comments(wanted: DataFrame, existing: DataFrame, marker: str) -> DataFrame:
    """change_id, body, action, comment_id: update the first comment with the marker, else create one."""
    own = existing.filter(F.col("body").contains(marker)).groupBy("change_id").agg(F.min("comment_id").alias("comment_id"))
    return wanted.join(own, "change_id", "left").select("change_id", "body", F.when(F.col("comment_id").isNull(), "create").otherwise("update").alias("action"), "comment_id")


def webhook_payload(outcomes: DataFrame) -> DataFrame:
    """change_id, payload: the JSON that a hook would be sent."""
    return outcomes.select("change_id", F.to_json(F.struct(*[c for c in outcomes.columns if c != "change_id"])).alias("payload"))


def send_payloads(payloads: DataFrame, url: str, timeout: float = 10.0, attempts: int = 2) -> DataFrame:
    """Posts the payload of each row (change_id, payload) as JSON: change_id, key, status, error, tries. A failure is a row with
    its error, and others are sent all the same. A task that runs again posts again, under the same key (the header
    Idempotency-Key, of change and payload), by which a receiver can tell; write the result once and read that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import urllib.error
        import urllib.request

        def post(body: bytes, key: str) -> tuple[int | None, str | None]:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Idempotency-Key": key}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return answer.status, None
            except urllib.error.HTTPError as bad:
                return bad.code, bad.reason
            except (OSError, ValueError) as bad:
                return None, str(bad)

        for batch in (b for b in batches if b.num_rows):
            told = []
            for change, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = (payload or "{}").encode()
                key = hashlib.sha256(f"{change}\n".encode() + body).hexdigest()
                for tries in range(1, attempts + 1):
                    status, error = post(body, key)
                    if error is None or (status is not None and status < 500):  # what is refused stays refused
                        break
                told.append((change, key, status, error, tries))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["change_id", "key", "status", "error", "tries"])

    rows = payloads.select(F.col("change_id").cast("string"), F.col("payload").cast("string"))
    return rows.mapInArrow(run, "change_id string, key string, status int, error string, tries int")
