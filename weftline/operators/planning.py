"""Planning with a model's answers as tables: prompts out, answers in, folded chunk by chunk and refined."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .. import schemas
from ..functions.prompts import Prompts, violation_line
from ..options import CHUNK_ATTEMPTS, MAX_OUTPUT_TOKENS, TOKEN_RATIO, PartitionStrategy, PlanOptions
from ..sources.documents import model_answers
from ..tables import stored
from . import chunking, edit, graph, kernels, score, stats, validate
from .partition import partition

_LIST = f"array<{schemas.ASSIGNMENT}>"


def calibrated_ratio(tokens: Column, overhead: Column, chars: Column) -> Column:
    """Tokens of a character, from a count of the whole prompt."""
    return F.when(chars > 0, (tokens - overhead) / chars).otherwise(F.lit(TOKEN_RATIO))


def calibrated_sequence(hunks: DataFrame, counts: DataFrame) -> DataFrame:
    """The hunk sequence with each change's own ratio. counts: change_id, tokens, overhead, chars."""
    ratio = counts.select("change_id", calibrated_ratio(F.col("tokens"), F.col("overhead"), F.col("chars")).alias("ratio"))
    order = W.Window.partitionBy("change_id").orderBy("file_ord", "hunk_index")
    rows = hunks.join(ratio, "change_id").withColumn("seq", F.row_number().over(order) - 1)
    tokens = F.greatest(F.lit(1), F.floor(F.length("hunk_text") * F.col("ratio")).cast("int"))
    return rows.select("change_id", "seq", "file_path", "hunk_index", tokens.alias("token_estimate"))


def accepted(answers: DataFrame, key: str, limit: int = CHUNK_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers: change_id, key, attempt, payload_json. (groups of the first attempt that can be read,
    change_id and key of what has such an attempt, change_id and key of what has none)."""
    keys = ["change_id", key]
    tried = stored(model_answers(answers.filter(F.col("attempt") <= limit)), "answers")
    bad = F.max(F.col("error").isNotNull())
    first = tried.groupBy(*keys, "attempt").agg(bad.alias("bad")).groupBy(*keys).agg(F.min(F.when(~F.col("bad"), F.col("attempt"))).alias("attempt"))
    # Answers move once, by change.
    read = tried.repartition("change_id").withColumn("_bad", bad.over(W.Window.partitionBy(*keys, "attempt")))
    read = read.withColumn("_first", F.min(F.when(~F.col("_bad"), F.col("attempt"))).over(W.Window.partitionBy(*keys))).filter("attempt = _first")
    kept = [c for c in tried.columns if c not in (*keys, "attempt", "groups", "error")]
    groups = read.select(*keys, *kept, F.posexplode("groups").alias("group_ord", "_g")).select(*keys, *kept, "group_ord", "_g.*")
    return groups, first.filter("attempt is not null").select(*keys), first.filter("attempt is null").select(*keys)


def fold_chunks(groups: DataFrame) -> DataFrame:
    """Groups of all chunks by id: assignments appended and dependencies united in order of chunk; title
    and description are the first; groups stand in order of first appearance."""
    part = F.struct("chunk", "group_ord", "title", "description", "depends_on", "assignments")
    rows = groups.groupBy("change_id", F.col("id").alias("group_id")).agg(F.sort_array(F.collect_list(part)).alias("p"))
    first = F.get("p", F.lit(0))
    order = W.Window.partitionBy("change_id").orderBy("at", "group_id")
    rows = rows.select(
        "change_id", "group_id", F.struct(first["chunk"], first["group_ord"]).alias("at"), first["title"].alias("title"), first["description"].alias("description"),
        F.array_distinct(F.flatten(F.transform("p", lambda p: F.coalesce(p["depends_on"], F.array().cast("array<string>"))))).alias("depends_on"),
        F.flatten(F.transform("p", lambda p: F.coalesce(p["assignments"], F.array().cast(_LIST)))).alias("assignments"),
    )
    return rows.withColumn("group_ord", F.row_number().over(order) - 1).drop("at")


def _lines(added: str, removed: str) -> list[Column]:
    a, r = (F.coalesce(c, F.lit(0)) for c in (added, removed))
    return [a.alias("estimated_added"), r.alias("estimated_removed"), (a + r).alias("estimated_loc")]


def with_uncovered(groups: DataFrame, hunks: DataFrame) -> DataFrame:
    """Groups that also hold the hunks that none lists: with the first group that has their file, else
    with the one that has the most assignments; lines counted anew."""
    listed = groups.select("change_id", "group_ord", "group_id", F.explode("assignments").alias("a")).select("change_id", "group_ord", "group_id", "a.file_path", F.explode_outer("a.hunk_indices").alias("hunk_index"))
    largest = groups.repartition("change_id").groupBy("change_id").agg(F.min(F.struct((-F.size("assignments")).alias("n"), "group_ord", "group_id"))["group_id"].alias("largest"))
    holder = F.min(F.when(~F.col("_own"), F.struct("group_ord", "group_id"))).over(W.Window.partitionBy("change_id", "file_path"))["group_id"]
    rows = stats.with_lines(listed, hunks).withColumn("holder", holder).filter("not (_own and _listed)").join(largest, "change_id")
    more = F.when(F.col("_own"), F.col("hunk_index").cast("int"))
    held_by = F.when(F.col("_own"), F.coalesce("holder", "largest")).otherwise(F.col("group_id"))
    rows = rows.select("change_id", held_by.alias("group_id"), "file_path", more.alias("more"), "_added", "_removed")
    files = rows.groupBy("change_id", "group_id", "file_path").agg(F.sort_array(F.collect_list("more")).alias("more"), F.sum("_added").alias("_added"), F.sum("_removed").alias("_removed"))
    files = files.groupBy("change_id", "group_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.size("more") > 0, F.struct("file_path", "more"))))).alias("more"), F.sum("_added").alias("_added"), F.sum("_removed").alias("_removed"))
    rows = groups.drop("estimated_added", "estimated_removed", "estimated_loc").filter("group_id is not null").join(files, ["change_id", "group_id"], "left")
    held = F.transform("assignments", lambda a: a["file_path"])
    none = F.array().cast("array<int>")
    at = F.coalesce("more", F.create_map().cast("map<string,array<int>>"))
    wide = F.transform("assignments", lambda a, i: F.struct(a["file_path"].alias("file_path"), a["assignment_type"].alias("assignment_type"), F.when(F.array_position(held, a["file_path"]) == i + 1, F.concat(F.coalesce(a["hunk_indices"], none), F.coalesce(F.try_element_at(at, a["file_path"]), none))).otherwise(a["hunk_indices"]).alias("hunk_indices")))
    new = F.transform(F.filter(F.map_entries(at), lambda e: ~F.array_contains(held, e["key"])), lambda e: F.struct(e["key"].alias("file_path"), F.lit("partial_hunks").alias("assignment_type"), e["value"].alias("hunk_indices")))
    wider = F.when(F.size(at) > 0, F.concat(wide, new)).otherwise(F.col("assignments"))
    return rows.withColumn("assignments", wider).select(*[c for c in rows.columns if c not in ("more", "_added", "_removed")], *_lines("_added", "_removed"))


def recounted(groups: DataFrame, hunks: DataFrame, version: str | None = None) -> DataFrame:
    """Groups with estimated_added, estimated_removed and estimated_loc from their listed hunks. version: a column that tells
    several plans of one change apart; they share its hunks."""
    keys = ["change_id", *[version] * (version is not None), "group_id"]
    kept = groups.drop("estimated_added", "estimated_removed", "estimated_loc").filter("group_id is not null")
    listed = kept.select(*keys, F.explode("assignments").alias("a")).select(*keys, "a.file_path", F.explode("a.hunk_indices").alias("hunk_index"))
    sums = stats.with_lines(listed, hunks).filter(~F.col("_own")).groupBy(*keys).agg(F.sum("_added").alias("_added"), F.sum("_removed").alias("_removed"))
    rows = kept.join(sums, keys, "left")
    return rows.select(*[c for c in rows.columns if c not in ("_added", "_removed")], *_lines("_added", "_removed"))


def chunked_plan(answers: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, failed chunks) from answers about chunks: change_id, chunk, attempt, payload_json. A change
    with a chunk that no attempt answered has no groups."""
    groups, _, failed = accepted(answers, "chunk")
    whole = groups.join(failed.select("change_id").distinct(), "change_id", "left_anti")
    return with_uncovered(stored(fold_chunks(whole), "folded"), hunks), failed


def refined(groups: DataFrame, answers: DataFrame, hunks: DataFrame, options: PlanOptions) -> tuple[DataFrame, DataFrame]:
    """(groups, outcome) after the rounds of refinement. answers: change_id, iteration from 1, attempt,
    payload_json: whole plans. A change stops at the first version within the bounds, where the next
    answer is missing or can't be read, or after the last round. outcome: change_id, iterations,
    remaining violations, resolved."""
    limit = options.max_refinement_iterations
    total = groups.groupBy("change_id").agg(F.sum("estimated_loc").alias("total"))
    if limit == 0:
        answers = answers.limit(0)
    later, good, _ = accepted(answers.filter(F.col("iteration") <= limit), "iteration", 1)
    key = F.struct("change_id", F.col("iteration").cast("int").alias("iteration"))
    later = recounted(later.withColumnRenamed("id", "group_id"), hunks, "iteration").withColumn("change_id", key)
    columns = ["group_ord", "group_id", "title", "description", "depends_on", "assignments", "estimated_added", "estimated_removed", "estimated_loc"]
    now = groups.withColumn("iteration", F.lit(0)).withColumn("change_id", key)
    versions = stored(now.select("change_id", *columns).unionByName(later.select("change_id", *columns)), "versions")
    good = stored(good, "answered")
    broken = validate.loc_bounds(versions, options.max_loc, options.min_loc).groupBy("change_id").agg(F.count("*").alias("remaining"))
    state = total.select("change_id", F.lit(0).alias("iteration")).union(good.select("change_id", F.col("iteration").cast("int")))
    state = state.join(broken.select("change_id.*", "remaining"), ["change_id", "iteration"], "left").na.fill(0, ["remaining"])
    following = state.select("change_id", (F.col("iteration") - 1).alias("iteration"), F.lit(True).alias("more"))
    state = state.join(following, ["change_id", "iteration"], "left").join(total, "change_id")
    small = F.lit(options.min_loc is None) & (F.lit(options.max_loc) >= F.col("total"))
    ends = state.filter((F.col("remaining") == 0) | F.col("more").isNull() | (F.col("iteration") == limit) | small)
    last = stored(ends.groupBy("change_id").agg(F.min(F.struct("iteration", "remaining")).alias("e")).select("change_id", "e.*"), "last")
    chosen = versions.select("change_id.*", *columns).join(last.select("change_id", "iteration"), ["change_id", "iteration"]).drop("iteration")
    return chosen, last.select("change_id", F.col("iteration").alias("iterations"), "remaining", (F.col("remaining") == 0).alias("resolved"))


def plan(hunks: DataFrame, options: PlanOptions, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, measures) by the strategy of the options. With a model, answers are change_id, attempt,
    payload_json: whole plans."""
    if options.partition_strategy == PartitionStrategy.LLM:
        if answers is None:
            raise ValueError("a model's plan needs its answers")
        made, _, _ = accepted(answers.withColumn("chunk", F.lit(0)), "chunk", 1)
        groups = recounted(made.drop("chunk").withColumnRenamed("id", "group_id"), hunks)
    else:
        groups = partition(hunks, options)
    return groups, score.plan_metrics(groups, graph.assigned(groups), options.max_loc, options.min_loc)


def plan_json(groups: DataFrame) -> DataFrame:
    """change_id, text: the groups of a change as an indented JSON list."""
    rows = groups.select("change_id", "group_ord", F.col("group_id").cast("string").alias("id"), "title", "description", "depends_on", "assignments", F.col("estimated_loc").cast("long").alias("estimated_loc"))
    names = rows.columns[2:]
    return kernels.by_change(rows, rows.columns[1:], lambda found: [(json.dumps([{n: r[n] for n in names} for r in found], indent=2),)], "text string")


def user_prompts(files: DataFrame, hunks: DataFrame, prompts: Prompts = Prompts()) -> DataFrame:
    """change_id, text: summary and labelled diff of each change."""
    both = stats.summary_text(files).withColumnRenamed("text", "summary").join(stats.labelled_diff(files, hunks), "change_id", "left")
    return both.select("change_id", prompts.filled("user", file_summary=F.col("summary"), full_diff=F.coalesce("text", F.lit(""))).alias("text"))


def chunk_prompts(chunks: DataFrame, files: DataFrame, hunks: DataFrame, catalogue: DataFrame | None = None, prompts: Prompts = Prompts()) -> DataFrame:
    """change_id, chunk, text for each chunk: the first, or with the catalogue of the groups so far (change_id,
    chunk, text: what is known before the chunk) the later ones."""
    key = F.struct("change_id", F.col("chunk").cast("int").alias("chunk"))
    own = chunks.join(hunks.select("change_id", "file_path", "hunk_index", "added", "removed"), ["change_id", "file_path", "hunk_index"])
    part = own.groupBy(key.alias("change_id"), "file_path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("hunk_count"))
    heads = files.select(F.col("change_id").alias("change"), "file_ord", F.col("file_path").alias("path"), "is_new", "is_deleted", "is_renamed")
    part = part.join(heads, (F.col("change_id.change_id") == F.col("change")) & (F.col("file_path") == F.col("path"))).drop("change", "path")
    summary = stats.summary_text(part).select("change_id.*", F.col("text").alias("summary"))
    total = chunks.groupBy("change_id").agg(F.countDistinct("chunk").alias("total"))
    diff = chunking.chunk_diffs(chunks, files, hunks).select("change_id", F.col("chunk").cast("int").alias("chunk"), F.col("text").alias("diff"))
    rows = summary.join(diff, ["change_id", "chunk"]).join(total, "change_id")
    said = catalogue.withColumnRenamed("text", "catalogue") if catalogue is not None else rows.select("change_id", "chunk", F.lit("").alias("catalogue")).limit(0)
    rows = rows.join(said.select("change_id", "chunk", "catalogue"), ["change_id", "chunk"], "left")
    first = prompts.filled("chunk_first", total_chunks=F.col("total"), remaining_chunks=F.col("total") - 1, file_summary=F.col("summary"), chunk_diff=F.col("diff"))
    next_ = prompts.filled("chunk_next", chunk_index=F.col("chunk") + 1, total_chunks=F.col("total"), group_catalog=F.coalesce("catalogue", F.lit("")), file_summary=F.col("summary"), chunk_diff=F.col("diff"))
    return rows.select("change_id", "chunk", F.when(F.col("chunk") == 0, first).otherwise(next_).alias("text"))


def refinement_prompts(groups: DataFrame, files: DataFrame, hunks: DataFrame, options: PlanOptions, prompts: Prompts = Prompts()) -> DataFrame:
    """change_id, text for changes whose groups break the bounds."""
    found = validate.loc_bounds(groups, options.max_loc, options.min_loc).join(groups.select("change_id", "group_id", "group_ord"), ["change_id", "group_id"])
    line = violation_line(F.col("violation_type"), F.col("group_id"), F.col("estimated_loc"), F.col("estimated_added"), F.col("estimated_removed"), F.col("limit"))
    told = found.groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("said"))
    rows = told.join(plan_json(groups).withColumnRenamed("text", "plan"), "change_id").join(stats.labelled_diff(files, hunks).withColumnRenamed("text", "diff"), "change_id", "left")
    return rows.select("change_id", prompts.filled("refine", violations=F.col("said"), current_plan=F.col("plan"), full_diff=F.coalesce("diff", F.lit(""))).alias("text"))


def token_counts(rows: DataFrame, path: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """All columns of rows and the number of tokens of a text by a vocabulary file of the tokenizers library;
    null counts 0. Texts go to Python in Arrow batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, out])

    at = rows.columns.index(text_col)
    return rows.mapInArrow(count, T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())]))


def needs_chunks(counts: DataFrame, options: PlanOptions) -> DataFrame:
    """counts: change_id, tokens (of system and user prompt) -> change_id, tokens, chunked: whether the prompt
    leaves no room for an answer."""
    return counts.select("change_id", "tokens", (F.col("tokens") > options.context_tokens - MAX_OUTPUT_TOKENS).alias("chunked"))
