"""Grouping of units: affinities, greedy groups with repair, exact groups, and groups as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import paths
from ..functions.text import group_description, group_title
from ..options import PartitionStrategy, PlanError, PlanOptions, Priority
from ..tables import stored
from . import batches, graph, grouping, stats
from .chunking import partition_units


def affinity_scores(units: DataFrame, *priorities: str | Priority) -> DataFrame:
    """change_id, a, b and a column for each priority, for pairs of positions a < b of which any is above 0.

    Only such pairs can score that share a file, the first directory, the test-normalised stem or, for
    logical grouping, the suffix; so the pairs come from equi-joins on those, never from all pairs of a
    change. A pair is kept at the first key that it shares, so no distinct is needed. Names go through the
    joins as 64-bit numbers; two of one change would have to agree by chance to be taken for equal."""
    wanted = [Priority(p) for p in priorities]
    number = lambda c: F.xxhash64(c)
    rows = paths.add_features(units, F.col("file_path").cast("string"), "f").select("change_id", "position", "f")
    f = F.col("f")
    small = F.struct(number(f["path"]).alias("path"), F.transform(f["heads"], lambda h: F.xxhash64(h)).alias("heads"), number(f["suffix"]).alias("suffix"), number(f["stem"]).alias("stem"), f["is_test"].alias("is_test"))
    # The features are laid down before the join, or they would be made again for each posting.
    rows = rows.select("change_id", "position", small.alias("f")).repartition("change_id")
    keys = [f["path"], F.get(f["heads"], F.lit(0)), f["stem"]] + [f["suffix"]] * (Priority.LOGICAL in wanted)
    posted = rows.select("change_id", "position", "f", F.posexplode(F.array(*keys)).alias("k", "v")).filter("v is not null")
    left, right = posted.withColumnsRenamed({"position": "a", "f": "x"}), posted.withColumnsRenamed({"position": "b", "f": "y"})
    x, y = F.col("x"), F.col("y")
    first = F.when(x["path"] == y["path"], 0).when(F.get(x["heads"], F.lit(0)) == F.get(y["heads"], F.lit(0)), 1).when(x["stem"] == y["stem"], 2).otherwise(3)
    pairs = left.join(right, ["change_id", "k", "v"]).filter((F.col("a") < F.col("b")) & (F.col("k") == first))
    scored = pairs.select("change_id", "a", "b", *[paths.affinity(x, y, p).alias(str(p)) for p in wanted])
    return scored.filter(reduce(lambda p, q: p | q, [F.col(str(p)) > 0 for p in wanted]))


def affinity_pairs(units: DataFrame, priority: str | Priority) -> DataFrame:
    """change_id, a, b, score for pairs of positions a < b with a score above 0."""
    return affinity_scores(units, priority).withColumnRenamed(str(Priority(priority)), "score")


def affinity_sums(units: DataFrame, *priorities: str | Priority) -> DataFrame:
    """change_id, priority, pairs, score, first, second: over all pairs of positions a < b with an affinity above 0 their
    number, the sum of affinities, and the sums of affinity times a and times b. Made of counts by class, whole batches of
    changes at a time, so no pair is ever listed: work is by unit, however many units share a directory or suffix."""
    return batches.sums_by_change(units, [Priority(p) for p in priorities])


def group_units(units: DataFrame, options: PlanOptions, keep: bool = False) -> DataFrame:
    """change_id, position, group_ord: greedy groups with repair, or the cheapest ones (exact_groups()).
    keep: loc and file_path of the units come along, which saves a join with them."""
    if options.partition_strategy == PartitionStrategy.LLM:
        raise PlanError("groups of a model come as a table; see sources.documents.model_groups")
    if options.partition_strategy == PartitionStrategy.CP_SAT:
        return exact_groups(units, options, keep).drop("cost", "bound")

    def run(work: grouping.Units) -> list[tuple]:
        return [(i, k) for k, g in enumerate(work.repair(work.grow())) for i in g]

    return batches.by_units(units, "greedy", run, options, "group_ord int", keep)


def exact_groups(units: DataFrame, options: PlanOptions, keep: bool = False) -> DataFrame:
    """change_id, position, group_ord, cost, bound: the cheapest partition of each change that is found, its cost, and
    what no partition is below; it is proven the cheapest where they are equal. Changes of up to
    grouping.SUBSET_UNITS units always are; larger ones as far as options.exact_steps go. keep as in group_units()."""

    def run(work: grouping.Units) -> list[tuple]:
        groups, cost, bound = work.exact(options.exact_steps)
        return [(i, k, cost, bound) for k, g in enumerate(groups) for i in g]

    return batches.by_units(units, "exact", run, options, "group_ord int, cost long, bound long", keep)


def groups_from_units(grouped: DataFrame, units: DataFrame | None, hunks: DataFrame, backend: str) -> DataFrame:
    """Groups as rows with ids pr-1.., titles, assignments, lines and reduced dependencies. units may be left out where
    grouped has their columns. Units and hunks move once, by change."""
    rows = grouped if units is None else grouped.join(units, ["change_id", "position"])
    listed = rows.select("change_id", "group_ord", F.col("file_path").cast("string").alias("file_path"), F.explode("hunk_indices").alias("hunk_index"))
    whole_count = F.count_if("_own").over(W.Window.partitionBy("change_id", "file_path"))
    found = stats.with_lines(listed, hunks).withColumn("hunk_count", whole_count).filter("not _own and hunk_count > 0")
    by_file = found.groupBy("change_id", "group_ord", "file_path").agg(F.array_sort(F.collect_set(F.struct("hunk_index", "_added", "_removed"))).alias("h"), F.max("hunk_count").alias("hunk_count"))
    number = F.col("group_ord") + 1
    by_file = by_file.withColumns({"group_id": F.concat(F.lit("pr-"), number.cast("string")), "hunk_indices": F.transform("h", lambda x: x["hunk_index"])})
    lines = lambda c: F.aggregate("h", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x[c], F.lit(0)))
    kind = F.when(F.col("hunk_indices") == F.transform(F.sequence(F.lit(0), F.col("hunk_count").cast("int") - 1), lambda x: x.cast("int")), "whole_file").otherwise("partial_hunks")
    before = F.lag("group_id").over(W.Window.partitionBy("change_id", "file_path").orderBy(F.get("hunk_indices", F.lit(0)), "group_id"))
    by_file = by_file.select("change_id", "group_ord", "group_id", F.struct("file_path", kind.alias("assignment_type"), "hunk_indices").alias("a"), lines("_added").alias("added"), lines("_removed").alias("removed"), before.alias("before"))
    groups = by_file.groupBy("change_id", "group_id", "group_ord").agg(
        F.sort_array(F.collect_list("a")).alias("assignments"), F.sum("added").alias("estimated_added"), F.sum("removed").alias("estimated_removed"), F.array_sort(F.collect_set("before")).alias("depends_on")
    )
    groups = stored(groups, "grouped")  # read twice: the reduction of dependencies takes small columns only
    files = F.transform("assignments", lambda a: a["file_path"])
    told = groups.select(
        "change_id", "group_id", "group_ord", "assignments", group_title(number, files).alias("title"), group_description(backend, files).alias("description"),
        "estimated_added", "estimated_removed", (F.col("estimated_added") + F.col("estimated_removed")).alias("estimated_loc"),
    )
    return told.join(graph.reduce_dependencies(groups.select("change_id", "group_id", "depends_on")), ["change_id", "group_id"])


def partition(hunks: DataFrame, options: PlanOptions) -> DataFrame:
    """From hunks to groups, for all changes at once. Files without hunks are in no group."""
    units = partition_units(hunks, options.max_loc)
    return groups_from_units(group_units(units, options), units, hunks, str(options.partition_strategy))


def whole_or_partial(assigned: DataFrame, hunks: DataFrame) -> DataFrame:
    """For each file of each group whether all hunks of the file are in it."""
    counts = hunks.groupBy("change_id", "file_path").agg(F.count("*").alias("hunk_count"))
    rows = assigned.groupBy("change_id", "group_id", "file_path").agg(F.array_sort(F.collect_set("hunk_index")).alias("hunk_indices")).join(counts, ["change_id", "file_path"])
    full = F.col("hunk_indices") == F.transform(F.sequence(F.lit(0), F.col("hunk_count").cast("int") - 1), lambda x: x.cast("int"))
    return rows.select("change_id", "group_id", "file_path", F.when(full, "whole_file").otherwise("partial_hunks").alias("assignment_type"), F.size("hunk_indices").alias("hunks"))


def expand_whole(assignments: DataFrame, files: DataFrame, union: bool = False) -> DataFrame:
    """One row for each hunk of each assignment. A whole file means all its hunks, whatever is listed, or
    with `union` those and the listed ones; a partial one means what is listed. Unknown files have none."""
    rows = assignments.join(files.select("change_id", "file_path", "hunk_count"), ["change_id", "file_path"], "left")
    n = F.coalesce(F.col("hunk_count"), F.lit(0)).cast("int")
    none = F.array().cast("array<int>")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    listed = F.coalesce("hunk_indices", none)
    whole: Column = F.array_union(every, listed) if union else every
    return rows.select("change_id", "group_id", "file_path", F.explode(F.when(F.col("assignment_type") == "whole_file", whole).otherwise(listed)).alias("hunk_index"))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
