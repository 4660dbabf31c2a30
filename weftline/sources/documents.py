"""Other inputs: plan files, group lists of a model, numstat, status lines, states of pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..options import AssignmentType, PlanError

GROUPS = f"groups array<struct<id: string, title: string, description: string, depends_on: array<string>, assignments: array<{schemas.ASSIGNMENT}>, estimated_loc: int>>"
FORK = "head struct<ref: string, sha: string, repo: struct<fork: boolean, clone_url: string, owner: struct<login: string>>>, base struct<ref: string>"


def plan_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The plan document: plan, git_state; an error where it is missing or malformed."""
    if not plan_exists(spark, path):
        raise PlanError(f"no plan at {path}")
    return spark.read.schema(schemas.PLAN).option("multiLine", True).option("mode", "FAILFAST").json(path)


def plan_groups(plans: DataFrame, change: Column) -> DataFrame:
    """A row for each group of each plan, in the plan's order."""
    rows = plans.select(change.alias("change_id"), F.posexplode("plan.groups").alias("group_ord", "g"))
    return rows.select("change_id", "group_ord", "g.*")


def model_answers(payloads: DataFrame, column: str = "payload_json") -> DataFrame:
    """All other columns of a model's JSON answers, their `groups` and the `error` of those that can't be read, which have
    null groups. `groups` must be a list; assignment types must be known."""
    keep = [c for c in payloads.columns if c != column]
    raw = payloads.select("*", F.from_json(column, GROUPS).alias("_d"))
    is_list = F.get_json_object(column, "$.groups").startswith("[")
    fine = F.coalesce(is_list, F.lit(False)) & F.col("_d.groups").isNotNull()
    known = [str(x) for x in AssignmentType]
    typed = F.forall(F.coalesce("_d.groups", F.array().cast(GROUPS.split(" ", 1)[1])), lambda g: F.forall(F.coalesce(g["assignments"], F.array().cast(f"array<{schemas.ASSIGNMENT}>")), lambda a: a["assignment_type"].isin(known)))
    keys = F.coalesce(F.array_join(F.json_object_keys(column), ", "), F.lit("none"))
    error = F.when(~fine, F.concat(F.lit("no list under 'groups'; keys: "), keys)).when(~typed, F.lit("unknown assignment type"))
    told = raw.select(*keep, "_d", error.alias("error"))
    return told.select(*keep, F.when(F.col("error").isNull(), F.col("_d.groups")).alias("groups"), "error")


def model_groups(payloads: DataFrame, column: str = "payload_json") -> tuple[DataFrame, DataFrame]:
    """(groups, errors) from a model's JSON answers; see model_answers."""
    read = model_answers(payloads, column)
    keep = read.columns[:-2]
    groups = read.select(*keep, F.posexplode("groups").alias("group_ord", "_g")).select(*keep, "group_ord", "_g.*")
    return groups, read.filter("error is not null").select(*keep, "error")


def numstat(spark: SparkSession, path: str) -> DataFrame:
    """file_path, added, removed from tab-separated lines; binary files count 0, short lines are skipped."""
    return numstat_lines(spark.read.text(path))


def numstat_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same for lines of a table, all its other columns kept."""
    parts = F.split(F.col(column), "\t")

    def number(k: int) -> Column:
        return F.when(parts[k] == "-", 0).otherwise(parts[k].try_cast("int"))

    return lines.filter(F.size(parts) >= 3).select(*[c for c in lines.columns if c != column], parts[2].alias("file_path"), number(0).alias("added"), number(1).alias("removed"))


def worktree_clean(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: whether every status line is about an untracked file (no lines: yes)."""
    return lines.filter(F.col(column) != "").agg(F.coalesce(F.bool_and(F.col(column).startswith("??")), F.lit(True)).alias("clean"))


def refs(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, sha from lines "sha name" that list a repository's refs."""
    parts = F.split(F.trim(F.col(column)), r"\s+", 2)
    return lines.filter(F.size(parts) == 2).select(F.regexp_replace(parts[1], "^refs/(heads|remotes|tags)/", "").alias("name"), parts[0].alias("sha"))


def refs_exist(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted: name -> name, exists; a name or a whole sha is known."""
    both = known.select("name").union(known.select("sha")).distinct()
    return wanted.join(both.withColumn("exists", F.lit(True)), "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def merge_bases(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """change_id, a, b, merge_base for each distinct wanted pair (change_id, a, b) over commits (change_id, sha,
    parents): a commit that both reach, themselves included, and that none such behind it reaches; of several the
    first sha, null where there is none or a or b isn't known. A change's commits are read once for all of its pairs, and a
    pair walks back only as far as generations below where its two sides have met."""
    from ..operators import kernels

    asked = wanted.groupBy("change_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("pairs"))
    rows = commits.select("change_id", "sha", "parents").withColumn("pairs", F.lit(None).cast(asked.schema["pairs"].dataType))
    rows = rows.unionByName(asked.select("change_id", F.lit(None).cast(rows.schema["sha"].dataType).alias("sha"), F.lit(None).cast(rows.schema["parents"].dataType).alias("parents"), "pairs"))

    def run(found: list[dict]):
        pairs = [(p["a"], p["b"]) for r in found for p in r["pairs"] or []]
        history = kernels.History({r["sha"]: r["parents"] or [] for r in found if r["sha"] is not None}) if pairs else None
        return [(a, b, min(history.bases(a, b), default=None)) for a, b in pairs]

    return kernels.by_change(rows, ["sha", "parents", "pairs"], run, "a string, b string, merge_base string")


def body_template(spark: SparkSession, path: str) -> str | None:
    """The text of a template file; null where there is none."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()) if plan_exists(spark, path) else None


def live_states(answers: DataFrame, number: str = "pr_number", column: str = "json") -> DataFrame:
    """pr_number, state, review_decision, is_draft; nulls where the answer is missing or no JSON."""
    d = F.from_json(column, "state string, reviewDecision string, isDraft boolean")
    return answers.select(number, d["state"].alias("state"), d["reviewDecision"].alias("review_decision"), d["isDraft"].alias("is_draft"))


def fork_pulls(answers: DataFrame, number: str = "pr_number", column: str = "json") -> DataFrame:
    """Answers about pull requests from forks: those whose head is a fork, with owner, url and refs; the
    others with an error."""
    d = F.from_json(column, FORK)
    fine = d["head"].isNotNull() & d["base"].isNotNull() & F.coalesce(d["head"]["repo"]["fork"], F.lit(False))
    return answers.select(number, d["head"]["repo"]["owner"]["login"].alias("user"), d["head"]["ref"].alias("branch"), d["head"]["repo"]["clone_url"].alias("url"), d["base"]["ref"].alias("base_branch"), F.when(~fine, "not a pull request from a fork").alias("error"))


def fork_branches(answers: DataFrame, user: str = "user", branch: str = "branch", column: str = "json") -> DataFrame:
    """Answers about a fork's repository: url and the default branch as base."""
    d = F.from_json(column, "fork boolean, clone_url string, default_branch string, parent struct<default_branch: string>")
    return answers.select(user, branch, d["clone_url"].alias("url"), F.coalesce(d["parent"]["default_branch"], d["default_branch"]).alias("base_branch"), F.when(~F.coalesce(d["fork"], F.lit(False)), "not a fork").alias("error"))
