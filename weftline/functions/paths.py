"""Column functions over paths and names of branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import LOGICAL_DIR_BONUS, ORTHOGONAL_PENALTY, SAME_FILE, SAME_SUFFIX, SHARED_DIR, TEST_PAIR, Priority


def parts(path: Column) -> Column:
    """Components of a path; an absolute path has "/" as its first."""
    names = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), names)).otherwise(names)


def name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), F.lit(-1)), F.lit(""))


def dirs(path: Column) -> Column:
    all_ = parts(path)
    return F.slice(all_, F.lit(1), F.greatest(F.lit(0), F.size(all_) - 1))


def suffix(path: Column) -> Column:
    """From the last dot on, unless that is the first or last character of the name."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    whole = name(path)
    return F.substring(whole, F.lit(1), F.length(whole) - F.length(suffix(path)))


def heads(path: Column) -> Column:
    """All directories that a path is in, from the outermost in."""
    all_ = dirs(path)
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(all_)), lambda n: n > 0), lambda n: F.array_join(F.slice(all_, F.lit(1), n), "/"))


def shared_dir_depth(a: Column, b: Column) -> Column:
    """How many leading directories two paths share; file names don't count."""
    return F.size(F.array_intersect(heads(a), heads(b)))


def test_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem(path), "^test_", ""), "_test$", "")


def is_test(path: Column) -> Column:
    return test_stem(path) != stem(path)


def features(path: Column) -> Column:
    """What affinity() needs of a path: made once for each path, however many pairs it is in."""
    return F.struct(path.alias("path"), heads(path).alias("heads"), suffix(path).alias("suffix"), test_stem(path).alias("stem"), is_test(path).alias("is_test"))


def add_features(rows: DataFrame, path: Column, out: str) -> DataFrame:
    """features() as a column, step by step, so that each step is evaluated once for a row."""
    rows = rows.withColumn("_path", path).withColumn("_parts", parts(F.col("_path"))).withColumn("_name", name(F.col("_path")))
    rows = rows.withColumn("_suffix", F.regexp_extract("_name", r"^.+(\.[^.]+)$", 1))
    rows = rows.withColumn("_stem", F.substring("_name", F.lit(1), F.length("_name") - F.length("_suffix")))
    rows = rows.withColumn("_bare", F.regexp_replace(F.regexp_replace("_stem", "^test_", ""), "_test$", ""))
    depth = F.size("_parts") - 1
    outer = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), depth)), lambda n: n > 0), lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/"))
    made = F.struct(F.col("_path").alias("path"), outer.alias("heads"), F.col("_suffix").alias("suffix"), F.col("_bare").alias("stem"), (F.col("_bare") != F.col("_stem")).alias("is_test"))
    return rows.withColumn(out, made).drop("_path", "_parts", "_name", "_suffix", "_stem", "_bare")


def test_pair_bonus(x: Column, y: Column) -> Column:
    """For two features: 40 if exactly one is a test and the stems are the same without that."""
    return F.when((x["is_test"] != y["is_test"]) & (x["stem"] == y["stem"]), TEST_PAIR).otherwise(0)


def affinity(x: Column, y: Column, priority: str | Priority) -> Column:
    """Closeness of two features: 500 for one file, else by shared directories, suffix and test pairing."""
    depth = F.size(F.array_intersect(x["heads"], y["heads"]))
    score = depth * SHARED_DIR + F.when(x["suffix"] == y["suffix"], SAME_SUFFIX).otherwise(0) + test_pair_bonus(x, y)
    if Priority(priority) == Priority.ORTHOGONAL:
        score = F.greatest(F.lit(0), score - ORTHOGONAL_PENALTY)
    else:
        score = score + F.when(depth > 0, LOGICAL_DIR_BONUS).otherwise(0)
    return F.when(x["path"] == y["path"], SAME_FILE).otherwise(score)


def split_namespace(arg: Column) -> Column:
    """What follows the first colon, or the text without leading #, made fit for a branch name."""
    tail = F.when(arg.contains(":"), F.regexp_replace(arg, r"(?s)^[^:]*:", "")).otherwise(F.regexp_replace(arg, "^#+", ""))
    return F.regexp_replace(F.regexp_replace(tail, r"[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")


def fork_kind(arg: Column) -> Column:
    """pr for digits with or without #, branch for user:branch, else null."""
    return F.when(arg.rlike(r"^#*\d+$"), "pr").when(arg.contains(":"), "branch")


def fork_ref(arg: Column) -> Column:
    """kind, pr_number, user, branch of a reference to a fork; null where it is none."""
    kind = fork_kind(arg)
    found = F.struct(
        kind.alias("kind"),
        F.when(kind == "pr", F.regexp_replace(arg, "^#+", "").cast("int")).alias("pr_number"),
        F.when(kind == "branch", F.regexp_extract(arg, r"(?s)^([^:]*):", 1)).alias("user"),
        F.when(kind == "branch", F.regexp_replace(arg, r"(?s)^[^:]*:", "")).alias("branch"),
    )
    return F.when(kind.isNotNull(), found)


def url_number(url: Column) -> Column:
    """The number at the end of the last line of what a creating command printed."""
    line = F.element_at(F.split(F.regexp_replace(url, r"\s+$", ""), "\n"), -1)
    return F.element_at(F.split(F.regexp_replace(line, "/+$", ""), "/"), -1).try_cast("int")
