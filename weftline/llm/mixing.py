"""Mixing sources to target weights that change over the course of training."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: A schedule is a broken line of (time from 0 to 1, weight). The integrals of these are 5, 2 and 1.
CURRICULUM = ([(0.0, 7.0), (1.0, 3.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)])


def integral(schedule: list[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _invert(schedule: list[tuple[float, float]], share: Column) -> Column:
    """The time at which the schedule's integral has reached that share of its whole."""
    whole, done, out = integral(schedule), 0.0, None
    pieces = list(zip(schedule, schedule[1:], strict=False))
    cases = []
    for (t0, a), (t1, b) in pieces:
        slope, need = (b - a) / (t1 - t0), share * whole - done
        at = need / a + t0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), need * (2 * slope) + a * a)) - a) / slope + t0
        done += (t1 - t0) * (a + b) / 2
        cases.append((share * whole <= done, F.least(at, F.lit(t1))))
    for reached, at in reversed(cases):
        out = at if out is None else F.when(reached, at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: list[float], share: Fraction, cap: int) -> DataFrame:
    """source, size -> source, place, weight, source_size, target: the budget by weight, no target over
    cap times the source's size, the excess dealt again by weight. A row for each source: sources that
    fill up come first in the order of size / weight, so running sums find the level in one pass."""
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.get(F.lit(weights).cast("array<double>"), F.col("place") % len(weights)))
    num, den = share.numerator, share.denominator
    first = W.Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything = W.Window.partitionBy()
    budget = (F.sum("source_size").over(everything) * num).cast("double")
    left = budget - F.coalesce(F.sum("source_size").over(first.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).cast("double") * (den * cap)
    open_ = F.sum("weight").over(first.rowsBetween(0, W.Window.unboundedFollowing))
    full = F.col("source_size").cast("double") * (den * cap) * open_ <= left * F.col("weight")
    marked = ranked.withColumn("full", full)
    left = (F.sum("source_size").over(everything) * num - F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything) * (den * cap)).cast("double")
    open_ = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("source_size").cast("double") * cap).otherwise(left * F.col("weight") / (open_ * den))
    return marked.select("source", "place", "weight", "source_size", target.alias("target"))


def mix(docs: DataFrame, schedules=CURRICULUM, share: Fraction = Fraction(3, 2), cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag: Column | None = None) -> DataFrame:
    """Training positions for the documents of all sources: id_col, size, source_size, target, taken,
    position, positions (one for each copy, from 0 to 1), copies (words of each copy), source, tag (what
    the caller wants to know rows by).

    Sources by code point, null last, take the schedules in turn; a schedule's integral is the source's
    weight. Its documents stand in the order of md5(id); pass k over them covers the words from
    k * source_size on, and the words below the rounded target are taken, the last document in part. A
    copy's position is where the integral of the schedule reaches its first word's share. Rows come
    sorted over ranges of position.

    Running sums go by (source, first three hex digits of the digest), so a source with a third of all
    rows is summed in 4,096 parts. Null and empty texts have size 0, are never taken and have no
    position; rows repeated under one id count each; an empty table gives no rows; other columns are
    ignored. The table of sources is sorted in one task: a row for each source.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = common.store(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), (F.lit(None).cast("int") if tag is None else tag).alias("tag")), "sized").withColumn("part", F.substring("key", 1, 3))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), [integral(s) for s in schedules], share, cap)
    before = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    parts = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    inner = W.Window.partitionBy("source", "part").orderBy("key", "id", "size", "tag").rowsBetween(W.Window.unboundedPreceding, -1)
    laid = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    laid = laid.join(parts, laid["source"].eqNullSafe(parts["source"]) & (laid["part"] == parts["part"])).drop(parts["source"], parts["part"])
    laid = laid.withColumn("ahead", F.col("ahead") + F.col("part_before"))
    goal = F.floor(F.col("target") + 0.5)
    copies = F.array(*[F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - (F.col("ahead") + F.col("source_size") * k))) for k in range(cap)])
    laid = laid.withColumn("copies", F.filter(copies, lambda n: n > 0))
    times = []
    for k in range(cap):
        gone = (F.col("ahead") + F.col("source_size") * k).cast("double") / F.col("target")
        at = None
        for i, schedule in enumerate(schedules):
            here = _invert(schedule, gone)
            at = F.when(F.col("place") % len(schedules) == i, here) if at is None else at.when(F.col("place") % len(schedules) == i, here)
        times.append(F.when((F.size("copies") > k) & (F.col("target") > 0), F.round(at, 9)))
    laid = laid.withColumn("positions", F.filter(F.array(*times), lambda t: t.isNotNull()))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, n: a + n)
    out = laid.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.get("positions", F.lit(0)).alias("position"), "positions", "copies", "source", "tag", "key")
    order = [F.col("position").asc_nulls_last(), F.col("key")]
    return out.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).drop("key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_texts: bool = False, **options) -> DataFrame:
    """The mix as a corpus: a row of docs for each copy taken, in ranges of training position. The one
    document of a source that the target cuts keeps its first words, or with `whole_texts` all of its
    text, so that a source's target is exceeded by less than that document. Rows are told apart by all
    their columns, so reruns agree; of equal rows each stands for itself. Null and empty texts, which have
    no words, are never taken; an empty table gives no rows; other columns are kept, whatever their names."""
    columns = docs.columns
    a_, b_, at_, text_ = common.free(columns, "a", "b", "at", "text_taken")
    tag = common.tag(docs)
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, tag=tag, **options).filter("taken > 0")
    plan = plan.select(F.col("tag.a").alias(a_), F.col("tag.b").alias(b_), F.posexplode(F.arrays_zip("positions", "copies", F.array_repeat("size", F.size("copies")).alias("sizes"))).alias("copy", at_))
    plan = common.store(plan, "plan")
    repeated = plan.filter("copy = 0").groupBy(a_, b_).count().filter("count > 1")
    rows = docs.withColumns({a_: tag["a"], b_: tag["b"]})
    if not repeated.isEmpty():  # of equal rows one stands for all, as their copies have one tag
        rows = rows.dropDuplicates([a_, b_])
    rows = rows.join(plan.drop("copy"), [a_, b_])
    taken = F.col(at_)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), taken["copies"].cast("int")), " ")
    whole = F.lit(True) if whole_texts else taken["copies"] == taken["sizes"]
    order = [taken["positions"], F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.col(a_)]
    out = rows.withColumn(text_, F.when(whole, F.col(text_col)).otherwise(part))
    out = out.repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    changed = {text_col: F.col(text_)}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text_).cast("long"))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in columns])
