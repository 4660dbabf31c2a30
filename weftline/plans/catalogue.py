"""The query catalogue: each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import file_flags, file_summary
from ..operators import chunking, edit, graph, partition, score, stats, status, validate
from ..options import PlanOptions, Priority
from ..sources import diffs
from ..tables import stored
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UNIT_LOC, CHUNK_BUDGET, MAX_LOC, MIN_LOC = 300, 600, 120, 30


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def _text(array: str) :
    return F.array_join(F.col(array).cast("array<string>"), ",")


@query(f"with {A.HUNKS}, x as (select change_id, file_path, sum(added) a, sum(removed) r from h group by all) select change_id, count(*) total_files, sum(a)::bigint total_added, sum(r)::bigint total_removed, sum(a + r)::bigint total_loc from x group by all")
def q01_diff_stats(spark, sf_dir):
    return stats.diff_stats(stats.files_from_hunks(A.li_hunks(spark, sf_dir))).drop("file_summaries")


@query(f"with recursive {A.CONV}, {A.conv_filled(UNIT_LOC)} select change_id, bin::bigint as position, change_id || ':' || min(turn) || '-' || max(turn) unit_id, min(turn) first_hunk, max(turn) last_hunk, count(*) hunks, sum(tok)::bigint loc from b group by change_id, bin")
def q02_unit_build(spark, sf_dir):
    units = chunking.partition_units(A.conv_seq(spark, sf_dir), UNIT_LOC)
    return units.select("change_id", "position", "unit_id", F.array_min("hunk_indices").alias("first_hunk"), F.array_max("hunk_indices").alias("last_hunk"), F.size("hunk_indices").cast("long").alias("hunks"), "loc")


_FITS = f"and change_id not in (select change_id from s where tok > {CHUNK_BUDGET})"


@query(f"with recursive {A.CONV}, {A.conv_filled(CHUNK_BUDGET)} select change_id, bin as chunk, min(turn) first_seq, max(turn) last_seq, count(*) hunks, sum(tok)::bigint tokens from b where true {_FITS} group by change_id, bin")
def q03_chunk_greedy(spark, sf_dir):
    rows = chunking.chunk(A.conv_seq(spark, sf_dir), CHUNK_BUDGET, "greedy")
    return rows.groupBy("change_id", "chunk").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("hunks"), F.sum("token_estimate").alias("tokens"))


@query(f"""with recursive {A.CONV}, t as (select change_id, i, n, sum(tok) over (partition by change_id order by i) upto from s where true {_FITS}),
d as (select distinct change_id, 0::bigint as i, [0.0::double] costs, [0::bigint] many from t union all
  select d.change_id, d.i + 1, list_append(d.costs, x.cost), list_append(d.many, x.many) from d, lateral (
    select d.costs[j.i::bigint] + (100.0::double + ({CHUNK_BUDGET} - used)::double * ({CHUNK_BUDGET} - used)::double / {CHUNK_BUDGET} + 0.0::double + case when d.i + 1 < j.n then 10000.0::double else 0.0::double end) cost, d.many[j.i::bigint] + 1 many
    from (select k.i, k.n, e.upto - coalesce(b.upto, 0) used from t k join t e on e.change_id = k.change_id and e.i = d.i + 1 left join t b on b.change_id = k.change_id and b.i = k.i - 1 where k.change_id = d.change_id and k.i <= d.i + 1) j
    where used <= {CHUNK_BUDGET} order by cost, j.i desc limit 1) x)
select d.change_id, d.costs[-1] as cost, d.many[-1] as chunks from d join (select change_id, max(n) n from t group by all) m on d.change_id = m.change_id and d.i = m.n""")
def q04_chunk_dp(spark, sf_dir):
    return chunking.chunk_costs(A.conv_seq(spark, sf_dir), CHUNK_BUDGET).withColumn("chunks", F.col("chunks").cast("long"))


@query(f"with recursive {A.CONV}, {A.conv_filled(CHUNK_BUDGET)} select change_id, bin as chunk, 1::bigint total_files, sum(tok)::bigint total_added, 0::bigint total_removed, sum(tok)::bigint total_loc, count(*) hunks, sum(tok)::bigint tokens from b where true {_FITS} group by change_id, bin")
def q05_chunk_stats(spark, sf_dir):
    seq = A.conv_seq(spark, sf_dir)
    return chunking.chunk_stats(chunking.chunk(seq, CHUNK_BUDGET, "greedy"), stats.files_from_hunks(seq), seq).drop("file_summaries")


@query(f"""with {A.HUNKS}, x as (select change_id, file_ord, file_path, sum(added)::bigint a, sum(removed)::bigint r, count(*) n from h group by all),
y as (select *, list_filter([case when r = 0 then 'new' end, case when a = 0 then 'deleted' end, case when file_ord % 7 = 0 then 'renamed' end], lambda z: z is not null) fl from x)
select change_id, file_ord, array_to_string(fl, ',') flags, '  ' || file_path || ': +' || a || '/-' || r || ' (' || n || ' hunks, indices 0..' || (n - 1) || ')' || case when len(fl) > 0 then ' [' || array_to_string(fl, ', ') || ']' else '' end summary from y""")
def q06_file_summary_flags(spark, sf_dir):
    files = stats.files_from_hunks(A.li_hunks(spark, sf_dir)).withColumn("is_renamed", F.col("file_ord") % 7 == 0)
    flags = file_flags(F.col("is_new"), F.col("is_deleted"), F.col("is_renamed"))
    return files.select("change_id", "file_ord", F.array_join(flags, ",").alias("flags"), file_summary(F.col("file_path"), F.col("added"), F.col("removed"), flags, F.col("hunk_count")).alias("summary"))


@query("""with w as (select conv_id change_id, case when turn % 2 = 0 then conv_id::varchar else 'none' end file_path, turn + 3 hunk_index from conversations)
select w.*, coalesce(c.text, '') hunk_text, case when c.text is null and w.file_path <> 'none' then 'no such hunk' end as error from w left join conversations c on c.conv_id = w.change_id and c.conv_id::varchar = w.file_path and c.turn = w.hunk_index""")
def q07_hunk_lookup(spark, sf_dir):
    seq = A.conv_seq(spark, sf_dir)
    wanted = seq.select("change_id", F.when(F.col("hunk_index") % 2 == 0, F.col("file_path")).otherwise("none").alias("file_path"), (F.col("hunk_index") + 3).alias("hunk_index"))
    return stats.hunk_texts(wanted, seq)


@query(r"""with a as (select page_id, url, regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) path from pages where url is not null), b as (select *, list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.') p from a),
c as (select *, coalesce(p[-1], '') name from b), d as (select *, regexp_extract(name, '^.+(\.[^.]+)$', 1) suffix from c), e as (select *, name[1:length(name) - length(suffix)] stem from d)
select page_id, greatest(0, len(p) - case when path like '/%' then 0 else 1 end)::bigint dirs, suffix, stem, regexp_replace(regexp_replace(stem, '^test_', ''), '_test$', '') test_stem,
regexp_replace(regexp_replace(regexp_replace(url, '(?s)^[^:]*:', ''), '[^A-Za-z0-9._-]', '-', 'g'), '^-+|-+$', '', 'g') namespace, case when page_id % 2 = 0 then 'pr' else 'branch' end fork from e""")
def q08_path_scalars(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").filter("url is not null").withColumn("path", F.regexp_extract("url", r"(?s)://[^/?#]*([^?#]*)", 1))
    path, ref = F.col("path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("#"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return pages.select("page_id", F.size(paths.dirs(path)).cast("long").alias("dirs"), paths.suffix(path).alias("suffix"), paths.stem(path).alias("stem"), paths.test_stem(path).alias("test_stem"), paths.split_namespace(F.col("url")).alias("namespace"), paths.fork_kind(ref).alias("fork"))


@query(f"""with {A.HUNKS}, {A.UNITS},
x as (select a.change_id, a.position a, b.position b, a.path = b.path same, case when a.d1 = b.d1 then case when a.d2 = b.d2 then 2 else 1 end else 0 end depth, a.suffix = b.suffix sfx,
  (a.norm <> a.stem) <> (b.norm <> b.stem) and a.norm = b.norm pair from u a join u b on a.change_id = b.change_id and a.position < b.position),
y as (select *, 25 * depth + case when sfx then 10 else 0 end + case when pair then 40 else 0 end base from x),
z as (select change_id, a, b, case when same then 500 else greatest(0, base - 20) end orthogonal, case when same then 500 else base + case when depth > 0 then 10 else 0 end end logical from y)
select change_id, count(*) filter (orthogonal > 0) orthogonal_pairs, coalesce(sum(orthogonal), 0)::bigint orthogonal_sum, count(*) filter (logical > 0) logical_pairs, coalesce(sum(logical), 0)::bigint logical_sum, sum(orthogonal * (a * 31 + b))::bigint orthogonal_check from z group by change_id having count(*) filter (logical > 0) > 0""")
def q09_affinity_pairs(spark, sf_dir):
    sums = partition.affinity_sums(A.li_units(spark, sf_dir), Priority.LOGICAL, Priority.ORTHOGONAL)
    of = lambda priority, x: F.coalesce(F.max(F.when(F.col("priority") == str(priority), x)), F.lit(0))
    one, two = Priority.LOGICAL, Priority.ORTHOGONAL
    return sums.groupBy("change_id").agg(
        of(one, F.col("pairs")).alias("logical_pairs"), of(one, F.col("score")).alias("logical_sum"), of(two, F.col("pairs")).alias("orthogonal_pairs"),
        of(two, F.col("score")).alias("orthogonal_sum"), of(two, F.col("first") * 31 + F.col("second")).alias("orthogonal_check"),
    )


@query()
def q10_partition_graph(spark, sf_dir):
    """Greedy groups with repair of small ones; no SQL states it, tests hold its invariants and fixtures."""
    units = A.li_units(spark, sf_dir)
    grouped = partition.group_units(units, PlanOptions(max_loc=MAX_LOC, min_loc=MIN_LOC), keep=True)
    return grouped.groupBy("change_id", "group_ord").agg(F.count("*").alias("units"), F.sum("loc").alias("loc"), F.countDistinct("file_path").alias("files"), F.min("position").alias("anchor"))


@query(f"with {A.HUNKS}, {A.LOC} select * from g")
def q11_group_loc(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    return stats.group_loc(hunks, hunks.drop("group_id"), hunks.select("change_id", "group_id").distinct())


@query(f"with {A.HUNKS}, t as (select change_id, file_path, count(*) n from h group by all), a as (select change_id, group_id, file_path, count(distinct hunk_index) k from h group by all) select change_id, group_id, file_path, case when k = n then 'whole_file' else 'partial_hunks' end assignment_type, k as hunks from a join t using (change_id, file_path)")
def q12_whole_vs_partial(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    return partition.whole_or_partial(hunks, hunks).withColumn("hunks", F.col("hunks").cast("long"))


@query(f"with {A.HUNKS} select change_id, file_path, hunk_index from h except select change_id, file_path, hunk_index from h where l_linenumber % 5 <> 0")
def q13_coverage_gap(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    return validate.coverage_gap(hunks.filter("l_linenumber % 5 <> 0"), hunks)


def _doubled(hunks: DataFrame) -> DataFrame:
    """Hunks of which those with a high discount are in the next group, too."""
    next_ = F.concat(F.lit("pr-"), ((F.col("group_ord") + 1) % 10 + 1).cast("string"))
    return hunks.unionByName(hunks.filter("l_discount >= 0.08").withColumn("group_id", next_))


_DOUBLED = "o as (select * from h union all select * replace ('pr-' || ((group_ord + 1) % 10 + 1) as group_id) from h where l_discount >= 0.08)"


@query(f"with {A.HUNKS}, {_DOUBLED} select change_id, file_path, hunk_index, string_agg(group_id, ',' order by group_id) group_ids from o group by all having count(*) > 1")
def q14_coverage_overlap(spark, sf_dir):
    return validate.coverage_overlap(_doubled(A.li_hunks(spark, sf_dir))).withColumn("group_ids", F.array_join("group_ids", ","))


@query(f"""with {A.HUNKS}, a as (select * from h where l_linenumber % 5 <> 0), ho as (select change_id, file_path, arg_min(group_id, group_ord) holder from a group by all),
s as (select change_id, group_ord, group_id, count(distinct file_path) n from a group by all), la as (select change_id, first(group_id order by n desc, group_ord) largest from s group by all)
select u.change_id, u.file_path, u.hunk_index, coalesce(holder, largest) group_id from h u left join ho using (change_id, file_path) left join la using (change_id) where u.l_linenumber % 5 = 0""")
def q15_assign_uncovered(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    return edit.assign_uncovered(hunks.filter("l_linenumber % 5 <> 0"), hunks)


@query(f"""with recursive {A.HUNKS}, {A.EDGES}, {A.CLOSURE}, {_DOUBLED}
select distinct a.change_id, a.file_path, a.hunk_index, a.group_id a, b.group_id b from o a join o b on a.change_id = b.change_id and a.file_path = b.file_path and a.hunk_index = b.hunk_index and a.group_id < b.group_id
where not exists (select 1 from c where c.change_id = a.change_id and (c.group_id = a.group_id and c.ancestor_id = b.group_id or c.group_id = b.group_id and c.ancestor_id = a.group_id))""")
def q16_conflicts(spark, sf_dir):
    hunks = stored(A.li_hunks(spark, sf_dir), "hunks")
    return validate.conflicts(_doubled(hunks), A.li_groups(hunks))


@query(f"with {A.HUNKS} select change_id, sum(case when l_linenumber <> 3 then added + removed else 0 end)::bigint group_loc, sum(added + removed)::bigint diff_loc from h group by all having group_loc <> diff_loc")
def q17_loc_conservation(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    groups = stats.group_loc(hunks.filter("l_linenumber <> 3"), hunks.drop("group_id"), hunks.select("change_id", "group_id").distinct())
    return validate.loc_mismatch(groups, hunks)


@query(f"""with {A.HUNKS}, {A.LOC}, x as (select *, unnest(list_filter([case when estimated_loc < {MIN_LOC} then 'below_min' end, case when estimated_loc > {MAX_LOC} then 'above_max' end], lambda z: z is not null)) violation_type from g)
select change_id, group_id, estimated_loc, violation_type, case violation_type when 'below_min' then {MIN_LOC} else {MAX_LOC} end::bigint as "limit", 'group ' || group_id || ' has ' || estimated_loc || ' lines of code (+' || estimated_added || ' -' || estimated_removed || '), ' ||
case violation_type when 'below_min' then 'below the minimum of {MIN_LOC}' else 'above the maximum of {MAX_LOC}' end as message from x""")
def q18_loc_bounds(spark, sf_dir):
    found = validate.loc_bounds(q11_group_loc(spark, sf_dir), MAX_LOC, MIN_LOC)
    return found.select("change_id", "group_id", "estimated_loc", "violation_type", F.col("limit").cast("long").alias("limit"), "message")


@query(f"with {A.HUNKS}, {A.EDGES} select distinct change_id, group_id, parent_id from l where parent_id is not null")
def q19_dep_edges(spark, sf_dir):
    return graph.file_order_edges(A.li_hunks(spark, sf_dir))


@query(f"with recursive {A.HUNKS}, {A.EDGES}, {A.CLOSURE} select e.* from e where not exists (select 1 from e w join c on c.change_id = w.change_id and c.group_id = w.parent_id and c.ancestor_id = e.parent_id where w.change_id = e.change_id and w.group_id = e.group_id and w.parent_id <> e.parent_id)")
def q20_transitive_reduction(spark, sf_dir):
    return graph.edges_of(graph.reduce_dependencies(A.li_groups(A.li_hunks(spark, sf_dir))))


@query(f"with recursive {A.HUNKS}, {A.EDGES}, {A.LEVELS} select change_id, group_id, level from v")
def q21_dag_levels(spark, sf_dir):
    return graph.levels(A.li_groups(A.li_hunks(spark, sf_dir)))


@query(f"""with {A.HUNKS}, {A.EDGES}, x as (select n.change_id, n.group_id, (select count(*) from e where e.change_id = n.change_id and e.group_id = n.group_id) parents, (select count(*) from e where e.change_id = n.change_id and e.parent_id = n.group_id) children from n)
select *, parents = 0 is_root, children = 0 is_leaf, parents > 1 is_merge from x""")
def q22_degrees(spark, sf_dir):
    groups = A.li_groups(A.li_hunks(spark, sf_dir))
    return graph.degrees(groups, graph.edges_of(groups))


@query(f"with recursive {A.HUNKS}, {A.EDGES}, {A.CLOSURE} select * from c")
def q23_closure(spark, sf_dir):
    return graph.closure(A.li_groups(A.li_hunks(spark, sf_dir)))


@query(f"""with recursive {A.HUNKS}, {A.EDGES}, j as (select change_id, group_id, parent_id from (select *, count(*) over (partition by change_id, group_id) p, count(*) over (partition by change_id, parent_id) k from e) where p = 1 and k = 1),
w as (select change_id, group_id head, group_id as node, 0 hop from n where not exists (select 1 from j where j.change_id = n.change_id and j.group_id = n.group_id) union all
  select w.change_id, w.head, j.group_id, w.hop + 1 from w join j on j.change_id = w.change_id and j.parent_id = w.node)
select change_id, head, string_agg(node, ',' order by hop) members, count(*) as length from w group by change_id, head""")
def q24_linear_chains(spark, sf_dir):
    chains = graph.linear_chains(A.li_groups(A.li_hunks(spark, sf_dir)))
    return chains.select("change_id", F.get("group_ids", F.lit(0)).alias("head"), F.array_join("group_ids", ",").alias("members"), F.size("group_ids").cast("long").alias("length"))


@query(f"with {A.HUNKS}, x as (select change_id, file_path, count(distinct group_id) - 1 k from h group by all) select change_id, sum(k)::bigint file_scatter from x group by all")
def q25_file_scatter(spark, sf_dir):
    return score.file_scatter(A.li_hunks(spark, sf_dir))


@query(f"""with recursive {A.HUNKS}, {A.EDGES}, {A.LEVELS}, {A.LOC},
a as (select change_id, count(*) group_count, max(estimated_loc) max_group_loc, sum(greatest(0, {MIN_LOC} - estimated_loc))::bigint underflow, sum(greatest(0, estimated_loc - {MAX_LOC}))::bigint overflow,
  count(*) filter (estimated_loc > 0 and estimated_loc < {MAX_LOC // 4}) tiny_groups, count(*) filter (estimated_loc < {MIN_LOC}) undersized_groups from g group by all),
b as (select change_id, count(*) dependency_edges from e group by all), d as (select change_id, max(level) + 1 dag_depth, max(k) dag_width from (select change_id, level, count(*) k from v group by all) group by all),
x as (select change_id, sum(k)::bigint file_scatter from (select change_id, file_path, count(distinct group_id) - 1 k from h group by all) group by all),
m as (select change_id, group_count, max_group_loc, underflow, overflow, coalesce(dependency_edges, 0) dependency_edges, tiny_groups, undersized_groups, file_scatter, dag_depth, dag_width from a left join b using (change_id) join d using (change_id) join x using (change_id))
select *, (1000 * underflow + 100 * undersized_groups + 1000 * overflow + 20 * dependency_edges + 50 * file_scatter + 10 * tiny_groups + 5 * dag_depth + group_count - 2 * dag_width)::bigint objective from m""")
def q26_plan_metrics(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    groups = A.li_groups(hunks).join(stats.group_loc(hunks, hunks.drop("group_id"), hunks.select("change_id", "group_id").distinct()), ["change_id", "group_id"])
    return score.plan_metrics(groups, hunks, MAX_LOC, MIN_LOC)


@query(f"""with {A.HUNKS}, {A.LOC}, z as (select change_id, count(*) total_files, sum(l)::bigint total_loc from (select change_id, file_path, sum(added + removed) l from h group by all) group by all),
a as (select change_id, count(*) k, sum(greatest(0, estimated_loc - {MAX_LOC}))::bigint o from g group by all), x as (select change_id, sum(k)::bigint s from (select change_id, file_path, count(distinct group_id) - 1 k from h group by all) group by all)
select change_id, total_files, total_loc, case when total_loc <= {MAX_LOC} then 1 else k end total_groups, case when total_loc <= {MAX_LOC} then 0 else 1000 * o + 50 * s + k end::bigint objective, total_loc > {MAX_LOC} and k >= 5 should_split from z join a using (change_id) join x using (change_id)""")
def q27_action_score(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    numstat = stats.files_from_hunks(hunks)
    return score.action_score(numstat, q11_group_loc(spark, sf_dir), hunks, MAX_LOC, 5)


def _part_groups(hunks: DataFrame, title: str) -> DataFrame:
    files = hunks.groupBy("change_id", "group_id", "group_ord", "file_path").agg(F.sort_array(F.collect_list("hunk_index")).alias("hunk_indices"))
    packed = files.groupBy("change_id", "group_id", "group_ord").agg(F.sort_array(F.collect_list(F.struct("file_path", "hunk_indices"))).alias("assignments"))
    edges = graph.file_order_edges(hunks)
    return graph.with_edges(packed, edges).withColumn("title", F.lit(title))


@query(f"""with {A.HUNKS}, h1 as (select * from h where l_linenumber <= 3), h2 as (select * from h where l_linenumber > 3),
l1 as (select change_id, group_id, lag(group_id) over (partition by change_id, file_path order by f, group_id) p from (select change_id, file_path, group_id, min(hunk_index) f from h1 group by all)),
l2 as (select change_id, group_id, lag(group_id) over (partition by change_id, file_path order by f, group_id) p from (select change_id, file_path, group_id, min(hunk_index) f from h2 group by all)),
d1 as (select change_id, group_id, list(distinct p order by p) d from l1 where p is not null group by all), d2 as (select change_id, group_id, list(distinct p order by p) d from l2 where p is not null group by all),
g1 as (select change_id, group_id, count(distinct file_path) k, 'first' title from h1 group by all), g2 as (select change_id, group_id, count(distinct file_path) k, 'second' title from h2 group by all)
select change_id, group_id, coalesce(g1.title, g2.title) title, coalesce(g1.k, 0) + coalesce(g2.k, 0) assignments, array_to_string(list_concat(coalesce(d1.d, []), list_filter(coalesce(d2.d, []), lambda x: not list_contains(coalesce(d1.d, []), x))), ',') depends_on
from g1 full join g2 using (change_id, group_id) left join d1 using (change_id, group_id) left join d2 using (change_id, group_id)""")
def q28_upsert_groups(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    merged = edit.upsert_groups(_part_groups(hunks.filter("l_linenumber <= 3"), "first"), _part_groups(hunks.filter("l_linenumber > 3"), "second"))
    return merged.select("change_id", "group_id", "title", F.size("assignments").cast("long").alias("assignments"), F.array_join("depends_on", ",").alias("depends_on"))


@query(f"""with recursive {A.HUNKS}, {A.EDGES}, {A.CLOSURE}, w as (select change_id, group_id, file_path, hunk_index from h union select c.change_id, c.group_id, h.file_path, h.hunk_index from c join h on h.change_id = c.change_id and h.group_id = c.ancestor_id)
select w.change_id, w.group_id, w.file_path, string_agg(w.hunk_index, ',' order by w.hunk_index) hunks from w where exists (select 1 from h where h.change_id = w.change_id and h.group_id = w.group_id and h.file_path = w.file_path) group by all""")
def q29_chain_merge(spark, sf_dir):
    hunks = stored(A.li_hunks(spark, sf_dir), "hunks")
    own = hunks.repartition("change_id").groupBy("change_id", "group_id", "file_path").agg(F.sort_array(F.collect_list("hunk_index")).alias("hunk_indices")).withColumn("assignment_type", F.lit("partial_hunks"))
    return edit.merge_own_chain(A.li_groups(hunks), own).select("change_id", "group_id", "file_path", _text("hunk_indices").alias("hunks"))


@query(f"""with {A.HUNKS}, k as (select distinct change_id, group_id from h), m as (select *, 'pr-' || ((group_ord + 3) % 10 + 1) to_id from h where l_tax >= 0.06)
select h.change_id, h.file_path, h.hunk_index, coalesce(case when exists (select 1 from k where k.change_id = h.change_id and k.group_id = m.to_id) then m.to_id end, h.group_id) group_id from h left join m on m.change_id = h.change_id and m.file_path = h.file_path and m.hunk_index = h.hunk_index""")
def q30_move_hunk(spark, sf_dir):
    hunks = A.li_hunks(spark, sf_dir)
    edits = hunks.filter("l_tax >= 0.06").select("change_id", "file_path", "hunk_index", F.col("group_id").alias("from_id"), F.concat(F.lit("pr-"), ((F.col("group_ord") + 3) % 10 + 1).cast("string")).alias("to_id"))
    assigned = hunks.select("change_id", "file_path", "hunk_index", "group_id")
    return edit.move_hunks(assigned, edits, assigned.select("change_id", "group_id").distinct(), assigned)[0]


@query(f"""with {A.HUNKS}, {A.PRS}, k as (select distinct change_id, group_id, group_ord from h)
select change_id, group_id, 'group ' || group_ord title, case when group_ord % 3 <> 0 then 'split/' || group_id else '' end branch_name, pr_number, upper(coalesce(live.state, 'open')) || case when coalesce(is_draft, false) then ' (draft)' else '' end state,
coalesce(case review_decision when 'CHANGES_REQUESTED' then 'Changes Requested' when 'REVIEW_REQUIRED' then 'Review Required' when 'APPROVED' then 'Approved' end, '') review from k left join prs using (change_id, group_id) left join live using (pr_number)""")
def q31_status(spark, sf_dir):
    prs, live = A.li_prs(spark, sf_dir)
    groups = A.li_hunks(spark, sf_dir).select("change_id", "group_id", "group_ord").distinct().withColumn("title", F.concat(F.lit("group "), F.col("group_ord").cast("string")))
    branches = groups.filter("group_ord % 3 <> 0").withColumn("branch_name", F.concat(F.lit("split/"), "group_id"))
    return status.plan_status(groups, branches, prs, live)


@query(f"""with recursive {A.HUNKS}, {A.EDGES}, {A.LEVELS}, {A.PRS},
o as (select v.change_id, v.group_id, v.level, pr_number, case when live.state is null then 'skip: state unknown' when live.state = 'MERGED' then 'merged' when live.state <> 'OPEN' then 'skip: ' || lower(live.state) when coalesce(is_draft, false) then 'skip: draft'
  when review_decision = 'CHANGES_REQUESTED' then 'skip: changes requested' when review_decision = 'REVIEW_REQUIRED' then 'skip: review required' else 'merge' end outcome from v join prs using (change_id, group_id) left join live using (pr_number)),
p as (select *, case when outcome = 'merge' and pr_number % 7 = 0 then 'failed' else outcome end as told from o), st as (select change_id, min(level) stop from p where told = 'failed' group by all)
select change_id, group_id, level, case when level > stop then 'not reached' else told end outcome from p left join st using (change_id)""")
def q32_merge_outcome(spark, sf_dir):
    prs, live = A.li_prs(spark, sf_dir)
    return status.merge_walk(A.li_groups(A.li_hunks(spark, sf_dir)), prs, live, prs.filter("pr_number % 7 = 0"))


@query("select user_id, arg_min(event_type, (ts, event_id)) event_type, min(ts) ts from events where event_type in ('error', 'purchase') and ts < timestamp '2024-01-20' group by all")
def q33_poll_terminal(spark, sf_dir):
    import datetime

    return status.first_terminal(A.table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", ["error", "purchase"], datetime.datetime(2024, 1, 20))


@query("select doc_id change_id, 'docs/' || doc_id || '.txt' file_path, true is_new, false is_renamed, len(string_split(coalesce(text, ''), chr(10)))::bigint added, 0::bigint removed, 1::bigint hunk_count from documents")
def q34_parse_diff(spark, sf_dir):
    files = diffs.files_of(diffs.parse_diffs(A.doc_diffs(spark, sf_dir)))
    return files.select("change_id", "file_path", "is_new", "is_renamed", *[F.col(c).cast("long").alias(c) for c in ("added", "removed", "hunk_count")])


@query("""with t as (select doc_id change_id, coalesce(text, '') x from documents), y as (select *, 'changed' || chr(10) || case when instr(x, chr(10)) > 0 then x[instr(x, chr(10)) + 1:] else '' end z from t)
select change_id, 'docs/' || change_id || '.txt' file_path, md5(case when z like '%' || chr(10) then z else z || chr(10) end) content_md5 from y""")
def q35_apply_hunks(spark, sf_dir):
    changes = A.doc_diffs(spark, sf_dir, edit=True)
    parsed = diffs.parse_diffs(changes)
    files, hunks = diffs.files_of(parsed), diffs.hunks_of(parsed)
    made = edit.materialize(hunks.select("change_id", F.lit("pr-1").alias("group_id"), "file_path", "hunk_index"), files, hunks, changes.select("change_id", "file_path", "content"))
    return made.select("change_id", "file_path", F.md5("content").alias("content_md5"))


@query(f"""with {A.HUNKS}, t as (select change_id, file_ord, file_path, '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || string_agg('[hunk_index=' || hunk_index || ']' || chr(10) || '+' || added || ' -' || removed || chr(10), chr(10) order by hunk_index) x from h group by change_id, file_ord, file_path),
y as (select change_id, string_agg(x, chr(10) order by file_ord) z from t group by change_id) select change_id, md5(z) text_md5, length(z) as length from y""")
def q36_labeled_diff(spark, sf_dir):
    text = F.concat(F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"), F.lit("\n"))
    hunks = A.li_hunks(spark, sf_dir).withColumn("hunk_text", text)
    files = stats.files_from_hunks(hunks).withColumns({"source_file": F.concat(F.lit("a/"), "file_path"), "target_file": F.concat(F.lit("b/"), "file_path")})
    return stats.labelled_diff(files, hunks).select("change_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("length"))


@query("""with recursive b as (select o_custkey change_id, row_number() over (partition by o_custkey order by o_orderkey) k, o_orderstatus <> 'P' pushed from orders),
u as (select change_id, k, k // 2 up from b where k > 1 union select u.change_id, u.k, u.up // 2 from u where u.up > 1)
select change_id, 'b' || k branch_name from b where not exists (select 1 from u join b x on x.change_id = u.change_id and x.k = u.up where u.change_id = b.change_id and u.k = b.k and not x.pushed)""")
def q37_base_pushed(spark, sf_dir):
    return graph.base_pushed(A.order_branches(spark, sf_dir))


@query()
def q62_exact_partition(spark, sf_dir):
    """Cheapest groups; of several equally cheap partitions any is right, so tests hold them against all set
    partitions, and q60 their costs against SQL."""
    units = A.order_units(spark, sf_dir)
    options = PlanOptions(max_loc=60, min_loc=10, priority="logical", partition_strategy="cp_sat")
    grouped = partition.exact_groups(units, options, keep=True)
    return grouped.groupBy("change_id", "group_ord").agg(F.count("*").alias("units"), F.sum("loc").alias("loc"), F.min("position").alias("anchor"))
