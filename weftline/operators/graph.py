"""The graph of dependencies between groups. Algorithms over a change's graph run in kernels; what is a
join or a window is one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import kernels
from .kernels import Graph


def assigned(groups: DataFrame) -> DataFrame:
    """Listed hunks of groups: change_id, group_id, file_path, hunk_index."""
    rows = groups.select("change_id", "group_id", F.explode("assignments").alias("a"))
    return rows.select("change_id", "group_id", "a.file_path", F.explode("a.hunk_indices").alias("hunk_index"))


def edges_of(groups: DataFrame) -> DataFrame:
    """group_id depends on parent_id."""
    return groups.select("change_id", "group_id", F.explode("depends_on").alias("parent_id"))


def unknown_dependencies(groups: DataFrame) -> DataFrame:
    known = groups.select("change_id", F.col("group_id").alias("parent_id"))
    return edges_of(groups).join(known, ["change_id", "parent_id"], "left_anti")


def file_order_edges(assigned: DataFrame) -> DataFrame:
    """In each file the groups follow each other by their first hunk, then by id: each depends on the one before."""
    firsts = assigned.groupBy("change_id", "file_path", "group_id").agg(F.coalesce(F.min("hunk_index"), F.lit(0)).alias("first"))
    before = F.lag("group_id").over(W.Window.partitionBy("change_id", "file_path").orderBy("first", "group_id"))
    return firsts.select("change_id", "group_id", before.alias("parent_id")).filter("parent_id is not null").distinct()


def _over(groups: DataFrame, run: Callable[[Graph], Iterable[tuple]], schema: str) -> DataFrame:
    """groups: change_id, group_id, depends_on, and group_ord where order matters."""
    order = F.col("group_ord") if "group_ord" in groups.columns else F.lit(0)
    rows = groups.select("change_id", order.alias("group_ord"), "group_id", "depends_on")
    return kernels.by_change(rows, ["group_ord", "group_id", "depends_on"], lambda r: run(Graph({x["group_id"]: x["depends_on"] or [] for x in r})), schema)


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their parents from an edge table as depends_on."""
    parents = edges.groupBy("change_id", "group_id").agg(F.array_sort(F.collect_set("parent_id")).alias("depends_on"))
    kind = dict(edges.dtypes)["parent_id"]
    return nodes.join(parents, ["change_id", "group_id"], "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast(f"array<{kind}>")))


def _id(groups: DataFrame) -> str:
    return dict(groups.dtypes)["group_id"]


def reduce_dependencies(groups: DataFrame) -> DataFrame:
    return _over(groups, lambda g: g.reduced().items(), f"group_id {_id(groups)}, depends_on array<{_id(groups)}>")


def dependencies(assigned: DataFrame, groups: DataFrame) -> DataFrame:
    """Given dependencies and those by file order, without what another way implies."""
    edges = edges_of(groups).unionByName(file_order_edges(assigned)).distinct()
    return reduce_dependencies(with_edges(groups.select("change_id", "group_id"), edges))


def levels(groups: DataFrame) -> DataFrame:
    """The batch of each group: the longest way from a root; null on and behind a cycle."""
    def run(g: Graph):
        found = g.levels()
        return [(n, found.get(n)) for n in g.parents]

    return _over(groups, run, f"group_id {_id(groups)}, level int")


def cycles(groups: DataFrame) -> DataFrame:
    return levels(groups).filter("level is null").select("change_id", "group_id")


def topological_order(groups: DataFrame) -> DataFrame:
    return _over(groups, lambda g: [(n, i) for i, n in enumerate(g.order())], f"group_id {_id(groups)}, place int")


def places(groups: Column) -> Column:
    """groups: of each change an array of structs with group_id and depends_on, in order; the place of each, null on and behind cycles."""
    @F.arrow_udf("array<int>")
    def run(groups: pa.Array) -> pa.Array:
        out = []
        for rows in kernels.values(groups):
            place = {n: i for i, n in enumerate(Graph({r["group_id"]: r["depends_on"] or [] for r in rows}).order())}
            out.append([place.get(r["group_id"]) for r in rows])
        return pa.array(out, pa.list_(pa.int32()))

    return run(groups)


def batches(groups: DataFrame) -> DataFrame:
    ids = F.array_sort(F.collect_list("group_id"))
    return levels(groups).filter("level is not null").groupBy("change_id", "level").agg(ids.alias("ready"))


def depth_and_width(groups: DataFrame) -> DataFrame:
    sizes = levels(groups).filter("level is not null").groupBy("change_id", "level").agg(F.count("*").alias("n"))
    return sizes.groupBy("change_id").agg((F.max("level") + 1).alias("dag_depth"), F.max("n").alias("dag_width"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents and children of each group; whether it is a root, a leaf, a merge."""
    up = edges.groupBy("change_id", "group_id").agg(F.count("*").alias("parents"))
    down = edges.groupBy("change_id", F.col("parent_id").alias("group_id")).agg(F.count("*").alias("children"))
    out = nodes.select("change_id", "group_id").join(up, ["change_id", "group_id"], "left").join(down, ["change_id", "group_id"], "left").na.fill(0, ["parents", "children"])
    return out.withColumns({"is_root": F.col("parents") == 0, "is_leaf": F.col("children") == 0, "is_merge": F.col("parents") > 1})


def closure(groups: DataFrame) -> DataFrame:
    """group_id, ancestor_id for all ancestors."""
    return _over(groups, lambda g: [(n, a) for n in g.parents for a in sorted(g.ancestors(n))], f"group_id {_id(groups)}, ancestor_id {_id(groups)}")


def ancestors(groups: DataFrame) -> DataFrame:
    """change_id, ancestors: a row for each change, from each group that has any to all its ancestors."""
    kind = _id(groups)
    return _over(groups, lambda g: [([(n, up) for n in g.parents if (up := sorted(g.ancestors(n)))],)], f"ancestors map<{kind}, array<{kind}>>")


def unrelated(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (change_id, a, b) of which neither depends on the other, by however many steps. Changes without
    a pair aren't looked at, and no closure is listed: each pair asks for one bit."""
    asked = pairs.groupBy("change_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("pairs"))
    nodes = groups.select("change_id", "group_id", "depends_on").join(asked.select("change_id"), "change_id", "left_semi")
    nothing = lambda c: F.lit(None).cast(nodes.schema[c].dataType).alias(c)
    rows = nodes.withColumn("pairs", F.lit(None).cast(asked.schema["pairs"].dataType)).unionByName(asked.select("change_id", nothing("group_id"), nothing("depends_on"), "pairs"))

    def run(found: list[dict]) -> Iterable[tuple]:
        g = Graph({r["group_id"]: r["depends_on"] or [] for r in found if r["group_id"] is not None})
        g.reach()
        for a, b in ((p["a"], p["b"]) for r in found for p in r["pairs"] or []):
            if a not in g.parents or b not in g.parents or not (g.reaches(a, b) or g.reaches(b, a)):
                yield a, b

    return kernels.by_change(rows, ["group_id", "depends_on", "pairs"], run, f"a {_id(groups)}, b {_id(groups)}")


def linear_chains(groups: DataFrame, least: int = 1) -> DataFrame:
    """chain, group_ids: runs without a fork or merge, of `least` groups or more; 2 for those worth linking."""
    kind = _id(groups)
    return _over(groups, lambda g: [(i, c) for i, c in enumerate(g.chains()) if len(c) >= least], f"chain int, group_ids array<{kind}>")


def chain_links(groups: DataFrame, prs: DataFrame) -> DataFrame:
    """Pull request numbers of chains of two or more, in order."""
    rows = linear_chains(groups, 2).select("change_id", "chain", F.posexplode("group_ids").alias("at", "group_id"))
    found = rows.join(prs.select("change_id", "group_id", "pr_number"), ["change_id", "group_id"])
    return found.groupBy("change_id", "chain").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "pr_number"))), lambda x: x["pr_number"]).alias("pr_numbers"))


def rendered(groups: DataFrame, markdown: bool = False) -> DataFrame:
    """The tree as text: one for the change, or in Markdown one for each group with it marked."""
    if markdown:
        return _over(groups, lambda g: [(n, "\n".join(g.tree(n, True))) for n in g.parents], f"group_id {_id(groups)}, tree string")
    return _over(groups, lambda g: [("\n".join(g.tree()),)], "tree string")


def base_chain(branches: DataFrame) -> DataFrame:
    """For each branch all branches that it stands on, by way of base_branch."""
    rows = branches.select("change_id", F.col("branch_name").alias("group_id"), F.array("base_branch").alias("depends_on"))
    return closure(rows).select("change_id", F.col("group_id").alias("branch_name"), F.col("ancestor_id").alias("base_name"))


def _bases_free(base: dict, pushed: dict) -> dict:
    """Of each branch whether all branches below it are pushed. base: the branch under each; others than these don't count."""
    out: dict = {}
    for n in base:
        way, at = {n: None} if n not in out else {}, base[n]
        while way and at in base and at not in out and at not in way:
            way[at], at = None, base[at]
        if at in way:  # on or behind a loop each goes the whole way, past itself
            for x in way:
                seen, y = {x}, base[x]
                while y in base and y not in seen and pushed[y]:
                    seen.add(y)
                    y = base[y]
                out[x] = y not in base or y in seen
            continue
        free = at not in base or pushed[at] and out.get(at, True)
        for x in reversed(way):
            out[x] = free
            free = free and pushed[x]
    return out


def bases_free(branches: Column) -> Column:
    """branches: of each change an array of structs with branch_name, base_branch, pushed; whether all bases of each are pushed."""
    @F.arrow_udf("array<boolean>")
    def run(branches: pa.Array) -> pa.Array:
        out = []
        for rows in kernels.values(branches):
            free = _bases_free({r["branch_name"]: r["base_branch"] for r in rows}, {r["branch_name"]: r["pushed"] for r in rows})
            out.append([free[r["branch_name"]] for r in rows])
        return pa.array(out, pa.list_(pa.bool_()))

    return run(branches)


def base_pushed(branches: DataFrame) -> DataFrame:
    """Branches (change_id, branch_name, base_branch, pushed) whose own bases are all pushed. They move once, by change."""
    row = F.struct("branch_name", "base_branch", F.coalesce("pushed", F.lit(True)).alias("pushed"))
    packed = branches.groupBy("change_id").agg(F.collect_list(row).alias("rows")).withColumn("free", bases_free(F.col("rows")))
    rows = packed.select("change_id", F.explode(F.arrays_zip(F.col("rows").alias("r"), F.col("free").alias("f"))).alias("x"))
    return rows.filter(F.col("x.f") | F.col("change_id").isNull()).select("change_id", "x.r.branch_name")
