"""Moves of selected files: bounded unions, cuts, retained code, evaluation reach, test partition, promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import selected
from ..session import cut
from . import graph


def select_files(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """nodes that a selector picks, repeated rows once; one that picks nothing, and picks from two applications, are errors. The counts of all selectors take one pass."""
    if not selectors:
        return nodes.limit(0)
    hits = [selected(F.col("path"), s) for s in selectors]
    found = nodes.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)], F.countDistinct(F.when(reduce(Column.__or__, hits), F.coalesce(F.col("application").cast("string"), F.lit("")))).alias("applications")).first()
    for i, s in enumerate(selectors):
        if not found[f"n{i}"]:
            raise ValueError(f"selector {s} matches nothing")
    if found["applications"] > 1:
        raise ValueError("selectors cross applications")
    return nodes.where(reduce(Column.__or__, hits)).dropDuplicates()


def bounded_union(comps: DataFrame, edges: DataFrame, chosen: DataFrame, composition: DataFrame) -> DataFrame:
    """(id, role) of chosen (id): selected, absorbed (a peer in the same component), retained (its component holds a composition root), dependency (needed directly, not selected)."""
    sel = chosen.select("id").distinct().join(comps, "id")
    held = comps.join(composition.select("id").distinct(), "id", "left_semi").select("comp").distinct()
    whole = comps.join(sel.select("comp").distinct(), "comp", "left_semi")
    keeps = whole.join(held, "comp", "left_semi").select("id", F.lit("retained").alias("role"))
    moves = whole.join(held, "comp", "left_anti").join(sel.select("id", F.lit(True).alias("s")), "id", "left")
    moving = moves.select("id", F.when(F.col("s"), "selected").otherwise("absorbed").alias("role"))
    gone = moving.select("id")
    deps = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(gone, "id", "left_anti").join(keeps, "id", "left_anti")
    return moving.union(keeps).union(deps.select("id", F.lit("dependency")))


def boundary_cuts(edges: DataFrame, moved: DataFrame, composition: Column, retained: Column) -> DataFrame:
    """(src, dst, reason) of edges from moved files out: composition before retained before outside; the conditions are on dst."""
    m = moved.select("id")
    out = edges.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return out.select("src", "dst", F.when(composition, "composition").when(retained, "retained").otherwise("outside").alias("reason"))


def retained_blockers(files: DataFrame, edges: DataFrame, retained: DataFrame) -> DataFrame:
    """(cand, target, source): targets in retained code that a closure needs, with the least file that does. files: (cand, path)."""
    need = files.withColumnRenamed("path", "src").join(edges, "src").join(retained.select(F.col("path").alias("dst")), "dst", "left_semi")
    return need.groupBy("cand", F.col("dst").alias("target")).agg(F.min("src").alias("source"))


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): the starts and all that edges lead to; a breadth-first fixpoint whose rounds are written tables."""
    e = cut(graph.simple(edges))
    seen = front = cut(starts.select("id").distinct())
    while True:
        front = cut(e.join(front, e["src"] == front["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not front.limit(1).collect():
            return seen
        seen = cut(seen.union(front))


def evaluation_reach(edges: DataFrame, starts: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """(id): what is evaluated when the starts are: edges that aren't type-only, with rewrites (src, dst, to) leading elsewhere."""
    e = edges.where("not type_only").select("src", "dst")
    if rewrites is not None:
        e = e.join(rewrites, ["src", "dst"], "left").select("src", F.coalesce("to", "dst").alias("dst"))
    return reach(e, starts)


def travelling_tests(tests: DataFrame, edges: DataFrame, moving: DataFrame) -> DataFrame:
    """(id): tests that can move: none is imported by a file that stays, another test that stays included.

    A test that stays makes the tests it imports stay, until nothing changes: what stays is what
    the staying files reach among tests.
    """
    t = tests.select("id")
    goes = moving.select("id").union(t)
    e = cut(edges.join(t.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    held = e.join(goes.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    inner = e.join(t.withColumnRenamed("id", "src"), "src", "left_semi")
    return t.join(reach(inner, held), "id", "left_anti")


def type_only_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): reach over type-only edges; a value edge from what is reached is an error."""
    found = reach(edges.where("type_only"), starts)
    bad = edges.where("not type_only").join(found.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst").orderBy("src", "dst").limit(1).collect()
    if bad:
        raise ValueError(f"value edge {bad[0]['src']} -> {bad[0]['dst']} in a type-only closure")
    return found


def promotion_cut(edges: DataFrame, comps: DataFrame, node) -> DataFrame:
    """(id, comp) of the component that holds ``node``, after the node is taken out."""
    mine = comps.join(comps.where(F.col("id") == node).select("comp"), "comp", "left_semi").select("id").where(F.col("id") != node)
    inner = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").join(mine.withColumnRenamed("id", "dst"), "dst", "left_semi")
    after = graph.strong_components(inner)
    return mine.join(after, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def spanning_forest(weighted: DataFrame) -> DataFrame:
    """(a, b, weight): the heaviest spanning forest of (a, b, weight), ties to the least ends; edges from a node to itself don't count.

    In rounds: every component takes its best edge to another one, what is so joined becomes one
    component, and of the edges between two components only the best stays. The order of edges is
    total, so there is one such forest; components at least halve, so rounds grow with the logarithm of the nodes.
    """
    e = cut(weighted.where("a <> b").select("a", "b", "weight", F.col("a").alias("x"), F.col("b").alias("y")))
    out = None
    key = F.struct((-F.col("weight")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"))
    while not e.isEmpty():
        both = e.select(F.col("x").alias("c"), key.alias("k"), F.col("y").alias("o")).union(e.select("y", key, "x"))
        best = cut(both.groupBy("c").agg(F.min(F.struct("k", "o")).alias("m")).select("c", "m.k", "m.o"))
        taken = best.select("k.a", "k.b", (-F.col("k.w")).alias("weight")).distinct()
        out = taken if out is None else out.union(taken)
        label = cut(clusters(best.select(F.col("c").alias("src"), F.col("o").alias("dst"))))
        for end in ("x", "y"):
            e = e.join(label.select(F.col("id").alias(end), F.col("cluster").alias("to")), end).drop(end).withColumnRenamed("to", end)
        between = e.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(key).alias("k"))
        e = cut(between.select("k.a", "k.b", (-F.col("k.w")).alias("weight"), "x", "y"))
    return (out if out is not None else weighted.limit(0)).select("a", "b", F.col("weight").cast(weighted.schema["weight"].dataType).alias("weight"))


def clusters(edges: DataFrame, limit: int = graph.KERNEL_EDGES) -> DataFrame:
    """(id, cluster): connected components of undirected edges (src, dst), by the least id. Up to ``limit`` edges a kernel takes, beyond it in rounds of stars."""
    both = cut(graph.simple(edges))
    if 2 * both.count() <= limit:
        return graph.strong_components(both.union(both.select("dst", "src")), limit).select("id", F.col("comp").alias("cluster"))
    return graph.nodes(both).join(_stars(both), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _stars(edges: DataFrame) -> DataFrame:
    """(id, cluster) of all nodes but the least of each connected component.

    Each round hangs a node's greater neighbours, then its lesser ones and itself, on the least of all of them; edges never
    become more, and every component ends as a star around its least node, after rounds in the logarithm of its size.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(least, "u").where("v <> m").select("v", "m").union(least).toDF("u", "v").distinct())
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
        e = new


def cohesion_clusters(uses: DataFrame) -> DataFrame:
    """(owner, id, cluster): methods of one owner that share a field, directly or by others; fields that max(3, 40 %) of its methods or more use don't count.

    uses: (owner, id, field). A field links its methods to the least of them, not all to all.
    """
    u = uses.select("owner", "id", "field").distinct()
    n = u.groupBy("owner").agg(F.countDistinct("id").alias("n"))
    rare = u.join(u.groupBy("owner", "field").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first")), ["owner", "field"]).join(n, "owner").where(F.col("k") < F.greatest(F.lit(3), F.ceil(F.col("n") * 0.4)))
    name = lambda c: F.concat_ws("\u0001", "owner", c)
    found = clusters(rare.select(name("id").alias("src"), name("first").alias("dst")))
    part = F.split("id", "\u0001")
    linked = found.select(F.get(part, 0).alias("owner"), F.get(part, 1).alias("id"), F.get(F.split("cluster", "\u0001"), 1).alias("cluster"))
    every = u.select(F.col("owner").cast("string").alias("owner"), F.col("id").cast("string").alias("id")).distinct()
    return every.join(linked, ["owner", "id"], "left").select("owner", "id", F.coalesce("cluster", "id").alias("cluster"))
