"""Conflicts between plans, and their waves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import KERNEL_EDGES
from ..session import cut

#: Roles of edits that can be put together if their keys are disjoint; fixed values.
STRUCTURED = ("consumer-source", "consumer-manifest", "consumer-project-references", "workspace-registry", "task-registry", "lockfile-importer")


def accesses(ops: DataFrame) -> DataFrame:
    """(plan_id, path, scope, mode, role, keys) of operations (plan_id, kind, source, target, path, keys).

    A move reads and removes its source and writes its target; a delete-tree covers a folder; a
    generated file's sources are read as trees; edits of a kind in STRUCTURED write keys of a file in that role.
    """
    a = lambda path, scope, mode, role: F.struct(F.col(path).alias("path"), F.lit(scope).alias("scope"), F.lit(mode).alias("mode"), F.lit(role).alias("role"), F.col("keys").alias("keys"))
    kind = F.col("kind")
    each = (
        F.when(kind.isin("move", "move-asset"), F.array(a("source", "exact", "write", "source"), a("target", "exact", "write", "target")))
        .when(kind.isin("rewrite-import", "rewrite-path"), F.array(a("path", "exact", "write", "rewrite")))
        .when(kind == "write", F.array(a("path", "exact", "write", "content")))
        .when(kind == "delete", F.array(a("path", "exact", "write", "removal")))
        .when(kind == "delete-tree", F.array(a("path", "tree", "write", "removal")))
        .when(kind.isin(*STRUCTURED), F.array(F.struct(F.col("path").alias("path"), F.lit("exact").alias("scope"), F.lit("write").alias("mode"), kind.alias("role"), F.col("keys").alias("keys"))))
        .when(kind == "generate", F.array(a("source", "tree", "read", "generator"), a("target", "exact", "write", "generated")))
        .otherwise(F.array(a("path", "exact", "read", "reference")))
    )
    return ops.select("plan_id", F.inline(each))


def _ancestors(path: Column) -> Column:
    """The path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def conflicts(acc: DataFrame) -> DataFrame:
    """(l, r, path, mergeable): plans l < r whose accesses meet at a path, one of them writing.

    Pairs of plans are what is asked for, so a path that n plans write gives n (n - 1) / 2 rows;
    build.conflict_report says the same by path, in as many rows as there are paths. An exact access meets a tree at or above it, and trees meet when one holds the other: each
    access is keyed by its ancestors, so the prefix join is an equality join. Two edits of one
    structured role with disjoint keys can merge; a path is mergeable if all its meetings are.
    """
    one = acc.where("scope = 'exact'").select("plan_id", "path", "mode", "role", "keys").distinct()
    tree = acc.where("scope = 'tree'").select("plan_id", "path", "mode", "role", "keys").distinct()
    # Only ancestors as deep as some tree are asked for, so a path is not shuffled once for each of its folders.
    depth = tree.select(F.size(F.split("path", "/")).alias("d")).distinct().agg(F.collect_set("d").alias("depths"))
    deep = lambda d: d.crossJoin(F.broadcast(depth)).withColumn("above", F.filter(_ancestors(F.col("path")), lambda x: F.array_contains("depths", F.size(F.split(x, "/")))))
    one, tree = deep(one), deep(tree)
    side = lambda d, s, key: d.select(key.alias("at"), *[F.col(c).alias(f"{c}_{s}") for c in ("plan_id", "path", "mode", "role", "keys")])
    here = F.col("path")
    exact = side(one, "l", here).join(side(one, "r", here), "at")
    under_l = side(one, "l", F.explode("above")).join(side(tree, "r", here), "at")
    under_r = side(tree, "l", here).join(side(one, "r", F.explode("above")), "at")
    trees_l = side(tree, "l", F.explode("above")).join(side(tree, "r", here), "at")
    trees_r = side(tree, "l", here).join(side(tree, "r", F.explode("above")), "at").where("path_l <> path_r")
    cols = exact.columns
    both = exact
    for x in (under_l, under_r, trees_l, trees_r):
        both = both.union(x.select(*cols))
    both = both.where("plan_id_l < plan_id_r and (mode_l = 'write' or mode_r = 'write')")
    longer = F.when(F.length("path_l") >= F.length("path_r"), F.col("path_l")).otherwise(F.col("path_r"))
    keyed = (F.size("keys_l") > 0) & (F.size("keys_r") > 0) & ~F.arrays_overlap("keys_l", "keys_r")
    merge = F.col("role_l").isin(*STRUCTURED) & (F.col("role_l") == F.col("role_r")) & F.coalesce(keyed, F.lit(False))
    return both.groupBy(F.col("plan_id_l").alias("l"), F.col("plan_id_r").alias("r"), longer.alias("path")).agg(F.bool_and(merge).alias("mergeable"))


def _first_fit(edges: pd.DataFrame) -> dict:
    """Waves of the plans of edges (a, b; ka before kb), each the first that none of its earlier neighbours has."""
    order = {**dict(zip(edges["a"], edges["ka"], strict=True)), **dict(zip(edges["b"], edges["kb"], strict=True))}
    near: dict = {}
    for a, b in zip(edges["a"], edges["b"], strict=True):
        near.setdefault(b, []).append(a)
    wave: dict = {}
    for plan in sorted(order, key=order.__getitem__):
        used = {wave[x] for x in near.get(plan, ())}
        wave[plan] = next(i for i in range(len(used) + 1) if i not in used)
    return wave


def waves(plans: DataFrame, hard: DataFrame, limit: int = KERNEL_EDGES) -> DataFrame:
    """(plan_id, wave): in order of priority (greatest first), then id, each plan takes the first wave where it conflicts with none. hard: (l, r).

    Up to ``limit`` conflicts a linear pass over them runs on the driver. Beyond, in rounds: a
    plan is placed when all earlier plans that it conflicts with are, in the least wave that they
    left free; each round is a few joins, and there are at least as many rounds as waves.
    """
    key = F.struct((-F.col("priority")).alias("p"), F.col("plan_id").alias("i"))
    place = plans.select("plan_id", key.alias("k"))
    side = lambda n: place.select(F.col("plan_id").alias(n), F.col("k").alias(f"k{n}"))
    meet = hard.select("l", "r").where("l <> r").distinct().join(side("l"), "l").join(side("r"), "r")
    first = F.col("kl") < F.col("kr")
    pick = lambda yes, no, n: F.when(first, F.col(yes)).otherwise(F.col(no)).alias(n)
    edges = cut(meet.select(pick("l", "r", "a"), pick("r", "l", "b"), pick("kl", "kr", "ka"), pick("kr", "kl", "kb")).distinct())
    kind = plans.schema["plan_id"].dataType.simpleString()
    if edges.limit(limit + 1).count() <= limit:
        flat = edges.select("a", "b", F.col("ka.p").alias("pa"), F.col("kb.p").alias("pb")).toPandas()
        flat["ka"], flat["kb"] = list(zip(flat["pa"], flat["a"], strict=True)), list(zip(flat["pb"], flat["b"], strict=True))
        found = plans.sparkSession.createDataFrame(sorted(_first_fit(flat).items()), f"plan_id {kind}, wave int")
        return plans.select("plan_id").join(found, "plan_id", "left").select("plan_id", F.coalesce("wave", F.lit(0)).alias("wave"))
    left, edges = cut(plans.select("plan_id").distinct()), edges.select("a", "b")
    seen, done = cut(edges.select(F.col("b").alias("plan_id"), F.lit(0).alias("used")).limit(0)), None
    while not left.isEmpty():
        ready = left.join(edges.select(F.col("b").alias("plan_id")), "plan_id", "left_anti")
        used = seen.groupBy("plan_id").agg(F.collect_set("used").alias("u"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("u")), "u"))
        now = cut(ready.join(used, "plan_id", "left").select("plan_id", F.when(F.col("u").isNull(), 0).otherwise(free).cast("int").alias("wave")))
        done = now if done is None else done.union(now)
        left = cut(left.join(now, "plan_id", "left_anti"))
        given = edges.join(now.select(F.col("plan_id").alias("a"), "wave"), "a").select(F.col("b").alias("plan_id"), F.col("wave").alias("used"))
        seen = cut(seen.join(now.select("plan_id"), "plan_id", "left_anti").union(given).distinct())
        edges = cut(edges.join(now.select(F.col("plan_id").alias("a")), "a", "left_anti"))
    return done if done is not None else plans.select("plan_id", F.lit(0).alias("wave")).limit(0)
