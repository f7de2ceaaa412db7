"""Closures of many starting sets at once, each under its key, with what refuses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rounds after which the tables of a closure are written as one.
COMPACT = 16


def keyed_reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(key, id): for each key its starts (key, id) and all that edges (src, dst) lead to.

    Semi-naive: a round joins only what the round before has found, under its key, and
    there are as many rounds as the longest of the shortest ways. Keys without an edge keep their starts.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = front = cut(starts.select("key", "id").distinct())
    rounds = 0
    while not front.isEmpty():
        hop = front.join(e, F.col("id") == F.col("src")).select("key", F.col("dst").alias("id")).distinct()
        front = cut(hop.join(seen, ["key", "id"], "left_anti"))
        rounds += 1
        seen = seen.union(front) if rounds % COMPACT else cut(seen.union(front))
    return seen


def type_only_closures(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: key, id; refused: key, src, dst) of preparations that may take along only what is needed as a type.

    edges: (src, dst, type_only). A preparation grows round by round along type-only edges; a value
    edge from what it holds refuses it: the least one of the first round that meets any. Refused
    ones leave the later rounds, and have no members.
    """
    e = cut(edges.groupBy("src", "dst").agg(F.bool_and("type_only").alias("type_only")))
    seen = front = cut(starts.select("key", "id").distinct())
    refused, rounds = None, 0
    while not front.isEmpty():
        hop = cut(front.join(e, F.col("id") == F.col("src")).select("key", "src", "dst", "type_only"))
        bad = cut(hop.where("NOT type_only").groupBy("key").agg(F.min(F.struct("src", "dst")).alias("b")).select("key", "b.src", "b.dst"))
        refused = bad if refused is None else refused.union(bad)
        grown = hop.where("type_only").select("key", F.col("dst").alias("id")).distinct()
        front = cut(grown.join(bad.select("key"), "key", "left_anti").join(seen, ["key", "id"], "left_anti"))
        rounds += 1
        seen = seen.union(front) if rounds % COMPACT else cut(seen.union(front))
    if refused is None:
        refused = e.select(F.lit(None).cast(starts.schema["key"].dataType).alias("key"), "src", "dst").limit(0)
    refused = cut(refused)
    return seen.join(refused.select("key"), "key", "left_anti"), refused


def value_splits(declarations: DataFrame, edges: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts: key, verdict, members, offenders; members: key, id) of exported values that leave their file with all they need of it.

    declarations: (file, id, name, exported, space), id unique; edges: (src, dst) between declarations, those
    between files are left out; splits: (key, file, name). Verdicts, the first that holds: ``unknown`` (no such
    declaration), ``not-exported-value``, ``retained`` (a declaration that stays needs one that would go; offenders are the names
    of those), ``splits``. Members are those of the closure, offenders an array, empty unless retained.
    """
    d = declarations.select("file", "id", "name", "exported", "space")
    asked = splits.select("key", "file", "name").join(d.groupBy("file", "name").agg(F.min("id").alias("id"), F.bool_or("exported").alias("exported"), F.bool_or(F.col("space").isin("value", "both")).alias("value")), ["file", "name"], "left")
    place = d.select("id", "file")
    inner = edges.select("src", "dst").distinct().join(place.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    inner = cut(inner.where("a = b AND src <> dst").select("src", "dst"))
    able = asked.where("id IS NOT NULL AND exported AND value")
    moved = cut(keyed_reach(inner, able.select("key", "id")))
    into = moved.join(inner, F.col("id") == F.col("dst")).select("key", "src", "dst")
    kept = into.join(moved.select("key", F.col("id").alias("src")), ["key", "src"], "left_anti")
    names = kept.join(d.select(F.col("id").alias("dst"), "name"), "dst").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("offenders"))
    sizes = moved.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    verdict = F.when(F.col("id").isNull(), "unknown").when(~(F.col("exported") & F.col("value")), "not-exported-value").when(F.col("offenders").isNotNull(), "retained").otherwise("splits")
    out = asked.join(sizes, "key", "left").join(names, "key", "left")
    return out.select("key", verdict.alias("verdict"), F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders")), moved
