"""Declarations and their users: symbol edges, groups, affinity, split scores, seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import js_round


def symbol_edges(refs: DataFrame) -> DataFrame:
    """(src, dst, space, n) of references (src, dst, space type or value): both where both occur; n counts all."""
    g = refs.groupBy("src", "dst").agg(F.bool_or(F.col("space") == "type").alias("t"), F.bool_or(F.col("space") == "value").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.select("src", "dst", F.when(F.col("t") & F.col("v"), "both").when(F.col("t"), "type").otherwise("value").alias("space"), "n")


def keyed_edges(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, space, n) of references between groups of different files. files: (id, file)."""
    a, b = files.select(F.col("id").alias("src"), F.col("file").alias("fa")), files.select(F.col("id").alias("dst"), F.col("file").alias("fb"))
    return refs.join(a, "src").join(b, "dst").where("fa <> fb").groupBy("src", "dst", "space").agg(F.count(F.lit(1)).alias("n"))


def groups(declarations: DataFrame) -> DataFrame:
    """(file, name, ids): declarations of one name in one file, in order of their spans."""
    each = declarations.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("start", "id"))).alias("x"))
    return each.select("file", "name", F.transform("x", lambda s: s["id"]).alias("ids"))


def external_consumers(uses: DataFrame) -> DataFrame:
    """(group, path, affinity, n): counted references."""
    return uses.groupBy("group", "path", "affinity").agg(F.count(F.lit(1)).alias("n"))


def most_references(consumers: DataFrame) -> DataFrame:
    """One row for each (group, path): its greatest count."""
    return consumers.groupBy("group", "path").agg(F.max("n").alias("n"))


def split_candidates(consumers: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, consumers, dominant, concentration, inside, outside, score) of groups with consumers.

    score: round(1000 concentration) + 10 consumers - edges into and out of the group.
    """
    per = consumers.groupBy("group", "affinity").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("group")
    top = per.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "affinity"))}).where("r = 1")
    count = consumers.groupBy("group").agg(F.countDistinct("path").alias("consumers"))
    into, out = edges.groupBy(F.col("dst").alias("group")).agg(F.count(F.lit(1)).alias("inside")), edges.groupBy(F.col("src").alias("group")).agg(F.count(F.lit(1)).alias("outside"))
    j = count.join(top, "group").join(into, "group", "left").join(out, "group", "left").fillna(0, ["inside", "outside"])
    share = F.col("n") / F.col("total")
    return j.select("group", "consumers", F.col("affinity").alias("dominant"), share.alias("concentration"), "inside", "outside", (js_round(share * 1000) + 10 * F.col("consumers") - F.col("inside") - F.col("outside")).cast("long").alias("score"))


def seam_crossings(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """(src, dst, direction): edges with exactly one end among the moved (id): moved-to-retained or retained-to-moved."""
    a, b = moved.select(F.col("id").alias("src"), F.lit(True).alias("ma")), moved.select(F.col("id").alias("dst"), F.lit(True).alias("mb"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    ma, mb = F.coalesce("ma", F.lit(False)), F.coalesce("mb", F.lit(False))
    return j.where(ma != mb).select("src", "dst", F.when(ma, "moved-to-retained").otherwise("retained-to-moved").alias("direction"))


def shims(reexports: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(path, package, inbound): files that only re-export one package and are imported at least ``least`` times. reexports: (path, package), a row for each statement; null for any other statement."""
    only = reexports.groupBy("path").agg(F.min("package").alias("package"), F.countDistinct("package").alias("k"), F.count_if(F.col("package").isNull()).alias("other")).where("k = 1 and other = 0")
    into = edges.select("src", F.col("dst").alias("path")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("inbound"))
    return only.join(into, "path").where(F.col("inbound") >= least).select("path", "package", "inbound")


def type_only_refusals(flags: DataFrame) -> DataFrame:
    """(id, refusals): the codes of the boolean columns of flags that hold, in column order."""
    names = [c for c in flags.columns if c != "id"]
    return flags.select("id", F.array_compact(F.array(*[F.when(F.col(c), c.replace("_", "-")) for c in names])).alias("refusals"))
