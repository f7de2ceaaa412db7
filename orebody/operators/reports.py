"""Roll-ups of a graph: nodes(path, zone, application, owner, domain, line_count, has_exports), edges(src, dst, kind, type_only, dynamic), comps(id, comp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import js_round
from ..session import cut, grows

ZONES = ("application", "package", "repo", "external")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(zone, nodes, edges): nodes of each of the four zones, zero-filled, beside the number of all edges."""
    zones = nodes.sparkSession.createDataFrame([(z,) for z in ZONES], "zone string")
    counted = nodes.groupBy("zone").agg(F.count(F.lit(1)).alias("nodes"))
    total = edges.agg(F.count(F.lit(1)).alias("edges"))
    return zones.join(counted, "zone", "left").select("zone", F.coalesce("nodes", F.lit(0)).alias("nodes")).crossJoin(F.broadcast(total))


# Base names that make a contract, and parts of names that make a policy.
CONTRACT = r"^(?:schemas?|models?|types?|contracts?|protocol)$"
POLICY = r"(?i)(?:helper|rule|policy|validation|normalize|format|transform|calculate|compute)"


def component_kinds(files: DataFrame, comps: DataFrame, composition: DataFrame, externals: DataFrame, framework: list[str], unsourced: DataFrame) -> DataFrame:
    """(comp, archetype, flags) of each component, by the names of its files and what they use.

    files: (path, file); composition: (path) of files that compose the application; externals: (path, package); framework: the packages that couple code
    to a framework; unsourced: (path) of generated files whose source is gone. Counts per component, so no list of its files is made.
    """
    mark = lambda d, n: d.select("path").distinct().withColumn(n, F.lit(True))
    base = F.substring_index("file", "/", -1)
    rows = comps.select(F.col("id").alias("path"), "comp").join(files.select("path", base.alias("base")), "path")
    for d, n in ((composition, "composes"), (externals.where(F.col("package").isin(*framework)), "coupled"), (unsourced, "gone")):
        rows = rows.join(mark(d, n), "path", "left")
    name = F.regexp_replace("base", r"\.[^.]+$", "")
    per = rows.groupBy("comp").agg(
        F.bool_and(name.rlike(CONTRACT)).alias("contract"), F.bool_or(name.rlike(POLICY)).alias("policy"), F.bool_or(F.col("base").startswith("index.")).alias("barrel"),
        *[(F.count(n) > 0).alias(n) for n in ("composes", "coupled", "gone")],
    )
    kind = F.when(F.col("contract"), "contract").when(F.col("composes"), "composition").when(F.col("coupled"), "runtime-adapter-or-ui").when(F.col("policy"), "policy-candidate").otherwise("module-candidate")
    flags = [("composition-or-route", F.col("composes")), ("barrel", F.col("barrel")), ("framework-coupled", F.col("coupled")), ("composition-root", kind == "composition"), ("generated-source-missing", F.col("gone"))]
    return per.select("comp", kind.alias("archetype"), F.array_compact(F.array(*[F.when(rule, n) for n, rule in flags])).alias("flags"))


def component_report(nodes: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """A row for each component: files, lines, distinct domains and owners, whether cyclic, edges out of and into it, type-only edges out."""
    own = nodes.join(comps.withColumnRenamed("id", "path"), "path")
    base = own.groupBy("comp").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("owner")).alias("owners"), F.count_if("has_exports").alias("exporting")
    )
    ends = edges.join(comps.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(comps.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst")
    own_edge = ends.where("src = dst").select(F.col("a").alias("comp"), F.lit(True).alias("self")).distinct()
    out = ends.where("a <> b").groupBy(F.col("a").alias("comp")).agg(F.count(F.lit(1)).alias("edges_out"), F.count_if("type_only").alias("type_only_out"))
    into = ends.where("a <> b").groupBy(F.col("b").alias("comp")).agg(F.count(F.lit(1)).alias("edges_in"))
    joined = base.join(out, "comp", "left").join(into, "comp", "left").join(own_edge, "comp", "left")
    return joined.select(
        "comp", "files", "lines", "domains", "owners", "exporting",
        ((F.col("files") > 1) | F.coalesce("self", F.lit(False))).alias("cyclic"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges_out", "type_only_out", "edges_in")],
    )


def component_id(members: Column) -> Column:
    """A stable id: the digest of the sorted members."""
    return F.sha2(F.array_join(F.array_sort(members), "\n"), 256)


def closed_files(nodes: DataFrame, comps: DataFrame, reach: DataFrame) -> DataFrame:
    """(path): files whose component and all it reaches lie in one domain. reach: (src, dst), the edges between components, or their closure.

    No pairs of the closure are made: a component keeps the least and the greatest domain that it reaches, and tells those that point to it when it turns from none
    to one or from one to several. That happens twice at most, so all rounds together send each edge twice at most.
    """
    domains = nodes.join(grows(comps.withColumnRenamed("id", "path")), "path").select("comp", "domain").distinct()
    own = domains.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("domain").alias("lo"), F.max("domain").alias("hi"))
    state = cut(comps.select("comp").distinct().join(grows(own), "comp", "left").select("comp", "n", F.col("lo").alias("own"), "lo", "hi"))
    ways, told = cut(reach.select("src", "dst").distinct()), state.where("lo IS NOT NULL")
    while True:
        sent = ways.join(grows(told.select(F.col("comp").alias("dst"), F.col("lo").alias("a"), F.col("hi").alias("b"))), "dst").groupBy(F.col("src").alias("comp")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
        told = state.where("lo IS NULL OR lo = hi").join(grows(sent), "comp").where("lo IS NULL OR a < lo OR b > hi").select("comp", "n", "own", F.least("lo", "a").alias("lo"), F.greatest("hi", "b").alias("hi"))
        told = cut(told)
        if told.isEmpty():
            break
        state = cut(state.join(grows(told.select("comp")), "comp", "left_anti").union(told))
    closed = state.where("n = 1 AND (own IS NULL OR lo = hi)")
    return comps.join(grows(closed), "comp", "left_semi").select(F.col("id").alias("path"))


def domain_report(nodes: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """A row for each domain: files, lines, closed files, lines and percent (one decimal, half up), domains it needs and that need it, edges out, blocked files."""
    marked = nodes.join(grows(closed.select("path", F.lit(True).alias("closed"))), "path", "left")
    base = marked.groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.count_if("closed").alias("closed_files"), F.coalesce(F.sum(F.when(F.col("closed"), F.col("line_count"))), F.lit(0)).alias("closed_lines"))
    of = nodes.select("path", "domain")
    cross = edges.join(grows(of.select(F.col("path").alias("src"), F.col("domain").alias("a"))), "src").join(grows(of.select(F.col("path").alias("dst"), F.col("domain").alias("b"))), "dst").where("a <> b")
    out = cross.groupBy(F.col("a").alias("domain")).agg(F.countDistinct("b").alias("needs"), F.count(F.lit(1)).alias("cross_edges"))
    into = cross.groupBy(F.col("b").alias("domain")).agg(F.countDistinct("a").alias("needed_by"))
    share = F.when(F.col("lines") > 0, js_round(F.col("closed_lines") * 1000 / F.col("lines")) / 10).otherwise(F.lit(0.0))
    return base.join(out, "domain", "left").join(into, "domain", "left").select("domain", "files", "lines", "closed_files", "closed_lines", share.alias("closed_percent"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("needs", "needed_by", "cross_edges")], (F.col("files") - F.col("closed_files")).alias("blocked_files"))


def owners(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))


def external_counts(uses: DataFrame) -> DataFrame:
    """(package, uses): importing occurrences, repeated ones included."""
    return uses.groupBy("package").agg(F.count(F.lit(1)).alias("uses"))


def backbone(weighted: DataFrame) -> DataFrame:
    """The best edge out of and into each node of (src, dst, weight): by weight, then the ends."""
    from pyspark.sql import Window

    pick = lambda side: weighted.withColumn("r", F.row_number().over(Window.partitionBy(side).orderBy(F.desc("weight"), "src", "dst"))).where("r = 1").drop("r")
    return pick("src").union(pick("dst")).distinct()
