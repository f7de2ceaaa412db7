"""Scanner reports, file trees and packages as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths

SCAN = "app string, source string, dependencies array<struct<module:string,resolved:string,dynamic:boolean,couldNotResolve:boolean>>"
#: Node's built-in modules that a specifier may name.
BUILTINS = "assert buffer child_process cluster console crypto dgram dns domain events fs http http2 https module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()


def read_reports(spark: SparkSession, reports: dict[str, str], lines: bool = False) -> DataFrame:
    """Captured JSON reports, one for each application, under an explicit schema; a malformed file fails. With lines, a report comes in objects of one line each, so that it is read in parts."""
    out = None
    for app, path in reports.items():
        one = spark.read.schema("modules array<struct<source:string,dependencies:array<struct<module:string,resolved:string,dynamic:boolean,couldNotResolve:boolean>>>>").option("multiLine", not lines).option("mode", "FAILFAST").json(path)
        one = one.select(F.explode("modules").alias("m")).select(F.lit(app).alias("app"), "m.source", "m.dependencies")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SCAN)


def read_tree(spark: SparkSession, root: str, most_bytes: int | None = None, skip: tuple[str, ...] = ("node_modules", ".git")) -> DataFrame:
    """(path, content, sha256, size) of the files below a folder, without the skipped folders and, with most_bytes, larger files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    out = files.select(path.alias("path"), "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    out = out.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*skip)))
    return out if most_bytes is None else out.where(F.col("size") <= most_bytes)


def packages(disk: DataFrame, configured: DataFrame) -> DataFrame:
    """(name, owner): configured entries override those on disk; two owners of one name in one source are an error."""
    both = disk.select("name", "owner", F.lit(0).alias("rank")).union(configured.select("name", "owner", F.lit(1).alias("rank"))).distinct()
    checked = both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name", "rank")))
    checked = checked.withColumn("name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate package name: "), F.col("name")))).otherwise(F.col("name")))
    return checked.groupBy("name").agg(F.max_by("owner", "rank").alias("owner"))


def build_graph(scan: DataFrame, facts: DataFrame, exports: DataFrame, packages: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The graph relations of scanner reports: nodes, edges, unresolved, workspace_edges, external_by_source, test_importers, test_kinds.

    scan: SCAN rows; of several reports on one path the last app by name wins. facts: (path,
    specifier, type_only, dynamic), an occurrence a row. exports: (path, has_exports,
    line_count). packages: (name, owner). Tests are importers, never nodes.
    """
    norm = paths.normalize_path
    last = scan.select("app", norm(F.col("source")).alias("source"), "dependencies").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("app"))))
    mine = F.col("source").rlike("^(" + "|".join([*(a.source_root.rstrip("/") + "/" for a in config.applications), *(r + "/" for r in config.package_roots), *(r + "/" for r in config.first_party_packages)]) + ")")
    modules = last.where((F.col("r") == 1) & mine & paths.extension_in(F.col("source"), config.source_extensions)).drop("r", "app")
    modules = modules.withColumn("test_kind", paths.test_kind(F.col("source"), config))
    source = modules.where("test_kind is null")
    nodes = source.select(F.col("source").alias("path")).join(exports, "path", "left").select(
        "path",
        F.when(paths.application(F.col("path"), config).isNotNull(), "application").otherwise("package").alias("zone"),
        paths.application(F.col("path"), config).alias("application"),
        paths.owner(F.col("path"), config).alias("owner"),
        paths.domain(F.col("path"), config).alias("domain"),
        F.col("path").rlike(r"\.d\.[cm]?ts$").alias("is_declaration"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("has_exports", F.lit(False)).alias("has_exports"),
    )
    kinds = facts.groupBy("path", "specifier").agg(F.bool_and("type_only").alias("type_only"), F.bool_or("dynamic").alias("dyn"))
    deps = modules.select("source", "test_kind", F.explode("dependencies").alias("d")).select("source", "test_kind", F.col("d.module").alias("specifier"), norm(F.col("d.resolved")).alias("to"), F.coalesce("d.dynamic", F.lit(False)).alias("dynamic"), F.coalesce("d.couldNotResolve", F.lit(False)).alias("missing"))
    deps = deps.join(kinds.withColumnRenamed("path", "source"), ["source", "specifier"], "left").join(nodes.select(F.col("path").alias("to"), F.lit(True).alias("is_node")), "to", "left")
    own = packages.select(F.col("name").alias("package"), F.col("owner").alias("to_owner"))
    deps = deps.withColumn("package", paths.package_name(F.col("specifier"))).join(own, "package", "left")
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    asset = paths.extension_in(F.col("to"), config.asset_extensions)
    production = deps.where("test_kind is null")
    edges = production.where("is_node").select(F.col("source").alias("src"), F.col("to").alias("dst"), "specifier", paths.edge_kind(F.coalesce(asset, F.lit(False)), F.col("dynamic") | F.coalesce("dyn", F.lit(False)), F.coalesce("type_only", F.lit(False))).alias("kind"), F.coalesce("type_only", F.lit(False)).alias("type_only"), (F.col("dynamic") | F.coalesce("dyn", F.lit(False))).alias("dynamic"))
    builtin = F.regexp_replace("package", "^node:", "").isin(*BUILTINS)
    return {
        "nodes": nodes,
        "edges": edges,
        "unresolved": production.where("missing").where(relative | (F.col("to_owner").isNotNull() & (F.col("specifier") != F.col("package")))).select("source", "specifier").distinct(),
        "workspace_edges": production.where("to_owner is not null and is_node is null").select(F.col("source").alias("from"), "to_owner", "specifier").distinct(),
        "external_by_source": production.where("to_owner is null and is_node is null").where(~relative & ~builtin).select("source", "package", "specifier"),
        "test_importers": deps.where("test_kind is not null and is_node").select(F.col("to").alias("target"), F.col("source").alias("test")).distinct(),
        "test_kinds": modules.where("test_kind is not null").select(F.col("source").alias("test"), F.col("test_kind").alias("kind")),
    }
