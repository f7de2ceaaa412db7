"""Proofs over a landed plan, and the rules that a plan must meet: each gives issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_collisions(moves: DataFrame) -> DataFrame:
    """(target, sources) of moves (source, target) that share a target."""
    return moves.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)


def missing_rewrites(refs: DataFrame, moves: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(path, specifier) of references that resolve to a moved source from a file that stays and has no recorded rewrite."""
    hit = refs.join(moves.select(F.col("source").alias("resolved")), "resolved", "left_semi").join(moves.select(F.col("source").alias("path")), "path", "left_anti")
    return hit.join(rewrites.select("path", "specifier"), ["path", "specifier"], "left_anti").select("path", "specifier").distinct()


def boundary_breaks(edges: DataFrame, packages: DataFrame, applications: DataFrame, baseline: DataFrame) -> DataFrame:
    """(src, dst): edges from package files into applications that the baseline doesn't record."""
    out = edges.join(packages.select(F.col("path").alias("src")), "src", "left_semi").join(applications.select(F.col("path").alias("dst")), "dst", "left_semi")
    return out.join(baseline.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst").distinct()


def entry_closure(landed: DataFrame, declared: DataFrame, inherited: DataFrame, produced: DataFrame) -> DataFrame:
    """(path, fault): landed files that are neither declared nor inherited, and declared ones that nothing produced."""
    undeclared = landed.select("path").distinct().join(declared, "path", "left_anti").join(inherited, "path", "left_anti")
    absent = declared.select("path").distinct().join(produced, "path", "left_anti")
    return undeclared.select("path", F.lit("undeclared").alias("fault")).union(absent.select("path", F.lit("not-produced")))


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, lost, gained, changed) of keyed digests (category, path, sha256)."""
    a, b = before.withColumnRenamed("sha256", "a"), after.withColumnRenamed("sha256", "b")
    j = a.join(b, ["category", "path"], "full_outer")
    return j.groupBy("category").agg(F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def postconditions(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(rule, name) of packages (name, owner) and dependencies (owner, name, range, section): duplicate names, workspace ranges without a package, one name in two sections."""
    twice = packages.groupBy("name").agg(F.countDistinct("owner").alias("n")).where("n > 1").select(F.lit("duplicate-name").alias("rule"), "name")
    lost = dependencies.where(F.col("range").startswith("workspace:")).join(packages, "name", "left_anti").select(F.lit("unresolved-workspace"), "name")
    both = dependencies.groupBy("owner", "name").agg(F.countDistinct("section").alias("n")).where("n > 1").select(F.lit("conflicting-sections"), "name")
    return twice.union(lost).union(both).distinct()


def proof_report(failures: DataFrame, proofs: list[str]) -> DataFrame:
    """(proof, failures, passed) for every proof, those without a failure included."""
    every = failures.sparkSession.createDataFrame([(p,) for p in proofs], "proof string")
    n = failures.groupBy("proof").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "proof", "left").select("proof", F.coalesce("n", F.lit(0)).alias("failures"), F.col("n").isNull().alias("passed"))


def issues(*rules: tuple[str, DataFrame]) -> DataFrame:
    """(rule_order, rule, path): the rules' rows (path) in the order given, then by path."""
    out = None
    for i, (name, rows) in enumerate(rules):
        one = rows.select(F.lit(i).alias("rule_order"), F.lit(name).alias("rule"), "path")
        out = one if out is None else out.union(one)
    return out.orderBy("rule_order", "path")


def source_issues(files: DataFrame, components: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rules of a plan's sources: each file once; components exactly partition the files; blobs cover them with well-formed digests."""
    once = files.groupBy("path").count().where("count > 1").select("path")
    parts = components.groupBy("path").count().where("count > 1").select("path")
    uncovered = files.select("path").distinct().join(components, "path", "full_outer").join(files.select("path", F.lit(1).alias("f")).distinct(), "path", "left").join(components.select("path", F.lit(1).alias("c")).distinct(), "path", "left").where("f is null or c is null").select("path").distinct()
    no_blob = files.select("path").distinct().join(blobs, "path", "left_anti")
    malformed = blobs.where(~F.col("sha256").rlike("^[0-9a-f]{64}$")).select("path")
    return issues(("duplicate-file", once), ("overlapping-components", parts), ("not-partitioned", uncovered), ("missing-blob", no_blob), ("malformed-digest", malformed))


def overlay(ops: DataFrame, accepted: DataFrame) -> DataFrame:
    """ops with the accepted states (path, sha256) put on the last operation that owns each path."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("idx"))) == 1
    marked = ops.withColumn("__last", last)
    j = marked.join(accepted.withColumnRenamed("sha256", "__sha"), "path", "left")
    return j.withColumn("result_hash", F.when(F.col("__last") & F.col("__sha").isNotNull(), F.col("__sha")).otherwise(F.col("result_hash"))).drop("__last", "__sha")


def reconcilable(discrepancies: DataFrame, ops: DataFrame) -> DataFrame:
    """(path, fault, allowed): drift in bytes or of generated files may be accepted; expected is the last operation's result."""
    last = ops.groupBy("path").agg(F.max_by("result_hash", "idx").alias("expected"), F.max_by("kind", "idx").alias("kind"))
    allowed = (F.col("fault") == "differs") | (F.col("kind") == "generate")
    return discrepancies.join(last, "path", "left").select("path", "fault", "expected", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def declarative_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, status): literal replacements (path, before, after). Exactly one match is replaced; none is accepted if the new text is there; anything else is refused and left."""
    j = files.join(edits, "path")
    n = (F.length("content") - F.length(F.replace("content", "before", F.lit("")))) / F.length("before")
    status = F.when(n == 1, "applied").when((n == 0) & F.contains("content", "after"), "already").otherwise("refused")
    return j.select("path", F.when(n == 1, F.replace("content", "before", "after")).otherwise(F.col("content")).alias("content"), status.alias("status"))
