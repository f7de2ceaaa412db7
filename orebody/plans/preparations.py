"""Preparations: which declarations may leave, what a boundary needs, what integration tests take along, and the audit of what landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evacuation import reach
from ..session import cut


def declaration_selection(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, name, verdict) of declarations asked for by name (file, name): ``missing``, ``ambiguous``, ``not-exported`` or ``eligible``. declared: (file, name, exported), a row for each declaration."""
    had = declared.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("exported").alias("exported"))
    j = asked.select("file", "name").distinct().join(had, ["file", "name"], "left")
    return j.select("file", "name", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(~F.col("exported"), "not-exported").otherwise("eligible").alias("verdict"))


def boundary_proofs(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(src, owner, boundary) for each file and owner that it reaches beyond its own: ``resolve`` if only types cross, ``existing-package`` if all targets lie in packages, else ``port``.

    edges: (src, dst, type_only); places: (path, owner, zone).
    """
    a = places.select(F.col("path").alias("src"), F.col("owner").alias("own"))
    b = places.select(F.col("path").alias("dst"), "owner", (F.col("zone") == "package").alias("packaged"))
    across = edges.join(a, "src").join(b, "dst").where("own <> owner")
    per = across.groupBy("src", "owner").agg(F.bool_and("type_only").alias("types"), F.bool_and("packaged").alias("served"))
    return per.select("src", "owner", F.when(F.col("types"), "resolve").when(F.col("served"), "existing-package").otherwise("port").alias("boundary"))


def test_closure(edges: DataFrame, tests: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, held) of the test files (id) that the starts reach through test files: held, and so not to be moved, if anything outside imports them too."""
    inner = edges.join(tests.select(F.col("id").alias("src")), "src", "left_semi").join(tests.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = cut(reach(inner.select("src", "dst"), starts))
    held = edges.join(found.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id")).distinct().withColumn("held", F.lit(True))
    return found.join(held, "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"))


def audit(declared: DataFrame, landed: DataFrame) -> DataFrame:
    """(path, fault) of prepared files (path, owner, sha256) against what landed, the first that holds: out of ``scope``, ``lost``, of another ``owner``, or other ``bytes``."""
    j = declared.select("path", "owner", "sha256").join(landed.select("path", F.col("owner").alias("is"), F.col("sha256").alias("live"), F.lit(True).alias("there")), "path", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "scope").when(F.col("there").isNull(), "lost").when(~F.col("is").eqNullSafe(F.col("owner")), "owner").when(F.col("live") != F.col("sha256"), "bytes")
    return j.select("path", fault.alias("fault")).where("fault IS NOT NULL")
