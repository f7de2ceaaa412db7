"""Package dependencies: evidence, versions, pruning, lockfile gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(uses: DataFrame) -> DataFrame:
    """(owner, package, section): runtime if any use is, else dev. uses: (owner, package, section)."""
    return uses.groupBy("owner", "package").agg(F.when(F.bool_or(F.col("section") == "runtime"), "runtime").otherwise("dev").alias("section"))


def versions(declared: DataFrame, root: DataFrame) -> DataFrame:
    """(package, version, source) of declared (owner, package, version): the one version that all owners declare, else the root's, else none (ambiguous)."""
    d = declared.groupBy("package").agg(F.countDistinct("version").alias("k"), F.min("version").alias("one"))
    r = root.groupBy("package").agg(F.min("version").alias("root"))
    j = d.join(r, "package", "left")
    one = F.col("k") == 1
    return j.select("package", F.when(one, F.col("one")).otherwise(F.col("root")).alias("version"), F.when(one, "declared").when(F.col("root").isNotNull(), "root").otherwise("ambiguous").alias("source"))


def prunable(declared: DataFrame, retained: DataFrame, types: DataFrame, kept: DataFrame) -> DataFrame:
    """declared (owner, package) that no retained use, no type setting and no keep list needs."""
    out = declared
    for other in (retained, types, kept):
        out = out.join(other.select("owner", "package").distinct(), ["owner", "package"], "left_anti")
    return out


def side_effects(manifests: DataFrame) -> DataFrame:
    """(package, class) of (package, json, resolved): unresolved, undeclared, none (false or an empty list) or some."""
    value = F.get_json_object("json", "$.sideEffects")
    kind = F.when(~F.col("resolved"), "unresolved").when(value.isNull(), "undeclared").when(value.isin("false", "[]"), "none").otherwise("some")
    return manifests.select("package", kind.alias("class"))


def missing_resolutions(importers: DataFrame, resolved: DataFrame) -> DataFrame:
    """(importer, package, version) of an importer's dependencies that have no resolution."""
    return importers.join(resolved.select("package", "version").distinct(), ["package", "version"], "left_anti").select("importer", "package", "version")
