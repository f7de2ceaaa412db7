"""Recorded relations: manifests, ledgers, trees by commit, settings."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config

MANIFEST = "plan string, idx long, kind string, source string, target string, pre_hash string, result_hash string"
LEDGER = "campaign long, seq long, id string, kind string, status string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Operations of plan manifests, JSON by line; a line that doesn't fit the schema is an error."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ledgers, JSON by line, with ``fault``: no-status, bad-id, or gap where an entry doesn't follow the one before."""
    rows = spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)
    before = F.lag("seq").over(Window.partitionBy("campaign").orderBy("seq"))
    fault = F.when(F.col("status").isNull(), "no-status").when(~F.col("id").rlike("^[0-9a-f]{64}$"), "bad-id").when(F.col("seq") != before + 1, "gap")
    return rows.withColumn("fault", fault)


def tree_at(trees: DataFrame, commit: Column, *ties: str) -> DataFrame:
    """(path, content) of the tree at a commit: of each path the last row (commit, path, content, deleted) up to it, unless it deletes."""
    last = trees.where(F.col("commit") <= commit).groupBy("path").agg(F.max_by(F.struct("content", "deleted"), F.struct("commit", *ties)).alias("x"))
    return last.where("not x.deleted").select("path", F.col("x.content").alias("content"))


def effective(spark: SparkSession, config: Config) -> DataFrame:
    """(setting, value, given): each setting as it is in force, and whether it differs from its default."""
    plain = Config()
    return spark.createDataFrame([(f.name, str(getattr(config, f.name)), getattr(config, f.name) != getattr(plain, f.name)) for f in fields(Config)], "setting string, value string, given boolean")


def effective_by_owner(given: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, setting, value, given): every setting of each owner, as it gives it (owner, setting, value) or by default; a given setting that doesn't exist has no default and is listed as ``unknown``."""
    plain = owners.sparkSession.createDataFrame([(f.name, str(getattr(Config(), f.name))) for f in fields(Config)], "setting string, default string")
    every = owners.select("owner").distinct().crossJoin(F.broadcast(plain)).withColumn("known", F.lit(True))
    j = every.join(given.select("owner", "setting", "value"), ["owner", "setting"], "full_outer")
    value = F.when(F.col("known").isNull(), "unknown").otherwise(F.coalesce("value", "default"))
    return j.select("owner", "setting", value.alias("value"), F.coalesce(F.col("value") != F.col("default"), F.col("known").isNull()).alias("given"))


def canonical_settings(settings: Column, local: tuple[str, ...]) -> Column:
    """A map of settings as JSON with sorted keys, without those that belong to the machine."""
    kept = F.map_filter(settings, lambda k, _: ~k.isin(*local))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def tree_hash(files: DataFrame, key: str, name: str, sha: str, bundle: int) -> DataFrame:
    """(key, files, digest): a hash over the hashes of bundles of files, so no list is longer than a bundle or the number of bundles."""
    line = F.concat_ws(":", name, sha)
    per = files.groupBy(key, F.floor(F.col(name) / bundle).alias("bundle")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("h"))
    return per.groupBy(key).agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bundle", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
