"""The driver's tables as the engine's relations.

Parts are modules. An order's line items, in a total order of their columns, make an import
chain: consecutive parts p, q with p's quantity of at least ``least`` are an edge p -> q.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import grows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str, least: int = 49) -> DataFrame:
    """(src, dst, type_only, dynamic), a row for each occurrence of an edge."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_returnflag") == "A").alias("type_only"), (F.col("l_linestatus") == "O").alias("dynamic"), F.lead("l_partkey").over(w).alias("dst"))  # noqa: E741
    return l.where((F.col("l_quantity") >= least) & F.col("dst").isNotNull() & (F.col("l_partkey") != F.col("dst"))).select(F.col("l_partkey").alias("src"), "dst", "type_only", "dynamic")


def edges(spark: SparkSession, sf_dir: str, least: int = 49) -> DataFrame:
    """(src, dst, type_only, dynamic) once for each pair: type-only if all occurrences are, dynamic if one is."""
    return occurrences(spark, sf_dir, least).groupBy("src", "dst").agg(F.bool_and("type_only").alias("type_only"), F.bool_or("dynamic").alias("dynamic"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as modules: path is the part's key."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("path"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey")).alias("file"),
        F.when(F.col("p_partkey") % 5 == 0, "package").otherwise("application").alias("zone"),
        F.when(F.col("p_partkey") % 2 == 0, "web").otherwise("api").alias("application"),
        F.col("p_type").alias("owner"),
        F.col("p_brand").alias("domain"),
        F.col("p_size").cast("long").alias("line_count"),
        (F.col("p_retailprice") >= 1000).alias("has_exports"),
    )


def graph_modules(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    """The modules with an edge."""
    ids = e.select(F.col("src").alias("path")).union(e.select(F.col("dst").alias("path"))).distinct()
    return modules(spark, sf_dir).join(grows(ids), "path", "left_semi")
