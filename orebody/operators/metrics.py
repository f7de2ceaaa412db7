"""Maintainability of files from facts of their functions: structural and volume scores, percentiles in their cohort, and the lever that would help most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import below

#: Metrics that are ranked, and those of them that a lever can act on, in the order that breaks ties.
RANKED = ("structural", "responsibilities", "max_cognitive", "max_nest", "fan_out")
DRIVERS = RANKED[1:]


def structural() -> Column:
    """2 max_cognitive + 4 avg_cognitive + 4 max_nest + 2.5 fan_out + 9 for each responsibility after the first + 0.1 max_loc."""
    c = F.col
    return 2.0 * c("max_cognitive") + 4.0 * c("avg_cognitive") + 4.0 * c("max_nest") + 2.5 * c("fan_out") + 9.0 * F.greatest(F.lit(0), c("responsibilities") - 1) + 0.1 * c("max_loc")


def volume() -> Column:
    """100 less a maintainability index, 0 at least, from vocabulary, cyclomatic complexity and lines of a file."""
    c = F.col
    steps = F.ln(F.greatest(c("cyclomatic"), F.lit(1)).cast("double"))
    factor = F.when(steps < 1, F.lit(1.0)).otherwise(c("lines") / steps)
    index = 171 - 5.2 * F.ln(F.greatest(c("vocabulary"), F.lit(1)).cast("double")) - 0.23 * c("cyclomatic") - 16.2 * F.ln(factor)
    return F.when(factor <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - index * 100 / 171))


def file_metrics(files: DataFrame, functions: DataFrame) -> DataFrame:
    """files (path, fan_out, responsibilities, ctor_params, vocabulary, cyclomatic, lines, archetype) with functions, their sums, means and maxima, ``structural`` and ``volume``.

    functions: (path, cyclo, cognitive, nest, loc). A file without a function has zeros.
    """
    per = functions.groupBy("path").agg(
        F.count(F.lit(1)).alias("functions"), F.avg("cyclo").alias("avg_cyclo"), F.max("cyclo").alias("max_cyclo"), F.sum("cognitive").alias("cognitive"),
        F.max("cognitive").alias("max_cognitive"), F.avg("cognitive").alias("avg_cognitive"), F.max("nest").alias("max_nest"), F.max("loc").alias("max_loc"),
    )
    j = files.join(per, "path", "left").fillna(0, per.columns[1:])
    return j.withColumns({"structural": structural(), "volume": volume()})


def percentiles(rows: DataFrame, least: int = 8) -> DataFrame:
    """(path, one column ``p_`` for each metric in RANKED): round(100 (below + equal / 2) / n) among the archetype's files, or all files if it has fewer than ``least``; 50 for a single file.

    Values are counted first; the running sum over all files is one in ranges for all metrics together.
    """
    long = rows.select("path", "archetype", F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(RANKED)])).alias("v")).select("path", "archetype", "v.metric", "v.value")
    own = Window.partitionBy("metric", "archetype")
    cohort = long.groupBy("metric", "archetype", "value").agg(F.count(F.lit(1)).alias("eq"))
    cohort = cohort.withColumns({"n": F.sum("eq").over(own), "under": F.sum("eq").over(own.orderBy("value")) - F.col("eq")})
    every = below(long.groupBy(F.struct("metric", "value").alias("key")).agg(F.count(F.lit(1)).alias("all_eq")), "key", "all_eq")
    every = every.select("key.metric", "key.value", "all_eq", F.col("below").alias("all_below"))
    base = every.groupBy("metric").agg(F.min("all_below").alias("base"), F.sum("all_eq").alias("total"))
    j = long.join(cohort, ["metric", "archetype", "value"]).join(every, ["metric", "value"]).join(F.broadcast(base), "metric")
    small = F.col("n") < least
    under, equal, n = (F.when(small, a).otherwise(b) for a, b in ((F.col("all_below") - F.col("base"), F.col("under")), (F.col("all_eq"), F.col("eq")), (F.col("total"), F.col("n"))))
    pct = F.when(n <= 1, 50).otherwise(F.floor((under + 0.5 * equal) / n * 100 + 0.5)).cast("long")
    return j.select("path", "metric", pct.alias("p")).groupBy("path").agg(*[F.max(F.when(F.col("metric") == i, F.col("p"))).alias(f"p_{m}") for i, m in enumerate(RANKED)])


def levers(rows: DataFrame) -> DataFrame:
    """rows (metrics, p_ columns, archetype, ctor_params) with ``lever`` and ``driver``, the metric that stands highest in its cohort.

    The first rule that holds: split-service (two responsibilities or more, above 60), extract-method (cognitive
    complexity the driver, above 75), flatten-nesting and reduce-coupling (the driver, above 60), deps-bag (over five
    constructor parameters), decompose-component and extract-hook (structural score above 60), else none.
    """
    c = F.col
    high = F.greatest(*[c(f"p_{m}") for m in DRIVERS])
    driver = F.lit(None).cast("string")
    for m in reversed(DRIVERS):
        driver = F.when(c(f"p_{m}") == high, F.lit(m)).otherwise(driver)
    out = rows.withColumn("driver", driver)
    is_ = lambda m: c("driver") == m
    lever = (
        F.when((c("responsibilities") >= 2) & (c("p_responsibilities") > 60), "split-service").when(is_("max_cognitive") & (c("p_max_cognitive") > 75), "extract-method")
        .when(is_("max_nest") & (c("p_max_nest") > 60), "flatten-nesting").when(is_("fan_out") & (c("p_fan_out") > 60), "reduce-coupling").when(c("ctor_params") > 5, "deps-bag")
        .when((c("archetype") == "react-component") & (c("p_structural") > 60), "decompose-component").when((c("archetype") == "react-hook") & (c("p_structural") > 60), "extract-hook").otherwise("none")
    )
    return out.withColumn("lever", lever)
