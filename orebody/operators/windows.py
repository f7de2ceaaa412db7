"""Order-dependent operators: percentiles, dominance, partitions, precedence, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


#: Keys that one window sums up; more are summed in ranges.
ONE_WINDOW = 100_000


def below(counts: DataFrame, key: str, amount: str, few: int = ONE_WINDOW) -> DataFrame:
    """counts (key, amount; one row a key) with ``below``: the sum of amount over all lesser keys.

    Up to ``few`` keys take one window. More are a running sum in ranges: each range is one task, and only the
    ranges' totals, as many as there are partitions, are added up on the driver.
    """
    spark = counts.sparkSession
    if counts.limit(few + 1).count() <= few:
        return counts.withColumn("below", F.sum(amount).over(Window.orderBy(key)) - F.col(amount))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(counts.repartitionByRange(n, key).withColumn("__range", F.spark_partition_id()))
    start, starts = 0, []
    for r in sorted(ranges.groupBy("__range").agg(F.sum(amount).alias("t")).collect()):
        starts.append((r["__range"], start))
        start += r["t"]
    offsets = spark.createDataFrame(starts, "__range int, __start long")
    w = Window.partitionBy("__range").orderBy(key)
    return ranges.join(F.broadcast(offsets), "__range").withColumn("below", F.sum(amount).over(w) - F.col(amount) + F.col("__start")).drop("__range", "__start")


def percentile(rows: DataFrame, cohort: str, metric: str, least: int = 8) -> DataFrame:
    """rows with cohort_size, source (cohort or repo) and percentile: round(100 (below + equal / 2) / n), 50 for a single row.

    A cohort of fewer than ``least`` rows is measured against all rows. Values are counted first,
    so the windows run over distinct values; the one over all values is a running sum in ranges.
    """
    counted = rows.groupBy(cohort, metric).agg(F.count(F.lit(1)).alias("__eq"))
    own = Window.partitionBy(cohort)
    counted = counted.withColumns({"__n": F.sum("__eq").over(own), "__below": F.sum("__eq").over(own.orderBy(metric)) - F.col("__eq")})
    every = below(rows.groupBy(metric).agg(F.count(F.lit(1)).alias("__all_eq")), metric, "__all_eq").withColumnRenamed("below", "__all_below")
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    joined = rows.join(counted, [cohort, metric]).join(every, metric).crossJoin(F.broadcast(total))
    small = F.col("__n") < least
    under, equal, n = (F.when(small, F.col(a)).otherwise(F.col(b)) for a, b in (("__all_below", "__below"), ("__all_eq", "__eq"), ("__total", "__n")))
    pct = F.when(n <= 1, 50).otherwise(F.floor((under + 0.5 * equal) / n * 100 + 0.5)).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__n").alias("cohort_size"), F.when(small, "repo").otherwise("cohort").alias("source"), pct.alias("percentile"))


def dominant(counts: DataFrame, key: str, label: str, amount: str) -> DataFrame:
    """(key, dominant, concentration): the label with most, ties to the least; its share of all."""
    per = counts.groupBy(key, label).agg(F.sum(amount).alias("a"))
    w = Window.partitionBy(key)
    r = per.withColumns({"total": F.sum("a").over(w), "r": F.row_number().over(w.orderBy(F.desc("a"), label))})
    return r.where("r = 1").select(key, F.col(label).alias("dominant"), (F.col("a") / F.col("total")).alias("concentration"))


def partitions(uses: DataFrame, item: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(item, labels) and (labels, members, first): the exact set of labels that use each item, and how many items share it, the least of them. No row holds a class's items."""
    per = uses.groupBy(item).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return per, per.groupBy("labels").agg(F.count(F.lit(1)).alias("members"), F.min(item).alias("first"))


def last_writer(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def increasing_faults(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value is not above that of the row before in its key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(value) <= F.col("before"))


def overlaps(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max(end).over(w)).where(F.col(start) < F.col("reached"))


def chain_faults(ops: DataFrame, key: str = "path", order: str = "idx") -> DataFrame:
    """Operations whose pre_hash isn't the result_hash of the operation before on the same file."""
    before = F.lag("result_hash").over(Window.partitionBy(key).orderBy(order))
    return ops.withColumn("state", before).where(F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("pre_hash")))


def multiset_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added and removed, with their multiplicity."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).union(before.exceptAll(after).withColumn("change", F.lit("removed")))


def inventory_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed between two keyed inventories."""
    a, b = before.select(key, F.col(value).alias("__a"), F.lit(True).alias("__ina")), after.select(key, F.col(value).alias("__b"), F.lit(True).alias("__inb"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("__ina").isNull(), "added").when(F.col("__inb").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(key, kind.alias("change")).where("change is not null")


def ratchet(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, metric, verdict) of (path, metric, value): new and worse fail; improved, accepted and stale don't."""
    a, b = recorded.withColumnRenamed("value", "old"), current.withColumnRenamed("value", "now")
    j = a.join(b, ["path", "metric"], "full_outer")
    verdict = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "stale").when(F.col("now") > F.col("old"), "worse").when(F.col("now") < F.col("old"), "improved").otherwise("accepted")
    return j.select("path", "metric", verdict.alias("verdict"))
