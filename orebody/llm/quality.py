"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts come from the whole text. Cutoffs are learned from labelled rows (quality 1: good) in two
parts, dealt by a hash of the row's id. The first part (TUNE of the rows) only says, for each
stratum and feature, how strict its cutoffs may get: up to the strictest that rejects no more
than an equal share of alpha of its good rows. That fixes one sequence of rule sets for each
stratum, from loose to strict: at each level every feature has that level's cutoff, or its own
strictest one. On the other part, the holdout, the good rows that a whole rule set rejects are
tested against alpha with the exact binomial tail at delta divided by the number of strata, level
by level, up to the first that fails; the last that passes is taken. The sequence does not depend
on the holdout, so with probability 1 - delta no stratum's learned rules together reject more
than alpha of its good rows. A stratum without a proven level rejects by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

#: Words in a window of n_repeat_words.
WINDOW = 8
#: Feature: cutoffs from strict to loose; a row is rejected if the feature is above the cutoff.
GRID = {
    "symbol_share": [x / 100 for x in (1, 2, 3, 5, 8, 12, 18, 25, 35, 50)],
    "dup_line_share": [x / 100 for x in (5, 10, 15, 20, 30, 40, 50, 60, 75, 90)],
    "repeat_share": [x / 100 for x in (2, 4, 6, 8, 10, 13, 16, 20, 25, 30)],
    "mean_word": [6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 16.0, 25.0, 50.0],
}
#: Allowed share of a stratum's good rows that learned rules reject, and the probability that a stratum exceeds it.
ALPHA, DELTA = 0.02, 0.05
#: One of so many labelled rows is for tuning.
TUNE = 4


def _pair(a: Column, shift: int) -> Column:
    """Hash of each element with the one ``shift`` further on, where there is one."""
    n = F.size(a) - shift
    return F.when(n > 0, F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(a, shift + 1, F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null and empty texts have no words and zero counts. Each row counts alone, so repeated rows
    have equal counts; columns of docs with these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in names]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    rows = docs.select(*others, t.alias("__t"), words.alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *others,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h1"),
    )
    rows = rows.select(*others, *names[:3], (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), _pair(F.col("__h1"), 1).alias("__h2"))
    rows = rows.select(*others, *names[:4], _pair(F.col("__h2"), 2).alias("__h4"))
    rows = rows.select(*others, *names[:4], _pair(F.col("__h4"), 4).alias("__h8"))
    # Only texts with a repeated window sort theirs; equal neighbours are the repeats.
    some = F.size(F.array_distinct("__h8")) < F.size("__h8")
    rows = rows.select(*others, *names[:4], F.when(some, F.array_sort(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    s = F.col("__s")
    starts = F.array_sort(F.transform(F.filter(F.zip_with(F.zip_with(s, F.slice(s, 2, 1 << 30), lambda x, after: F.struct(x.alias("x"), after["h"].alias("after"))), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s), lambda p, before: F.struct(p["x"]["i"].alias("i"), (F.coalesce(p["x"]["h"] == p["after"], F.lit(False)) | F.coalesce(p["x"]["h"] == before["h"], F.lit(False))).alias("again"))), lambda p: p["again"]), lambda p: p["i"]))
    rows = rows.select(*others, *names[:4], starts.alias("__r"))
    r = F.col("__r")
    covered = F.aggregate(F.zip_with(F.slice(r, 2, 1 << 30), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y) + WINDOW
    return rows.select(*others, *names[:4], F.coalesce(F.when(F.size(r) > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def rates() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") * 8 / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in log space from the ratios of its terms."""
    import math

    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["sum"] - top))).alias("sum"))

    return F.exp(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["sum"]))


def ranks(grid: dict[str, list[float]]) -> list[Column]:
    """For each feature how many of its cutoffs, from the strict end, reject the row."""
    rate = rates()
    return [F.size(F.filter(F.transform(F.array(*map(F.lit, cs)), lambda c: rate[f] > c), lambda x: x)).alias(f"r_{f}") for f, cs in grid.items()]


def thresholds(labelled: DataFrame, stratum: str, good: str = "quality", alpha: float = ALPHA, delta: float = DELTA, grid: dict[str, list[float]] | None = None, key: str | None = None) -> DataFrame:
    """(stratum, feature, cutoff, n, rejected): the strictest cutoffs proven, infinity where none is; n good holdout rows of the stratum, of which the rules reject ``rejected``.

    labelled holds the features, the stratum and good (1: good). Rows with a null label or a
    label other than 1 don't bear on false rejection. A null stratum is one of its own. One row
    per stratum and feature. Rows are dealt to tuning by a hash of ``key``; without one all are
    held out, and every feature may get as strict as its grid. All cutoffs have equally many levels.
    """
    grid = grid or GRID
    levels = len(next(iter(grid.values())))
    tune = F.pmod(F.xxhash64(key, F.lit("tune")), F.lit(TUNE)) == 0 if key else F.lit(False)
    names = [f"r_{f}" for f in grid]
    good_rows = labelled.where(F.col(good) == 1).select(F.col(stratum).alias("stratum"), tune.alias("tune"), *ranks(grid))
    # All that the tests need: at most (levels + 1) ** features rows a stratum and part.
    counts = written(good_rows.groupBy("stratum", "tune", *names).agg(F.count(F.lit(1)).alias("rows")), "ranks")
    strata = max(1, counts.where("not tune").select("stratum").distinct().count())
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows"))), F.lit(0))
    tuned = counts.where("tune").groupBy("stratum").agg(F.sum("rows").alias("rows"), *[F.array(*[total(F.col(n) > i) for i in range(levels)]).alias(n) for n in names])
    # The first level, from the strict end, that tuning allows; one past the last where none is.
    least = [F.size(F.filter(F.col(n), lambda k: k > F.col("rows") * (alpha / len(grid)))).alias(f"least_{n}") for n in names]
    limits = tuned.select(F.col("stratum").alias("__s"), *least)
    held = counts.where("not tune").join(limits, F.col("stratum").eqNullSafe(F.col("__s")), "left").drop("__s")
    held = held.withColumns({f"least_{n}": F.coalesce(f"least_{n}", F.lit(0)) for n in names})
    # A rule set of level t rejects a row if a feature's cutoff of level max(t, least) does.
    reach = F.greatest(*[F.when(F.col(n) > F.col(f"least_{n}"), F.col(n)).otherwise(0) for n in names])
    per = held.withColumn("reach", reach).groupBy("stratum", *[f"least_{n}" for n in names]).agg(F.sum("rows").alias("n"), F.array(*[total(F.col("reach") > t) for t in range(levels)]).alias("k"))
    tests = per.select("*", F.posexplode("k").alias("level", "rejected"))
    passes = (F.col("rejected") <= F.col("n") * alpha) & (binomial_tail(F.col("rejected"), F.col("n"), alpha) <= delta / strata)
    looser = Window.partitionBy("stratum").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    tests = tests.withColumn("passes", passes).withColumn("unbroken", F.min("passes").over(looser))
    best = tests.groupBy("stratum", "n", *[f"least_{n}" for n in names]).agg(F.min(F.when(F.col("unbroken"), F.struct("level", "rejected"))).alias("best"))
    at = lambda n: F.when(F.col("best").isNotNull(), F.greatest(F.col("best.level"), F.col(f"least_{n}")))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.get(F.array(*map(F.lit, cs)), at(f"r_{f}")), F.lit(float("inf"))).alias("cutoff")) for f, cs in grid.items()])
    return best.select("stratum", F.inline(cells), "n", F.coalesce("best.rejected", F.lit(0)).cast("long").alias("rejected"))


def verdicts(rows: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """rows (with features) plus base_failed and kept; a stratum that has no cutoffs rejects by the base rules alone.

    Each row is judged alone, repeated ones alike; a null stratum has cutoffs of its own. An empty table stays empty.
    """
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("__cut")).withColumnRenamed("stratum", "__stratum")
    rate = rates()
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    joined = rows.join(wide, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    passed = None
    for f in GRID:
        ok = F.coalesce(rate[f] <= F.col("__cut")[f], F.lit(True))
        passed = ok if passed is None else passed & ok
    return joined.withColumns({"base_failed": base, "kept": ~base & passed}).drop("__cut", "__stratum")
