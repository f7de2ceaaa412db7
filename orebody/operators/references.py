"""References between files: resolution, rewrites and their ambiguities, triggers, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Endings tried, in order, for a relative specifier.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def resolve_relative(refs: DataFrame, tree: DataFrame) -> DataFrame:
    """refs (source, specifier) with ``resolved``: the first of the endings that the tree (path) has; null if none. A .js may stand for a .ts."""
    folder = F.slice(F.split("source", "/"), 1, F.size(F.split("source", "/")) - 1)
    steps = F.split("specifier", "/")
    walk = F.aggregate(steps, folder, lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    base = F.array_join(walk, "/")
    tries = F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES], F.regexp_replace(base, r"\.jsx?$", ".ts"))
    each = refs.select("source", "specifier", F.posexplode(tries).alias("order", "path"))
    found = each.join(tree.select("path").distinct(), "path").groupBy("source", "specifier").agg(F.min_by("path", "order").alias("resolved"))
    return refs.join(found, ["source", "specifier"], "left")


#: Patterns that are tried on each file in one pass; settings of more are refused.
PATTERNS = 1000


def triggered(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(name) of artifacts (name, pattern) whose pattern some file matches, or that have none. The patterns are settings: they become one expression over the files, which are read once."""
    rules = artifacts.where("pattern is not null").limit(PATTERNS + 1).collect()
    if len(rules) > PATTERNS:
        raise ValueError(f"at most {PATTERNS} patterns")
    always = artifacts.where("pattern is null").select("name").distinct()
    if not rules:
        return always
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(r["pattern"]), F.lit(r["name"])) for r in rules]))
    return always.union(files.select(F.explode(hits).alias("name")).distinct()).distinct()


def ambiguous(matches: DataFrame) -> DataFrame:
    """(file, start, end, choices): spans of matches (file, start, end, to) that could become more than one thing; they are left alone."""
    return matches.groupBy("file", "start", "end").agg(F.countDistinct("to").alias("choices")).where("choices > 1")


def collisions(matches: DataFrame) -> DataFrame:
    """(file, to, donors): one replacement that different donors (donor) would make in a file."""
    return matches.groupBy("file", "to").agg(F.countDistinct("donor").alias("donors")).where("donors > 1")


def unreplayed(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded rewrites (path, start, from, to) that a new scan doesn't find."""
    return recorded.join(live, ["path", "start", "from", "to"], "left_anti")


def chain_breaks(commits: DataFrame) -> DataFrame:
    """(chain, seq, id) of commits (chain, seq, id, parent) whose parent isn't the commit before."""
    before = F.lag("id").over(Window.partitionBy("chain").orderBy("seq"))
    return commits.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("parent").eqNullSafe(F.col("before"))).select("chain", "seq", "id")


def unclosed(selection: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of edges that leave a selection (id); none if it is closed."""
    return edges.select("src", "dst").distinct().join(selection.select(F.col("id").alias("src")), "src", "left_semi").join(selection.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def css_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(selector, change) of rules (selector, declarations): missing, added, or the same declarations in another order or others."""
    a, b = before.groupBy("selector").agg(F.array_sort(F.collect_list("declarations")).alias("a")), after.groupBy("selector").agg(F.array_sort(F.collect_list("declarations")).alias("b"))
    parts = lambda c: F.array_sort(F.flatten(F.transform(c, lambda d: F.split(d, ";"))))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), None).when(parts("a") == parts("b"), "reordered").otherwise("changed")
    return a.join(b, "selector", "full_outer").select("selector", kind.alias("change")).where("change is not null")


def seam_blockers(*rules: tuple[str, str, DataFrame]) -> DataFrame:
    """(certainty, code, id) of rules (certainty, code, rows (id)): exact before heuristic, then code, then id."""
    out = None
    for certainty, code, rows in rules:
        one = rows.select(F.lit(certainty).alias("certainty"), F.lit(code).alias("code"), "id")
        out = one if out is None else out.union(one)
    return out.distinct().orderBy("certainty", "code", "id")
