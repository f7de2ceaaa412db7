"""Rules that a plan must keep, each as rows of (plan, subject, rule); a plan without rows is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of operations, and the form of a commit's subject.
MOVES = ("move", "move-with-rewrite")
EDITS = ("rewrite-import", "rewrite-fs-reference", "rewrite-path-reference")
KINDS = (*MOVES, *EDITS, "write-file", "delete-file")
SUBJECT = r"^(refactor|fix|feat|chore|test|docs|ci|build|perf|style)(\([^)\n]+\))?!?: [^\n]+$"


def sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def file_state(x: Column) -> Column:
    """A hash, or "missing"."""
    return sha256(x) | F.coalesce(x == "missing", F.lit(False))


def issues(rows: DataFrame, subject: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """(plan, subject, rule) of the rules that hold for a row; a rule on missing facts doesn't."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]))
    return rows.select("plan", subject.cast("string").alias("subject"), F.explode(hit).alias("rule"))


def all_of(*found: DataFrame) -> DataFrame:
    """Issues of several kinds as one relation."""
    return reduce(DataFrame.unionByName, found)


def summary(found: DataFrame) -> DataFrame:
    """(plan, rule, n)."""
    return found.groupBy("plan", "rule").agg(F.count(F.lit(1)).alias("n"))


def operation_issues(ops: DataFrame, consumers: DataFrame, root: str, donors: DataFrame | None = None) -> DataFrame:
    """Issues of operations (plan, idx, kind, source, target, file, pre, post, blob, role) by themselves and among each other.

    blob is the hash of the source at the baseline; consumers (plan, file) are the declared ones;
    donors (plan, idx, donor) are the files an import rewrite is about. A moved file may have its imports rewritten if another donor moves too.
    """
    c = F.col
    move, edit = c("kind").isin(*MOVES), c("kind").isin(*EDITS)
    key = F.concat_ws(":", "kind", F.when(move, F.concat_ws(":", "source", "target")).otherwise(c("file")))
    nth = F.row_number().over(Window.partitionBy("plan", "key").orderBy("idx"))
    touched = F.row_number().over(Window.partitionBy("plan", "file").orderBy("idx"))
    rows = ops.withColumn("key", key).withColumn("nth", nth).withColumn("touched", touched)
    moved = ops.where(move).select("plan", F.explode(F.array("source", "target")).alias("file")).distinct().withColumn("is_moved", F.lit(True))
    known = consumers.select("plan", "file").distinct().withColumn("is_consumer", F.lit(True))
    landed = F.count(F.lit(1)).over(Window.partitionBy("plan", F.when(move, F.lit(True)), "target"))
    rows = rows.withColumn("landed", landed).join(moved, ["plan", "file"], "left").join(known, ["plan", "file"], "left")
    if donors is None:
        rows = rows.withColumn("__cross", F.lit(False))
    else:
        about = ops.where("kind = 'rewrite-import'").select("plan", "idx", F.col("file").alias("__own")).join(donors.select("plan", "idx", F.col("donor").alias("file")), ["plan", "idx"]).where("file <> __own")
        crossing = about.join(moved, ["plan", "file"], "left_semi").select("plan", "idx").distinct().withColumn("__cross", F.lit(True))
        rows = rows.join(crossing, ["plan", "idx"], "left").withColumn("__cross", F.coalesce("__cross", F.lit(False)) & c("is_moved").isNotNull())
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    return issues(rows, c("idx"), [
        ("unknown-operation", ~c("kind").isin(*KINDS)),
        ("duplicate-operation", c("nth") > 1),
        ("duplicate-move", move & (c("source") == c("target"))),
        ("move-hash", move & (~file_state(c("pre")) | ~sha256(c("post")))),
        ("move-precondition", move & differs("pre", "blob")),
        ("move-not-byte-identical", (c("kind") == "move") & differs("post", "blob")),
        ("move-targets", move & (c("landed") > 1)),
        ("target-containment", move & ~c("target").startswith(root + "/")),
        ("asset-move", (c("kind") == "move-with-rewrite") & (c("role") == "asset")),
        ("rewrite-identity", ((c("kind") == "move-with-rewrite") | edit) & (c("pre") == c("post"))),
        ("rewrite-hash", edit & (~file_state(c("pre")) | ~sha256(c("post")))),
        ("rewrite-consumer", (c("kind") == "rewrite-import") & c("is_consumer").isNull()),
        ("multiple-mutations", ~move & (c("is_moved").isNotNull() & ~c("__cross") | edit & (c("touched") > 1))),
        ("invalid-precondition", (c("kind") == "delete-file") & (c("pre") == "missing")),
        ("delete-hash", (c("kind") == "delete-file") & (~file_state(c("pre")) | ~c("post").eqNullSafe(F.lit("missing")))),
    ])


def coverage_issues(ops: DataFrame, sources: DataFrame, consumers: DataFrame, changed: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Issues of a plan as a whole: sources (plan, path) not moved, moves of what is no source, consumers without a rewrite, changed files (plan, path) that don't match what operations and regeneration (plan, path) touch."""
    move = F.col("kind").isin(*MOVES)
    said = lambda rows, column, rule: rows.select("plan", F.col(column).cast("string").alias("subject"), F.lit(rule).alias("rule"))
    moved = ops.where(move).select("plan", F.col("source").alias("path")).distinct()
    edited = ops.where("kind = 'rewrite-import'").select("plan", "file").distinct()
    touched = ops.select("plan", F.explode(F.when(move, F.array("source", "target")).otherwise(F.array("file"))).alias("path")).distinct()
    due = touched.union(regenerated.select("plan", "path")).distinct()
    wrong = lambda a, b: a.distinct().join(b, a.columns, "left_anti")
    return all_of(
        said(wrong(sources.select("plan", "path"), moved), "path", "move-coverage"),
        said(wrong(moved, sources.select("plan", "path")), "path", "move-coverage"),
        said(wrong(consumers.select("plan", "file"), edited), "file", "consumer-coverage"),
        said(wrong(due, changed.select("plan", "path")), "path", "changed-files"),
        said(wrong(changed.select("plan", "path"), due), "path", "changed-files"),
        said(touched.join(regenerated.select("plan", "path"), ["plan", "path"], "left_semi"), "path", "generated-file"),
    )


def donor_surface_issues(rewrites: DataFrame, surface: DataFrame, selected: DataFrame) -> DataFrame:
    """Issues of rewrites (plan, file, donor, to, package): one without a donor must name the package; a donor's must name its public specifier (surface: plan, donor, specifier), or the package if the selected donor (plan, donor) has none."""
    chosen = selected.select("plan", "donor").distinct().withColumn("chosen", F.lit(True))
    rows = rewrites.join(surface, ["plan", "donor"], "left").join(chosen, ["plan", "donor"], "left")
    c = F.col
    bare, root = c("donor").isNull(), c("to") == c("package")
    return issues(rows, c("file"), [
        ("donor-unnamed", bare & ~root),
        ("donor-unselected", ~bare & c("specifier").isNull() & c("chosen").isNull()),
        ("donor-root", ~bare & c("specifier").isNull() & c("chosen").isNotNull() & ~root),
        ("donor-surface", c("specifier").isNotNull() & (c("to") != c("specifier"))),
    ])


def consumer_issues(consumers: DataFrame, targets: DataFrame) -> DataFrame:
    """Issues of consumers (plan, file, n, importer, section, rewrites array<struct<from, to>>), n the copies of the row; targets (plan, specifier) may be rewritten to."""
    own = issues(consumers, F.col("file"), [
        ("duplicate-consumer", F.col("n") > 1),
        ("no-importer", F.col("importer").isNull()),
        ("bad-section", F.col("section").isNull() | ~F.col("section").isin("runtime", "dev")),
        ("no-rewrite", F.size("rewrites") == 0),
        ("no-op", F.exists("rewrites", lambda r: r["from"] == r["to"])),
    ])
    each = consumers.select("plan", "file", F.explode("rewrites.to").alias("specifier")).distinct()
    loose = each.join(targets.select("plan", "specifier").distinct(), ["plan", "specifier"], "left_anti")
    return own.union(loose.select("plan", F.col("file").cast("string"), F.lit("undeclared-target")).distinct())


def target_issues(targets: DataFrame, modules: DataFrame, name: str, roots: tuple[str, ...]) -> DataFrame:
    """Issues of targets (plan, package, root, entry) and of their public modules (plan, source, key, target, specifier)."""
    c = F.col
    under = reduce(lambda a, b: a | b, [c("root").startswith(r + "/") for r in roots])
    own = issues(targets, c("package"), [("target-name", ~c("package").rlike(name)), ("target-root", ~under | c("root").contains("..")), ("target-entrypoint", c("entry").isNull() | (c("entry") == ""))])
    again = lambda x: F.row_number().over(Window.partitionBy("plan", x).orderBy("source", "key")) > 1
    m = modules.join(targets.select("plan", "package"), "plan").withColumns({"key_again": again("key"), "source_again": again("source")})
    inside = c("specifier").startswith(F.concat("package", F.lit("/"))) | (c("key") == ".") & (c("specifier") == c("package"))
    return own.union(issues(m, c("source"), [
        ("module-specifier", ~inside),
        ("module-paths", (c("key") != ".") & ~c("key").startswith("./") | ~c("target").startswith("./")),
        ("module-duplicate", c("key_again") | c("source_again")),
    ]))


def artifact_issues(projected: DataFrame, derived: DataFrame) -> DataFrame:
    """Projected artifacts (plan, path, hash) that aren't what the operations give (plan, path, hash), either way."""
    a, b = projected.select("plan", "path", F.col("hash").alias("said")), derived.select("plan", "path", F.col("hash").alias("is"))
    j = a.join(b, ["plan", "path"], "full_outer").where(~F.col("said").eqNullSafe(F.col("is")))
    return j.select("plan", F.col("path").cast("string").alias("subject"), F.lit("projected-artifacts").alias("rule"))


def decision_issues(decisions: DataFrame, due: DataFrame) -> DataFrame:
    """Issues of dependency decisions (plan, name, decision, reasons): repeated, without a reason, missing or beyond those due (plan, name, decision)."""
    c, key = F.col, ["plan", "name", "decision"]
    # One aggregation of both, so no task holds two of them and what their joins sort.
    rows = decisions.select(*key, F.lit(True).alias("said"), "reasons").union(due.select(*key, F.lit(False), F.lit(None)))
    per = rows.groupBy(*key).agg(F.count_if("said").alias("n"), F.min("reasons").alias("reasons"), F.bool_or(~c("said")).alias("due"))
    # A key with a null is equal to none.
    met = (c("n") > 0) & c("due") & c("plan").isNotNull() & c("name").isNotNull() & c("decision").isNotNull()
    return issues(per, F.concat_ws(":", "name", "decision"), [
        ("repeated-decision", c("n") > 1),
        ("no-reason", c("reasons") == 0),
        ("missing-decision", c("due") & ~met),
        ("undeclared-decision", (c("n") > 0) & ~met),
    ])


def record_issues(generated: DataFrame, commits: DataFrame, gates: DataFrame) -> DataFrame:
    """Issues of generated files (plan, path, command, hash, exempt), commits (plan, name, subject) and gate commands (plan, tier, command)."""
    c = F.col
    made = issues(generated, c("path"), [("no-command", c("command").isNull() | (c("command") == "")), ("bad-hash", c("hash").isNotNull() & ~sha256(c("hash"))), ("unproven", c("hash").isNull() & c("exempt").isNull())])
    subject = commits.withColumnRenamed("subject", "line")
    return all_of(made, issues(subject, c("name"), [("commit-subject", ~c("line").rlike(SUBJECT))]), issues(gates, c("tier"), [("empty-gate", c("command").isNull() | (c("command") == ""))]))


def promotion_issues(promotions: DataFrame) -> DataFrame:
    """Issues of module promotions (plan, source, files, proof, consumers, tests, before, after, removed array<struct<src, dst>>, edges_before, edges_after).

    The source is the one file moved; the proof lists its importers sorted and once, which are the
    consumers and tests; exactly one of a component cut (before, after) and a containment cut
    (edges_before, edges_after) is given; what is removed touches the source.
    """
    c = F.col
    cycle, containment = c("before").isNotNull(), c("edges_before").isNotNull()
    importers = F.array_union("consumers", "tests")
    rest = F.array_except("before", F.array("source"))
    touching = (F.size("removed") > 0) & F.forall("removed", lambda e: (e["src"] == c("source")) | (e["dst"] == c("source")))
    flat = F.flatten("after")
    return issues(promotions, c("source"), [
        ("single-source", ~c("files").eqNullSafe(F.array("source"))),
        ("sorted-proof", c("proof") != F.array_sort(F.array_distinct("proof"))),
        ("proof-is-importers", F.array_sort(F.array_distinct("proof")) != F.array_sort(importers)),
        ("one-cut", cycle == containment),
        ("cycle-source", cycle & ((F.size("before") < 2) | ~F.array_contains("before", c("source")))),
        ("cycle-partition", cycle & (F.array_sort(flat) != F.array_sort(rest))),
        ("cycle-smaller", cycle & F.exists("after", lambda x: F.size(x) >= F.size(c("before")))),
        ("cut-edges", ~touching),
        ("containment-metric", containment & ((c("edges_after") != c("edges_before") - F.size("removed")) | (c("edges_after") >= c("edges_before")))),
    ])


def dependency_issues(dependencies: DataFrame, references: DataFrame, owners: DataFrame) -> DataFrame:
    """Issues of dependencies (plan, name, version) and package references (plan, owner): names that can't be, empty versions, a folder for a name, repeated or unknown references. owners: (owner)."""
    known = owners.select("owner").distinct().withColumn("known", F.lit(True))
    named = dependencies.join(known.withColumnRenamed("owner", "name"), "name", "left")
    c = F.col
    own = issues(named, c("name"), [("dependency-name", ~c("name").rlike("^[a-zA-Z0-9_.@/-]+$")), ("dependency-version", c("version").isNull() | (c("version") == "")), ("dependency-folder", c("known").isNotNull())])
    per = references.groupBy("plan", "owner").agg(F.count(F.lit(1)).alias("n")).join(known, "owner", "left")
    return own.union(issues(per, c("owner"), [("repeated-reference", c("n") > 1), ("unknown-reference", c("known").isNull())]))


def migration_issues(triggered: DataFrame, recorded: DataFrame) -> DataFrame:
    """Issues of path migrations: triggered (plan, migration) not recorded (plan, migration, changes, before, after) or more than once, recorded without a trigger, no-ops whose bytes differ, changes whose bytes don't."""
    key = ["plan", "migration"]
    per = recorded.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("changes") == 0) & (F.col("before") != F.col("after"))).alias("moved"), F.bool_or((F.col("changes") > 0) & (F.col("before") == F.col("after"))).alias("still"))
    j = triggered.select(*key).distinct().withColumn("due", F.lit(True)).join(per, key, "full_outer")
    c = F.col
    return issues(j, c("migration"), [("missing-migration", c("n").isNull()), ("repeated-migration", c("n") > 1), ("untriggered-migration", c("due").isNull()), ("noop-differs", c("moved")), ("change-is-noop", c("still"))])


def path_reference_issues(recorded: DataFrame, moves: DataFrame) -> DataFrame:
    """Recorded path rewrites (plan, file, from, to, donor) whose donor isn't moved (plan, source, target), which change nothing, or whose end isn't the move's target."""
    j = recorded.join(moves.select("plan", F.col("source").alias("donor"), F.col("target").alias("lands")), ["plan", "donor"], "left")
    c = F.col
    return issues(j, c("file"), [("reference-donor", c("lands").isNull()), ("reference-noop", c("from") == c("to")), ("reference-target", c("lands").isNotNull() & (c("to") != c("lands")))])


def settings_issues(kinds: DataFrame, suites: DataFrame, roots: DataFrame) -> DataFrame:
    """Issues of settings: test kinds (plan, kind) and suites (plan, suite, kind) that repeat, suites of an unknown kind, first-party roots (plan, root) that hold each other.

    A root that lies below another is found by its folders, an equality join.
    """
    said = lambda d, column, rule: d.select("plan", F.col(column).cast("string").alias("subject"), F.lit(rule).alias("rule"))
    twice = lambda d, x: d.groupBy("plan", x).count().where("count > 1")
    parts = F.split("root", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = roots.where(F.size(parts) > 1).select("plan", "root", F.explode(above).alias("folder"))
    held = below.join(roots.select("plan", F.col("root").alias("folder")).distinct(), ["plan", "folder"], "left_semi").select("plan", "root").distinct()
    return all_of(said(twice(kinds, "kind"), "kind", "repeated-kind"), said(twice(suites, "suite"), "suite", "repeated-suite"), said(suites.join(kinds.select("plan", "kind").distinct(), ["plan", "kind"], "left_anti"), "suite", "unknown-kind"), said(held, "root", "root-overlap"))
