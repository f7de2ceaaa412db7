"""Journals replayed over file trees, their audit, and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


#: What stands for a path that holds no file.
MISSING = ""


def _touches(tree: DataFrame, ops: DataFrame) -> DataFrame:
    """(idx, path, role, after, prev, before): each path an operation meets, its state after it, and the operation and state before it.

    If every operation before it has landed, what a path holds is what the last one that met it
    leaves there, else what the tree holds; that takes a window over each path's operations, not a fold.
    """
    leaves = F.when(F.col("kind").isin("move", "delete"), F.lit(MISSING)).otherwise(F.col("result_hash"))
    met = ops.select("idx", "path", F.lit("at").alias("role"), leaves.alias("after"))
    met = met.union(ops.where("kind = 'move'").select("idx", F.col("target").alias("path"), F.lit("to"), F.coalesce("result_hash", "pre_hash")))
    w = Window.partitionBy("path").orderBy("idx", "role")
    met = met.withColumns({"prev": F.lag("idx").over(w), "left": F.lag("after").over(w)})
    live = tree.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("live"))
    before = F.when(F.col("prev").isNotNull(), F.col("left")).otherwise(F.coalesce("live", F.lit(MISSING)))
    return met.join(live, "path", "left").select("idx", "path", "role", "after", "prev", before.alias("before"))


def _judged(tree: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ops with before, to_before, prev, to_prev, done and fault; the touches)."""
    met = cut(_touches(tree, ops))
    at = met.where("role = 'at'").select("idx", "before", "prev")
    to = met.where("role = 'to'").select("idx", F.col("before").alias("to_before"), F.col("prev").alias("to_prev"))
    j = ops.join(at, "idx").join(to, "idx", "left")
    c, none = F.col, F.lit(MISSING)
    pre, result = F.coalesce("pre_hash", none), F.coalesce("result_hash", none)
    move, delete, self_move = c("kind") == "move", c("kind") == "delete", F.coalesce(c("path") == c("target"), F.lit(False))
    done = F.when(move, (c("before") == none) & (c("to_before") == F.coalesce("result_hash", "pre_hash", none)) & (c("to_before") != none)).when(delete, c("before") == none).otherwise(c("before") == result) & ~self_move
    ready = F.when(move, (c("before") == pre) & (pre != none) & (c("to_before") == none)).otherwise(c("before") == pre) & ~self_move
    made = F.when(delete, True).when(c("content").isNotNull(), F.sha2(c("content").cast("binary"), 256) == result).when(move, F.coalesce(c("result_hash") == c("pre_hash"), F.lit(True))).otherwise(False)
    fault = F.when(done, None).when(~ready, "precondition").when(~made, "result-hash")
    return j.withColumns({"done": done, "fault": fault}), met


def preconditions(tree: DataFrame, ops: DataFrame) -> DataFrame:
    """(idx, kind, path, pre_hash, state, fault) of operations that can't land if all before them have: the least idx is where the journal stops.

    tree: (path, content); ops: (idx, kind, path, target, content, pre_hash, result_hash), idx unique.
    An operation whose outcome is there already is passed over. ``precondition``: the path isn't in
    the state expected (or a move's target isn't free); ``result-hash``: what it makes hasn't the digest recorded.
    A null hash is that of a missing file.
    """
    return _judged(tree, ops)[0].where("fault IS NOT NULL").select("idx", "kind", "path", "pre_hash", F.col("before").alias("state"), "fault")


def apply_journal(tree: DataFrame, ops: DataFrame) -> DataFrame:
    """The tree (path, content) after the operations in order of idx, all or none: if one can't land (preconditions()), the tree is given back unchanged.

    Kinds: write and rewrite (content at path), move (path to target, with content if it changed),
    delete. A version of a file is made by an operation that has its content, or points to
    the version it was moved from; pointers are doubled in rounds of joins until each ends at an
    operation with content or at the tree, so chains of any length take rounds in their logarithm,
    and no text is shuffled before the last join. An empty journal leaves the tree as it is.
    """
    judged, met = _judged(tree, ops)
    judged = cut(judged.select("idx", "kind", "path", "prev", "to_prev", "done", "fault", F.col("content").isNotNull().alias("has")))
    if not judged.where("fault IS NOT NULL").isEmpty():
        return tree.select("path", "content")
    v = met.where(F.col("after") != MISSING).select("idx", "path", "prev").join(judged.select("idx", "kind", F.col("path").alias("source"), F.col("prev").alias("source_prev"), "done", "has"), "idx")
    own = F.col("has") & ~F.col("done")
    carried = (F.col("kind") == "move") & ~F.col("done")
    ends = v.select(
        "path", "idx",
        F.when(own, F.col("path")).when(carried, F.col("source")).otherwise(F.col("path")).alias("to_path"),
        F.when(own, F.col("idx")).when(carried, F.col("source_prev")).otherwise(F.col("prev")).alias("to_idx"),
        own.alias("own"),
    )
    ends = cut(ends.withColumn("open", ~F.col("own") & F.col("to_idx").isNotNull()).drop("own"))
    while not ends.where("open").isEmpty():
        far = ends.select(F.col("path").alias("to_path"), F.col("idx").alias("to_idx"), F.col("to_path").alias("p"), F.col("to_idx").alias("i"), F.col("open").alias("o"))
        ends = cut(ends.where("open").join(far, ["to_path", "to_idx"]).select("path", "idx", F.col("p").alias("to_path"), F.col("i").alias("to_idx"), F.col("o").alias("open")).union(ends.where("NOT open")))
    last = met.groupBy("path").agg(F.max_by(F.struct("after", "idx"), F.struct("idx", "role")).alias("l")).select("path", F.col("l.idx").alias("idx"), (F.col("l.after") != MISSING).alias("there"))
    final = cut(last.where("there").select("path", "idx").join(ends, ["path", "idx"]).select("path", "to_path", "to_idx"))
    made = final.where("to_idx IS NOT NULL").join(ops.select(F.col("idx").alias("to_idx"), "content"), "to_idx").select("path", "content")
    kept = final.where("to_idx IS NULL").select("path", "to_path").join(tree.select(F.col("path").alias("to_path"), "content"), "to_path").select("path", "content")
    return tree.join(last.select("path"), "path", "left_anti").select("path", "content").union(made).union(kept)


def projected(ops: DataFrame) -> DataFrame:
    """(path, result_hash): what the last operation leaves at each path that one meets; null where it leaves no file."""
    leaves = F.when(F.col("kind").isin("move", "delete"), None).otherwise(F.col("result_hash"))
    met = ops.select("path", "idx", leaves.alias("h")).union(ops.where("kind = 'move'").select("target", "idx", F.coalesce("result_hash", "pre_hash")))
    return met.groupBy("path").agg(F.max_by(F.struct("h"), "idx").alias("s")).select("path", F.col("s.h").alias("result_hash"))


def byte_fidelity(ops: DataFrame, landed: DataFrame) -> DataFrame:
    """(path, fault): paths that a journal meets which are missing, differ from what it leaves there, or survive it. landed: (path, sha256)."""
    j = projected(ops).join(landed.select("path", F.col("sha256").alias("live")), "path", "left")
    fault = F.when(F.col("result_hash").isNull() & F.col("live").isNotNull(), "survives").when(F.col("result_hash").isNotNull() & F.col("live").isNull(), "missing").when(~F.col("result_hash").eqNullSafe(F.col("live")), "differs")
    return j.select("path", fault.alias("fault")).where("fault is not null")


def operation_counts(ops: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, n) of every kind, zero-filled."""
    every = ops.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(ops.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


#: Operations that a task counts, more or less.
COUNTED = 500_000


def duplicate_operations(ops: DataFrame, rows: int) -> DataFrame:
    """(kind, path, n) of operations that occur more than once. rows: about how many there are, for the number of tasks.

    Nearly all differ, so counting before the shuffle holds a task's operations beside what its joins sort and saves nothing.
    """
    parts = ops.select("kind", "path").repartition(-(-rows // COUNTED) or 1, "kind", "path")
    return parts.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ledger_issues(ledger: DataFrame) -> DataFrame:
    """(campaign, seq, issue) of an append-only ledger (campaign, seq, id, kind, baseline, status, audit_passed): gaps, repeated ids, changed baselines, applied without a passed audit."""
    w = Window.partitionBy("campaign").orderBy("seq")
    by_id = Window.partitionBy("campaign", "id").orderBy("seq")
    x = ledger.withColumns({"before": F.lag("seq").over(w), "base": F.first("baseline").over(w), "nth": F.row_number().over(by_id)})
    rules = F.array_compact(F.array(
        F.when(F.coalesce(F.col("seq") != F.col("before") + 1, F.lit(False)), "sequence"),
        F.when(F.col("nth") > 1, "repeated-id"),
        F.when(~F.col("baseline").eqNullSafe(F.col("base")), "stale-baseline"),
        F.when((F.col("status") == "applied") & ~F.coalesce("audit_passed", F.lit(False)), "unaudited"),
    ))
    return x.select("campaign", "seq", F.explode(rules).alias("issue"))


def lifecycle(rows: DataFrame) -> DataFrame:
    """rows with state, from the flags applied, audited, reconciled, dirty, stale, failed and planned."""
    c = F.col
    state = F.when(c("failed"), "failed").when(c("applied") & c("audited") & c("reconciled"), "reconciled").when(c("applied") & c("audited"), "verified").when(c("applied"), "applied").when(c("stale"), "stale").when(c("dirty"), "dirty").when(c("planned"), "planned").otherwise("unknown")
    return rows.withColumn("state", state)


def qualification(diagnostics: DataFrame, key: str) -> DataFrame:
    """(key, status, exit_code) of (key, severity, allowed_empty): fatal before degraded before allowed-empty before qualified."""
    g = diagnostics.groupBy(key).agg(F.bool_or(F.col("severity") == "fatal").alias("f"), F.bool_or(F.col("severity") == "degraded").alias("d"), F.bool_or("allowed_empty").alias("e"))
    status = F.when(F.col("f"), "fatal").when(F.col("d"), "degraded").when(F.col("e"), "allowed-empty").otherwise("qualified")
    code = F.when(F.col("f"), 1).when(F.col("d"), 2).otherwise(0)
    return g.select(key, status.alias("status"), code.alias("exit_code"))
