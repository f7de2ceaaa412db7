"""Compiling a plan as relations: its journal in order, dependencies and their decisions, effects, records and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conflicts import STRUCTURED

# The phases of a journal, the precedence of conflict categories, and the kinds that a consolidation does first.
PHASES = ("move", "move-asset", "rewrite-path-reference", "rewrite-import", "rewrite-fs-reference", "write-file", "prune", "migrate-path-keys")
CATEGORIES = (
    ("generated-artifact", ("generated-artifact", "generated-source")),
    ("moved-path", ("move-source", "move-target")),
    ("consumer-source", ("consumer-source",)),
    ("lockfile-importer", ("lockfile-importer",)),
    ("workspace-registry", ("workspace-registry",)),
    ("task-registry", ("task-registry",)),
    ("path-key-artifact", ("path-key-artifact",)),
    ("package-manifest", ("package-manifest", "consumer-manifest")),
    ("project-references", ("consumer-project-references",)),
    ("scaffold-output", ("scaffold-output", "entrypoint", "task-file")),
)
CONSOLIDATION = ("rewrite-import", "move", "move-with-rewrite")


def journal(*phases: tuple[str, DataFrame]) -> DataFrame:
    """(plan, idx, kind, path, target): the operations (plan, path, target) of each phase in the order of PHASES, within a phase by path; idx runs from 0 in each plan."""
    rows = reduce(DataFrame.unionByName, [d.select("plan", "path", F.col("target").cast("string").alias("target"), F.lit(kind).alias("kind"), F.lit(PHASES.index(kind)).alias("phase")) for kind, d in phases])
    order = F.row_number().over(Window.partitionBy("plan").orderBy("phase", "path", "target"))
    return rows.select("plan", (order - 1).cast("long").alias("idx"), "kind", "path", "target")


def consolidated(ops: DataFrame) -> DataFrame:
    """ops (plan, idx, kind, ...) in a consolidation's order: import rewrites, then moves, then the rest, each as they were."""
    rank = F.when(F.col("kind") == CONSOLIDATION[0], 0).when(F.col("kind").isin(*CONSOLIDATION[1:]), 1).otherwise(2)
    return ops.withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy(rank, "idx")).cast("long"))


def category(roles: Column) -> Column:
    """The category of the most specific role at a path."""
    out = F.lit("shared-path")
    for name, some in reversed(CATEGORIES):
        out = F.when(F.arrays_overlap(roles, F.array(*map(F.lit, some))), name).otherwise(out)
    return out


def conflict_report(acc: DataFrame) -> DataFrame:
    """(path, plans, category, disposition) of paths that several plans write (plan, path, role, keys): mergeable if all are one structured role with keys that no two plans share.

    Counted by path and by key, so a path that many plans touch costs its rows, not their pairs.
    """
    per = acc.groupBy("path").agg(F.countDistinct("plan").alias("plans"), F.collect_set("role").alias("roles"), F.bool_and(F.size("keys") > 0).alias("keyed")).where("plans > 1")
    shared = acc.select("path", "plan", F.explode("keys").alias("key")).distinct().groupBy("path", "key").count().where("count > 1").select("path").distinct().withColumn("shared", F.lit(True))
    merge = (F.size("roles") == 1) & F.get("roles", 0).isin(*STRUCTURED) & F.col("keyed") & F.col("shared").isNull()
    return per.join(shared, "path", "left").select("path", "plans", category(F.col("roles")).alias("category"), F.when(merge, "mergeable").otherwise("exclusive").alias("disposition"))


def inferred(uses: DataFrame, versions: DataFrame, own: DataFrame) -> DataFrame:
    """(plan, name, section, version, fault) from uses (plan, file, name, type_only, test): runtime if some production file needs the value, else dev; the version must be one (plan, name, version). What the plan owns (plan, name) is none."""
    need = uses.join(own.select("plan", "name").distinct(), ["plan", "name"], "left_anti")
    per = need.groupBy("plan", "name").agg(F.bool_or(~F.col("type_only") & ~F.col("test")).alias("value"))
    known = versions.groupBy("plan", "name").agg(F.countDistinct("version").alias("k"), F.min("version").alias("v"))
    j = per.join(known, ["plan", "name"], "left")
    return j.select("plan", "name", F.when(F.col("value"), "runtime").otherwise("dev").alias("section"), F.when(F.col("k") == 1, F.col("v")).alias("version"), F.when(F.col("k").isNull(), "undeclared").when(F.col("k") > 1, "ambiguous").alias("fault"))


def with_jsx_runtime(found: DataFrame, sources: DataFrame, profiles: DataFrame, declared: DataFrame, root_version: str | None, runtime: str = "react") -> DataFrame:
    """inferred() with the runtime that compiled JSX imports by itself: a runtime dependency of each plan whose profile (plan, jsx) compiles JSX and which moves a .tsx source (plan, file, owner).

    Its version is the one that the donating owners declare (owner, version), else the workspace root's; none is the
    fault ``undeclared``, several are ``ambiguous``. It replaces an entry that was inferred for the same name.
    """
    due = sources.where(F.col("file").endswith(".tsx")).select("plan").distinct().join(profiles.where("jsx").select("plan"), "plan", "left_semi")
    versions = sources.select("plan", "owner").distinct().join(declared.where("version IS NOT NULL"), "owner").groupBy("plan").agg(F.countDistinct("version").alias("k"), F.min("version").alias("v"))
    j = due.join(versions, "plan", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    version = F.when(F.col("k") == 1, F.col("v")).when(F.col("k") == 0, F.lit(root_version))
    mine = j.select("plan", F.lit(runtime).alias("name"), F.lit("runtime").alias("section"), version.alias("version"), F.when(F.col("k") > 1, "ambiguous").when(version.isNull(), "undeclared").alias("fault"))
    others = found.join(mine.select("plan", "name"), ["plan", "name"], "left_anti").select("plan", "name", "section", "version", "fault")
    return others.union(mine)


def decisions(found: DataFrame, uses: DataFrame, pruned: DataFrame, apply: bool) -> DataFrame:
    """(plan, name, decision, reasons, sources): each inferred dependency with why, and each donor's dependency that nothing needs any more (plan, name)."""
    why = F.when(F.col("test"), "test-import").when(F.col("type_only"), "type-only-import").otherwise("production-import")
    per = uses.groupBy("plan", "name").agg(F.array_sort(F.collect_set(why)).alias("reasons"), F.countDistinct("file").alias("sources"))
    mine = found.join(per, ["plan", "name"], "left").select("plan", "name", F.concat(F.lit("target-"), "section").alias("decision"), "reasons", "sources")
    gone = pruned.select("plan", "name", F.lit("donor-remove" if apply else "donor-review").alias("decision"), F.array(F.lit("no-retained-consumer")).alias("reasons"), F.lit(0).cast("long").alias("sources"))
    return mine.union(gone)


def effect_inventory(moved: DataFrame, generated: DataFrame, reached: DataFrame, packages: DataFrame) -> DataFrame:
    """(origin, kind, n, first): effects (path, kind) of what moves, is generated, is reached beyond it, and of packages."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(o).alias("origin"), F.col("path").cast("string").alias("path"), "kind") for o, d in (("moved", moved), ("generated", generated), ("reached", reached), ("package", packages))])
    return rows.groupBy("origin", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


def unreachable_assets(edges: DataFrame, moved: DataFrame, assets: DataFrame, tests: DataFrame) -> DataFrame:
    """(importer, asset): moved files that import an asset, that nothing but tests imports, and whose assets nothing that stays imports: the bundler may drop them. All are (id)."""
    e = edges.select("src", "dst").distinct()
    live = e.join(tests.select(F.col("id").alias("src")), "src", "left_anti")
    uses = e.join(moved.select(F.col("id").alias("src")), "src", "left_semi").join(assets.select(F.col("id").alias("dst")), "dst", "left_semi")
    wanted = live.select(F.col("dst").alias("src")).distinct()
    outside = live.join(moved.select(F.col("id").alias("src")), "src", "left_anti").select("dst").distinct()
    kept = uses.join(outside, "dst", "left_semi").select("src").distinct()
    return uses.join(wanted, "src", "left_anti").join(kept, "src", "left_anti").select(F.col("src").alias("importer"), F.col("dst").alias("asset"))


def refresh(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, change, fields): what a plan compiled again says otherwise, field by field."""
    a, b = old.select(*key, F.struct(*fields).alias("__a")), new.select(*key, F.struct(*fields).alias("__b"))
    j = a.join(b, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), f) for f in fields]))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(differs) > 0, "changed")
    return j.select(*key, change.alias("change"), F.when(change == "changed", differs).otherwise(F.array().cast("array<string>")).alias("fields")).where("change is not null")


def review(ops: DataFrame, lines: DataFrame) -> DataFrame:
    """(plan, operations, moves, rewrites, writes, moved_lines, largest): the summary that a reviewer reads; lines (source, line_count)."""
    j = ops.join(lines, "source", "left")
    kind, move = F.col("kind"), F.col("kind").startswith("move")
    return j.groupBy("plan").agg(F.count(F.lit(1)).alias("operations"), F.count_if(move).alias("moves"), F.count_if(kind.startswith("rewrite")).alias("rewrites"), F.count_if(kind.isin("write-file", "delete-file")).alias("writes"), F.coalesce(F.sum(F.when(move, F.col("line_count"))), F.lit(0)).alias("moved_lines"), F.max_by(F.when(move, F.col("source")), F.when(move, F.struct("line_count", "source"))).alias("largest"))


def review_line() -> Column:
    """A row of review() as text."""
    return F.concat_ws(" ", F.concat("plan", F.lit(":")), "operations", F.lit("operations,"), "moves", F.lit("moves of"), "moved_lines", F.lit("lines, largest"), F.coalesce("largest", F.lit("none")))


def metrics(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """(application, moved_files, moved_lines, lines_before, lines_after) of nodes (path, application, line_count) and moved (path)."""
    j = nodes.join(moved.select("path").distinct().withColumn("m", F.lit(True)), "path", "left")
    taken = F.coalesce(F.sum(F.when(F.col("m"), F.col("line_count"))), F.lit(0))
    return j.groupBy("application").agg(F.count_if("m").alias("moved_files"), taken.alias("moved_lines"), F.sum("line_count").alias("lines_before"), F.greatest(F.lit(0), F.sum("line_count") - taken).alias("lines_after"))


def import_operations(rewrites: DataFrame, owned: DataFrame) -> DataFrame:
    """(file, rewrites, before, after, dynamic): one operation for each importer of rewrites (file, text, from, to, dynamic), with the hashes of its text and of the text rewritten; files that a generator owns (file) are skipped.

    Specifiers are quoted, so one that begins another isn't touched by it.
    """
    mine = rewrites.join(owned.select("file").distinct(), "file", "left_anti")
    per = mine.groupBy("file").agg(F.first("text").alias("text"), F.array_sort(F.collect_set(F.struct("from", "to"))).alias("pairs"), F.count_if("dynamic").alias("dynamic"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    after = F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(t, quoted(p["from"]), quoted(p["to"])))
    return per.select("file", F.size("pairs").cast("long").alias("rewrites"), F.sha2("text", 256).alias("before"), F.sha2(after, 256).alias("after"), "dynamic")


def pruned_section(manifest: Column, gone: Column) -> Column:
    """A dependency section (map) without some names; null once it is empty."""
    left = F.map_filter(manifest, lambda k, _: ~F.array_contains(gone, k))
    return F.when(F.size(left) > 0, left)


def generated_records(headers: DataFrame, triggered: DataFrame, preparers: DataFrame) -> DataFrame:
    """(path, origin): generated files by their header, by a trigger and by a preparer, each path once, in that order of precedence."""
    rows = reduce(DataFrame.unionByName, [d.select("path", F.lit(o).alias("origin"), F.lit(i).alias("rank")) for i, (o, d) in enumerate((("header", headers), ("trigger", triggered), ("preparer", preparers)))])
    return rows.groupBy("path").agg(F.min_by("origin", "rank").alias("origin"))


def rendered_moves(moves: DataFrame) -> DataFrame:
    """(source, target, kind, pre, post) of moves (source, target, text, rewritten): byte-identical if nothing is rewritten."""
    same = F.coalesce(F.col("rewritten") == F.col("text"), F.lit(True))
    return moves.select("source", "target", F.when(same, "move").otherwise("move-with-rewrite").alias("kind"), F.sha2("text", 256).alias("pre"), F.sha2(F.coalesce("rewritten", "text"), 256).alias("post"))


def public_subpaths(modules: DataFrame, prefix: str, extension: str) -> DataFrame:
    """(source, key, target, clash) of modules (source, module): the export key and target from templates; keys and targets must each be unique."""
    bare = F.regexp_replace("module", r"\.[A-Za-z0-9]+$", "")
    rows = modules.select("source", F.concat(F.lit(prefix), bare).alias("key"), F.concat(F.lit(prefix + "src/"), bare, F.lit(extension)).alias("target"))
    twice = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) > 1
    return rows.withColumn("clash", twice("key") | twice("target"))


def changed_files(ops: DataFrame, generated: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path): what a plan changes: the paths of its operations (path), generated files and preparers' outputs, each once."""
    return ops.select("path").union(generated.select("path")).union(outputs.select("path")).distinct()


def owned_outputs(outputs: DataFrame, rewrites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrites (path) that a generator's outputs (path) exclude, and those that stay."""
    own = outputs.select("path").distinct()
    return rewrites.join(own, "path", "left_semi"), rewrites.join(own, "path", "left_anti")


def dirty_paths(dirty: DataFrame, guarded: DataFrame) -> DataFrame:
    """(path) of dirty paths that hold, or lie in, a guarded path; met by ancestors, an equality join either way."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = dirty.select("path", F.explode(above).alias("at")).join(guarded.select(F.col("path").alias("at")).distinct(), "at", "left_semi").select("path")
    holds = dirty.join(guarded.select(F.explode(above).alias("path")).distinct(), "path", "left_semi").select("path")
    return inside.union(holds).distinct()


def receipt_faults(receipts: DataFrame, records: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, fault) of receipts (id, record, digest, commit): a record that isn't there, a digest that isn't the record's (record, digest), a commit that isn't in the chain (commit)."""
    j = receipts.join(records.select("record", F.col("digest").alias("is")), "record", "left").join(chain.select("commit").distinct().withColumn("linked", F.lit(True)), "commit", "left")
    fault = F.when(F.col("is").isNull(), "no-record").when(F.col("digest") != F.col("is"), "digest").when(F.col("linked").isNull(), "unlinked")
    return j.select("id", fault.alias("fault")).where("fault is not null")


def folder_members(paths: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(folder, name, kind): what each folder of the paths holds, files and folders, without excluded names.

    One row a member: a folder of any size is no single row.
    """
    parts = F.split("path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.get(parts, i - 1).alias("name"), F.when(i == F.size(parts), "file").otherwise("folder").alias("kind")))).alias("m")).select("m.*")
    return each.where(~F.col("name").isin(*excluded) if excluded else F.lit(True)).distinct()


def canonical_inputs(paths: DataFrame, root: str, installed: str) -> DataFrame:
    """(path, namespace, name) of absolute paths: in the repository by its relative name, installed by package and file, external by the whole path."""
    inside = F.col("path").startswith(root + "/")
    below = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    package = F.element_at(F.split("path", f"/{installed}/"), -1)
    space = F.when(F.col("path").contains(f"/{installed}/"), "installed").when(inside, "repository").otherwise("external")
    return paths.select("path", space.alias("namespace"), F.when(space == "installed", package).when(space == "repository", below).otherwise(F.col("path")).alias("name"))


def availability(reports: DataFrame, needs: DataFrame) -> DataFrame:
    """(report, state, lacking): a derived report is available if all it needs (report, need) are (report, available)."""
    j = needs.join(reports.select(F.col("report").alias("need"), "available"), "need", "left")
    lacking = F.array_sort(F.collect_set(F.when(~F.coalesce("available", F.lit(False)), F.col("need"))))
    return j.groupBy("report").agg(lacking.alias("lacking")).select("report", F.when(F.size("lacking") == 0, "available").otherwise("unavailable").alias("state"), "lacking")


def phases(entries: DataFrame) -> DataFrame:
    """(campaign, phase, next): where a campaign stands by its last entry (campaign, seq, kind, status), and what comes next."""
    last = entries.groupBy("campaign").agg(F.max_by(F.struct("kind", "status"), "seq").alias("last"), F.count_if(F.col("status") == "applied").alias("applied"))
    done, kind = F.col("last.status") == "applied", F.col("last.kind")
    phase = F.when(F.col("last.status") == "stopped", "stopped").when(done, F.concat(kind, F.lit("-applied"))).otherwise(F.concat(kind, F.lit("-planned")))
    step = F.when(F.col("last.status") == "stopped", "none").when(~done, "apply").when(kind == "preparation", "plan").otherwise("record")
    return last.select("campaign", phase.alias("phase"), step.alias("next"), "applied")


def unauthorized(touched: DataFrame, roots: DataFrame, granted: DataFrame) -> DataFrame:
    """(path, root): touched paths (path) under a protected root (root) without a grant for that root (root) or for the very path (root)."""
    parts = F.split("path", "/")
    above = touched.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    held = above.join(roots.select("root").distinct(), "root", "left_semi")
    ok = granted.select("root").distinct()
    return held.join(ok, "root", "left_anti").join(ok.withColumnRenamed("root", "path"), "path", "left_anti").select("path", "root")


def inclusion_faults(included: DataFrame, composition: DataFrame, proofs: DataFrame) -> DataFrame:
    """(path, fault): composition files (path) that a move includes (path) without a proof (path), and proofs of what isn't included."""
    need = included.join(composition.select("path").distinct(), "path", "left_semi")
    said = lambda d, f: d.select("path", F.lit(f).alias("fault")).distinct()
    return said(need.join(proofs, "path", "left_anti"), "no-proof").union(said(proofs.join(need, "path", "left_anti"), "idle-proof"))


def symbol_seams(refs: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """(a, b, space, n, crossing): references (src, dst, space) between symbols' files (id, file), and whether they cross from moved files (file) to others."""
    e = refs.join(files.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b")
    m = moved.select("file").distinct()
    flag = lambda c, n: m.select(F.col("file").alias(c), F.lit(True).alias(n))
    j = e.join(flag("a", "ma"), "a", "left").join(flag("b", "mb"), "b", "left")
    crossing = F.col("ma").isNotNull() != F.col("mb").isNotNull()
    return j.groupBy("a", "b", "space").agg(F.count(F.lit(1)).alias("n"), F.first(crossing).alias("crossing"))
