"""Compiling, rewriting, recording and reviewing as queries; their SQL is in oracle_moves.py."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .bindings import edges, modules, table
from .config import Application, Config
from .operators import closures, evacuation, graph, portfolio, references, rewrites, symbols, windows
from .plans import audit, build, preparations, validation
from .queries import CONFIG, _candidates, _judged, _references, _uses
from .queries_plans import operations, rewrite_donors, role
from .session import cut, shared_dir
from .sources import lockfiles, records, scan, workspace
from .streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


# Rewrites of references


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("u"))


@query
def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address named in four ways, where a third of the addresses move."""
    p = _addresses(spark, sf_dir)
    text = F.concat(F.lit("see "), "u", F.lit(" or /srv/"), "u", F.lit(" or ./"), F.translate("u", "/", "\\"), F.lit(" or x/"), "u")
    each = p.select("page_id", F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_@.\-\\/]+"), F.lit(0))).alias("token"))
    moves = p.where("page_id % 3 = 0").groupBy(F.col("u").alias("source")).agg(F.concat(F.lit("moved/"), F.min("page_id")).alias("target"))
    return rewrites.path_rewrites(each.select(F.col("page_id").alias("file"), F.lit(0).alias("start"), "token"), moves).select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "from", "to", "donor")


@query
def path_reference_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By domain of address: how many strings in how many files name a path that moves, and the first."""
    r = path_rewrites(spark, sf_dir).select(F.element_at(F.split(F.split("donor", "/")[0], r"\."), -1).alias("group"), "file", "donor")
    return r.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.min(F.struct("file", "donor")).alias("m")).select("group", "n", "files", F.concat_ws(":", F.col("m.file"), F.col("m.donor")).alias("first"))


@query
def literal_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat("p_name", F.lit("'s"))).when(k % 5 == 1, F.concat(F.lit("${"), "p_name", F.lit("}"))).when(k % 5 == 2, F.concat("p_name", F.lit("\\"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", rewrites.fits_literal(text, F.get(F.array(F.lit('"'), F.lit("'"), F.lit("`"), F.lit("/")), (k % 4).cast("int"))).alias("fits"))


@query
def specifier_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import lines of modules: the quoted specifier becomes the package of the part imported."""
    e = edges(spark, sf_dir).join(modules(spark, sf_dir).select(F.col("path").alias("dst"), "owner"), "dst")
    mark = F.when(F.col("src") % 2 == 0, "'").otherwise('"')
    old = F.concat(F.lit("./"), "dst")
    text = F.concat(F.lit("import x from "), mark, old, mark, F.lit("; // "), old)
    spans = e.select("src", "dst", text.alias("text"), F.lit(14).alias("start"), (F.length(old) + 16).alias("end"), F.concat(F.lit("@engine/"), F.lower("owner"), F.when(F.col("dst") % 7 == 0, "'s").otherwise("")).alias("to"))
    return rewrites.specifier_rewrites(spans).select("src", "dst", "rewritten")


@query
def codemod_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites done again: those whose recorded hash isn't that of the text rewritten now."""
    r = specifier_rewrites(spark, sf_dir).where("rewritten is not null")
    recorded = F.sha2(F.when(F.col("dst") % 13 == 0, F.concat("rewritten", F.lit(" "))).otherwise(F.col("rewritten")), 256)
    return r.where(recorded != F.sha2("rewritten", 256)).select("src", "dst")


@query
def escape_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of what a file imports from other owners, one row a file."""
    of = modules(spark, sf_dir).select("path", "owner")
    e = edges(spark, sf_dir, 45).join(of.select(F.col("path").alias("src"), F.col("owner").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("owner").alias("b")), "dst").where("a <> b")
    return e.groupBy(F.col("src").alias("file")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("./"), "dst", F.lit(">@engine/"), F.lower("b")))), " ").alias("rewrites"))


@query
def import_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation for each importer; every thirteenth file is a generator's."""
    e = edges(spark, sf_dir, 45)
    text = e.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda d: F.concat(F.lit('import "./'), d, F.lit('";'))), "\n").alias("text"))
    r = e.join(text, "src").select(F.col("src").alias("file"), "text", F.concat(F.lit("./"), "dst").alias("from"), F.concat(F.lit("@engine/p"), "dst").alias("to"), "dynamic")
    return build.import_operations(r, modules(spark, sf_dir).where("path % 13 = 0").select(F.col("path").alias("file")))


@query
def fs_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static file references of modules to parts that move: the new relative path from the referring folder."""
    m = modules(spark, sf_dir).select("path", "file", "owner")
    e = edges(spark, sf_dir).join(m.select(F.col("path").alias("src"), F.col("file").alias("source")), "src").join(m.where("path % 4 = 0").select(F.col("path").alias("dst"), F.lower("owner").alias("o")), "dst")
    return e.select("source", F.concat(F.lit("../"), "o", F.lit("/"), "dst").alias("from"), F.concat(F.lit("../../libs/"), "o", F.lit("/src/"), "dst").alias("to"))


@query
def emitted_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path", "file", "owner")
    e = edges(spark, sf_dir).join(m.select(F.col("path").alias("dst"), F.lower("owner").alias("o")), "dst")
    texts = e.select(F.col("src").alias("file"), F.concat(F.lit('{"a": "../'), "o", F.lit("/./"), "dst", F.lit('.js", "b": "./gone.js"}')).alias("text"))
    moves = m.where("path % 3 <> 0").select(F.concat("file", F.lit(".ts")).alias("source"), F.concat(F.lit("libs/"), "path", F.lit(".ts")).alias("target"))
    return rewrites.emitted_specifiers(texts, moves, "src/promo")


@query
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages; the tree has some of the files that they name."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    at = lambda n, keep: F.when(keep, F.concat(F.lit("./"), F.lit(n)))
    packages = s.select(F.concat(F.lit("libs/"), k).alias("owner"), at("whole.ts", k % 5 == 0).alias("whole"), at("import.ts", k % 2 == 0).alias("on_import"), at("default.ts", k % 3 == 0).alias("on_default"), at("types.d.ts", k % 7 == 0).alias("on_types"), at("main.ts", k % 4 != 0).alias("main"), at("index.d.ts", F.lit(True)).alias("types"))
    names = F.explode(F.array(*map(F.lit, ("whole.ts", "import.ts", "default.ts", "types.d.ts", "main.ts", "index.d.ts"))))
    tree = s.select(k.alias("k"), names.alias("n")).where((F.col("k") + F.length("n")) % 3 != 0).select(F.concat(F.lit("libs/"), "k", F.lit("/"), "n").alias("path"))
    return rewrites.entry_points(packages, tree)


@query
def alias_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    spec = F.when(F.col("path") % 4 == 0, F.concat(F.lit("@/"), "file")).when(F.col("path") % 4 == 1, F.concat(F.lit("~"), F.lower("owner"), F.lit(".css"))).when(F.col("path") % 4 == 2, "config").otherwise(F.concat(F.lit("./"), "path"))
    return m.select("path", rewrites.alias_path(spec, [("config", "src/config.ts"), ("@/*", "app/*.ts"), ("~*.css", "styles/*.css"), ("@/src/*", "never/*")]).alias("resolved"))


@query
def target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where parts land: as they stood, or in an asked folder of the package."""
    m = modules(spark, sf_dir)
    k = F.col("path")
    path = F.when(k % 4 == 0, F.concat(F.lit("apps/web/"), "file")).when(k % 4 == 1, F.concat(F.lit("libs/p"), k, F.lit("/src/a/"), k, F.lit(".ts"))).when(k % 4 == 2, F.concat(F.lit("libs/p"), k, F.lit("/"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("other/"), k))
    asked = F.when(k % 3 == 0, F.get(F.array(*map(F.lit, ("src", "./src/deep/", "src/../x", "/src", "lib", "src\\win"))), (k % 6 + F.when(k % 2 == 0, 1).otherwise(0)).cast("int") % 6))
    sub, relative = rewrites.target_subpath(asked), rewrites.target_relative(path, ("apps/web",), ("libs",))
    return m.select("path", relative.alias("relative"), sub.alias("subpath"), rewrites.module_path(path, sub, relative).alias("module"))


@query
def extension_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, 45)
    ending = F.get(F.array(*map(F.lit, (".ts", ".tsx", "", ".css", ".mjs"))), (F.col("dst") % 5).cast("int"))
    refs = e.select(F.col("src").alias("file"), F.col("dst").alias("line"), F.concat(F.when(F.col("dst") % 2 == 0, "./").otherwise("pkg/"), "dst", ending).alias("specifier"))
    return rewrites.extension_violations(refs, (".ts", ".tsx", ".css"))


@query
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", rewrites.excerpt(F.col("text"), 40, 20).alias("excerpt"))


@query
def trimmed_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text before and after a line in the middle is changed: how many are common at both ends."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("a"))
    b = F.transform("a", lambda x, i: F.when(i == F.floor(F.size("a") / 2), F.concat(x, F.lit("!"))).otherwise(x))
    front, back = rewrites.common_ends(F.col("a"), b)
    return d.select("doc_id", front.cast("long").alias("front"), back.cast("long").alias("back"), (F.size("a") - front - back).cast("long").alias("changed"))


# Candidates


@query
def recommendation_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(_candidates(spark, sf_dir)[3])
    return j.select(F.explode("advice").alias("advice"), "status").groupBy("advice", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def candidate_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(_candidates(spark, sf_dir)[3])
    return j.select("id", F.col("review_units").cast("long").alias("review_units"), "risk", "cohesion", "files", "tests", "assets", "consumers", "escapes", "warnings", F.col("rejections").cast("long").alias("blockers"))


@query
def candidate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners as candidates: blocked by code that must stay, or alone in a domain that is no target."""
    m, e = modules(spark, sf_dir), edges(spark, sf_dir)
    files = m.select(F.concat_ws("/", "owner", "domain").alias("cand"), "path")
    blocked = evacuation.retained_blockers(files, e, m.where("path % 50 = 0")).groupBy("cand").agg(F.count(F.lit(1)).alias("blockers"))
    facts = m.groupBy(F.concat_ws("/", "owner", "domain").alias("cand")).agg(F.min("domain").alias("only")).join(blocked, "cand", "left").fillna(0, ["blockers"])
    return facts.select("cand", "blockers", portfolio.classification(F.col("blockers"), F.lit(1), F.col("only"), "Brand#3", True).alias("class"))


@query
def first_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("detail"), "l_linenumber", "l_partkey")  # noqa: E741
    return portfolio.first_reasons(l, "id", ["l_linenumber", "l_partkey"])


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).select(F.col("domain").alias("cand"), F.concat("file", F.when(F.col("path") % 2 == 0, ".ts").otherwise("/a.ts")).alias("path"), role().alias("role"))


@query
def candidate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    d = portfolio.detail_view(c.union(c.where("role = 'test'")))
    return d.select("cand", *[F.array_join(x, ",").alias(x) for x in ("files", "tests", "assets")], F.size("closure").cast("long").alias("closure"))


@query
def claiming_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    out = None
    for x in ("./src/promo/", "src/small/1", "src/economy/29"):
        one = portfolio.claiming(c, x).select(F.lit(x).alias("path"), "cand")
        out = one if out is None else out.union(one)
    return out


@query
def evaluation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evaluating a domain's modules reaches: effectful ones, those beyond it, and the three riskiest packages."""
    e, m = edges(spark, sf_dir), modules(spark, sf_dir)
    seed = m.where("domain = 'Brand#1'").select(F.col("path").alias("id"))
    found = evacuation.evaluation_reach(e, seed).select(F.col("id").alias("path")).join(m, "path")
    eff = found.where("path % 4 = 0")
    ranked = found.groupBy("owner").agg(F.min(F.col("path") % 4).alias("rank")).orderBy("rank", "owner").limit(3)
    a = found.agg(F.count(F.lit(1)).alias("modules"))
    b = eff.agg(F.count(F.lit(1)).alias("effectful"), F.count_if(F.expr("domain <> 'Brand#1'")).alias("beyond"), F.min("path").alias("first"))
    c = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "owner"))), lambda x: x["owner"]), ",").alias("packages"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


@query
def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that several customers' orders touch, in roles by line number."""
    roles = ("consumer-source", "lockfile-importer", "move-target", "generated-source", "task-file", "package-manifest", "workspace-registry")
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    acc = l.select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("path"), F.get(F.array(*map(F.lit, roles)), ((F.col("l_partkey") + F.when(F.col("l_quantity") > 49, F.col("l_linenumber")).otherwise(0)) % 7).cast("int")).alias("role"), F.array((F.col("l_suppkey") * 100 + F.col("l_orderkey") % 100).cast("string")).alias("keys"))
    return build.conflict_report(acc)


# Sets


@query
def owners_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of what orders touch: domains and owners, without repeats."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("path")).join(modules(spark, sf_dir).select("path", "domain", "owner"), "path")  # noqa: E741
    return l.groupBy("l_orderkey").agg(joined(F.array_sort(F.array_union(F.collect_set("domain"), F.collect_set("owner")))).alias("names"))


@query
def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that sell every one of a brand's sizes above 45 that the brand has."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size > 45"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey", "p_size").distinct()  # noqa: E741
    n = l.groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"))
    return l.groupBy("p_brand", "l_suppkey").agg(F.count(F.lit(1)).alias("k")).join(n, "p_brand").where("k = n").select("p_brand", "l_suppkey")


@query
def unselected_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = edges(spark, sf_dir), modules(spark, sf_dir)
    chosen = m.where("path % 4 = 0").select(F.col("path").alias("id"))
    return e.join(chosen, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(chosen, "id", "left_anti")


@query
def equal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by whether the suppliers before their fourth line are those from it on."""
    side = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("l_suppkey") % 3)))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side(F.col("l_linenumber") < 4).alias("a"), side(F.col("l_linenumber") >= 4).alias("b"))
    return g.select("l_orderkey", (F.col("a") == F.col("b")).alias("equal"))


@query
def last_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several suppliers on parts, one after another: the last on each part counts."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("report")).agg(F.sum("l_linenumber").alias("value"))  # noqa: E741
    return windows.last_writer(l, ["path"], [F.desc("report")])


@query
def sorted_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order years with 1995 put in its place, once."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("y"))
    return o.select("o_custkey", joined(F.array_sort(F.array_union("y", F.array(F.lit(1995))))).alias("years"))


@query
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by owner and domain, with subtotals, and how near the approximate count of names comes."""
    m = table(spark, sf_dir, "part")
    level = F.grouping_id().cast("long").alias("level")
    # Beside a distinct count, the sketch would be kept for each key of each group (3 KB each), so it is taken apart.
    r = m.rollup("p_type", "p_brand").agg(level, F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), F.approx_count_distinct("p_partkey", 0.02).alias("about"))
    d = m.rollup("p_type", "p_brand").agg(level, F.countDistinct("p_partkey").alias("keys")).select(F.col("p_type").alias("t"), F.col("p_brand").alias("b"), F.col("level").alias("l"), "keys")
    j = r.join(d, F.col("p_type").eqNullSafe(F.col("t")) & F.col("p_brand").eqNullSafe(F.col("b")) & (F.col("level") == F.col("l")))
    return j.select("p_type", "p_brand", "level", "n", "size", (F.abs(F.col("about") - F.col("keys")) <= 0.2 * F.col("keys")).alias("near"))


@query
def consumer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("package")).agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "runtime").otherwise("dev").alias("section"))


@query
def declaration_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("file")).agg(F.count(F.lit(1)).alias("declarations"), F.countDistinct("p_name").alias("names"), F.count_if(F.expr("p_retailprice >= 1000")).alias("exported"), F.max("p_size").alias("largest"))


# Compiling


def _phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).select(F.col("owner").alias("plan"), F.col("path").alias("k"), F.col("file").alias("path"), F.concat(F.lit("libs/"), F.lower("owner"), F.lit("/src/"), "path").alias("target"))


@query
def journal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _phase(spark, sf_dir)
    bare = lambda keep: m.where(keep).select("plan", "path", F.lit(None).cast("string").alias("target"))
    return build.journal(("write-file", bare("k % 7 = 0")), ("move-asset", m.where("k % 10 = 7")), ("rewrite-import", bare("k % 4 = 1")), ("move", m.where("k % 3 = 0 and k % 10 <> 7")), ("migrate-path-keys", bare("k % 97 = 0")), ("rewrite-path-reference", bare("k % 11 = 0")))


@query
def plan_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan compiled end to end for each owner: its journal's length, first and last operation, moves, and what breaks a rule."""
    j, bad = journal_order(spark, sf_dir), validation.operation_issues(operations(spark, sf_dir), modules(spark, sf_dir).select(F.col("owner").alias("plan"), "file"), "libs", rewrite_donors(operations(spark, sf_dir)))
    a = j.groupBy("plan").agg(F.count(F.lit(1)).alias("operations"), F.count_if(F.expr("kind like 'move%'")).alias("moves"), F.min_by("path", "idx").alias("first"), F.max_by("path", "idx").alias("last"))
    return a.join(bad.groupBy("plan").agg(F.countDistinct("subject").alias("faulty")), "plan", "left")


@query
def consolidation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.consolidated(operations(spark, sf_dir).select("plan", "idx", "kind"))


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") % 40).alias("plan"), F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name"), (F.col("l_returnflag") == "A").alias("type_only"), (F.col("l_orderkey") % 10 == 3).alias("test"))


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    versions = _needs(spark, sf_dir).select("plan", "name").distinct().where("(plan + name) % 5 <> 0").select("plan", "name", F.when(F.col("name") % 2 == 0, F.array(F.lit("1"))).when(F.col("plan") % 3 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("2"))).alias("v"))
    own = s.select((F.col("s_suppkey") % 40).alias("plan"), F.col("s_suppkey").alias("name"))
    return build.inferred(_needs(spark, sf_dir), versions.select("plan", "name", F.explode("v").alias("version")), own)


@query
def inferred_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir)


@query
def jsx_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dependencies with the JSX runtime: parts as sources of plans, suppliers' nations as what owners declare."""
    found = _inferred(spark, sf_dir).select("plan", F.col("name").cast("string").alias("name"), "section", F.col("version").cast("string").alias("version"), "fault")
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("long").alias("plan"), F.concat(F.lit("src/"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, ".tsx").otherwise(".ts")).alias("file"), (F.col("p_partkey") % 120).alias("owner"))
    profiles = p.select("plan", (F.col("plan") % 4 != 0).alias("jsx")).distinct()
    declared = table(spark, sf_dir, "supplier").where("s_nationkey < 8").select((F.col("s_suppkey") % 120).alias("owner"), F.concat(F.lit("18."), F.col("s_nationkey") % 2).alias("version"))
    return build.with_jsx_runtime(found, p, profiles, declared, "17.0")


@query
def dependency_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") % 40).alias("plan"), F.col("s_suppkey").alias("name"))
    d = build.decisions(_inferred(spark, sf_dir), _needs(spark, sf_dir), gone, True)
    return d.withColumn("reasons", F.array_join("reasons", ","))


@query
def effect_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = modules(spark, sf_dir), edges(spark, sf_dir)
    effect = F.get(F.array(*map(F.lit, ("call", "assignment", "import", "decorator"))), (F.col("path") % 4).cast("int")).alias("kind")
    of = lambda d: d.where("path % 3 = 0").select("path", effect)
    moved = m.where("domain = 'Brand#1'")
    reached = evacuation.evaluation_reach(e, moved.select(F.col("path").alias("id"))).select(F.col("id").alias("path")).join(moved.select("path"), "path", "left_anti")
    return build.effect_inventory(of(moved.select("path")), of(m.where("path % 20 = 0").select("path")), of(reached), of(m.where("zone = 'package'").select("path")))


@query
def asset_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    ids = lambda keep: m.where(keep).select(F.col("path").alias("id"))
    return build.unreachable_assets(edges(spark, sf_dir, 45), ids("path % 2 = 0"), ids("path % 10 = 7"), ids("path % 10 = 3"))


@query
def plan_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).select("plan", "idx", "kind", "target", "post")
    new = ops.where("idx % 12 <> 0").withColumns({"kind": F.when(F.col("idx") % 30 == 1, "copy").otherwise(F.col("kind")), "post": F.when(F.col("idx") % 18 == 1, "x").otherwise(F.col("post"))})
    return build.refresh(ops.where("idx % 11 <> 0"), new, ["plan", "idx"], ["kind", "target", "post"]).withColumn("fields", F.array_join("fields", ","))


@query
def plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.review(operations(spark, sf_dir), modules(spark, sf_dir).select(F.col("file").alias("source"), "line_count"))


@query
def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_review(spark, sf_dir).select("plan", build.review_line().alias("line"))


@query
def move_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    return build.metrics(m, m.where("path % 3 = 0").select("path"))


@query
def rendered_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return build.rendered_moves(d.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1_000_000).alias("target"), "text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" THE "))).alias("rewritten")))


@query
def public_subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return build.public_subpaths(p.select(F.col("p_partkey").alias("source"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("-"), F.col("p_partkey") % 90, F.lit(".tsx")).alias("module")), "./", ".ts")


@query
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path")
    return build.changed_files(m.where("path % 4 = 0"), m.where("path % 6 = 0"), m.where("path % 7 = 0"))


@query
def owned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path")
    own, rest = build.owned_outputs(m.where("path % 6 = 0"), m.where("path % 4 = 0"))
    return own.select("path", F.lit("excluded").alias("fate")).union(rest.select("path", F.lit("kept")))


@query
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path")
    return build.generated_records(m.where("path % 6 = 0"), m.where("path % 4 = 0"), m.where("path % 5 = 0"))


@query
def pruned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as its dependency section; those with a negative balance go."""
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("gone"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(gone, "l_suppkey", "left")  # noqa: E741
    g = l.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_suppkey").alias("k"), F.lit("1").alias("v")))).alias("section"), F.collect_list(F.when(F.col("gone"), F.col("l_suppkey"))).alias("names"))
    return g.select("l_orderkey", joined(F.array_sort(F.map_keys(build.pruned_section(F.col("section"), F.col("names"))))).alias("left"))


@query
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    dirty = m.where("path % 3 = 0").select("file", "path").select(F.when(F.col("path") % 2 == 0, F.concat("file", F.lit("/deep/a"))).otherwise(F.regexp_extract("file", "^(src/[a-z]+)", 1)).alias("path")).distinct()
    return build.dirty_paths(dirty, m.where("path % 4 = 0").select(F.col("file").alias("path")))


@query
def receipt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    receipts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("record"), F.sha2(F.concat(F.lit("Customer#"), F.lpad(F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string"), 9, "0")), 256).alias("digest"), (F.col("o_orderkey") % 5).alias("commit"))
    records = c.where("c_custkey % 20 <> 0").select(F.col("c_custkey").alias("record"), F.sha2("c_name", 256).alias("digest"))
    return build.receipt_faults(receipts, records, spark.range(0, 4).select(F.col("id").alias("commit")))


@query
def folder_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.folder_members(_claims(spark, sf_dir).select("path"), ("1", "a.ts"))


@query
def canonical_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    path = F.when(F.col("path") % 3 == 0, F.concat(F.lit("/work/repo/"), "file")).when(F.col("path") % 3 == 1, F.concat(F.lit("/work/repo/deps/x"), F.col("path") % 9, F.lit("/"), "file")).otherwise(F.concat(F.lit("/tmp/"), "file"))
    return build.canonical_inputs(m.select(path.alias("path")), "/work/repo", "deps")


@query
def derived_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as derived reports that need their parts, which are available unless their price is high."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")  # noqa: E741
    return build.availability(p.select(F.col("p_partkey").alias("report"), (F.col("p_retailprice") < 1050).alias("available")), l.select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("need"))).withColumn("lacking", joined(F.col("lacking")))


@query
def findings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as lines of a list, one for each rule and plan."""
    i = validation.summary(validation.operation_issues(operations(spark, sf_dir), modules(spark, sf_dir).select(F.col("owner").alias("plan"), "file"), "libs", rewrite_donors(operations(spark, sf_dir))))
    return i.groupBy("plan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "n"))), lambda x: F.concat(F.lit("- "), x["rule"], F.lit(": "), x["n"])), "\n").alias("text"))


@query
def campaign_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "P", "stopped").otherwise("planned")
    return build.phases(o.select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "extraction").otherwise("preparation").alias("kind"), status.alias("status")))


@query
def artifact_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated artifacts after the journal: missing, stray, or with other bytes than recorded."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    return windows.inventory_diff(d.where("path % 9 <> 0"), d.where("path % 8 <> 0").withColumn("sha", F.when(F.col("path") % 10 == 0, "x").otherwise(F.col("sha"))), "path", "sha")


@query
def unauthorized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    roots = m.select(F.regexp_extract("file", "^(src/[a-z]+)", 1).alias("root")).where("root <> 'src/small'").distinct()
    granted = m.where("path % 5 = 0").select(F.col("file").alias("root")).union(roots.where("root = 'src/promo'"))
    return build.unauthorized(m.select(F.col("file").alias("path")), roots, granted)


@query
def inclusion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path")
    return build.inclusion_faults(m.where("path % 2 = 0"), m.where("path % 7 = 0"), m.where("path % 21 = 0"))


@query
def multi_file_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    return build.symbol_seams(_references(spark, sf_dir), m.select(F.col("path").alias("id"), F.col("domain").alias("file")), m.where("domain like '%1'").select(F.col("domain").alias("file")))


@query
def seam_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that refer to each other in a circle, by symbols: the components of the files' graph."""
    of = modules(spark, sf_dir).select("path", F.concat_ws("/", "owner", "domain").alias("file"))
    e = edges(spark, sf_dir, 49).join(of.select(F.col("path").alias("src"), F.col("file").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b")
    return graph.strong_components(cut(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()))


@query
def symbol_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers of each group and whether it is worth a split: at least two affinities, none of which holds more than six tenths."""
    c = symbols.external_consumers(_uses(spark, sf_dir))
    t = windows.dominant(c, "group", "affinity", "n")
    k = c.groupBy("group").agg(F.countDistinct("path").alias("consumers"), F.countDistinct("affinity").alias("affinities"))
    return k.join(t, "group").select("group", "consumers", "affinities", ((F.col("affinities") > 1) & (F.col("concentration") <= 0.6)).alias("split"))


@query
def evacuation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files chosen by selectors, end to end: what moves, is absorbed, stays or is needed, and the cuts of its boundary."""
    e, m = cut(edges(spark, sf_dir)), modules(spark, sf_dir)
    chosen = evacuation.select_files(m.where("application = 'web'").select(F.col("file").alias("path"), "application"), ["src/promo", "src/small/**"])
    ids = m.join(chosen.select(F.col("path").alias("file")), "file", "left_semi").select(F.col("path").alias("id"))
    union = cut(evacuation.bounded_union(cut(graph.strong_components(e)), e, ids, m.where("path % 97 = 0").select(F.col("path").alias("id"))))
    moved = union.where("role in ('selected', 'absorbed')").select("id")
    cuts = evacuation.boundary_cuts(e, moved, F.col("dst") % 97 == 0, F.col("dst") % 5 == 0)
    return union.groupBy(F.concat(F.lit("role:"), "role").alias("what")).agg(F.count(F.lit(1)).alias("n")).union(cuts.groupBy(F.concat(F.lit("cut:"), "reason").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query
def consolidation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages folded into others: files of each donor (owner and domain), lines, and who imports them from outside."""
    m, e = modules(spark, sf_dir), edges(spark, sf_dir)
    files = m.where("zone = 'package'").select(F.concat_ws("/", "owner", "domain").alias("cand"), "path", "line_count")
    seen = portfolio.consumers(files.select("cand", "path"), e.withColumn("specifier", F.col("dst").cast("string"))).groupBy("cand").agg(F.count(F.lit(1)).alias("consumers"))
    own = files.groupBy("cand").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda x: x.cast("string")), "\n"), 256).alias("id"))
    return own.join(seen, "cand", "left").fillna(0, ["consumers"])


@query
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of package zone that applications import: their importers inside and outside of the owner, and whether only one owner needs them."""
    e, m = edges(spark, sf_dir), modules(spark, sf_dir)
    j = e.join(m.where("zone = 'package'").select(F.col("path").alias("dst"), F.col("owner").alias("b")), "dst").join(m.select(F.col("path").alias("src"), F.col("owner").alias("a")), "src")
    return j.groupBy(F.col("dst").alias("source")).agg(F.count_if(F.expr("a = b")).alias("inside"), F.count_if(F.expr("a <> b")).alias("outside"), (F.countDistinct("a") == 1).alias("single"))


@query
def test_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helpers that integration tests reach among tests, and those that something else imports as well, which can't move."""
    m = modules(spark, sf_dir)
    ids = lambda rule: m.where(rule).select(F.col("path").alias("id"))
    return preparations.test_closure(edges(spark, sf_dir, 45), ids("path % 3 = 0"), ids("path % 30 = 0"))


@query
def test_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a package of integration tests: its closure's files that can move, in order, each with its target."""
    c = test_closure(spark, sf_dir).where("not held").join(modules(spark, sf_dir).select(F.col("path").alias("id"), "file"), "id")
    return build.journal(("move", c.select(F.lit("tests").alias("plan"), F.col("file").alias("path"), F.concat(F.lit("tests/"), "file").alias("target"))))


@query
def preparation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates before and after an application's dynamic edges are prepared away: rejections that go and that come."""
    facts = _candidates(spark, sf_dir)[3]
    before = _judged(facts).select("id", F.explode_outer("codes").alias("code"))
    facts = facts.withColumns({"unsupported": F.lit(0), "composition": F.lit(0)})
    after = _judged(facts).select("id", F.explode_outer("codes").alias("code"))
    gone = before.exceptAll(after).groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("change", F.lit("gone"))
    return gone.union(after.exceptAll(before).groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("change", F.lit("come")))


# Preparations


def _preparations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbouring parts as preparations: members and refusals of their type-only closures."""
    starts = modules(spark, sf_dir).select(F.floor(F.col("path") / 2).alias("key"), F.col("path").alias("id"))
    return closures.type_only_closures(edges(spark, sf_dir, 45), starts)


@query
def preparation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each preparation takes along."""
    return _preparations(spark, sf_dir)[0]


@query
def preparation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value edge that refuses a preparation."""
    return _preparations(spark, sf_dir)[1]


@query
def declaration_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations asked for by name in files: found once, missing, or ambiguous; only exported ones are eligible."""
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), (F.col("p_retailprice") >= 1000).alias("exported"), "p_size")
    return preparations.declaration_selection(named, named.where("p_size < 20"))


@query
def replayed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of preparations made of spans of a source: the spans in order, joined by newlines."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 60")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((40, 55), (0, 10), (20, 31))])
    cut_ = F.transform(F.array_sort(spans), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    return d.select("doc_id", F.array_join(cut_, "\n").alias("text"))


@query
def boundary_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries between owners: resolved if only types cross, served by a package if all targets are one's, else a port is due."""
    return preparations.boundary_proofs(edges(spark, sf_dir, 45), modules(spark, sf_dir)).withColumnRenamed("owner", "b")


@query
def value_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations of their brand's file, each asked to leave it with all it needs; every eleventh is asked for in the next file."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_retailprice") >= 1000).alias("exported"), "p_size")
    name = F.concat(F.lit("d"), F.col("id"))
    d = p.select(F.col("p_brand").alias("file"), "id", name.alias("name"), "exported", F.when(F.col("p_size") % 5 == 0, "type").when(F.col("p_size") % 5 == 1, "both").otherwise("value").alias("space"))
    asked = d.select(F.col("id").alias("key"), F.when(F.col("id") % 11 == 0, "Brand#00").otherwise(F.col("file")).alias("file"), "name")
    out = closures.value_splits(d, edges(spark, sf_dir, 1), asked)[0]
    return out.withColumn("offenders", F.array_join("offenders", ","))


@query
def preparation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared files against what was declared: out of scope, of another owner, lost, or not the replayed bytes."""
    m = modules(spark, sf_dir)
    declared = m.where("path % 4 = 0").select("path", "owner", F.sha2("file", 256).alias("sha256"))
    landed = m.where("path % 4 = 0 and path % 20 <> 0 or path % 50 = 1").select("path", F.when(F.col("path") % 24 == 0, "PROMO").otherwise(F.col("owner")).alias("owner"), F.sha2(F.when(F.col("path") % 28 == 0, F.concat("file", F.lit("?"))).otherwise(F.col("file")), 256).alias("sha256"))
    return preparations.audit(declared, landed)


# Sources of records and settings


@query
def ledger_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as ledgers and read again under their schema: rows, and issues found on reading."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    path = f"{shared_dir(spark)}/orebody-ledgers-{uuid.uuid4().hex}"
    c.select(F.col("conv_id").alias("campaign"), F.col("turn").alias("seq"), F.sha2("text", 256).alias("id"), F.col("role").alias("kind"), F.when(F.col("turn") % 5 == 0, None).otherwise("applied").alias("status")).write.json(path)
    return records.read_ledgers(spark, path).groupBy("campaign").agg(F.count(F.lit(1)).alias("entries"), F.count("fault").alias("faults"))


@query
def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans written as manifests, an operation a line, and read again under their schema."""
    path = f"{shared_dir(spark)}/orebody-manifests-{uuid.uuid4().hex}"
    operations(spark, sf_dir).select("plan", "idx", "kind", "source", "target", F.col("pre").alias("pre_hash"), F.col("post").alias("result_hash")).write.json(path)
    return records.read_manifests(spark, path).groupBy("plan", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("targets"))


@query
def baseline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of a commit out of trees by commit: the file as the last commit up to it left it."""
    o = table(spark, sf_dir, "orders")
    trees = o.select(F.col("o_orderdate").alias("commit"), F.col("o_custkey").alias("path"), F.col("o_orderkey").cast("string").alias("content"), (F.col("o_orderstatus") == "P").alias("deleted"), "o_orderkey")
    return records.tree_at(trees, F.lit("1996-06-30").cast("timestamp"), "o_orderkey")


@query
def config_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' settings as they are in force: some set a scope, a smallest size (at times the default one) or a name that doesn't exist."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_mktsegment")
    some = lambda rule, name, value: c.where(rule).select("owner", F.lit(name).alias("setting"), value.cast("string").alias("value"))
    given = some("owner % 2 = 0", "scope", F.concat(F.lit("@"), F.lower("c_mktsegment"))).union(some("owner % 5 = 0", "min_files", F.col("owner") % 4)).union(some("owner % 11 = 0", "min_size", F.col("owner")))
    return records.effective_by_owner(given, c)


@query
def config_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by nation as canonical JSON without the machine's place, and their digest."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(records.canonical_settings(F.create_map(F.lit("root"), F.concat(F.lit("/home/"), "n_name"), F.lit("name"), F.col("n_name"), F.lit("app"), F.col("n_regionkey").cast("string")), ("root",)), 256).alias("digest"))


@query
def build_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for each language over its documents' names and hashes, by bundles of 1,000 ids."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", "doc_id", F.sha2("text", 256).alias("sha"))
    return records.tree_hash(d, "lang", "doc_id", "sha", 1000)


# Scans and sinks


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' imports as two applications' reports, written as JSON and read again as captured reports are."""
    m = modules(spark, sf_dir).select("path", "application", F.concat(F.lit("apps/"), "application", F.lit("/"), "file", F.when(F.col("path") % 10 == 3, ".test.ts").otherwise(".ts")).alias("source"))
    e = edges(spark, sf_dir).join(m.select(F.col("path").alias("dst"), F.col("source").alias("resolved")), "dst")
    dep = F.struct(F.concat(F.when(F.col("dst") % 17 == 0, "pkg-").otherwise("./"), "dst").alias("module"), F.when(F.col("dst") % 17 != 0, F.col("resolved")).alias("resolved"), "dynamic", (F.col("dst") % 17 == 0).alias("couldNotResolve"))
    per = e.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list(dep)).alias("dependencies"))
    rows = m.join(per, "path", "left").select("application", "source", F.coalesce("dependencies", F.array().cast(per.schema["dependencies"].dataType)).alias("dependencies"))
    folder = f"{shared_dir(spark)}/orebody-reports-{uuid.uuid4().hex}"
    reports = {}
    for app in ("api", "web"):
        # One object a line: a report in parts, as many as there are tasks.
        rows.where(F.col("application") == app).select(F.array(F.struct("source", "dependencies")).alias("modules")).write.json(f"{folder}/{app}")
        reports[app] = f"{folder}/{app}"
    return scan.read_reports(spark, reports, lines=True)


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = cut(_scan(spark, sf_dir))
    facts = s.select(F.col("source").alias("path"), F.explode("dependencies").alias("d")).select("path", F.col("d.module").alias("specifier"), F.col("d.module").endswith("5").alias("type_only"), F.lit(False).alias("dynamic"))
    exports = s.select(F.col("source").alias("path"), F.lit(True).alias("has_exports"), F.length("source").cast("long").alias("line_count"))
    config = Config(applications=(Application("web", "apps/web"), Application("api", "apps/api")))
    return scan.build_graph(s, facts, exports, spark.createDataFrame([], "name string, owner string"), config)


@query
def scanned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["nodes"].groupBy("application", "zone").agg(F.count(F.lit(1)).alias("nodes"), F.sum("line_count").alias("lines"))


@query
def scanned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["edges"].select("src", "dst", "kind")


@query
def scanned_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't an edge between production files: unresolved, external and test imports, and tests by kind."""
    g = _graph(spark, sf_dir)
    out = None
    for name in ("unresolved", "external_by_source", "test_importers", "test_kinds"):
        one = g[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.union(one)
    return out


@query
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files by language and read again as a tree: files, bytes and how many are the same bytes."""
    folder = f"{shared_dir(spark)}/orebody-tree-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "\n").alias("value"))
    d.repartition("p_type").write.partitionBy("p_type").text(folder)
    tree = scan.read_tree(spark, folder, 1_000_000, ("_temporary",)).where("path like '%.txt'")
    found = tree.select(F.regexp_extract("path", "p_type=([^/]+)/", 1).alias("p_type"), "size", "sha256")
    return found.join(d.select("p_type", F.sha2(F.concat("value", F.lit("\n")), 256).alias("want")), "p_type").select("p_type", F.col("size").cast("long").alias("size"), (F.col("sha256") == F.col("want")).alias("same"))


@query
def workspace_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that workspace globs pick."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("libs"), F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path")).distinct()
    return workspace.resolve_globs(p, ["libs/*/small-*", "libs/promo/*", "!**/*-ring", "!libs/large/**"])[0]


@query
def workspace_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by name: configured entries override what is on disk."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    disk = s.select(F.concat(F.lit("p"), F.col("s_suppkey")).alias("name"), F.concat(F.lit("libs/"), "s_suppkey").alias("owner"))
    return scan.packages(disk, n.select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("name"), F.concat(F.lit("own/"), "n_name").alias("owner")))


@query
def provenance_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 4 == 0, F.concat(F.lit("// Generated from specs/"), k, F.lit(".json\n"))).when(k % 4 == 1, F.concat(F.lit("\n/* Generated by tool-"), k % 9, F.lit(" */\n"))).when(k % 4 == 2, "a\nb\nc\nd\ne\n// source: late\n").otherwise("code\n"), "p_name")
    return p.select("p_partkey", workspace.provenance(text).alias("origin"))


@query
def style_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of style sheets before and after: selectors lost, added, changed, or declared in another order."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rule = lambda text: p.select(F.concat(F.lit(".c"), k).alias("selector"), text.alias("declarations"), k.alias("k"))
    before = rule(F.concat(F.lit("color:"), F.col("p_size"), F.lit(";width:1"))).where("k % 7 <> 0").drop("k")
    after = rule(F.when(k % 5 == 0, F.concat(F.lit("width:1;color:"), "p_size")).when(k % 11 == 0, F.lit("color:none")).otherwise(F.concat(F.lit("color:"), F.col("p_size"), F.lit(";width:1")))).where("k % 9 <> 0").drop("k")
    return references.css_changes(before, after)


@query
def type_only_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    k = F.col("path")
    flags = m.select(k.alias("id"), (k % 3 == 0).alias("value_reference"), (k % 5 == 0).alias("not_exported"), F.col("has_exports").alias("has_surface"), (F.col("line_count") > 40).alias("too_large"))
    return symbols.type_only_refusals(flags).select("id", F.array_join("refusals", ",").alias("refusals"))


@query
def proof_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proofs with their failures: byte fidelity, boundaries, postconditions, and one that nothing fails."""
    from .queries import boundary_breaks, byte_fidelity, postconditions

    failures = byte_fidelity(spark, sf_dir).select(F.lit("bytes").alias("proof")).union(boundary_breaks(spark, sf_dir).select(F.lit("boundaries"))).union(postconditions(spark, sf_dir).select(F.lit("postconditions")))
    return audit.proof_report(failures, ["boundaries", "bytes", "consumers", "postconditions"])


@query
def report_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as the sinks render them: canonical JSON, a padded table, and a table written and read again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = f"{shared_dir(spark)}/orebody-report-{uuid.uuid4().hex}"
    sinks.write_table(n, path)
    kept = spark.read.parquet(path).exceptAll(n).count() + n.exceptAll(spark.read.parquet(path)).count()
    rows = [(kind, hashlib.sha256(text.encode()).hexdigest(), len(text.encode())) for kind, text in (("json", sinks.json_report(n, ["n_nationkey"])), ("table", sinks.text_table(n, ["n_nationkey"])))]
    return spark.createDataFrame([*rows, ("lost", "", kept)], "kind string, sha256 string, bytes long")


# Lockfiles


def _locked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as workspaces, their orders as packages (lock, root), line items as dependencies."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lock"), F.concat(F.lit("packages/p"), "o_orderkey").alias("root"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    section = F.when(F.col("l_returnflag") == "A", "dependencies").when(F.col("l_returnflag") == "R", "devDependencies").otherwise("optionalDependencies")
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("@s"), F.col("l_suppkey"), F.lit("/p"), F.col("l_partkey"))).otherwise(F.concat(F.lit("p"), F.col("l_partkey")))
    d = l.groupBy("lock", "root", section.alias("section"), name.alias("name")).agg(F.max("l_quantity").cast("long").alias("q"), F.min("l_linenumber").alias("n"))
    return o.select("lock", "root"), d.select("lock", "root", "section", "name", F.concat(F.lit("^"), "q", F.lit(".0.0")).alias("specifier"), F.when(F.col("n") == 1, F.concat(F.lit("link:../p"), "q", F.lit(":"))).otherwise(F.concat("q", F.lit(".0."), "n")).alias("version"))


@query
def lockfile_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockfiles written from line items and read back."""
    roots, declared = _locked(spark, sf_dir)
    return lockfiles.dependencies(cut(lockfiles.rendered(roots, declared)))


@query
def lockfile_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, declared = _locked(spark, sf_dir)
    return lockfiles.importers(cut(lockfiles.rendered(roots, declared))).select("lock", "root", "lines")


@query
def projected_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages against lockfiles that lack every 13th package, every 7th dependency's name, and have other versions of some."""
    roots, declared = _locked(spark, sf_dir)
    number = lambda c: F.regexp_extract(c, "p([0-9]+)$", 1).cast("long")
    stale = declared.where(number("root") % 13 != 0).where(number("name") % 7 != 0).withColumn("version", F.when(number("name") % 11 == 0, "0.0.1").otherwise(F.col("version")))
    locks = cut(lockfiles.rendered(roots.where(number("root") % 13 != 0), stale))
    return lockfiles.compared(roots, declared.where(number("name") % 17 != 0), locks)


# Streams


@query
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as campaigns, their turns as events (plan and record in turn), some stale or badly audited, read as a stream of files."""
    turns = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parquet*")  # a pattern, as a stream of one file needs
    seq, n = F.col("turn") + 1, F.length("text")
    child = F.floor((F.col("turn") + 2) / 2)
    role, other = (F.when(child % 2 == odd, "preparation").otherwise("extraction") for odd in (1, 0))
    plan = seq % 2 == 1
    numbered = lambda prefix, x: F.concat(F.lit(prefix), x)
    events = turns.select(
        F.col("conv_id").cast("string").alias("campaign"), seq.alias("seq"), F.timestamp_seconds(86_400 + F.col("turn") * 60).alias("at"), F.when(plan, "plan").otherwise("record").alias("kind"),
        numbered("c", child).alias("id"), numbered("plan", child).alias("plan_id"), numbered("p", F.floor((child + 1) / 2)).alias("pair_id"), role.alias("role"),
        F.when(n % 7 == 0, "old").otherwise(numbered("k", child - 1)).alias("baseline"), numbered("k", child).alias("result"), numbered("g", child - 1).alias("graph_before"), numbered("g", child).alias("graph_after"),
        F.when(n % 11 == 0, other).otherwise(role).alias("audit_role"), (n % 5 != 0).alias("audit_passed"),
    )
    at = f"{shared_dir(spark)}/orebody-ledger-{uuid.uuid4().hex}"
    ledger.written(ledger.checked(events, ttl_ms=210_000), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(ledger.OUT).parquet(f"{at}/out").select("campaign", "seq", "id", "accepted", "reason")
