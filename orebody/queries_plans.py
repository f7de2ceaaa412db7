"""Plan validation as queries: parts are files, their types are plans, suppliers are packages. Their SQL is in oracle_plans.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import edges, modules, occurrences, table
from .plans import validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def role() -> Column:
    k = F.col("path") % 10
    return F.when(k == 3, "test").when(k == 7, "asset").otherwise("file")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation for each part, in the plan of its type; kinds, hashes and targets go by its key, and some are wrong."""
    k = F.col("path")
    kind = F.when(k % 8 < 2, "move").when(k % 8 == 2, "move-with-rewrite").when(k % 8 == 3, "rewrite-import").when(k % 8 == 4, "write-file").when(k % 8 == 5, "delete-file").when(k % 8 == 6, "rewrite-fs-reference").when(k % 16 == 7, "rewrite-path-reference").otherwise("copy")
    own = F.sha2("file", 256)
    target = F.when(k % 40 == 0, F.col("file")).when(k % 48 == 1, F.concat(F.lit("other/"), k)).otherwise(F.concat(F.lit("libs/"), F.lower("domain"), F.lit("/src/"), k % 500))
    pre = F.when(k % 9 == 0, "missing").when(k % 11 == 0, "bad").otherwise(own)
    post = F.when(kind == "delete-file", F.when(k % 10 == 5, own).otherwise("missing")).when(kind == "move", F.when(k % 13 == 0, F.sha2(F.concat("file", F.lit("!")), 256)).otherwise(own)).when(k % 17 == 0, pre).otherwise(F.sha2(F.concat("file", F.lit("x")), 256))
    shared = F.concat(F.lit("src/"), F.lower("owner"), F.lit("/"), k % 150)
    return modules(spark, sf_dir).select(F.col("owner").alias("plan"), k.alias("idx"), kind.alias("kind"), F.col("file").alias("source"), target.alias("target"), shared.alias("file"), pre.alias("pre"), post.alias("post"), F.when(k % 7 != 0, own).alias("blob"), role().alias("role"))


def declared_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).where("path % 6 <> 0").select(F.col("owner").alias("plan"), F.concat(F.lit("src/"), F.lower("owner"), F.lit("/"), F.col("path") % 150).alias("file")).distinct()


def rewrite_donors(ops: DataFrame) -> DataFrame:
    """Import rewrites of every third key are about the first file that their plan moves."""
    first = ops.where("kind IN ('move', 'move-with-rewrite')").groupBy("plan").agg(F.min("source").alias("donor"))
    return ops.where("kind = 'rewrite-import' AND idx % 3 = 0").select("plan", "idx").join(first, "plan")


@query
def operation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    return validation.operation_issues(ops, declared_consumers(spark, sf_dir), "libs", rewrite_donors(ops))


@query
def coverage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, m = operations(spark, sf_dir), modules(spark, sf_dir)
    sources = m.where("path % 8 < 4").select(F.col("owner").alias("plan"), F.col("file").alias("path"))
    changed = m.where("path % 5 <> 0").select(F.col("owner").alias("plan"), F.col("file").alias("path"))
    made = m.where("path % 20 = 0").select(F.col("owner").alias("plan"), F.concat(F.lit("src/"), F.lower("owner"), F.lit("/"), F.col("path") % 150).alias("path")).distinct()
    return validation.summary(validation.coverage_issues(ops, sources, declared_consumers(spark, sf_dir), changed, made))


def _rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of another owner's parts, as rewrites to that owner's package."""
    of = modules(spark, sf_dir).select("path", "owner")
    e = edges(spark, sf_dir, 40).join(of.select(F.col("path").alias("src"), F.col("owner").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("owner").alias("plan")), "dst").where("a <> plan")
    package = F.concat(F.lit("@engine/"), F.lower("plan"))
    to = F.when(F.col("dst") % 4 == 0, F.concat_ws("/", package, "dst")).otherwise(package)
    return e.select("plan", F.col("src").alias("file"), F.when(F.col("dst") % 6 != 0, F.col("dst")).alias("donor"), to.alias("to"), package.alias("package"), "dst")


@query
def donor_surface_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    surface = m.where("path % 5 = 0").select(F.col("owner").alias("plan"), F.col("path").alias("donor"), F.concat(F.lit("@engine/"), F.lower("owner"), F.lit("/"), "path").alias("specifier"))
    chosen = m.where("path % 9 <> 0").select(F.col("owner").alias("plan"), F.col("path").alias("donor"))
    return validation.donor_surface_issues(_rewrites(spark, sf_dir), surface, chosen)


@query
def consumer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewrites(spark, sf_dir)
    pair = F.struct(F.when(F.col("dst") % 31 == 0, F.col("to")).otherwise(F.concat(F.lit("./"), "dst")).alias("from"), "to")
    found = r.groupBy("plan", "file").agg(F.collect_set(F.when(F.col("dst") % 7 != 0, pair)).alias("rewrites"))
    c = found.select("plan", "file", (F.when(F.col("file") % 29 == 0, 2).otherwise(1)).alias("n"), F.when(F.col("file") % 19 != 0, F.col("file")).alias("importer"), F.when(F.col("file") % 7 == 0, "peer").when(F.col("file") % 2 == 0, "dev").otherwise("runtime").alias("section"), "rewrites")
    declared = r.where("dst % 23 <> 0").select("plan", F.col("to").alias("specifier"))
    return validation.consumer_issues(c, declared)


@query
def target_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as targets; the parts they sell as public modules."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    package = F.when(key % 7 == 0, F.col("s_name")).otherwise(F.concat(F.lit("@engine/s"), key))
    root = F.when(key % 11 == 0, F.concat(F.lit("libs/../"), key)).when(key % 13 == 0, F.concat(F.lit("apps/"), key)).otherwise(F.concat(F.lit("libs/"), key))
    targets = s.select(key.alias("plan"), package.alias("package"), root.alias("root"), F.when(key % 5 != 0, "src/index.ts").alias("entry"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("q"))  # noqa: E741
    name = F.when(F.col("line") == 1, ".").when(F.col("line") == 7, F.col("source").cast("string")).otherwise(F.concat(F.lit("./"), (F.col("source") + F.col("line")) % 40))
    specifier = F.when(F.col("line") == 6, F.concat(F.lit("@other/"), "source")).otherwise(F.concat(F.lit("@engine/s"), "plan", F.when(F.col("line") == 1, "").otherwise(F.concat(F.lit("/"), "source"))))
    mods = l.select("plan", "source", name.alias("key"), F.when(F.col("q") > 49, "src/x.ts").otherwise("./src/x.ts").alias("target"), specifier.alias("specifier"))
    return validation.summary(validation.target_issues(targets, mods, r"^@engine/[a-z0-9][a-z0-9-]*$", ("libs",)))


@query
def artifact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' statuses by customer: what was projected against the last operation's result."""
    o = table(spark, sf_dir, "orders")
    derived = o.groupBy(F.lit("plan").alias("plan"), F.col("o_custkey").alias("path")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("hash"))
    said = table(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(F.lit("plan").alias("plan"), F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") < 2000, "O").otherwise("F").alias("hash"))
    return validation.artifact_issues(said, derived)


@query
def decision_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("name"), F.when(F.col("l_linestatus") == "O", "target-runtime").otherwise("target-dev").alias("decision"), "l_linenumber", "l_quantity")  # noqa: E741
    said = l.where("l_quantity > 10 and l_linenumber < 6").withColumn("reasons", F.when(F.col("l_quantity") > 48, 0).otherwise(1))
    return validation.summary(validation.decision_issues(said, l.where("l_linenumber < 5")))


@query
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    made = c.select(F.col("c_nationkey").alias("plan"), k.alias("path"), F.when(k % 9 != 0, "make").alias("command"), F.when(k % 4 == 0, F.sha2("c_name", 256)).when(k % 4 == 1, F.col("c_name")).alias("hash"), F.when(k % 3 == 0, "random").alias("exempt"))
    kinds = F.get(F.array(*map(F.lit, ("fix: mend it", "feat(core)!: add it", "Mended it", "fix:no blank", "chore(): empty scope"))), (F.col("o_orderkey") % 5).cast("int"))
    commits = o.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("name"), kinds.alias("subject"))
    gates = o.select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("tier"), F.when(F.col("o_orderkey") % 6 != 0, "check").alias("command"))
    return validation.summary(validation.record_issues(made, commits, gates))


@query
def promotion_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as promoted modules: their importers are the consumers, some of them tests."""
    e = edges(spark, sf_dir, 45)
    who = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("src"))))
    of = e.groupBy(F.col("dst").alias("source")).agg(who(F.col("src") % 10 != 3).alias("consumers"), who(F.col("src") % 10 == 3).alias("tests"), who(F.lit(True)).alias("all"), F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("removed"))
    k = F.col("source")
    proof = F.when(k % 5 == 0, F.reverse("all")).when(k % 7 == 0, F.slice("all", 1, 1)).otherwise(F.col("all"))
    before = F.when(k % 3 != 0, F.when(k % 8 == 0, F.col("all")).otherwise(F.array_union(F.array(k), "all")))
    rest = F.array_except("all", F.array(k))
    after = F.when(k % 10 == 1, F.array(F.slice(rest, 1, 1))).otherwise(F.array(rest))
    removed = F.when(k % 11 == 0, F.slice("removed", 1, 0)).when(k % 13 == 0, F.transform("removed", lambda x: F.struct(x["src"].alias("src"), (x["dst"] + 1).alias("dst")))).otherwise(F.col("removed"))
    p = of.select(F.lit("p").alias("plan"), "source", F.when(k % 17 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("files"), proof.alias("proof"), "consumers", "tests", before.alias("before"), after.alias("after"), removed.alias("removed"), F.when((k % 3 == 0) & (k % 9 != 0) | (k % 19 == 0), F.lit(10)).alias("edges_before"), (F.lit(10) - F.size("removed") + F.when(k % 4 == 0, 1).otherwise(0)).alias("edges_after"))
    return validation.promotion_issues(p)


@query
def dependency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    deps = p.select(F.col("p_brand").alias("plan"), F.when(k % 6 == 0, F.col("p_name")).when(k % 6 == 1, F.concat(F.lit("libs/"), k % 50)).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.when(k % 8 != 0, F.col("p_type")).otherwise("").alias("version"))
    refs = p.select(F.col("p_brand").alias("plan"), F.concat(F.lit("libs/"), k % 60).alias("owner"))
    owners = p.select(F.concat(F.lit("libs/"), k % 50).alias("owner"))
    return validation.summary(validation.dependency_issues(deps, refs, owners))


@query
def migration_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    recorded = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("migration"), (F.col("o_orderkey") % 3).alias("changes"), F.lit("a").alias("before"), F.when(F.col("o_orderkey") % 4 == 0, "a").otherwise("b").alias("after"))
    return validation.migration_issues(o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("migration")), recorded)


@query
def path_reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    moves = modules(spark, sf_dir).where("path % 3 <> 0").select(F.lit("p").alias("plan"), F.col("path").alias("source"), (F.col("path") % 100).alias("target"))
    recorded = l.select(F.lit("p").alias("plan"), F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("from"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).otherwise(F.col("l_partkey") % 100).alias("to"), F.col("l_partkey").alias("donor"))
    return validation.path_reference_issues(recorded, moves).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("files"))


@query
def settings_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    kinds = p.where("p_size > 48").select(F.col("p_type").alias("plan"), F.col("p_brand").alias("kind"))
    suites = p.where("p_size < 4").select(F.col("p_type").alias("plan"), F.col("p_name").alias("suite"), F.col("p_brand").alias("kind"))
    k = F.col("c_custkey")
    roots = c.select(F.col("c_mktsegment").alias("plan"), F.when(k % 3 == 0, F.concat_ws("/", F.lit("libs"), (k % 40).cast("string"))).otherwise(F.concat_ws("/", F.lit("libs"), (k % 60).cast("string"), k.cast("string"))).alias("root"))
    return validation.settings_issues(kinds, suites, roots)


@query
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over a part's operations, its settings and its donors: how often each is broken in each plan."""
    return validation.summary(validation.all_of(operation_issues(spark, sf_dir), donor_surface_issues(spark, sf_dir), consumer_issues(spark, sf_dir)))


@query
def unauditable_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as manifests: one without its first record, without a hash or with records out of order can't be audited."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("plan")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.length("text") % 7 == 0)).alias("blank"))
    return validation.issues(c, F.col("plan"), [("no-first-record", F.col("first") > 1), ("gaps", F.col("last") - F.col("first") + 1 != F.col("n")), ("no-hash", F.col("blank") > 0)])


@query
def occurrence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that no rule can rewrite: those without a specifier, by file."""
    r = occurrences(spark, sf_dir, 40).select(F.col("src").alias("path"), F.when(F.col("dst") % 9 != 0, F.concat(F.lit("./"), "dst")).alias("specifier"))
    return r.where("specifier is null").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
