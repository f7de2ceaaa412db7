"""The engine's operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame; their SQL is in oracle.py."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import edges, graph_modules, modules, occurrences, table
from .config import Config, Weights
from .functions import documents, paths
from .operators import dependencies, evacuation, graph, metrics, portfolio, references, reports, symbols, windows
from .plans import audit, conflicts, journal
from .session import cut, fingerprint, grows, reused
from .sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Graph


@query
def scc_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    comps = graph.strong_components(e)
    layer = graph.layers(comps.select("comp"), graph.condensed(e, comps))
    return comps.join(layer, "comp").select("id", "comp", "layer")


@query
def scc_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir, 48))
    return graph.strong_components(e).groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select("src", "dst", "type_only", "dynamic", paths.edge_kind(F.lit(False), F.col("dynamic"), F.col("type_only")).alias("kind"))


@query
def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir)


@query
def condensation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return graph.condensed(e, graph.strong_components(e))


@query
def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir, 48))
    comps = graph.strong_components(e)
    return comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), reports.component_id(F.collect_list(F.format_string("%09d", "id"))).alias("stable_id"))


@query
def closure_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return graph.closure(e).groupBy("src").agg(F.count(F.lit(1)).alias("reached"))


@query
def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    r = reports.component_report(graph_modules(spark, sf_dir, e), e, graph.strong_components(e))
    return r.select("comp", "files", "lines", F.array_join("domains", ",").alias("domains"), F.array_join("owners", ",").alias("owners"), "exporting", "cyclic", "edges_out", "type_only_out", "edges_in")


@query
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return reports.summary(graph_modules(spark, sf_dir, e), e)


def _closed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = cut(edges(spark, sf_dir))
    comps = cut(graph.strong_components(e))
    nodes = cut(graph_modules(spark, sf_dir, e))
    return e, nodes, reports.closed_files(nodes, comps, graph.condensed(e, comps))


@query
def closed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir)[2]


@query
def domain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, nodes, closed = _closed(spark, sf_dir)
    return reports.domain_report(nodes, e, closed)


@query
def domain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of domains that heavy line items cross, with components and layers at that level."""
    e = cut(edges(spark, sf_dir))
    of = modules(spark, sf_dir).select("path", "domain")
    d = e.join(of.select(F.col("path").alias("src"), F.col("domain").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("domain").alias("b")), "dst").where("a <> b")
    g = cut(d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comps = graph.strong_components(g)
    layer = graph.layers(comps.select("comp"), graph.condensed(g, comps))
    return comps.join(layer, "comp").select("id", "comp", "layer")


@query
def key_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of all rows by their foreign keys, whose tables name one another without a cycle."""

    def rows(name: str, key: str, **columns: str) -> tuple[DataFrame, dict[str, str]]:
        found = table(spark, sf_dir, name).select(F.col(key).alias("key"), *[F.col(c).alias(kind) for kind, c in columns.items()])
        return found, {kind: kind for kind in columns}

    layer = graph.key_layers({
        "line": rows("lineitem", "l_orderkey", order="l_orderkey", supplier="l_suppkey", part="l_partkey"),
        "order": rows("orders", "o_orderkey", customer="o_custkey"),
        "customer": rows("customer", "c_custkey", nation="c_nationkey"),
        "supplier": rows("supplier", "s_suppkey", nation="s_nationkey"),
        "nation": rows("nation", "n_nationkey", region="n_regionkey"),
    })
    parts = [d.select(F.concat(F.lit(f"{kind}/"), F.col("key")).alias("comp"), "layer") for kind, d in layer.items()]
    return functools.reduce(DataFrame.union, parts)


@query
def scc_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and layers of the graph of all line items, in the form for graphs of any size."""
    e = cut(edges(spark, sf_dir, 1))
    comps = cut(graph.strong_components(e, limit=0))
    layer = graph.layers(comps.select("comp"), graph.condensed(e, comps), limit=0)
    return comps.join(grows(layer), "comp").select("id", "comp", "layer")


@query
def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetypes and flags of components: names by the last digits of a part's key, suppliers' nations as packages."""
    e = edges(spark, sf_dir)
    m = modules(spark, sf_dir).select("path")
    base = F.when(F.col("path") % 7 == 0, "types.ts").when(F.col("path") % 7 == 1, "index.ts").when(F.col("path") % 7 == 2, F.concat(F.lit("PriceRule"), F.col("path"), F.lit(".tsx"))).otherwise(F.concat(F.lit("part.v"), F.col("path"), F.lit(".ts")))
    files = m.select("path", F.concat(F.lit("src/parts/"), base).alias("file"))
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("pkg-"), F.col("s_nationkey")).alias("package"))
    externals = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").join(nations, "l_suppkey").select(F.col("l_partkey").alias("path"), "package")
    out = reports.component_kinds(files, graph.strong_components(e), m.where("path % 97 = 0"), externals, ["pkg-3", "pkg-4"], m.where("path % 59 = 0"))
    return out.withColumn("flags", F.array_join("flags", ","))


@query
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.owners(modules(spark, sf_dir))


@query
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages: occurrences, repeated ones included."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return reports.external_counts(l.select(F.col("l_suppkey").alias("package")))


@query
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    out = e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")).cast("array<string>"), ",").alias("targets"))
    return out.select(F.col("src").alias("id"), "targets")


@query
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.simple(edges(spark, sf_dir))
    i, o = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")), e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return i.join(o, "id", "full_outer").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


@query
def hub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(edges(spark, sf_dir, 30), 12)


@query
def undirected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(edges(spark, sf_dir))


@query
def application_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends in one application."""
    e = edges(spark, sf_dir)
    web = modules(spark, sf_dir).where("application = 'web'").select("path")
    return e.join(web, e["src"] == web["path"], "left_semi").join(web, e["dst"] == web["path"], "left_semi").select("src", "dst")


@query
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir, 48))
    return graph.communities(e, modules(spark, sf_dir).select(F.col("path").alias("id"), F.col("application").alias("app")))


@query
def community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside and out of owners, as of given communities, on the whole graph."""
    e = graph.simple(edges(spark, sf_dir))
    of = modules(spark, sf_dir).select("path", "owner")
    j = e.join(of.select(F.col("path").alias("src"), F.col("owner").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("owner").alias("b")), "dst")
    return j.groupBy(F.col("a").alias("community")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal"), F.count_if(F.col("a") != F.col("b")).alias("external"))


@query
def condensed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between domains with counts and the kinds they have."""
    e = graph_edges(spark, sf_dir)
    of = modules(spark, sf_dir).select("path", "domain")
    j = e.join(of.select(F.col("path").alias("src"), F.col("domain").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("domain").alias("b")), "dst").where("a <> b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query
def view_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = condensed_view(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))
    return reports.backbone(v)


# Candidates


CONFIG = Config(min_files=2, max_files=20, generic_segments=("brand-7", "brand-11"), max_recommended_files=12, max_recommended_lines=400, high_inbound=3, high_fan_out=3)


def _keeper(spark: SparkSession, sf_dir: str) -> Callable[[str, Callable[[], DataFrame]], DataFrame]:
    """Relations of line items and parts, kept by name for the queries that share them."""
    seen = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")])
    return lambda name, build: reused(spark, name, seen, {"config": CONFIG}, build)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, files (cand, path) of each component and all it reaches, facts of each candidate)."""
    keep = _keeper(spark, sf_dir)
    e = keep("edges", lambda: edges(spark, sf_dir))
    comps = keep("components", lambda: graph.strong_components(e))
    nodes = graph_modules(spark, sf_dir, e)

    def closures() -> DataFrame:
        reach = graph.closure(graph.condensed(e, comps))
        whole = comps.select(F.col("comp").alias("cand"), F.col("comp")).distinct().union(reach.select(F.col("src").alias("cand"), F.col("dst").alias("comp")))
        return whole.join(comps, "comp").select("cand", F.col("id").alias("path"))

    files = keep("closures", closures)
    return e, nodes, files, keep("facts", lambda: _facts(e, nodes, comps, files))


def _facts(e: DataFrame, nodes: DataFrame, comps: DataFrame, files: DataFrame) -> DataFrame:
    """(cand, ...): the facts of each candidate that its rules and scores read."""
    into, out = (e.groupBy(F.col(side).alias("path")).agg(F.count(F.lit(1)).alias(n)) for side, n in (("dst", "fan_in"), ("src", "fan_out")))
    some = nodes.join(into, "path", "left").join(out, "path", "left").fillna(0, ["fan_in", "fan_out"])
    every = lambda k, n: F.count_if(F.col("path") % k == 0).alias(n)
    # Owners, domains and landing places are few: as sets they are one pass, while several distinct counts would repeat each row of each closure for each of them.
    kinds = lambda x: F.size(F.collect_set(x)).cast("long")
    facts = files.join(some, "path").groupBy("cand").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("line_count"), kinds("owner").alias("owners"), kinds("domain").alias("domains"),
        F.count_if("has_exports").alias("exporting"), every(97, "composition"), every(89, "protected"), F.min("domain").alias("first_domain"),
        every(71, "escapes"), every(83, "unresolved"), every(59, "stale_generated"), every(3, "declarations"), every(67, "uninstalled"), every(73, "unmovable"),
        F.count_if(F.col("path") % 10 == 3).alias("tests"), F.count_if(F.col("path") % 10 == 7).alias("assets"), every(43, "rewrites"), every(79, "retained"), every(61, "warnings"), every(41, "adjacent"), every(37, "effectful"),
        F.count_if((F.col("path") % 53 == 0) & (F.col("fan_in") > 0)).alias("shims"), F.sum(F.when((F.col("path") % 53 == 0) & (F.col("fan_in") > 0), F.col("line_count")).otherwise(0)).alias("shim_lines"),
        F.count_if(F.col("fan_in") >= CONFIG.high_inbound).alias("high_inbound"), F.count_if(F.col("fan_out") >= CONFIG.high_fan_out).alias("high_fan_out"),
        (F.count(F.lit(1)) - kinds(F.col("path") % 500)).alias("collisions"),
    )
    seen = portfolio.consumers(files, e.withColumn("specifier", F.col("dst").cast("string"))).groupBy("cand").agg(F.count(F.lit(1)).alias("consumers"))
    dyn = e.where("dynamic").join(files.select("cand", F.col("path").alias("src")), "src").groupBy("cand").agg(F.count(F.lit(1)).alias("unsupported"))
    at = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    across = e.join(at("src"), "src").join(at("dst"), "dst").where("csrc <> cdst")
    inbound = across.groupBy(F.col("cdst").alias("cand")).agg(F.countDistinct("src").alias("inbound"))
    packages = across.join(nodes.where("zone = 'package'").select(F.col("path").alias("dst"), "owner"), "dst").groupBy(F.col("csrc").alias("cand")).agg(F.countDistinct("owner").alias("dependencies"))
    tested = comps.groupBy(F.col("comp").alias("cand")).agg(F.count_if(F.col("id") % 10 == 3).alias("seed_tests"))
    for more in (seen, dyn, inbound, packages, tested):
        facts = facts.join(more, "cand", "left")
    return facts.fillna(0, ["consumers", "unsupported", "inbound", "dependencies", "seed_tests"])




def _judged(facts: DataFrame) -> DataFrame:
    """Facts with codes, advice, status, cohesion, score, effort, risk, application and classification. A candidate is of its seed's application."""
    full = facts.withColumns({"churn": F.col("inbound") + F.col("seed_tests"), "segment": portfolio.suggested_name(F.col("first_domain"), F.col("cand").cast("string"))})
    judged = portfolio.recommendation_reasons(portfolio.reasons(full, CONFIG), CONFIG).withColumns({"rejections": F.size("codes"), "reasons": F.size("advice")})
    judged = judged.withColumns({"application": F.when(F.col("cand") % 2 == 0, "web").otherwise("api"), "classification": portfolio.classification(F.col("retained"), F.col("domains"), F.col("first_domain"), "root", False)})
    return judged.withColumns({"score": portfolio.score(Weights()), "review_units": portfolio.review_units(), "risk": portfolio.risk(), "eligible": F.size("codes") == 0, "id": F.col("cand")})


@query
def candidate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[3].select("cand", "files", "line_count", "owners", "domains", "exporting", "composition", "protected", "consumers", "unsupported")


@query
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(_candidates(spark, sf_dir)[3])
    name = portfolio.suggested_name(F.col("first_domain"), F.col("cand").cast("string"), "@engine")
    return j.select("id", F.array_join("codes", ",").alias("codes"), "eligible", F.round("score", 6).alias("score"), "classification", F.col("review_units").cast("long").alias("review_units"), F.round(F.col("line_count") / F.col("review_units"), 6).alias("lines_per_unit"), name.alias("package"), "status", "cohesion", "risk", F.array_join("advice", ",").alias("advice"))


@query
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(_candidates(spark, sf_dir)[3])
    return j.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def closure_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each owner's files that leave it."""
    e = edges(spark, sf_dir)
    files = modules(spark, sf_dir).select(F.col("owner").alias("cand"), "path")
    refs = files.withColumnRenamed("path", "src").join(e, "src").select("cand", F.col("src").alias("source"), F.concat(F.lit("./"), "dst").alias("specifier"), F.lit(None).cast("string").alias("package"), F.col("dst").alias("resolved"), F.lit(False).alias("asset"))
    none = spark.createDataFrame([], "package string")
    c = portfolio.containment(refs, files, none, none, none)
    return c.groupBy("cand", F.col("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def owner_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("specifier", F.concat(F.lit("./"), "dst"))
    files = modules(spark, sf_dir).select(F.col("owner").alias("cand"), "path")
    return portfolio.consumers(files, e).select("cand", "importer", F.array_join("specifiers", ",").alias("specifiers"))


@query
def marginal_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains as candidates: each edge to another domain is what blocks it."""
    e = edges(spark, sf_dir)
    of = modules(spark, sf_dir)
    cross = e.join(of.select(F.col("path").alias("src"), "owner", F.col("domain").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("domain").alias("b")), "dst").where("a <> b")
    r = cross.groupBy("src", "owner").agg(F.struct(F.lit("crosses-domain").alias("code"), F.lit("another domain").alias("detail"), F.array_sort(F.collect_set("b")).alias("edges")).alias("one"))
    cands = r.join(of.select(F.col("path").alias("src"), "line_count"), "src").select(F.col("src").alias("id"), "line_count", F.array("one").alias("rejections"))
    return portfolio.marginal_blockers(cands)


def _supplier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("item"))


@query
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different sets of suppliers, each by the least order that has it (jaccard_classes: which orders do)."""
    return portfolio.jaccard_pairs(cut(portfolio.equal_sets(_supplier_sets(spark, sf_dir))[1]), 0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.equal_sets(_supplier_sets(spark, sf_dir))[0]


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, files, judged candidates, their groups)."""
    e, nodes, files, facts = _candidates(spark, sf_dir)
    keep = _keeper(spark, sf_dir)
    judged = keep("judged", lambda: _judged(facts))
    kinds = judged.select("id", "score", F.concat_ws("|", "application", "eligible", "classification", "status").alias("kind"))
    return e, nodes, files, judged, keep("groups", lambda: portfolio.equivalence_groups(kinds, files, CONFIG.similarity))


@query
def equivalence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)[4]


@query
def equivalence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, files, _, groups = _grouped(spark, sf_dir)
    return portfolio.group_summary(groups, files)


@query
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(_judged(_candidates(spark, sf_dir)[3]).where("eligible and status = 'recommended'"), "campaign", 1).select("id", F.round("score", 6).alias("score"))


@query
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible candidates that share no file, test or asset; a file's tests and assets are named by its key."""
    _, _, files, facts = _candidates(spark, sf_dir)
    some = cut(_judged(facts).where("eligible").select("id", "score"))
    own = files.join(some.select(F.col("id").alias("cand")), "cand", "left_semi")
    named = lambda rule, kind, by: own.where(rule).select(F.col("cand").alias("id"), F.concat(F.lit(kind), by).alias("path"))
    claims = own.select(F.col("cand").alias("id"), F.col("path").cast("string").alias("path"))
    claims = claims.union(named("path % 10 = 3", "test/", F.floor(F.col("path") / 20))).union(named("path % 10 = 7", "asset/", F.floor(F.col("path") / 20)))
    return portfolio.greedy_selection(some, claims)


@query
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, nodes, files, judged, groups = _grouped(spark, sf_dir)
    some = judged.join(groups.select(F.col("representative").alias("id")).distinct(), "id", "left_semi").select("cand", "line_count", "domains", "status")
    h = portfolio.hotspots(files, some, e, nodes)
    return h.withColumn("candidates", F.array_join("candidates", ","))


@query
def lazy_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    files = modules(spark, sf_dir).where("has_exports").select(F.col("domain").alias("cand"), "path")
    return portfolio.lazy_registry(e, files).select("src", "dst", F.array_join("candidates", ",").alias("candidates"))


@query
def strategy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = cut(_judged(_candidates(spark, sf_dir)[3]).select("id", "score", "domains", "escapes", "review_units", "line_count"))
    out = None
    for name in portfolio.STRATEGIES:
        one = portfolio.ranked(j, name, 20).select(F.lit(name).alias("strategy"), "id", F.col("place").cast("long").alias("place"))
        out = one if out is None else out.union(one)
    return out


@query
def bounded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = modules(spark, sf_dir).select("path", "line_count")
    return portfolio.bounded(nodes, [F.desc("line_count"), F.asc("path")], 25)


# Order and windows


@query
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_type", "p_brand").alias("cohort"), F.col("p_size").cast("long").alias("metric"))
    return windows.percentile(p, "cohort", "metric")


@query
def dominant_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.dominant(ev, "user_id", "event_type", "n").select("user_id", "dominant", F.round("concentration", 9).alias("concentration"))


@query
def capability_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = windows.partitions(o.select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")[1]
    return p.select(F.array_join("labels", ",").alias("labels"), "members", "first")


@query
def unused_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("property"))


@query
def multiset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda flag: l.where(F.col("l_returnflag") == flag).select("l_partkey", "l_linenumber")
    return windows.multiset_delta(pick("A"), pick("R")).groupBy("change", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return windows.last_writer(ev, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query
def adjacent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that repeat the type of the event before them, by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    return ev.where("before = event_type").select("user_id", "event_id", "event_type")


@query
def increasing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return windows.increasing_faults(ev, "user_id", "value", ["event_id"])


@query
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey")).alias("start"))  # noqa: E741
    spans = l.select("l_orderkey", "start", (F.col("start") + 25).alias("end")).distinct()
    return windows.overlaps(spans, "l_orderkey")


@query
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as operations on one file: each expects the status the one before left."""
    o = table(spark, sf_dir, "orders")
    ops = o.select(F.col("o_custkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("idx"), "o_orderkey", F.col("o_orderstatus").alias("result_hash"), F.when(F.col("o_orderkey") % 3 == 0, "O").otherwise("F").alias("pre_hash"))
    return windows.chain_faults(ops).select("path", "o_orderkey", "pre_hash", "state")


@query
def inventory_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' account digests before and after a change to some of them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.sha2(F.col("c_name"), 256).alias("sha"))
    before, after = c.where("path % 11 <> 0"), c.where("path % 13 <> 0").withColumn("sha", F.when(F.col("path") % 17 == 0, F.lit("x")).otherwise(F.col("sha")))
    return windows.inventory_diff(before, after, "path", "sha")


@query
def metric_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    per = lambda flag: l.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("lines"))
    return windows.ratchet(per("A"), per("R"))


@query
def preparation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics before and after, and their difference, over labelled documents."""
    b = table(spark, sf_dir, "labels")
    m = lambda d, s: d.agg(F.count(F.lit(1)).alias(f"rows_{s}"), F.sum("quality").alias(f"good_{s}"))
    j = m(b, "before").crossJoin(F.broadcast(m(b.where("toxic = 0"), "after")))
    return j.withColumns({"rows_delta": F.col("rows_after") - F.col("rows_before"), "good_delta": F.col("good_after") - F.col("good_before")})


# Scalar functions


@query
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path functions over pages' URLs."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    return p.select("page_id", paths.normalize_path(F.concat(F.lit("./"), F.translate("u", "/", "\\"))).alias("normal"), paths.package_name(F.concat(F.lit("@"), "u")).alias("package"), paths.types_package(F.col("u")).alias("types"), paths.strip_extension(F.col("u")).alias("stem"), paths.segments(F.col("u")).cast("long").alias("segments"), paths.selected(F.col("u"), "*.example.com/**").alias("globbed"))


@query
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-like tokens of the pages' markup and addresses, normalised, and how many there are."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(paths.tokens(F.concat_ws(" ", "html", "url"))).alias("token"))
    return p.select("page_id", paths.normalize_token(F.col("token")).alias("path")).where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query
def suffix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    return p.select("page_id", F.explode(paths.suffix_keys(F.col("u"), 2)).alias("key"))


@query
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", paths.newlines(F.col("text")).cast("long").alias("newlines"), paths.script_lines(F.col("text")).cast("long").alias("lines"), F.sha2("text", 256).alias("sha256"))


@query
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("small ring", "red widget", "large bolt", "blue gear")))
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", F.levenshtein("p_name", F.lit("small ring")).cast("long").alias("distance"), paths.closest(F.col("p_name"), names).alias("closest"))


@query
def numbers_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", paths.js_round((F.col("o_totalprice") - 250000) / 1000).cast("long").alias("rounded"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"), F.sha2(F.col("o_orderkey").cast("string"), 256).rlike("^[0-9a-f]{64}$").alias("is_hash"))


@query
def rendered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", paths.render("{brand}/{type}-{key}", {"brand": F.lower("p_brand"), "type": F.lower("p_type"), "key": F.col("p_partkey").cast("string")}).alias("name"))


@query
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the first "the" of each document, from its offset."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "the").alias("at")).where("at > 0")
    head = F.substring(F.col("text"), F.lit(1), F.col("at") - 1)
    return d.select("doc_id", (paths.newlines(head) + 1).cast("long").alias("line"), F.length(F.substring_index(head, "\n", -1)).cast("long").alias("column"))


@query
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by JSON pointer out of the events' properties."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# Plans


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as plans, their line items as operations on a part's files, one for each supplier; a delete-tree takes the part's folder."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("plan_id"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    p = modules(spark, sf_dir).select(F.col("path").alias("l_partkey"), "file")
    edit = F.when(F.col("l_linenumber") % 2 == 0, "consumer-manifest").otherwise("consumer-source")
    kind = F.when(F.col("l_returnflag") == "A", edit).when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49), "delete-tree").otherwise("write")
    path = F.when(kind == "delete-tree", F.col("file")).otherwise(F.concat_ws("/", "file", "l_suppkey"))
    keys = F.when(F.col("l_returnflag") == "A", F.array((F.col("l_linenumber") % 3).cast("string"))).otherwise(F.array().cast("array<string>"))
    return l.join(p, "l_partkey").select("plan_id", kind.alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), path.alias("path"), keys.alias("keys"), F.col("l_linenumber").alias("idx"))


@query
def plan_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflicts(conflicts.accesses(_operations(spark, sf_dir)))


@query
def plan_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(spark, sf_dir)
    hard = conflicts.conflicts(conflicts.accesses(ops.where("kind <> 'delete-tree'"))).where("not mergeable")
    return conflicts.waves(ops.select("plan_id", (F.col("plan_id") % 7).cast("double").alias("priority")).distinct(), hard)


@query
def operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.operation_counts(_operations(spark, sf_dir), ("move", "write", "rewrite", "delete", "delete-tree", "consumer-source", "consumer-manifest", "generate"))


@query
def duplicate_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.duplicate_operations(_operations(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


#: (k, step, kind, folder it moves to, what is put behind the content): journals of customers by the last digit of their key.
STEPS = [
    (1, 0, "rewrite", None, "!"), (1, 1, "move", "moved/", None), (2, 0, "rewrite", None, "!"), (3, 0, "delete", None, None),
    (4, 0, "move", "moved/", None), (4, 1, "rewrite", None, "?"), (4, 2, "move", "final/", None), (5, 0, "move", "moved/", "~"),
    (6, 0, "done", None, ""), (6, 1, "move", "moved/", None),
]


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a file tree, and a journal over it: chains of moves, rewrites and deletions by key, some done before, and a new file where one was moved away."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 10).alias("k"))
    at = lambda folder: F.concat(F.lit(folder), F.col("c_custkey"))
    tree = c.select(at("c/").alias("path"), F.col("c_name").alias("content"))
    ops, state = [], {k: (at("c/"), F.col("c_name")) for k in range(1, 7)}
    digest = lambda x: F.sha2(x, 256)
    none = F.lit(None).cast("string")
    for k, step, kind, folder, more in STEPS:
        path, text = state[k]
        target = at(folder) if folder else none
        new = F.concat(text, F.lit(more)) if more else none
        after = new if more else text
        pre = digest(F.lit("older")) if kind == "done" else digest(text)
        given = text if kind == "done" else new
        ops.append(c.where(F.col("k") == k).select((4 * F.col("c_custkey") + step).alias("idx"), F.lit("rewrite" if kind == "done" else kind).alias("kind"), path.alias("path"), target.alias("target"), given.alias("content"), pre.alias("pre_hash"), (none if kind == "delete" else digest(after)).alias("result_hash")))
        state[k] = (target if folder else path, after)
    stub = F.concat(F.lit("stub "), F.col("c_name"))
    ops.append(c.where("k = 5").select((4 * F.col("c_custkey") + 1).alias("idx"), F.lit("write").alias("kind"), at("c/").alias("path"), none.alias("target"), stub.alias("content"), none.alias("pre_hash"), digest(stub).alias("result_hash")))
    every = ops[0]
    for o in ops[1:]:
        every = every.union(o)
    return tree, every


@query
def journal_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.apply_journal(*_tree(spark, sf_dir))


@query
def journal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where that journal can't land if some files were edited meanwhile and some recorded digests are wrong."""
    tree, ops = _tree(spark, sf_dir)
    key = F.substring_index("path", "/", -1).cast("long") % 70
    tree = tree.withColumn("content", F.when(key == 4, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    wrong = (F.floor(F.col("idx") / 4) % 70 == 12) & (F.col("idx") % 4 == 0)
    return journal.preconditions(tree, ops.withColumn("result_hash", F.when(wrong, F.sha2(F.lit("wrong"), 256)).otherwise(F.col("result_hash")))).select("idx", "fault")


@query
def byte_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a landed tree in which some files were altered, lost or left."""
    tree, ops = _tree(spark, sf_dir)
    landed = journal.apply_journal(tree, ops).select("path", F.sha2(F.when(F.col("path").endswith("7"), F.concat("content", F.lit("?"))).when(F.col("path").endswith("42"), F.lit("other")).otherwise(F.col("content")), 256).alias("sha256")).where("path not like '%51'")
    landed = landed.union(tree.where("path like '%93'").select("path", F.sha2("content", 256)))
    return journal.byte_fidelity(ops, landed)


@query
def projected_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.projected(_tree(spark, sf_dir)[1])


@query
def ledger_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ledgers."""
    c = table(spark, sf_dir, "conversations")
    l = c.select(F.col("conv_id").alias("campaign"), F.col("turn").alias("seq"), F.sha2("text", 256).alias("id"), F.col("role").alias("kind"), F.when(F.col("turn") < 6, "a").otherwise("b").alias("baseline"), F.when(F.col("role") == "assistant", "applied").otherwise("planned").alias("status"), (F.length("text") % 2 == 0).alias("audit_passed"))  # noqa: E741
    return journal.ledger_issues(l.dropDuplicates(["campaign", "seq", "id"])).groupBy("campaign", "issue").agg(F.count(F.lit(1)).alias("n"))


@query
def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    d = ev.select("user_id", F.when((F.col("event_type") == "error") & (F.col("value") > 60), "fatal").when(F.col("event_type") == "error", "degraded").otherwise("none").alias("severity"), (F.col("value") < 1).alias("allowed_empty"))
    return journal.qualification(d, "user_id")


@query
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    f = o.select("o_orderkey", (s == "F").alias("applied"), (F.col("o_totalprice") > 100000).alias("audited"), (F.col("o_orderkey") % 4 == 0).alias("reconciled"), (s == "P").alias("dirty"), (F.col("o_orderkey") % 9 == 0).alias("stale"), F.lit(False).alias("failed"), F.lit(True).alias("planned"))
    return journal.lifecycle(f).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Symbols and seams


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir, 40).select("src", "dst", F.when(F.col("type_only"), "type").otherwise("value").alias("space"))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_partkey").alias("group"), F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("affinity"))


@query
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_edges(_references(spark, sf_dir))


@query
def keyed_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.keyed_edges(_references(spark, sf_dir), modules(spark, sf_dir).select(F.col("path").alias("id"), F.col("domain").alias("file")))


@query
def declaration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    g = symbols.groups(p.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("start"), F.col("p_partkey").alias("id")))
    return g.select("file", "name", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query
def external_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.external_consumers(_uses(spark, sf_dir))


@query
def most_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.most_references(symbols.external_consumers(_uses(spark, sf_dir)))


@query
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols.split_candidates(symbols.external_consumers(_uses(spark, sf_dir)), edges(spark, sf_dir))
    return s.withColumn("concentration", F.round("concentration", 9))


@query
def seam_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = modules(spark, sf_dir).where("owner = 'PROMO'").select(F.col("path").alias("id"))
    return symbols.seam_crossings(edges(spark, sf_dir).select("src", "dst"), moved)


@query
def compatibility_shims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one supplier alone sells, imported often enough."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")  # noqa: E741
    return symbols.shims(l.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("package")), edges(spark, sf_dir, 45), 1)


# Moves


@query
def evaluation_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return evacuation.evaluation_reach(e, modules(spark, sf_dir).where("domain = 'Brand#1'").select(F.col("path").alias("id")))


@query
def bounded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir, 48))
    m = modules(spark, sf_dir)
    return evacuation.bounded_union(cut(graph.strong_components(e)), e, m.where("line_count > 47").select(F.col("path").alias("id")), m.where("path % 97 = 0").select(F.col("path").alias("id")))


@query
def boundary_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = modules(spark, sf_dir).where("application = 'web'").select(F.col("path").alias("id"))
    return evacuation.boundary_cuts(edges(spark, sf_dir), moved, F.col("dst") % 97 == 0, F.col("dst") % 5 == 0)


@query
def retained_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    files = m.where("owner <> 'PROMO'").select(F.col("owner").alias("cand"), "path")
    return evacuation.retained_blockers(files, edges(spark, sf_dir), m.where("owner = 'PROMO'"))


@query
def travelling_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    return evacuation.travelling_tests(m.where("path % 3 = 0").select(F.col("path").alias("id")), edges(spark, sf_dir), m.where("path % 3 = 1").select(F.col("path").alias("id")))


@query
def promotion_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component without its least member."""
    e = cut(edges(spark, sf_dir, 48))
    comps = cut(graph.strong_components(e))
    node = comps.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
    return evacuation.promotion_cut(e, comps, node)


@query
def connectivity_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = condensed_view(spark, sf_dir)
    return evacuation.spanning_forest(v.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("weight")))


@query
def weak_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evacuation.clusters(edges(spark, sf_dir).where("not dynamic"))


@query
def cohesion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as methods of a supplier's lines, parts as the fields that they use."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return evacuation.cohesion_clusters(l.select(F.concat_ws("/", "l_suppkey", "l_linenumber").alias("owner"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("field")))


# Dependencies


@query
def dependency_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return dependencies.evidence(l.select(F.col("l_partkey").alias("owner"), F.col("l_suppkey").alias("package"), F.when(F.col("l_linestatus") == "O", "runtime").otherwise("dev").alias("section")))


@query
def version_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("package"), F.col("p_type").alias("version"))
    return dependencies.versions(d, d.where("owner = 'Brand#1'"))


@query
def donor_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("owner"), F.col("l_suppkey").alias("package"), "l_returnflag", "l_linestatus", "l_quantity")  # noqa: E741
    return dependencies.prunable(l.select("owner", "package").distinct(), l.where("l_returnflag = 'R'"), l.where("l_linestatus = 'O' and l_quantity > 25"), l.where("package = 7"))


@query
def missing_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("importer"), F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("version"))  # noqa: E741
    return dependencies.missing_resolutions(l.distinct(), l.where("importer % 2 = 1"))


# Audit and assessment


@query
def target_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    moves = p.select(F.col("p_partkey").alias("source"), F.concat_ws("/", F.lit("libs"), F.lower("p_brand"), "p_name").alias("target"))
    return audit.target_collisions(moves).select("target", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query
def missing_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    refs = e.select(F.col("src").alias("path"), F.col("dst").alias("resolved"), F.concat(F.lit("./"), "dst").alias("specifier"))
    return audit.missing_rewrites(refs, modules(spark, sf_dir).where("path % 3 = 0").select(F.col("path").alias("source")), refs.where("path % 2 = 0"))


@query
def boundary_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = edges(spark, sf_dir), modules(spark, sf_dir)
    return audit.boundary_breaks(e, m.where("zone = 'package'"), m.where("zone = 'application'"), e.where("dynamic"))


@query
def source_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return audit.conservation(d.where("path % 7 <> 0"), d.where("path % 5 <> 0").withColumn("sha256", F.when(F.col("path") % 11 == 0, F.lit("x")).otherwise(F.col("sha256"))))


@query
def postconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    packages = c.where("c_custkey % 3 <> 0").select((F.col("c_custkey") % 400).cast("string").alias("name"), F.col("c_custkey").alias("owner"))
    deps = o.select((F.col("o_custkey") % 50).alias("owner"), (F.col("o_custkey") % 900).cast("string").alias("name"), F.when(F.col("o_orderstatus") == "P", "workspace:*").otherwise("1").alias("range"), F.when(F.col("o_totalprice") > 400000, "dev").otherwise("runtime").alias("section"))
    return audit.postconditions(packages, deps)


@query
def accepted_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ops = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("result_hash"))
    accepted = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path"), F.lit("accepted").alias("sha256"))
    return audit.overlay(ops, accepted).select("path", "idx", "result_hash")


@query
def declarative_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal replaced in each document where it stands exactly once."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    out = audit.declarative_edits(d, d.select("path", F.lit(" with ").alias("before"), F.lit(" WITH ").alias("after")))
    return out.select("path", "status", F.sha2("content", 256).alias("sha256"))


@query
def input_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's folder: members, bytes, and a digest of the folder by bundles of 1,000 ids."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    size = d.groupBy("source").agg(F.sum("size").alias("bytes"))
    return records.tree_hash(d, "source", "doc_id", "sha", 1000).select("source", F.col("files").alias("members"), "digest").join(size, "source")


@query
def unbound_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as reports, bound to customers, as inputs: without one, or with another state."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 20 <> 0")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    fault = F.when(F.col("c_custkey").isNull(), "unbound").when((F.col("c_acctbal") < 0) & (F.col("o_orderstatus") == "O"), "drifted")
    return j.select("o_orderkey", fault.alias("fault")).where("fault is not null")


@query
def graph_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each owner's outgoing edges in order, by bundles of 1,000 sources."""
    e = edges(spark, sf_dir).join(modules(spark, sf_dir).select(F.col("path").alias("src"), "owner"), "src")
    per = e.groupBy("owner", "src").agg(F.array_join(F.array_sort(F.collect_list("dst")).cast("array<string>"), ";").alias("out"))
    return records.tree_hash(per, "owner", "src", "out", 1000).select("owner", "digest")


@query
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", documents.canonical_json(F.concat(F.lit('{"z": [1.0, 2], "a": '), "props", F.lit("}"))).alias("json"))


@query
def spliced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and third characters of each text replaced, and the fifth taken out."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 6)
    put = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("<a>").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("").alias("text")), F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit("<b>").alias("text")))
    return d.select("doc_id", F.sha2(documents.splice(F.col("text"), put), 256).alias("sha256"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, their line items as functions, suppliers as collaborators."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", "react-component").when(F.col("o_orderpriority") == "2-HIGH", "react-hook").otherwise("module").alias("archetype"))
    loc = F.floor(F.col("l_extendedprice") / 1000)
    functions = l.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("cyclo"), F.col("l_quantity").cast("long").alias("cognitive"), (F.col("l_suppkey") % 6).alias("nest"), loc.alias("loc"))
    # Sets of one order's lines: distinct counts would shuffle each line five times.
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")
    facts = l.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("path")).agg(kinds("l_suppkey").alias("fan_out"), kinds("l_returnflag").alias("responsibilities"), F.count_if(F.col("l_quantity") > 20).alias("ctor_params"), (kinds("l_partkey") + kinds("l_quantity")).alias("vocabulary"), (F.sum("l_linenumber") + 1).alias("cyclomatic"), F.sum(loc).alias("lines"))
    files = o.join(facts, "path", "left").fillna(0, facts.columns[1:])
    return metrics.file_metrics(files, functions)


@query
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _measured(spark, sf_dir)
    return f.select("path", "functions", "max_cognitive", "max_nest", "max_loc", "fan_out", "responsibilities", F.round("avg_cyclo", 6).alias("avg_cyclo"), F.round("structural", 6).alias("structural"), F.round("volume", 6).alias("volume"))


@query
def levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cut(_measured(spark, sf_dir).withColumn("structural", F.round("structural", 6)))
    return metrics.levers(f.join(metrics.percentiles(f), "path")).select("path", "lever", "driver", *[f"p_{m}" for m in metrics.RANKED])


# More of candidates and assessment


@query
def recipe_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select(F.col("file").alias("path"), F.col("path").alias("k"))
    promotions = spark.createDataFrame([(2, "src/promo"), (1, "src/promo"), (3, "src/small")], "id long, path string")
    return portfolio.recipe_steps(m.select("path"), m.where("k % 7 = 0").select(F.col("k").alias("id"), "path"), promotions)


@query
def hotspot_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = portfolio.hotspot_actions(hotspots(spark, sf_dir), Config(fan_in_action=2, fan_out_action=2))
    return h.select("path", F.array_join("actions", ",").alias("actions"))


@query
def target_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, suppliers as packages."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    uses = l.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("package"))
    c = l.groupBy(F.col("l_orderkey").alias("id")).agg((F.min("l_suppkey") + F.max("l_linenumber")).alias("suggested"))
    return portfolio.target_options(c, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("package")), uses)


@query
def rewritable_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders need of a supplier's parts, against what its surface offers."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    needed = l.where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("package")).agg(F.array_sort(F.collect_set(F.when(F.col("l_tax") == 0, "default").otherwise(F.col("l_returnflag")))).alias("bindings"))
    surface = l.where("l_quantity <= 45").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("target"), F.when(F.col("l_discount") == 0, "*").otherwise(F.col("l_returnflag")).alias("name"))
    return portfolio.rewritable(needed, surface)


@query
def campaign_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = cut(_judged(_candidates(spark, sf_dir)[3]).select("id", "line_count", F.col("review_units").cast("long").alias("review_units"), "first_domain"))
    groups = j.withColumn("representative", F.min("id").over(Window.partitionBy("first_domain", "line_count"))).select("id", "representative")
    return portfolio.campaign_targets(j, groups, 15).select("id", "line_count", F.round("rate", 6).alias("rate"))


@query
def gate_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("project", "test {owner}"), ("project", "lint {owner}"), ("package", "build"), ("workspace", "check"), ("workspace", "check")], "tier string, command string")
    return portfolio.gates(modules(spark, sf_dir), templates)


@query
def stop_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "applied").otherwise("planned").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "extraction").otherwise("preparation").alias("kind"), "o_totalprice")
    rules = [("budget", F.col("o_totalprice") > 450000), ("no-progress", F.col("o_totalprice") < 20000), ("milestone", F.col("o_orderkey") % 100 == 0)]
    return portfolio.stop_condition(o, rules).where("stop is not null").select("o_orderkey", "stop")


@query
def workspace_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = lambda d: d.select(F.concat_ws("/", F.lower("p_brand"), F.when(F.col("p_size") == 50, "..").otherwise(F.lower("p_type")), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path"))
    return portfolio.coverage(name(p.where("p_partkey % 2 = 0")), name(p.where("p_partkey % 3 = 0")), name(p.where("p_partkey % 5 <> 0")))


@query
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(_candidates(spark, sf_dir)[3])
    status = F.col("status")
    return j.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("blocked"), F.count_if(status == "recommended").alias("recommended"), F.count_if(status == "discouraged").alias("discouraged"), F.sum(F.when(F.col("eligible"), F.col("line_count")).otherwise(0)).alias("eligible_lines"))


@query
def ratchet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_ratchet(spark, sf_dir).groupBy("metric", "verdict").agg(F.count(F.lit(1)).alias("n"))


# References


@query
def relative_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).select("path", "file", F.lower("owner").alias("folder"))
    tree = m.select(F.concat("file", F.when(F.col("path") % 4 == 0, ".ts").when(F.col("path") % 4 == 1, "/index.ts").when(F.col("path") % 4 == 2, ".js").otherwise(".css")).alias("path"))
    e = edges(spark, sf_dir).join(m.select(F.col("path").alias("src"), F.concat("file", F.lit(".ts")).alias("source")), "src").join(m.select(F.col("path").alias("dst"), "folder"), "dst")
    refs = e.select("source", F.concat(F.lit("../"), "folder", F.lit("/./"), "dst").alias("specifier"))
    return references.resolve_relative(refs, tree)


@query
def triggered_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("docs", None), ("promo", "^src/promo/"), ("none", "^lib/"), ("tens", "0$")], "name string, pattern string")
    return references.triggered(a, modules(spark, sf_dir).select(F.col("file").alias("path")))


@query
def ambiguous_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of pages' URLs that more than one page has."""
    k = suffix_keys(spark, sf_dir)
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("to"))
    return references.ambiguous(k.join(p, "page_id").select(F.lit("index").alias("file"), F.col("key").alias("start"), F.col("key").alias("end"), "to")).select(F.col("start").alias("key"), "choices")


@query
def rewrite_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return references.collisions(l.select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("to"), F.col("l_suppkey").alias("donor")))


@query
def rewrite_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"), "l_quantity")  # noqa: E741
    return references.unreplayed(l.drop("l_quantity").distinct(), l.where("l_quantity > 5"))


@query
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits whose parent should be the turn before; every seventh turn names another."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("t"))
    return references.chain_breaks(c.select(F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", F.col("turn") - F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, 2).otherwise(1)).alias("parent")))


@query
def unclosed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.unclosed(modules(spark, sf_dir).where("owner in ('PROMO', 'SMALL')").select(F.col("path").alias("id")), edges(spark, sf_dir))


@query
def seam_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir).where("owner = 'PROMO'")
    e = edges(spark, sf_dir)
    cyc = e.join(e.select(F.col("src").alias("d"), F.col("dst").alias("s")), (F.col("dst") == F.col("d")) & (F.col("src") == F.col("s")), "left_semi").select(F.col("src").alias("id"))
    return references.seam_blockers(("exact", "no-exports", m.where("not has_exports").select(F.col("path").alias("id"))), ("exact", "cycle", cyc), ("heuristic", "large", m.where("line_count > 45").select(F.col("path").alias("id"))))


@query
def batch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files under most pressure, for a batch of declarations."""
    return hotspots(spark, sf_dir).orderBy(F.desc("pressure"), "path").limit(10).select("path", "pressure")


@query
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report paths without the machine's root."""
    m = modules(spark, sf_dir)
    return m.select("path", F.regexp_replace(F.concat(F.when(F.col("path") % 2 == 0, "/home/u/work/").otherwise(""), "file"), "^/home/u/work/", "").alias("file"))
