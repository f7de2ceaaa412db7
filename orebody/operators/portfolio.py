"""Candidates for extraction: containment, consumers, rejections, scores, groups, selection, blockers, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Weights
from ..session import cut, grows
from .windows import below


def containment(refs: DataFrame, files: DataFrame, builtins: DataFrame, workspace: DataFrame, installed: DataFrame) -> DataFrame:
    """refs (cand, source, specifier, package, resolved, asset) with class: internal, asset, builtin, workspace, installed, external or escape.

    files: (cand, path) of each closure. A reference that resolves inside is internal; one that
    resolves outside, or is relative and doesn't resolve, escapes.
    """
    inside = files.select("cand", F.col("path").alias("resolved"), F.lit(True).alias("__in"))
    flag = lambda d, n: d.select("package").distinct().withColumn(n, F.lit(True))
    r = refs.join(inside, ["cand", "resolved"], "left").join(flag(builtins, "__b"), "package", "left").join(flag(workspace, "__w"), "package", "left").join(flag(installed, "__i"), "package", "left")
    relative = F.col("specifier").startswith(".")
    kind = F.when(F.col("__in"), "internal").when(F.col("asset"), "asset").when(F.col("resolved").isNotNull() | relative, "escape").when(F.col("__b"), "builtin").when(F.col("__w"), "workspace").when(F.col("__i"), "installed").otherwise("external")
    return r.withColumn("class", kind).drop("__in", "__b", "__w", "__i")


def consumers(files: DataFrame, edges: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(cand, importer, specifiers): who outside imports a file inside; tests (target, test) come with no specifiers."""
    into = files.select("cand", F.col("path").alias("dst")).join(edges, "dst").select("cand", F.col("src").alias("importer"), "specifier")
    if tests is not None:
        into = into.union(files.select("cand", F.col("path").alias("target")).join(tests, "target").select("cand", F.col("test").alias("importer"), F.lit(None).cast("string")))
    outside = into.join(files.select("cand", F.col("path").alias("importer")), ["cand", "importer"], "left_anti")
    return outside.groupBy("cand", "importer").agg(F.array_sort(F.collect_set("specifier")).alias("specifiers"))


def reasons(candidates: DataFrame, config: Config) -> DataFrame:
    """candidates with ``codes``, the rejections in rule order, from their facts.

    Facts: files, owners, unresolved, stale_generated (generated files whose source is gone),
    composition, unsupported, declarations, exporting, inbound (who imports the seed component), tests,
    uninstalled, unmovable, escapes, protected, collisions (files that would land on one target).
    """
    c = F.col
    rules = [
        ("multiple-owners", c("owners") != 1),
        ("unresolved-imports", c("unresolved") > 0),
        ("generated-source-missing", c("stale_generated") > 0),
        ("composition-root", c("composition") > 0),
        ("unsupported-module-reference", c("unsupported") > 0),
        ("declaration-only", c("declarations") == c("files")),
        ("no-exports", (c("inbound") == 0) & (c("tests") == 0) & (c("exporting") == 0)),
        ("uninstalled-package", c("uninstalled") > 0),
        ("unmovable-asset", c("unmovable") > 0),
        ("closure-escapes-app-code", c("escapes") > 0),
        ("protected-path", c("protected") > 0),
        ("too-small", c("files") < config.min_files),
        ("too-large", c("files") > config.max_files),
        ("unplannable", c("collisions") > 0),
    ]
    return candidates.withColumn("codes", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules])))


#: Reasons that discourage a candidate; any other only asks for review.
DISCOURAGING = ("generic-target", "composition-adjacent", "compatibility-shim", "large-review")


def recommendation_reasons(candidates: DataFrame, config: Config) -> DataFrame:
    """candidates with ``advice``, the reasons against a plain recommendation in order, ``status`` and ``cohesion``.

    Facts: segment (last part of the suggested name), adjacent (files beside the composition),
    shims, domains, high_inbound and high_fan_out (files over the thresholds), files, line_count,
    effectful (files that do work when evaluated). A review limit that isn't set doesn't count.
    """
    c = F.col
    over = F.lit(False)
    if config.max_recommended_files is not None:
        over = over | (c("files") > config.max_recommended_files)
    if config.max_recommended_lines is not None:
        over = over | (c("line_count") > config.max_recommended_lines)
    rules = [
        ("generic-target", c("segment").isin(*config.generic_segments) if config.generic_segments else F.lit(False)),
        ("composition-adjacent", c("adjacent") > 0),
        ("compatibility-shim", c("shims") > 0),
        ("cross-domain", c("domains") > 1),
        ("high-inbound", c("high_inbound") > 0),
        ("high-fan-out", c("high_fan_out") > 0),
        ("large-review", over),
        ("evaluation-effects", c("effectful") > 0),
    ]
    out = candidates.withColumn("advice", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules])))
    cohesion = F.when(c("domains") <= 1, "high").when(c("domains") == 2, "medium").otherwise("low")
    return out.withColumns({"status": recommendation(c("advice"), list(DISCOURAGING)), "cohesion": cohesion})


def risk() -> Column:
    """high for a rejected or discouraged candidate, medium for one with warnings or to be reviewed, else low; needs codes, status and warnings."""
    return F.when((F.size("codes") > 0) | (F.col("status") == "discouraged"), "high").when((F.col("warnings") > 0) | (F.col("status") == "review-required"), "medium").otherwise("low")


def classification(blockers: Column, domains: Column, only: Column, root: str, forbid_root: bool) -> Column:
    """preparation if retained code blocks it, or if its one domain is the application's own root and that may not be a target; else extraction."""
    alone = (domains == 1) & (only == root) if forbid_root else F.lit(False)
    return F.when((blockers > 0) | alone, "preparation").otherwise("extraction")


def first_reasons(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the reasons (key, code, detail) of a candidate, the first of each code and detail."""
    w = Window.partitionBy(key, "code", "detail").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def detail_view(claims: DataFrame) -> DataFrame:
    """(cand, files, tests, assets, closure): the claims (cand, path, role) of a candidate as sorted arrays without repeats."""
    of = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("path"))))
    return claims.groupBy("cand").agg(of("file").alias("files"), of("test").alias("tests"), of("asset").alias("assets"), F.array_sort(F.collect_set("path")).alias("closure"))


def claiming(claims: DataFrame, path: str) -> DataFrame:
    """(cand) of the candidates that claim the path or something below it; the path must stay in the workspace."""
    clean = path.replace("\\", "/").removeprefix("./").rstrip("/")
    if not clean or any(s in ("", "..") for s in clean.split("/")):
        raise ValueError(f"candidate path must be relative to the workspace: {path}")
    return claims.where((F.col("path") == clean) | F.col("path").startswith(clean + "/")).select("cand").distinct()


def coverage_share() -> Column:
    """Tests for each file, one at most."""
    return F.when(F.col("tests") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("tests") / F.greatest(F.lit(1), F.col("files"))))


def score(w: Weights) -> Column:
    """Weighted sum over ten terms.

    Facts: line_count, shim_lines (of compatibility shims, not counted), files, churn (who imports or tests the seed
    component), tests, dependencies (packages the seed component uses), rejections, rewrites
    (escapes that can be rewritten), domains (both crossings count once, above one), retained (edges to code that stays).
    """
    c = F.col
    crossing = (c("domains") > 1).cast("int")
    return (
        w.line_count * (c("line_count") - c("shim_lines")) + w.file * c("files") + w.consumer * c("churn") + w.test_coverage * coverage_share() + w.prerequisite * c("dependencies")
        + w.rejection * c("rejections") + w.rewrite_escape * c("rewrites") + (w.domain_crossing + w.runtime_crossing) * crossing + w.retained_edge * c("retained")
    )


def review_units() -> Column:
    """files + tests + assets + 3 churn + 2 rewrites + dependencies + 2 warnings + 5 rejections + 2 reasons, 1 at least."""
    c = F.col
    return F.greatest(F.lit(1), c("files") + c("tests") + c("assets") + 3 * c("churn") + 2 * c("rewrites") + c("dependencies") + 2 * c("warnings") + 5 * c("rejections") + 2 * c("reasons"))


def suggested_name(domain: Column, fallback: Column, scope: str | None = None) -> Column:
    """A package name from the last part of the first domain, else the fallback."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(domain, ":"), -1)), "[^a-z0-9]+", "-"), "^-|-$", "")
    name = F.when(slug.rlike("^[a-z0-9][a-z0-9-]*$"), slug).otherwise(fallback)
    return F.concat(F.lit(scope + "/"), name) if scope else name


def recommendation(codes: Column, discouraging: list[str]) -> Column:
    return F.when(F.arrays_overlap(codes, F.array(*map(F.lit, discouraging))), "discouraged").when(F.size(codes) > 0, "review-required").otherwise("recommended")


def marginal_blockers(candidates: DataFrame) -> DataFrame:
    """(code, edge, occurrences, freed, freed_lines): what each blocking edge holds back.

    candidates: id, line_count, rejections array<struct<code, detail, edges array<string>>>. A
    candidate is freed by a blocker only if that is its sole reason and has one edge at most.
    """
    sole = F.size("rejections") == 1
    each = candidates.select("id", "line_count", sole.alias("sole"), F.explode("rejections").alias("r"))
    each = each.select("id", "line_count", (F.col("sole") & (F.size("r.edges") <= 1)).alias("frees"), "r.code", "r.detail", F.explode_outer("r.edges").alias("edge"))
    return each.groupBy("code", F.coalesce("edge", "detail").alias("edge")).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("frees").alias("freed"), F.coalesce(F.sum(F.when(F.col("frees"), F.col("line_count"))), F.lit(0)).alias("freed_lines"))


def equal_sets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, same) and (id, s): the least id with the same set of items (id, item) as each id, and the distinct sets by that id."""
    return _by_set(_sets(members))


def _sets(members: DataFrame) -> DataFrame:
    """(id, s, k): the set of items of each id, and its digest."""
    return members.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("s")).withColumn("k", F.sha2(F.to_json(F.struct("s")), 256))


def _by_set(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    distinct = sets.groupBy("k").agg(F.min("id").alias("same"), F.first("s").alias("s"))
    return sets.select("id", "k").join(distinct.select("k", "same"), "k").select("id", "same"), distinct.select(F.col("same").alias("id"), "s")


#: Sets up to this size meet by two items, larger ones by one.
SMALL_SET = 16


def near_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b) once each: pairs of sets (id, s) among which are all different ones whose Jaccard similarity is ``least`` or more.

    Prefix filtering: items are ordered by how rare they are. Sets of n and m items that share q or more have their
    first l shared ones among the first n - q + l and m - q + l. Up to SMALL_SET items they meet by
    sizes and two such items (one, if q is 1), so an item that many sets hold makes no square of them. Where the larger set has more, they meet
    by one item and a band of sizes, and are kept if the item's places leave room for q. A set is only asked
    for sizes at which a different set can be as similar.
    """
    n, m = F.col("n"), F.col("m")
    # A little less than the bounds: what is let in by rounding is compared in full.
    share = lambda x, y: F.ceil((x + y) * (least / (1 + least)) - 1e-6).cast("int")
    lowest, highest = F.greatest(F.lit(1), F.ceil(n * least - 1e-6).cast("int")), F.floor(n / least + 1e-6).cast("int")
    band = lambda x: F.floor(F.log(x) / F.log(F.lit(1.25)) + 1e-6).cast("int")
    item = sets.select("id", F.explode("s").alias("item"))
    ordered = item.join(grows(item.groupBy("item").agg(F.count(F.lit(1)).alias("df"))), "item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("o"))
    ordered = cut(ordered.withColumn("n", F.size("o")))

    sized = ordered.where(n <= SMALL_SET).select("id", "o", "n", F.explode(F.sequence(lowest, F.least(highest, F.lit(SMALL_SET)))).alias("m"))
    sized = sized.withColumn("q", share(n, m)).where((n != m) | (F.col("q") < n))
    head = sized.select("id", "n", "m", "q", F.slice("o", F.lit(1), n - F.col("q") + F.least(F.col("q"), F.lit(2))).alias("p"))
    two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keyed = head.select("id", "n", "m", F.explode(F.when(F.col("q") > 1, two).otherwise(F.transform("p", lambda x: F.struct(x.alias("x"), x.alias("y"))))).alias("k"))
    side = lambda c: keyed.where(n <= m if c == "u" else n >= m).select(F.col("id").alias(c), F.least("n", "m").alias("lo"), F.greatest("n", "m").alias("hi"), "k.x", "k.y")
    small = side("u").join(grows(side("v")), ["lo", "hi", "x", "y"]).where((F.col("lo") < F.col("hi")) | (F.col("u") < F.col("v"))).select("u", "v")

    first = ordered.where(highest > SMALL_SET).select("id", "n", highest.alias("most"), F.posexplode(F.slice("o", F.lit(1), n - lowest + 1)).alias("r", "item"))
    u = first.select(F.col("id").alias("u"), "item", F.col("n").alias("nu"), F.col("r").alias("ru"), "most", F.explode(F.sequence(band(n), band(F.col("most")))).alias("band"))
    v = first.where(n > SMALL_SET).select(F.col("id").alias("v"), "item", F.col("n").alias("nv"), F.col("r").alias("rv"), band(n).alias("band"))
    nu, nv = F.col("nu"), F.col("nv")
    room = lambda k, r: F.col(r) <= k - share(nu, nv)
    large = u.join(grows(v), ["item", "band"]).where((nv <= F.col("most")) & ((nu < nv) | ((nu == nv) & (F.col("u") < F.col("v")))) & room(nu, "ru") & room(nv, "rv")).select("u", "v")
    return small.union(large).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of different sets (id, s) whose Jaccard similarity is ``least`` or more: near_pairs(), compared in full."""
    of = lambda x: grows(sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")))
    both = near_pairs(sets, least).join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    sim = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= least)


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (id) that a greedy pass in order of id keeps, if a kept one bars its neighbours. edges: (lo, hi), lo before hi.

    In rounds: a node is kept once every lower neighbour is barred, and bars its own; what is
    decided leaves the graph. A round is two joins; there are as many rounds as the longest chain of
    decisions that hang on one another, in practice a few.
    """
    free, left, kept = cut(nodes.select("id").distinct()), cut(edges.select("lo", "hi").distinct()), None
    while not free.isEmpty():
        now = cut(free.join(left.select(F.col("hi").alias("id")), "id", "left_anti"))
        barred = cut(left.join(now.select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id")).distinct())
        kept = now if kept is None else kept.union(now)
        out = now.union(barred)
        free = cut(free.join(out, "id", "left_anti"))
        left = cut(left.join(out.select(F.col("id").alias("lo")), "lo", "left_anti").join(barred.select(F.col("id").alias("hi")), "hi", "left_anti"))
    return kept if kept is not None else nodes.select("id").limit(0)


def equivalence_groups(candidates: DataFrame, files: DataFrame, least: float) -> DataFrame:
    """(id, seed, representative, similarity): in order of id, the least free candidate takes in the free ones of its kind whose files are similar to its own.

    candidates: (id, score, kind); files: (cand, path). Candidates of one kind with the same files
    are decided as one; between different sets the seeds are those of first_independent() over
    the pairs at ``least`` or above, and each other set goes to its least seed. The representative has the greatest score, then the least id.
    """
    # Both results read the sets: they are made once.
    classes, sets = _by_set(cut(_sets(files.select(F.col("cand").alias("id"), F.col("path").alias("item")))))
    pairs = jaccard_pairs(cut(sets), least)
    own = candidates.select("id", "score", "kind").join(classes, "id")
    own = cut(own.withColumn("node", F.min("id").over(Window.partitionBy("same", "kind"))))
    nodes = cut(own.where("id = node").select("node", "same", "kind"))
    side = lambda n: nodes.select(F.col("same").alias(n), F.col("node").alias(f"n{n}"), "kind")
    near = pairs.join(side("a"), "a").join(side("b"), ["b", "kind"])
    near = cut(near.select(F.least("na", "nb").alias("lo"), F.greatest("na", "nb").alias("hi"), "similarity"))
    seeds = cut(first_independent(nodes.select(F.col("node").alias("id")), near))
    taken = near.join(seeds.select(F.col("id").alias("lo")), "lo", "left_semi").groupBy(F.col("hi").alias("node")).agg(F.min(F.struct("lo", "similarity")).alias("s"))
    place = seeds.select(F.col("id").alias("node"), F.col("id").alias("seed"), F.lit(1.0).alias("similarity")).union(taken.join(seeds.select(F.col("id").alias("node")), "node", "left_anti").select("node", "s.lo", "s.similarity"))
    joined = own.join(place, "node")
    best = joined.groupBy("seed").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("seed", F.col("b.id").alias("representative"))
    return joined.join(best, "seed").select("id", "seed", "representative", "similarity")


def group_summary(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(group, representative, candidates, shared, similarity) of equivalence_groups(): ``eg-`` and 12 digits of the ids' digest, members, files that all hold, least similarity to the seed."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n")
    per = groups.groupBy("seed", "representative").agg(F.concat(F.lit("eg-"), F.substring(F.sha2(ids, 256), 1, 12)).alias("group"), F.count(F.lit(1)).alias("candidates"), F.min("similarity").alias("similarity"))
    held = files.select(F.col("cand").alias("id"), "path").distinct().join(groups.select("id", "seed"), "id").groupBy("seed", "path").agg(F.count(F.lit(1)).alias("n"))
    shared = held.join(per.select("seed", "candidates"), "seed").where("n = candidates").groupBy("seed").agg(F.count(F.lit(1)).alias("shared"))
    return per.join(shared, "seed", "left").select("group", "representative", "candidates", F.coalesce("shared", F.lit(0)).alias("shared"), "similarity")


def greedy_selection(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, rank): by score, then id, each candidate none of whose paths is already claimed. candidates: (id, score); claims: (id, path) of files, tests and assets.

    By election: each path keeps its best claimant that is left; who wins all its paths is selected,
    and who meets it leaves. A candidate without a claim is selected. The order among the selected is a running count in ranges.
    """
    place = candidates.select("id", F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")).alias("key"))
    left = cut(claims.select("id", "path").distinct().join(place, "id"))
    won = cut(place.join(left.select("id"), "id", "left_anti").select("id", "key"))
    while not left.isEmpty():
        best = left.groupBy("path").agg(F.min("key").alias("best"))
        judged = cut(left.join(best, "path"))
        now = cut(judged.groupBy("id", "key").agg(F.bool_and(F.col("best") == F.col("key")).alias("all")).where("all").select("id", "key"))
        won = won.union(now)
        met = judged.join(now.select(F.col("key").alias("best")), "best", "left_semi").select("id").distinct()
        left = cut(left.join(met, "id", "left_anti"))
    rank = below(won.select("id", "key", F.lit(1).alias("one")), "key", "one")
    return rank.select("id", (F.col("below") + 1).cast("int").alias("rank"))


def hotspots(files: DataFrame, candidates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How much closure pressure each application file passes on: path, application, line_count, inbound, fan_out, closures, largest_lines, cross_domain, discouraged, pressure, action, candidates.

    files: (cand, path); candidates: (cand, line_count, domains, status), the representatives of
    their groups; nodes: (path, zone, application, line_count). cross_domain and discouraged count closures that hold
    the file. pressure: largest_lines + 100 inbound + 50 fan_out + 250 cross_domain + 100 discouraged.
    """
    own = files.join(nodes.where("zone = 'application'").select("path"), "path", "left_semi").join(candidates, "cand")
    per = own.groupBy("path").agg(
        F.count(F.lit(1)).alias("closures"), F.max("line_count").alias("largest_lines"), F.count_if(F.col("domains") > 1).alias("cross_domain"),
        F.count_if(F.col("status") == "discouraged").alias("discouraged"), F.array_sort(F.collect_list("cand")).alias("candidates"),
    )
    e = edges.select("src", "dst").distinct()
    into, out = (e.groupBy(F.col(side).alias("path")).agg(F.count(F.lit(1)).alias(n)) for side, n in (("dst", "inbound"), ("src", "fan_out")))
    all_ = per.join(nodes.select("path", "application", "line_count"), "path").join(into, "path", "left").join(out, "path", "left").fillna(0, ["inbound", "fan_out"])
    c = F.col
    pressure = c("largest_lines") + 100 * c("inbound") + 50 * c("fan_out") + 250 * c("cross_domain") + 100 * c("discouraged")
    action = F.when(c("inbound") >= 8, "split-capabilities").when(c("fan_out") >= 8, "extract-registry").when(c("cross_domain") > 0, "declare-boundary").otherwise("review-closure")
    return all_.withColumns({"pressure": pressure, "action": action})


def lazy_registry(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, candidates): dynamic edges with the candidates that hold their target; none is an empty array."""
    held = files.groupBy(F.col("path").alias("dst")).agg(F.array_sort(F.collect_set("cand")).alias("candidates"))
    kind = files.schema["cand"].dataType.simpleString()
    return edges.where("dynamic").select("src", "dst").distinct().join(held, "dst", "left").select("src", "dst", F.coalesce("candidates", F.array().cast(f"array<{kind}>")).alias("candidates"))


#: Order of candidates for each strategy.
STRATEGIES = {
    "cohesive": [("domains", True), ("score", False), ("id", True)],
    "campaign": [("score", False), ("id", True)],
    "preparation": [("escapes", True), ("score", False), ("id", True)],
    "low-risk": [("review_units", True), ("score", False), ("id", True)],
    "max-loc": [("line_count", False), ("id", True)],
}


def ranked(candidates: DataFrame, strategy: str, top: int) -> DataFrame:
    """The first ``top`` candidates under a strategy with their place; only those come to one task."""
    keys = [F.asc(c) if up else F.desc(c) for c, up in STRATEGIES[strategy]]
    some = candidates.orderBy(*keys).limit(top)
    return some.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def bounded(report: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows beside the total and what was left out."""
    total = report.agg(F.count(F.lit(1)).alias("total"))
    return report.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("total") - limit, F.lit(0)))


def recipe_steps(files: DataFrame, boundaries: DataFrame, promotions: DataFrame) -> DataFrame:
    """(path, step, id): a boundary for exactly this path (least id), else a promotion for a folder above it (least id), else unconfigured.

    boundaries and promotions: (id, path). A promotion meets its files by their ancestors, an equality join.
    """
    exact = files.join(boundaries, "path").groupBy("path").agg(F.min("id").alias("b"))
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    prefix = above.join(promotions.withColumnRenamed("path", "root"), "root").groupBy("path").agg(F.min("id").alias("p"))
    j = files.select("path").distinct().join(exact, "path", "left").join(prefix, "path", "left")
    return j.select("path", F.when(F.col("b").isNotNull(), "boundary").when(F.col("p").isNotNull(), "promotion").otherwise("unconfigured").alias("step"), F.coalesce("b", "p").alias("id"))


def hotspot_actions(rows: DataFrame, config: Config) -> DataFrame:
    """rows of hotspots with ``actions``, those whose threshold is met, in order."""
    c = F.col
    rules = [("stabilise-inbound", c("inbound") >= config.fan_in_action), ("reduce-fan-out", c("fan_out") >= config.fan_out_action), ("cut-cross-domain", c("cross_domain") > 0)]
    return rows.withColumn("actions", F.array_compact(F.array(*[F.when(r, n) for n, r in rules])))


def target_options(candidates: DataFrame, packages: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, package, option, fit): packages that a candidate (id, suggested) already uses can be extended; the suggested one is extended if it is there, else created. uses: (id, package)."""
    here = packages.select("package").distinct()
    used = uses.join(here, "package", "left_semi").select("id", "package", F.lit("extend").alias("option"), F.lit("medium").alias("fit")).distinct()
    own = candidates.join(here.select(F.col("package").alias("suggested"), F.lit(True).alias("__is")), "suggested", "left")
    own = own.select("id", F.col("suggested").alias("package"), F.when(F.col("__is"), "extend").otherwise("create").alias("option"), F.lit("high").alias("fit"))
    return used.join(own.select("id", "package"), ["id", "package"], "left_anti").union(own)


def rewritable(escapes: DataFrame, surface: DataFrame) -> DataFrame:
    """escapes (source, target, package, bindings) with ``rewritable``: the package's surface (package, target, name) offers every binding; * offers all but default."""
    offered = surface.groupBy("package", "target").agg(F.collect_set("name").alias("names"))
    j = escapes.join(offered, ["package", "target"], "left")
    star = F.array_contains("names", "*")
    missing = F.filter("bindings", lambda b: ~F.array_contains("names", b) & ~(star & (b != "default")))
    return j.select("source", "target", "package", F.coalesce(F.size(missing) == 0, F.lit(False)).alias("rewritable"))


def campaign_targets(candidates: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The first ``top`` representatives by lines for each review unit, then lines, then id. groups: (id, representative)."""
    own = candidates.join(groups.where("id = representative").select("id"), "id", "left_semi")
    rate = own.withColumn("rate", F.col("line_count") / F.col("review_units"))
    return rate.orderBy(F.desc("rate"), F.desc("line_count"), "id").limit(top)


def gates(owners: DataFrame, templates: DataFrame) -> DataFrame:
    """(tier, command): project templates for each owner ({owner} filled in), others once; repeated commands once. templates: (tier, command), a handful."""
    each = owners.select("owner").distinct().crossJoin(F.broadcast(templates.where("tier = 'project'"))).select("tier", F.replace("command", F.lit("{owner}"), "owner").alias("command"))
    return each.union(templates.where("tier <> 'project'").select("tier", "command")).distinct()


def stop_condition(rows: DataFrame, conditions: list[tuple[str, Column]]) -> DataFrame:
    """rows with ``stop``, the first condition that holds, only after an applied extraction."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(conditions):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return rows.withColumn("stop", F.when((F.col("status") == "applied") & (F.col("kind") == "extraction"), out))


def coverage(production: DataFrame, configured: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, fault): production files that the settings or the scan leave out, paths configured twice, unsafe paths."""
    out = production.select("path").distinct().join(configured, "path", "left_anti").select("path", F.lit("not-configured").alias("fault"))
    out = out.union(production.select("path").distinct().join(scanned, "path", "left_anti").select("path", F.lit("not-scanned")))
    out = out.union(configured.groupBy("path").count().where("count > 1").select("path", F.lit("configured-twice")))
    return out.union(configured.where(F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda s: s == "..")).select("path", F.lit("unsafe")).distinct())
