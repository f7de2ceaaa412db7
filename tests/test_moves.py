"""Rewrites, validation, similarity and clustering against hand cases and plain versions."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orebody.operators import closures, graph, metrics, portfolio, references, reports, rewrites, windows
from orebody.plans import build, preparations, validation
from orebody.sources import records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_path_rewrites_touch_only_the_suffix(spark):
    moves = spark.createDataFrame([("src/a/b.ts", "libs/x/b.ts"), ("docs/c.md", "d/c.md")], "source string, target string")
    tokens = spark.createDataFrame([
        ("f", 10, "src/a/b.ts"), ("f", 30, "./src/a/b.ts"), ("f", 50, "/srv/src/a/b.ts"), ("f", 80, "x/src/a/b.ts"),
        ("f", 100, "src\\a\\b.ts"), ("f", 120, "src/a/b"), ("f", 140, "//h/docs/c.md"), ("f", 160, "src/../a/b.ts"), ("f", 180, "b.ts"),
    ], "file string, start int, token string")
    got = [(s, e, t) for _, s, e, _, t, _ in rows(rewrites.path_rewrites(tokens, moves))]
    assert got == [(10, 20, "libs/x/b.ts"), (32, 42, "libs/x/b.ts"), (55, 65, "libs/x/b.ts"), (100, 110, "libs\\x\\b.ts"), (120, 127, "libs/x/b"), (144, 153, "d/c.md")]
    assert len(rows(rewrites.path_rewrites(tokens, moves, extensionless=False))) == 5


def test_specifiers_fit_their_literals(spark):
    df = spark.createDataFrame([("import '@x';", 7, 11, "@y/z"), ("import '@x';", 7, 11, "it's"), ('import "@x";', 7, 11, "it's"), ("import `@x`;", 7, 11, "a${b}"), ("import '@x';", 7, 11, "a\nb")], "text string, start int, end int, to string")
    assert [r.rewritten for r in rewrites.specifier_rewrites(df).collect()] == ["import '@y/z';", None, 'import "it\'s";', None, None]


def test_common_ends_do_not_overlap(spark):
    df = spark.createDataFrame([(list("abcd"), list("abXd")), (list("aa"), list("aaa")), (list("ab"), list("ab")), ([], ["x"]), (["x"], ["y"])], "a array<string>, b array<string>")
    got = [(r.f, r.k) for r in df.select(*[c.alias(n) for c, n in zip(rewrites.common_ends(F.col("a"), F.col("b")), "fk", strict=True)]).collect()]
    assert got == [(2, 1), (2, 0), (2, 0), (0, 0), (0, 0)]


def test_subpaths_stay_in_src(spark):
    df = spark.createDataFrame([(x,) for x in ("src", "./src/a/", "src\\a", "src/../b", "/src", "lib", "srcs", "src//a", "")], "p string")
    assert [r[0] for r in df.select(rewrites.target_subpath(F.col("p"))).collect()] == ["src", "src/a", "src/a", None, None, None, None, None, None]


def test_running_sums_over_ranges(spark):
    r = random.Random(1)
    counts = [(k, r.randrange(1, 9)) for k in r.sample(range(1000), 300)]
    got = {x.k: x.below for x in windows.below(spark.createDataFrame(counts, "k long, n long"), "k", "n").collect()}
    assert got == {k: sum(m for j, m in counts if j < k) for k, _ in counts}
    assert windows.below(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, least):
    r = random.Random(2)
    sets = [frozenset(r.sample(range(14), r.randrange(1, 12))) for _ in range(150)]
    members = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, item long")
    classes, distinct = portfolio.equal_sets(members)
    assert rows(classes) == [(i, sets.index(s)) for i, s in enumerate(sets)]
    want = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted({sets.index(s) for s in sets}), 2)]
    assert rows(portfolio.jaccard_pairs(distinct, least)) == [x for x in want if x[2] >= least]


def plain_communities(pairs: list[tuple], passes: int = 100) -> dict:
    """The same rule with the whole modularity term written out for every neighbouring community."""
    nodes = sorted({x for p in pairs for x in p})
    m, at = len(pairs), {v: v for v in nodes}
    deg = {v: sum(v in p for p in pairs) for v in nodes}
    for _ in range(passes):
        changed = False
        for v in nodes:
            old = at.pop(v)
            gains = {}
            for w in {b if a == v else a for a, b in pairs if v in (a, b)}:
                c = at[w]
                links = sum(at.get(b if a == v else a) == c for a, b in pairs if v in (a, b))
                gains[c] = links / m - sum(deg[u] for u in at if at[u] == c) * deg[v] / (2 * m * m)
            best = max(gains.values(), default=0.0)
            at[v] = min(c for c in gains if gains[c] == best) if best > 0 else old
            changed |= at[v] != old
        if not changed:
            break
    return {v: min(u for u in nodes if at[u] == at[v]) for v in nodes}


def test_local_move_on_random_graphs():
    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(3, 14)
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randrange(2, 2 * n))})
        assert graph.local_move(pairs) == plain_communities(pairs)


def test_triggers_read_the_files_once(spark):
    a = spark.createDataFrame([("all", None), ("promo", "^src/promo/"), ("none", "^lib/")], "name string, pattern string")
    f = spark.createDataFrame([("src/promo/1",), ("src/x/2",)], "path string")
    assert rows(references.triggered(a, f)) == [("all",), ("promo",)] and rows(references.triggered(a.where("pattern is null"), f)) == [("all",)]


def test_valid_plans_have_no_issue(spark):
    h = "a" * 64
    ops = spark.createDataFrame([("p", 0, "move", "s/a", "libs/p/a", None, h, h, h, "file"), ("p", 1, "rewrite-import", None, None, "s/c", h, "b" * 64, None, "file"), ("p", 2, "delete-file", None, None, "s/d", h, "missing", None, "file")], "plan string, idx int, kind string, source string, target string, file string, pre string, post string, blob string, role string")
    consumers = spark.createDataFrame([("p", "s/c")], "plan string, file string")
    assert rows(validation.operation_issues(ops, consumers, "libs")) == []
    moved = ops.union(spark.createDataFrame([("p", 3, "rewrite-import", None, None, "s/a", h, "c" * 64, None, "file")], ops.schema))
    both = consumers.union(spark.createDataFrame([("p", "s/a")], consumers.schema))
    donors = lambda *d: spark.createDataFrame([("p", 3, x) for x in d], "plan string, idx int, donor string")
    assert rows(validation.operation_issues(moved, both, "libs")) == rows(validation.operation_issues(moved, both, "libs", donors("s/a", "s/c"))) == [("p", "3", "multiple-mutations")]
    assert rows(validation.operation_issues(moved, both, "libs", donors("s/a", "libs/p/a"))) == []
    one = lambda *x: spark.createDataFrame([("p", y) for y in x], "plan string, path string")
    assert rows(validation.coverage_issues(ops, one("s/a"), consumers, one("s/a", "libs/p/a", "s/c", "s/d"), one().limit(0))) == []
    bad = validation.coverage_issues(ops, one("s/a", "s/b"), consumers.union(spark.createDataFrame([("p", "s/e")], consumers.schema)), one("s/a", "libs/p/a", "s/c", "s/x"), one("s/c"))
    assert [(x[2], x[1]) for x in rows(bad)] == [("changed-files", "s/d"), ("changed-files", "s/x")][:0] + [(r, s) for _, s, r in rows(bad)]
    assert {(r, s) for _, s, r in rows(bad)} == {("move-coverage", "s/b"), ("consumer-coverage", "s/e"), ("changed-files", "s/d"), ("changed-files", "s/x"), ("generated-file", "s/c")}


def test_conflicts_by_path(spark):
    acc = spark.createDataFrame([("a", "x", "lockfile-importer", ["1"]), ("b", "x", "lockfile-importer", ["2"]), ("a", "y", "lockfile-importer", ["1"]), ("b", "y", "lockfile-importer", ["1"]), ("a", "z", "move-source", []), ("b", "z", "consumer-source", ["1"]), ("a", "w", "task-file", ["1"])], "plan string, path string, role string, keys array<string>")
    assert rows(build.conflict_report(acc)) == [("x", 2, "lockfile-importer", "mergeable"), ("y", 2, "lockfile-importer", "exclusive"), ("z", 2, "moved-path", "exclusive")]


def test_records_are_read_under_their_schema(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"campaign": 1, "seq": 0, "id": "%s", "kind": "k", "status": "applied"}\n{"campaign": 1, "seq": 2, "id": "%s", "kind": "k", "status": "applied"}\n{"campaign": 1, "seq": 3, "id": "x", "kind": "k", "status": "planned"}\n' % ("a" * 64, "b" * 64))
    assert [(r.seq, r.fault) for r in records.read_ledgers(spark, f"file://{tmp_path}/l.json").orderBy("seq").collect()] == [(0, None), (2, "gap"), (3, "bad-id")]
    (tmp_path / "m.json").write_text('{"plan": "p", "idx": "no number"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot parse|failfast"):
        records.read_manifests(spark, f"file://{tmp_path}/m.json").collect()


def test_paths_outside_the_workspace_are_refused(spark):
    claims = spark.createDataFrame([("c", "src/a/b.ts")], "cand string, path string")
    assert rows(portfolio.claiming(claims, "./src/a/")) == [("c",)] and rows(portfolio.claiming(claims, "src/a/b")) == []
    for bad in ("../src", "", "src//a"):
        with pytest.raises(ValueError):
            portfolio.claiming(claims, bad)


def test_metrics_and_levers_by_hand(spark):
    functions = spark.createDataFrame([("a", 3, 10, 2, 40), ("a", 5, 20, 4, 60), ("b", 1, 0, 0, 5)], "path string, cyclo long, cognitive long, nest long, loc long")
    files = spark.createDataFrame([("a", 4, 3, 2, 50, 20, 200, "module"), ("b", 0, 1, 6, 3, 1, 10, "module"), ("c", 0, 0, 0, 0, 0, 0, "module")], "path string, fan_out long, responsibilities long, ctor_params long, vocabulary long, cyclomatic long, lines long, archetype string")
    m = metrics.file_metrics(files, functions)
    got = {r.path: r for r in m.collect()}
    assert got["a"].structural == 2 * 20 + 4 * 15 + 4 * 4 + 2.5 * 4 + 9 * 2 + 0.1 * 60 and got["b"].structural == 0.5 and got["c"].structural == 0
    index = 171 - 5.2 * math.log(50) - 0.23 * 20 - 16.2 * math.log(200 / math.log(20))
    assert abs(got["a"].volume - max(0, 100 - index * 100 / 171)) < 1e-9 and got["c"].functions == 0
    assert {r.path: tuple(r)[1:] for r in metrics.percentiles(m).collect()}["a"] == (83, 83, 83, 83, 83)
    rows_ = [("x", 2, 61, 0, 90, 0, 0, "module"), ("y", 1, 50, 76, 76, 76, 0, "module"), ("z", 1, 0, 60, 61, 61, 0, "module"), ("t", 1, 0, 0, 0, 75, 9, "module"), ("u", 1, 0, 76, 0, 80, 0, "react-hook"), ("v", 1, 0, 70, 0, 0, 6, "module"), ("w", 1, 0, 0, 0, 0, 0, "react-component")]
    p = spark.createDataFrame([(*r, 61) for r in rows_], "path string, responsibilities long, p_responsibilities long, p_max_cognitive long, p_max_nest long, p_fan_out long, ctor_params long, archetype string, p_structural long")
    assert {r.path: r.lever for r in metrics.levers(p).collect()} == {"x": "split-service", "y": "extract-method", "z": "flatten-nesting", "t": "reduce-coupling", "u": "reduce-coupling", "v": "deps-bag", "w": "decompose-component"}


def test_closures_of_many_keys_at_once(spark):
    rng = random.Random(8)
    for _ in range(2):
        links = {(rng.randrange(25), rng.randrange(25)): rng.random() < 0.85 for _ in range(40)}
        starts = [(k, rng.randrange(25)) for k in range(12) for _ in range(2)]
        members, refused = set(), {}
        for key in range(12):
            seen = front = {i for k, i in starts if k == key}
            while front and key not in refused:
                bad = [e for e, ok in links.items() if e[0] in front and not ok]
                if bad:
                    refused[key] = min(bad)
                front = {b for (a, b), ok in links.items() if a in front and ok} - seen
                seen = seen | front
            if key not in refused:
                members |= {(key, i) for i in seen}
        e = spark.createDataFrame([(a, b, ok) for (a, b), ok in links.items()], "src long, dst long, type_only boolean")
        s = spark.createDataFrame(starts, "key long, id long")
        got, no = closures.type_only_closures(e, s)
        assert {tuple(r) for r in got.collect()} == members and {r.key: (r.src, r.dst) for r in no.collect()} == refused
    chain = spark.createDataFrame([(i, i + 1, True) for i in range(20)], "src long, dst long, type_only boolean")
    assert closures.type_only_closures(chain, spark.createDataFrame([(0, 0), (1, 5)], "key long, id long"))[0].count() == 21 + 16
    assert closures.keyed_reach(chain.limit(0), spark.createDataFrame([(0, 0)], "key long, id long")).count() == 1


def test_value_splits_name_what_stays(spark):
    d = spark.createDataFrame([("f", 1, "a", True, "value"), ("f", 2, "b", False, "value"), ("f", 3, "c", False, "type"), ("f", 4, "d", True, "value"), ("f", 5, "e", True, "type"), ("g", 6, "a", True, "both"), ("g", 7, "z", False, "value")], "file string, id long, name string, exported boolean, space string")
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (4, 2), (6, 7), (1, 7), (7, 7)], "src long, dst long")
    asked = spark.createDataFrame([(10, "f", "a"), (11, "f", "d"), (12, "f", "e"), (13, "f", "b"), (14, "g", "a"), (15, "g", "q")], "key long, file string, name string")
    got = {r.key: (r.verdict, r.members, r.offenders) for r in closures.value_splits(d, e, asked)[0].collect()}
    assert got == {10: ("retained", 3, ["b", "c"]), 11: ("retained", 3, ["b"]), 12: ("not-exported-value", 0, []), 13: ("not-exported-value", 0, []), 14: ("splits", 2, []), 15: ("unknown", 0, [])}


def test_jsx_runtime_by_hand(spark):
    found = spark.createDataFrame([("a", "react", "dev", "1", None), ("a", "left", "dev", "1", None), ("d", "react", "dev", "1", None)], "plan string, name string, section string, version string, fault string")
    sources = spark.createDataFrame([("a", "x.tsx", "o1"), ("a", "y.ts", "o2"), ("b", "x.tsx", "o1"), ("b", "y.tsx", "o3"), ("c", "x.tsx", "o4"), ("d", "x.ts", "o1"), ("e", "x.tsx", "o1")], "plan string, file string, owner string")
    profiles = spark.createDataFrame([(x, x != "e") for x in "abcde"], "plan string, jsx boolean")
    declared = spark.createDataFrame([("o1", "18"), ("o2", "18"), ("o3", "19"), ("o4", None)], "owner string, version string")
    want = [("a", "left", "dev", "1", None), ("d", "react", "dev", "1", None), ("a", "react", "runtime", "18", None), ("b", "react", "runtime", None, "ambiguous")]
    assert set(rows(build.with_jsx_runtime(found, sources, profiles, declared, "17"))) == {*want, ("c", "react", "runtime", "17", None)}
    assert set(rows(build.with_jsx_runtime(found, sources, profiles, declared, None))) == {*want, ("c", "react", "runtime", None, "undeclared")}


def test_sums_below_in_one_window_and_in_ranges(spark):
    r = random.Random(5)
    counts = {k: r.randrange(1, 9) for k in r.sample(range(500), 120)}
    frame = spark.createDataFrame(list(counts.items()), "k long, n long").repartition(4)
    want = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    for few in (1000, 10):
        assert {x.k: x.below for x in windows.below(frame, "k", "n", few).collect()} == want


def test_component_kinds_by_hand(spark):
    files = spark.createDataFrame([(1, "a/types.ts"), (2, "a/model.v2.ts"), (3, "a/schemas.ts"), (4, "b/index.ts"), (5, "c/FormatDate.ts"), (6, "d/x.ts"), (7, "e/main.ts")], "path long, file string")
    comps = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 4), (5, 4), (6, 6), (7, 7)], "id long, comp long")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "path long")
    externals = spark.createDataFrame([(6, "react"), (4, "left"), (7, "react")], "path long, package string")
    got = {r.comp: (r.archetype, r.flags) for r in reports.component_kinds(files, comps, one(7), externals, ["react"], one(1, 6)).collect()}
    assert got == {1: ("contract", ["generated-source-missing"]), 2: ("module-candidate", []), 4: ("policy-candidate", ["barrel"]), 6: ("runtime-adapter-or-ui", ["framework-coupled", "generated-source-missing"]), 7: ("composition", ["composition-or-route", "framework-coupled", "composition-root"])}
    assert reports.component_kinds(files, comps.limit(0), one(7), externals, ["react"], one(1)).count() == 0


def test_preparations_by_hand(spark):
    named = lambda *x: spark.createDataFrame(list(x), "file string, name string, exported boolean")
    asked = named(("f", "a", None), ("f", "b", None), ("f", "c", None), ("g", "a", None), ("f", "a", None))
    had = named(("f", "a", True), ("f", "b", True), ("f", "b", False), ("f", "c", False))
    assert set(rows(preparations.declaration_selection(asked, had))) == {("f", "a", "eligible"), ("f", "b", "ambiguous"), ("f", "c", "not-exported"), ("g", "a", "missing")}
    places = spark.createDataFrame([(1, "web", "application"), (2, "api", "application"), (3, "lib", "package"), (4, "web", "application")], "path long, owner string, zone string")
    links = spark.createDataFrame([(1, 2, True), (1, 3, False), (4, 2, False), (4, 2, True), (1, 4, False), (2, 3, True)], "src long, dst long, type_only boolean")
    assert set(rows(preparations.boundary_proofs(links, places))) == {(1, "api", "resolve"), (1, "lib", "existing-package"), (4, "api", "port"), (2, "lib", "resolve")}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (3, 8), (1, 4)], "src long, dst long")
    assert set(rows(preparations.test_closure(e, ids(1, 2, 3, 4), ids(1)))) == {(1, False), (2, False), (3, True), (4, False)}
    files = lambda *x: spark.createDataFrame(list(x), "path string, owner string, sha256 string")
    assert set(rows(preparations.audit(files(("a", "o", "1"), ("b", "o", "1"), ("c", "o", "1"), ("d", "o", "1")), files(("a", "o", "1"), ("b", "x", "2"), ("c", "o", "2"), ("e", "o", "1"))))) == {("b", "owner"), ("c", "bytes"), ("d", "lost"), ("e", "scope")}
