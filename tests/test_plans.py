from __future__ import annotations

import datetime
import hashlib
import json
import random

import pytest

from orebody.config import Application, Config, Weights
from orebody.functions import paths
from orebody.operators import evacuation, portfolio, windows
from orebody.plans import conflicts, journal
from orebody.sources import lockfiles, scan
from orebody.streaming import ledger


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


CONFIG = Config(applications=(Application("web", "apps/web/src"), Application("api", "apps/api/src")), asset_extensions=(".css",))


def test_graph_from_reports(spark, tmp_path):
    d = lambda module, resolved, dynamic=False, missing=False: {"module": module, "resolved": resolved, "dynamic": dynamic, "couldNotResolve": missing}
    report = {"modules": [
        {"source": "apps/web/src/a.ts", "dependencies": [d("./b", "apps/web/src/b.ts"), d("./c", "apps/web/src/c.ts"), d("./d.css", "apps/web/src/d.css"), d("@x/lib", "@x/lib", missing=True), d("@x/lib/deep", "@x/lib/deep", missing=True), d("react/jsx", "node_modules/react/jsx.js"), d("fs", "fs"), d("./gone", "./gone", missing=True)]},
        {"source": "./apps/web/src/b.ts", "dependencies": []},
        {"source": "apps/web/src/c.ts", "dependencies": []},
        {"source": "apps/web/src/a.test.ts", "dependencies": [d("./a", "apps/web/src/a.ts")]},
        {"source": "node_modules/react/jsx.js", "dependencies": []},
    ]}
    file = tmp_path / "web.json"
    file.write_text(json.dumps(report))
    facts = spark.createDataFrame([("apps/web/src/a.ts", "./b", True, False), ("apps/web/src/a.ts", "./c", True, False), ("apps/web/src/a.ts", "./c", False, True)], "path string, specifier string, type_only boolean, dynamic boolean")
    exports = spark.createDataFrame([("apps/web/src/b.ts", True, 7)], "path string, has_exports boolean, line_count int")
    packages = spark.createDataFrame([("@x/lib", "libs/lib")], "name string, owner string")
    g = scan.build_graph(scan.read_reports(spark, {"web": f"file://{file}"}), facts, exports, packages, CONFIG)
    rows = lambda n, *c: {tuple(r) for r in g[n].select(*c).collect()}
    assert rows("nodes", "path", "zone", "domain", "line_count") == {(f"apps/web/src/{x}.ts", "application", "web:__root__", 7 if x == "b" else 0) for x in "abc"}
    assert rows("edges", "dst", "kind") == {("apps/web/src/b.ts", "type-only"), ("apps/web/src/c.ts", "dynamic")}
    assert rows("workspace_edges", "specifier") == {("@x/lib",), ("@x/lib/deep",)}
    assert rows("unresolved", "specifier") == {("@x/lib/deep",), ("./gone",)}
    assert rows("external_by_source", "package") == {("react",)}
    assert rows("test_importers", "target", "test") == {("apps/web/src/a.ts", "apps/web/src/a.test.ts")}
    assert rows("test_kinds", "kind") == {("unit",)}


def test_overlapping_test_kinds_are_refused(spark):
    c = Config(test_patterns=(("unit", r"\.test\.ts$"), ("e2e", r"^e2e/")))
    df = spark.createDataFrame([("e2e/a.test.ts",)], "p string")
    with pytest.raises(Exception, match="overlapping test kinds"):
        df.select(paths.test_kind(df.p, c)).collect()


def test_config_refuses():
    for bad in ({"min_files": 9, "max_files": 2}, {"similarity": 0}, {"first_party_packages": ("a", "a/b")}, {"domains": (("d", "(?<=x)y"),)}):
        with pytest.raises(ValueError):
            Config(**bad)


@pytest.mark.parametrize("token, want", [("./x/y/z.ts", "x/y/z.ts"), ("/abs/x.ts", "abs/x.ts"), ("a/../b", None), ("a\\b\\c.ts", "a/b/c.ts"), ("plain", None), ("a//b", None)])
def test_tokens(spark, token, want):
    df = spark.createDataFrame([(token,)], "t string")
    assert df.select(paths.normalize_token(df.t)).first()[0] == want


@pytest.mark.parametrize("glob, path, hit", [("a/*.ts", "a/b.ts", True), ("a/*.ts", "a/b/c.ts", False), ("a/**/c.ts", "a/c.ts", True), ("a/**", "a/b/c.ts", True), ("a", "a/b.ts", True), ("a", "ab.ts", False)])
def test_selectors(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.selected(df.p, glob)).first()[0] is hit


def test_render_refuses_unknown_names():
    with pytest.raises(ValueError):
        paths.render("{a}/{b}", {"a": None})


def ops(spark, rows):
    return spark.createDataFrame(rows, "plan_id string, kind string, source string, target string, path string, keys array<string>")


def test_conflict_shapes(spark):
    o = ops(spark, [
        ("a", "write", None, None, "x/f", []), ("b", "write", None, None, "x/f", []),
        ("c", "delete-tree", None, None, "y", []), ("d", "write", None, None, "y/z/f", []), ("e", "delete-tree", None, None, "y/z", []),
        ("f", "read", None, None, "r", []), ("g", "read", None, None, "r", []),
        ("h", "task-registry", None, None, "s", ["1"]), ("i", "task-registry", None, None, "s", ["2"]), ("j", "task-registry", None, None, "s", ["2", "3"]), ("k", "workspace-registry", None, None, "s", ["9"]),
    ])
    got = {tuple(r) for r in conflicts.conflicts(conflicts.accesses(o)).collect()}
    assert got == {("a", "b", "x/f", False), ("c", "d", "y/z/f", False), ("c", "e", "y/z", False), ("d", "e", "y/z/f", False), ("h", "i", "s", True), ("h", "j", "s", True), ("i", "j", "s", False), ("h", "k", "s", False), ("i", "k", "s", False), ("j", "k", "s", False)}
    plans = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "plan_id string, priority double")
    hard = spark.createDataFrame([("a", "b")], "l string, r string")
    assert {tuple(r) for r in conflicts.waves(plans, hard).collect()} == {("b", 0), ("a", 1), ("c", 0)}


def test_waves_in_both_forms_equal_a_fold(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 40), (25, 200)):
        plans = [(f"p{i}", float(rng.randrange(4))) for i in range(n)]
        hard = [tuple(rng.sample(plans, 2)) for _ in range(m)]
        hard = [(a[0], b[0]) for a, b in hard]
        near = {}
        for a, b in hard:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for p, _ in sorted(plans, key=lambda x: (-x[1], x[0])):
            used = {want[x] for x in near.get(p, ()) if x in want}
            want[p] = min(set(range(n + 1)) - used)
        frame, links = spark.createDataFrame(plans, "plan_id string, priority double"), spark.createDataFrame(hard, "l string, r string")
        for limit in (1_000_000, 0 if m else 1):
            assert dict(map(tuple, conflicts.waves(frame, links, limit).collect())) == want


def test_score_terms(spark):
    none = {"line_count": 0, "shim_lines": 0, "files": 0, "churn": 0, "tests": 0, "dependencies": 0, "rejections": 0, "rewrites": 0, "domains": 1, "retained": 0}
    cases = [({}, 0), ({"line_count": 120, "shim_lines": 20}, 100), ({"files": 3}, 15), ({"churn": 4}, 40), ({"files": 4, "tests": 1}, 20 + 12.5), ({"files": 2, "tests": 5}, 10 + 50), ({"tests": 2}, 50), ({"dependencies": 2}, -24), ({"rejections": 2}, -2000), ({"rewrites": 3}, -300), ({"domains": 2}, -800), ({"domains": 3}, -800), ({"retained": 2}, -500)]
    rows = [tuple((none | c).values()) + (float(want),) for c, want in cases]
    got = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in none) + ", want double").select(portfolio.score(Weights()).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_equivalence_groups_equal_a_fold(spark):
    rng = random.Random(7)
    for seed in range(3):
        base = [rng.sample(range(30), 10) for _ in range(5)]
        sets = {}
        for i in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randrange(3)):
                s.symmetric_difference_update({rng.randrange(30)})
            sets[i] = s
        kinds, scores = {i: rng.choice("xy") for i in sets}, {i: float(rng.randrange(5)) for i in sets}
        alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        free, want, summary = sorted(sets), set(), set()
        while free:
            seed = free[0]
            members = [x for x in free if x == seed or kinds[x] == kinds[seed] and alike(x, seed) >= 0.8]
            free = [x for x in free if x not in members]
            best = min(members, key=lambda x: (-scores[x], x))
            want |= {(x, seed, best, round(alike(x, seed), 9)) for x in members}
            name = "eg-" + sha("\n".join(sorted(map(str, members))))[:12]
            summary.add((name, best, len(members), len(set.intersection(*[sets[x] for x in members])), round(min(alike(x, seed) for x in members), 9)))
        c = spark.createDataFrame([(i, scores[i], kinds[i]) for i in sets], "id long, score double, kind string")
        f = spark.createDataFrame([(i, p) for i, s in sets.items() for p in s], "cand long, path long")
        g = portfolio.equivalence_groups(c, f, 0.8)
        assert {(r[0], r[1], r[2], round(r[3], 9)) for r in g.collect()} == want
        assert {(r[0], r[1], r[2], r[3], round(r[4], 9)) for r in portfolio.group_summary(g, f).collect()} == summary


def test_first_independent_on_a_chain_and_random_graphs(spark):
    rng = random.Random(2)
    for links in ([(i, i + 1) for i in range(12)], [tuple(sorted(rng.sample(range(20), 2))) for _ in range(30)], []):
        kept = []
        for x in range(20):
            if not any((k, x) in set(links) for k in kept):
                kept.append(x)
        got = portfolio.first_independent(spark.range(20).select("id"), spark.createDataFrame(links, "lo long, hi long"))
        assert sorted(r.id for r in got.collect()) == kept


def test_greedy_selection_equals_a_fold(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(6))) for i in range(40)]
    claims = [(i, f"f{rng.randrange(45)}") for i in range(38) for _ in range(rng.randint(1, 3))]
    taken, want = set(), {}
    for i, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        mine = {p for c, p in claims if c == i}
        if not mine & taken:
            taken |= mine
            want[i] = len(want) + 1
    got = portfolio.greedy_selection(spark.createDataFrame(rows, "id long, score double"), spark.createDataFrame(claims, "id long, path string"))
    assert dict(map(tuple, got.collect())) == want


def test_hotspots_by_hand(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "lib")], "cand long, path string")
    cands = spark.createDataFrame([(1, 40, 2, "discouraged"), (2, 90, 1, "recommended"), (3, 5, 3, "discouraged")], "cand long, line_count long, domains long, status string")
    links = spark.createDataFrame([("x", "a"), ("y", "a"), ("a", "b"), ("a", "b")] + [(f"u{i}", "b") for i in range(8)], "src string, dst string")
    nodes = spark.createDataFrame([("a", "application", "web", 7), ("b", "application", "web", 9), ("lib", "package", None, 1), ("c", "application", "web", 3)], "path string, zone string, application string, line_count long")
    got = {r.path: r for r in portfolio.hotspots(files, cands, links, nodes).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.inbound, a.fan_out, a.closures, a.largest_lines, a.cross_domain, a.discouraged, a.candidates, a.action) == (2, 1, 2, 90, 1, 1, [1, 2], "declare-boundary")
    assert a.pressure == 90 + 200 + 50 + 250 + 100 and b.pressure == 40 + 900 + 250 + 100 and b.action == "split-capabilities"


def test_spanning_forest_equals_sorted_edges(spark):
    rng = random.Random(9)
    for n, m in ((12, 40), (40, 60), (3, 0)):
        links = [(f"n{min(a, b):02}", f"n{max(a, b):02}", rng.randrange(4)) for a, b in (rng.sample(range(n), 2) for _ in range(m))]
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        want = set()
        for a, b, w in sorted(set(links), key=lambda r: (-r[2], r[0], r[1])):
            if find(a) != find(b):
                root[find(a)] = find(b)
                want.add((a, b, w))
        got = evacuation.spanning_forest(spark.createDataFrame(links, "a string, b string, weight long"))
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


JOURNAL = "idx long, kind string, path string, target string, content string, pre_hash string, result_hash string"


def test_journal_is_all_or_nothing(spark):
    tree = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content string")
    good = [(0, "move", "a", "z/a", None, sha("1"), sha("1")), (1, "rewrite", "b", None, "2!", sha("2"), sha("2!")), (2, "write", "n", None, "new", None, sha("new")), (3, "delete", "c", None, None, sha("3"), None), (4, "rewrite", "b", None, "2?", sha("2!"), sha("2?"))]
    out = {tuple(r) for r in journal.apply_journal(tree, spark.createDataFrame(good, JOURNAL)).collect()}
    assert out == {("z/a", "1"), ("b", "2?"), ("n", "new"), ("d", "4")}
    bad = [*good, (5, "rewrite", "d", None, "x", sha("other"), sha("x"))]
    assert {tuple(r) for r in journal.apply_journal(tree, spark.createDataFrame(bad, JOURNAL)).collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")}
    landed = spark.createDataFrame([("z/a", sha("1")), ("b", sha("wrong")), ("c", sha("3"))], "path string, sha256 string")
    assert {tuple(r) for r in journal.byte_fidelity(spark.createDataFrame(good, JOURNAL), landed).collect()} == {("b", "differs"), ("n", "missing"), ("c", "survives")}


def fold(tree, ops):
    """The journal one operation after another: the tree, and where it stopped (None: nowhere)."""
    now = dict(tree)
    state = lambda p: sha(now[p]) if p in now else ""
    for idx, kind, path, target, content, pre, result in sorted(ops):
        pre, result = pre or "", result or ""
        if kind == "move":
            if path != target and path not in now and target in now and state(target) == (result or pre):
                continue
            if path == target or path not in now or target in now or state(path) != pre:
                return dict(tree), (idx, "precondition")
            if content is not None and sha(content) != result or content is None and result not in ("", pre):
                return dict(tree), (idx, "result-hash")
            was = now.pop(path)
            now[target] = was if content is None else content
        elif kind == "delete":
            if path not in now:
                continue
            if state(path) != pre:
                return dict(tree), (idx, "precondition")
            del now[path]
        else:
            if state(path) == result:
                continue
            if state(path) != pre:
                return dict(tree), (idx, "precondition")
            if content is None or sha(content) != result:
                return dict(tree), (idx, "result-hash")
            now[path] = content
    return now, None


def journal_of(rng, tree, n, spoil):
    """n operations that mostly follow one another on a few paths; some already done, and one spoiled if asked."""
    now, ops = dict(tree), []
    bad = rng.randrange(n) if spoil else -1
    for i in range(n):
        path = rng.choice("abcdef")
        there = path in now
        free = [x for x in "abcdefghijkl" if x not in now]
        kind = rng.choice((["move", "move"] if free else []) + ["rewrite", "delete"] if there else ["write"])
        pre = sha(now[path]) if there else None
        target = content = None
        if kind == "move":
            target = rng.choice(free)
            content = rng.choice([None, None, f"moved {i}"])
            result = sha(now[path]) if content is None else sha(content)
            now[target] = now.pop(path) if content is None else (now.pop(path), content)[1]
        elif kind == "delete":
            result = None
            del now[path]
        else:
            content = rng.choice([f"text {i}", now.get(path, "again")])
            result = sha(content)
            now[path] = content
        if i == bad:
            pre, result = rng.choice([(sha("x"), result), (pre, sha("y"))])
        ops.append((i, kind, path, target, content, pre, result))
    return ops


@pytest.mark.parametrize("seed", range(9))
def test_journal_equals_a_fold(spark, seed):
    rng = random.Random(seed)
    tree = {x: f"file {x}" for x in "abcd"}
    ops = journal_of(rng, tree, 24, seed % 3 == 2)
    rng.shuffle(ops)
    want, stop = fold(tree, ops)
    t, o = spark.createDataFrame(list(tree.items()), "path string, content string"), spark.createDataFrame(ops, JOURNAL)
    assert dict(map(tuple, journal.apply_journal(t, o).collect())) == want
    bad = sorted((r.idx, r.fault) for r in journal.preconditions(t, o).collect())
    assert (bad[0] if bad else None) == stop


def test_journal_every_pair_of_kinds_on_one_file(spark):
    tree = {"a": "x", "z": "zz"}
    steps = {"write": lambda p, i: ("write", p, None, f"w{i}"), "move": lambda p, i: ("move", p, f"t{i}", None), "edit": lambda p, i: ("move", p, f"t{i}", f"m{i}"), "delete": lambda p, i: ("delete", p, None, None)}
    for first in steps.values():
        for second in steps.values():
            for follow in (True, False):  # the second at what the first leaves, or at the first's path
                kind, path, target, content = first("a", 0)
                now = "" if kind == "delete" else content or "x"
                at = (target or path) if follow else path
                held = now if at == (target or path) else ""
                ops = [(0, kind, path, target, content, sha("x"), sha(now) if now else None)]
                kind, path, target, content = second(at, 1)
                after = "" if kind == "delete" else content or held
                ops.append((1, kind, path, target, content, sha(held) if held else None, sha(after) if after else None))
                want, _ = fold(tree, ops)
                got = journal.apply_journal(spark.createDataFrame(list(tree.items()), "path string, content string"), spark.createDataFrame(ops, JOURNAL))
                assert dict(map(tuple, got.collect())) == want, ops


def test_journal_done_before_and_long_chains(spark):
    n = 40
    tree = {"p0": "x", "done": "new", "kept": "k"}
    ops = [(i, "move", f"p{i}", f"p{i + 1}", None, sha("x"), sha("x")) for i in range(n)]
    ops += [(n, "rewrite", "done", None, "new", sha("old"), sha("new")), (n + 1, "delete", "gone", None, None, sha("q"), None), (n + 2, "move", "was", "kept", None, sha("k"), sha("k"))]
    want, stop = fold(tree, ops)
    assert stop is None
    t, o = spark.createDataFrame(list(tree.items()), "path string, content string"), spark.createDataFrame(ops, JOURNAL)
    assert dict(map(tuple, journal.apply_journal(t, o).collect())) == want == {f"p{n}": "x", "done": "new", "kept": "k"}
    assert dict(map(tuple, journal.apply_journal(t, o.limit(0)).collect())) == tree
    assert journal.apply_journal(t.limit(0), o.limit(0)).count() == 0


def test_ledger(spark):
    rows = [("c", 1, "a", "prep", "x", "planned", None), ("c", 2, "b", "extract", "x", "applied", True), ("c", 4, "a", "extract", "y", "applied", False)]
    l = spark.createDataFrame(rows, "campaign string, seq long, id string, kind string, baseline string, status string, audit_passed boolean")  # noqa: E741
    assert {tuple(r)[1:] for r in journal.ledger_issues(l).collect()} == {(4, "sequence"), (4, "repeated-id"), (4, "stale-baseline"), (4, "unaudited")}


def ledger_event(seq, kind, child=None, at=0, **more):
    base = {"campaign": "c", "seq": seq, "at": datetime.datetime.fromtimestamp(86_400 + at, datetime.UTC).replace(tzinfo=None), "kind": kind, "id": None, "plan_id": None, "pair_id": None, "role": None, "baseline": None, "result": None, "graph_before": None, "graph_after": None, "audit_role": None, "audit_passed": None}
    if child:
        role = "preparation" if child % 2 else "extraction"
        base |= {"id": f"i{child}", "plan_id": f"n{child}", "pair_id": f"p{(child + 1) // 2}", "role": role, "baseline": f"k{child - 1}", "result": f"k{child}", "graph_before": f"g{child - 1}", "graph_after": f"g{child}", "audit_role": role, "audit_passed": True}
    return base | more


def test_ledger_rules():
    def run(*events, most=None):
        state, used, out = {"seq": 0, "status": "active", "commit": None, "graph": None, "pending": None, "last": None, "applied": 0}, {"ids": [], "plans": [], "pairs": []}, []
        for e in events:
            out.append(ledger.refusal(state, e, used))
            if out[-1] is None:
                ledger.advanced(state, e, used, most)
        return out, state

    e = ledger_event
    whole = [e(1, "plan", 1), e(2, "record", 1), e(3, "plan", 2), e(4, "record", 2), e(5, "complete")]
    out, state = run(*whole)
    assert out == [None] * 5 and state["status"] == "completed" and state["commit"] == "k2" and state["applied"] == 2
    assert run(*whole, e(6, "plan", 3))[0][-1] == "campaign is completed" and run(*whole[:3], e(4, "stop"), e(5, "record", 2))[0][-1] == "campaign is stopped"
    for event, why in [
        (e(3, "plan", 2, baseline="old"), "stale baseline"), (e(3, "plan", 2, id="i1"), "duplicate child"), (e(3, "plan", 2, plan_id="n1"), "duplicate plan"), (e(3, "plan", 2, role="preparation"), "must extract after a preparation"),
        (e(3, "plan", 2, pair_id="other"), "must share the pair of the preparation"), (e(3, "record", 2), "no child awaits application"), (e(2, "plan", 2), "already recorded"), (e(4, "plan", 2), "gap"), (e(3, "else"), "unknown kind"),
    ]:
        assert run(*whole[:2], event)[0][-1] == why
    for event, why in [
        (e(4, "plan", 3), "another child awaits application"), (e(4, "record", 2, id="i9"), "can't skip the planned child"), (e(4, "record", 2, graph_before="g0"), "graph doesn't follow"),
        (e(4, "record", 2, audit_role="preparation"), "audit of another kind"), (e(4, "record", 2, audit_passed=False), "audit failed"), (e(4, "complete"), "a child awaits application"),
    ]:
        assert run(*whole[:3], event)[0][-1] == why
    assert run(e(1, "plan", 2))[0] == ["must prepare first"] and run(*whole[:4], e(5, "plan", 3, pair_id="p1"))[0][-1] == "pair is completed"
    assert run(*whole[:4], most=2)[1]["status"] == "stopped"


def test_streaming_ledger_keeps_state_expires_and_repeats_no_batch(spark, tmp_path):
    e = ledger_event
    parts = [[e(1, "plan", 1), e(2, "record", 1, at=10)], [e(2, "record", 1, at=20), e(3, "plan", 2, at=30, baseline="old")], [e(3, "plan", 2, at=40), e(1, "plan", 1, at=9000, campaign="other")], [e(4, "record", 2, at=9100)]]
    schema, at = ledger.EVENT, f"file://{tmp_path}"
    for i, part in enumerate(parts):
        spark.createDataFrame([tuple(x.values()) for x in part], ", ".join(f"{k} {v}" for k, v in (c.split(" ") for c in schema.split(", ")))).coalesce(1).write.json(f"{at}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{at}/in")
        ledger.written(ledger.checked(stream, ttl_ms=60_000), f"{at}/out", f"{at}/check")
    got = sorted(map(tuple, spark.read.schema(ledger.OUT).parquet(f"{at}/out").select("campaign", "seq", "id", "accepted", "reason").collect()), key=repr)
    want = [("c", 1, "i1", True, None), ("c", 2, "i1", True, None), ("c", 2, "i1", False, "already recorded"), ("c", 3, "i2", False, "stale baseline"), ("c", 3, "i2", True, None), ("other", 1, "i1", True, None), ("c", 3, None, None, "expired"), ("c", 4, "i2", False, "gap"), ("other", 1, None, None, "expired")]
    assert got == sorted(want, key=repr)


def test_marginal_blockers(spark):
    r = lambda code, *edges: (code, "d", list(edges))
    c = spark.createDataFrame([("1", 30, [r("e", "x")]), ("2", 40, [r("e", "x")]), ("3", 50, [r("e", "x"), r("f", "y")]), ("4", 60, [r("e", "x", "z")])], "id string, line_count long, rejections array<struct<code:string,detail:string,edges:array<string>>>")
    got = {(x.code, x.edge): tuple(x)[2:] for x in portfolio.marginal_blockers(c).collect()}
    assert got == {("e", "x"): (4, 2, 70), ("e", "z"): (1, 0, 0), ("f", "y"): (1, 0, 0)}


def test_groups_take_in_order_and_by_kind(spark):
    c = spark.createDataFrame([("a", 1.0, "x"), ("b", 5.0, "x"), ("c", 9.0, "x"), ("d", 9.0, "y")], "id string, score double, kind string")
    sets = {"a": range(1, 10), "b": range(10), "c": range(-1, 10), "d": range(10)}
    f = spark.createDataFrame([(k, p) for k, v in sets.items() for p in v], "cand string, path long")
    assert {tuple(r)[:3] for r in portfolio.equivalence_groups(c, f, 0.9).collect()} == {("a", "a", "b"), ("b", "a", "b"), ("c", "c", "c"), ("d", "d", "d")}


def test_percentile_of_few_and_ties(spark):
    rows = [(i, "big", i // 2) for i in range(8)] + [(100, "small", 3)]
    got = {r.id: (r.source, r.percentile) for r in windows.percentile(spark.createDataFrame(rows, "id long, cohort string, metric long"), "cohort", "metric").collect()}
    assert got[0] == ("cohort", 13) and got[100] == ("repo", 83)
    one = windows.percentile(spark.createDataFrame([(1, "a", 5)], "id long, cohort string, metric long"), "cohort", "metric").first()
    assert one.percentile == 50


def test_multiset_and_ratchet(spark):
    f = lambda s: spark.createDataFrame([(x,) for x in s], "x string")
    assert sorted(map(tuple, windows.multiset_delta(f("aab"), f("acc")).collect())) == [("a", "removed"), ("b", "removed"), ("c", "added"), ("c", "added")]
    m = lambda rows: spark.createDataFrame(rows, "path string, metric string, value long")
    got = {r.path: r.verdict for r in windows.ratchet(m([("w", "l", 1), ("i", "l", 3), ("e", "l", 2), ("s", "l", 1)]), m([("w", "l", 2), ("i", "l", 1), ("e", "l", 2), ("n", "l", 1)])).collect()}
    assert got == {"w": "worse", "i": "improved", "e": "accepted", "s": "stale", "n": "new"}


def test_json_and_text_functions(spark):
    from orebody.functions import documents as d

    assert d.canonical({"b": 1.0, "a": [{"d": 1, "c": "é "}]}) == '{"a":[{"c":"é ","d":1}],"b":1}'
    assert d.pointer({"a/b": {"~c": [1, 2]}}, "/a~1b/~0c/1") == 2
    assert '"new"' in d.relocate_keys('{"m": {"old": 1, "k": 2}}', "/m", {"old": "new"})
    with pytest.raises(ValueError):
        d.relocate_keys('{"m": {"old": 1, "k": 2}}', "/m", {"old": "k"})
    assert d.registry_values('{"r": {"x": {"m": "./a"}, "y": {"m": "./b"}}}', "/r/*/m") == [("/r/x/m", "./a"), ("/r/y/m", "./b")]
    assert d.css_rules("/* c */ a, b { color: red; top: 1px } @media print { p { x: y } }") == [("a", "color:red;top:1px"), ("b", "color:red;top:1px"), ("@media print p", "x:y")]
    exports = {"exports": {".": {"types": "./t.d.ts", "import": "./i.js"}, "./f/*": "./src/f/*.js", "./f/x/*": "./src/x/*.js", "./no": None}}
    assert [d.exports_target(exports, s) for s in (".", "./f/a", "./f/x/b", "./no", "./other")] == ["./i.js", "./src/f/a.js", "./src/x/b.js", None, None]
    df = spark.createDataFrame([("abcdef", [(1, 2, "X"), (4, 6, "")])], "t string, r array<struct<start:int,end:int,text:string>>")
    assert df.select(d.splice(df.t, df.r)).first()[0] == "aXcd"


def test_sinks(spark, tmp_path):
    from orebody import sinks

    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert sinks.json_report(df, ["k"]) == '[{"k":"a","v":1},{"k":"b","v":2}]\n'
    assert sinks.text_table(df, ["k"]) == "k  v\na  1\nb  2\n"
    target = str(tmp_path / "bundle")
    sinks.write_bundle(target, {"a.json": "1", "b.md": "x"}, budget=10)
    assert sinks.bundle_faults(target) == []
    (tmp_path / "bundle" / "a.json").write_text("2")
    (tmp_path / "bundle" / "c").write_text("")
    assert sinks.bundle_faults(target) == [("a.json", "differs"), ("c", "unexpected")]
    for bad in ({"../x": "1"}, {"big": "x" * 99}):
        with pytest.raises(ValueError):
            sinks.write_bundle(str(tmp_path / "other"), bad, budget=10)
    sinks.write_text(str(tmp_path / "t"), "one")
    with pytest.raises(FileExistsError):
        sinks.write_text(str(tmp_path / "t"), "two", exclusive=True)


def test_workspace_globs_and_provenance(spark):
    from orebody.sources import workspace

    folders = spark.createDataFrame([("libs/a",), ("libs/b",), ("libs/b/x",), ("apps/w",)], "path string")
    hit, missed = workspace.resolve_globs(folders, ["libs/*", "tools/*", "!**/b"])
    assert [r.path for r in hit.collect()] == ["libs/a"] and missed == ["tools/*"]
    with pytest.raises(ValueError):
        workspace.resolve_globs(folders, ["libs/**"])
    df = spark.createDataFrame([("// Generated from api/x.yaml\nconst a",), ("a\nb\nc\nd\ne\n// source: late",)], "t string")
    assert [r[0] for r in df.select(workspace.provenance(df.t)).collect()] == ["api/x.yaml", None]


def test_read_tree(spark, tmp_path):
    for p, text in (("a.ts", "1\n"), ("d/b.ts", "22"), ("node_modules/c.ts", "x")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {(r.path, r.sha256, r.size) for r in scan.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.ts", sha("1\n"), 2), ("d/b.ts", sha("22"), 2)}
    assert [r.path for r in scan.read_tree(spark, str(tmp_path), most_bytes=1).collect()] == []


def test_audit_rules(spark):
    from orebody.plans import audit

    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    blobs = spark.createDataFrame([("a", sha("a")), ("b", "XY")], "path string, sha256 string")
    got = [(r.rule, r.path) for r in audit.source_issues(f("a", "b", "b", "c"), f("a", "b", "d"), blobs).collect()]
    assert got == [("duplicate-file", "b"), ("not-partitioned", "c"), ("not-partitioned", "d"), ("missing-blob", "c"), ("malformed-digest", "b")]
    assert {tuple(r) for r in audit.entry_closure(f("a", "b", "c"), f("a", "d"), f("b"), f("a")).collect()} == {("c", "undeclared"), ("d", "not-produced")}
    report = audit.proof_report(spark.createDataFrame([("x",), ("x",)], "proof string"), ["x", "y"])
    assert {tuple(r) for r in report.collect()} == {("x", 2, False), ("y", 0, True)}
    disc = spark.createDataFrame([("a", "differs"), ("b", "missing"), ("g", "missing")], "path string, fault string")
    ops = spark.createDataFrame([(1, "write", "a", "h1"), (2, "write", "a", "h2"), (1, "write", "b", "h"), (1, "generate", "g", "h")], "idx long, kind string, path string, result_hash string")
    assert {tuple(r) for r in audit.reconcilable(disc, ops).collect()} == {("a", "differs", "h2", True), ("b", "missing", "h", False), ("g", "missing", "h", True)}
    edits = audit.declarative_edits(spark.createDataFrame([("a", "x y"), ("b", "x x"), ("c", "z")], "path string, content string"), spark.createDataFrame([(p, "x", "z") for p in "abc"], "path string, before string, after string"))
    assert {tuple(r) for r in edits.collect()} == {("a", "z y", "applied"), ("b", "x x", "refused"), ("c", "z", "already")}


def test_moves(spark):
    from orebody.operators import evacuation

    e = spark.createDataFrame([(1, 2, True), (2, 3, True), (3, 4, False)], "src long, dst long, type_only boolean")
    start = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError, match="value edge 3 -> 4"):
        evacuation.type_only_closure(e, start)
    assert {r.id for r in evacuation.type_only_closure(e.where("src < 3"), start).collect()} == {1, 2, 3}
    assert {r.id for r in evacuation.evaluation_reach(e, spark.createDataFrame([(3,)], "id long"), spark.createDataFrame([(3, 4, 9)], "src long, dst long, to long")).collect()} == {3, 9}
    nodes = spark.createDataFrame([("a/x", "web"), ("a/y", "web"), ("b/z", "api")], "path string, application string")
    assert evacuation.select_files(nodes, ["a"]).count() == 2
    for bad in (["none"], ["a", "b"]):
        with pytest.raises(ValueError):
            evacuation.select_files(nodes, bad)
    w = spark.createDataFrame([("a", "b", 1), ("b", "c", 5), ("a", "c", 3)], "a string, b string, weight long")
    assert {tuple(r) for r in evacuation.spanning_forest(w).collect()} == {("b", "c", 5), ("a", "c", 3)}
    uses = spark.createDataFrame([("o", m, f) for m, f in (("m1", "f1"), ("m2", "f1"), ("m2", "f2"), ("m3", "f2"), ("m4", "f3"))] + [("o", m, "all") for m in ("m1", "m2", "m3", "m4")], "owner string, id string, field string")
    assert {(r.id, r.cluster) for r in evacuation.cohesion_clusters(uses).collect()} == {("m1", "m1"), ("m2", "m1"), ("m3", "m1"), ("m4", "m4")}


def test_style_changes(spark):
    from orebody.functions.documents import css_rules
    from orebody.operators import references

    f = lambda sheet: spark.createDataFrame(css_rules(sheet), "selector string, declarations string")
    got = references.css_changes(f("a{x:1;y:2} b{z:1} c{q:1} d{m:1}"), f("a{y:2;x:1} b{z:2} d{m:1} e{n:1}"))
    assert {tuple(r) for r in got.collect()} == {("a", "reordered"), ("b", "changed"), ("c", "missing"), ("e", "added")}


def test_relative_resolution_order(spark):
    from orebody.operators import references

    tree = spark.createDataFrame([("a/b.ts",), ("a/b/index.ts",), ("c.ts",), ("a/d.ts",)], "path string")
    refs = spark.createDataFrame([("a/x.ts", "./b"), ("a/x.ts", "../c"), ("a/x.ts", "./d.js"), ("a/x.ts", "./none"), ("c.ts", "../../c")], "source string, specifier string")
    got = {r.specifier: r.resolved for r in references.resolve_relative(refs, tree).collect()}
    assert got == {"./b": "a/b.ts", "../c": "c.ts", "./d.js": "a/d.ts", "./none": None, "../../c": "c.ts"}


def test_lockfiles_by_hand(spark):
    text = "lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n    dependencies:\n      left:\n        specifier: ^1.0.0\n        version: 1.0.0\n    devDependencies:\n      '@a/b':\n        specifier: 'workspace:*'\n        version: 'link:../b:'\n\n  pkg/x: {}\n\n  pkg/y:\n    dependenciesMeta:\n      left:\n        injected: true\n\npackages:\n\n  left@1.0.0:\n    dependencies:\n      not: mine\n"
    locks = spark.createDataFrame([("l", text), ("none", "packages:\n  a: b\n"), ("empty", "")], "lock string, text string")
    assert {tuple(r) for r in lockfiles.dependencies(locks).collect()} == {("l", ".", "dependencies", "left", "^1.0.0", "1.0.0"), ("l", ".", "devDependencies", "@a/b", "workspace:*", "link:../b:")}
    found = {r.root: (r.start, r.lines, r.block_hash) for r in lockfiles.importers(locks).collect()}
    assert found["pkg/x"] == (14, 2, sha("  pkg/x: {}\n\n")) and found["."][:2] == (4, 10) and found["pkg/y"][:2] == (16, 5)
    assert {tuple(r) for r in lockfiles.faults(locks).collect()} == {("none", "no-importers", None), ("empty", "no-importers", None), ("l", "unfamiliar-mapping", "dependenciesMeta:")}
    roots = spark.createDataFrame([("l", "."), ("l", "pkg/x"), ("l", "gone")], "lock string, root string")
    declared = spark.createDataFrame([("l", ".", "dependencies", "left", "^1.0.0", "1.0.1"), ("l", "pkg/x", "dependencies", "n", "1", "1"), ("l", "gone", "dependencies", "n", "1", "1")], "lock string, root string, section string, name string, specifier string, version string")
    assert {tuple(r)[1:] for r in lockfiles.compared(roots, declared, locks).collect()} == {(".", "dependencies", "left", "differs"), (".", "devDependencies", "@a/b", "undeclared"), ("pkg/x", "dependencies", "n", "missing"), ("gone", None, None, "no-importer")}
    again = lockfiles.rendered(roots, declared)
    assert {tuple(r) for r in lockfiles.dependencies(again).collect()} == {tuple(r) for r in declared.collect()}
    bun = '{\n  "lockfileVersion": 1,\n  "workspaces": {\n    "": {\n      "name": "root",\n    },\n    "pkg/a": {\n      "dependencies": {\n        "x": "1",\n      },\n    },\n  },\n  "packages": {\n    "x": ["x@1.0.0", ""],\n\n    "a/x": ["x@2"],\n  }\n}\n'
    got = {tuple(r)[1:] for r in lockfiles.json_entries(spark.createDataFrame([("b", bun)], "lock string, text string")).collect()}
    assert got == {("workspaces", "", 3, 3), ("workspaces", "pkg/a", 6, 5), ("packages", "x", 13, 1), ("packages", "a/x", 15, 1)}
