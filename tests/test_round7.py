"""Findings of round 4 at size: layers of keys, closures and components of many edges, held to plain forms."""

from __future__ import annotations

import random

import pytest

from orebody.operators import graph, portfolio


def plan_of(df) -> str:
    """The physical plan before it adapts."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that the graph operators write."""
    seen, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(plan_of(df)) or cut(df))
    return seen


def rows_of(spark, r, n, keys, **columns):
    """Rows with a key and a key of each column, some of them null, repeated or without a row of their own."""
    pick = lambda top: r.choice([None, *range(top), *range(top)])
    found = [(pick(keys), *(pick(top) for top in columns.values())) for _ in range(n)]
    return spark.createDataFrame(found, ", ".join(f"{c} long" for c in ("key", *columns))), found


@pytest.mark.parametrize("seed", range(3))
def test_key_layers_are_those_of_the_peeled_edges(spark, seed):
    r = random.Random(seed)
    made = {"a": rows_of(spark, r, 40, 20, b=14, c=9, d=5), "b": rows_of(spark, r, 12, 14, c=9), "c": rows_of(spark, r, 6, 9, d=5)}
    got = graph.key_layers({k: (d, {c: c for c in d.columns[1:]}) for k, (d, _) in made.items()})
    pairs, alone = [], set()
    for k, (d, found) in made.items():
        for key, *to in found:
            ends = [(c, t) for c, t in zip(d.columns[1:], to, strict=True) if t is not None]
            alone |= {*ends, *([(k, key)] if key is not None else [])}
            pairs += [(f"{k}/{key}", f"{c}/{t}") for c, t in ends if key is not None]
    e = spark.createDataFrame(pairs, "src string, dst string").distinct()
    want = graph.layers(spark.createDataFrame([(f"{k}/{x}",) for k, x in alone], "comp string"), e, limit=0)
    assert sorted((f"{k}/{x.key}", x.layer) for k, d in got.items() for x in d.collect()) == sorted(map(tuple, want.collect()))
    assert len({x.layer for x in want.collect()}) > 2


def test_key_layers_join_nothing_where_a_kind_has_one_layer(spark, plans):
    """Peeling read, joined and wrote all edges again for each layer."""
    a = spark.createDataFrame([(i, i % 7, i % 3) for i in range(50)], "key long, b long, c long")
    b = spark.createDataFrame([(i, i % 3) for i in range(7)], "key long, c long")
    got = graph.key_layers({"a": (a, {"b": "b", "c": "c"}), "b": (b, {"c": "c"})})
    assert {k: {x.layer for x in d.collect()} for k, d in got.items()} == {"a": {2}, "b": {1}, "c": {0}}
    assert len(plans) == 2 and not [p for p in [*plans, *map(plan_of, got.values())] if "Join" in p]


def test_key_layers_refuse_a_cycle_of_kinds(spark):
    a = spark.createDataFrame([(1, 2)], "key long, b long")
    with pytest.raises(ValueError):
        graph.key_layers({"a": (a, {"b": "b"}), "b": (a, {"b": "a"})})


@pytest.mark.parametrize("limit", [0, 30])
@pytest.mark.parametrize("seed", range(2))
def test_closures_and_components_of_trimmed_graphs_are_the_kernels(spark, seed, limit):
    """Sparse graphs that trimming eats up, with cycles that it leaves to the kernel or to the rounds."""
    r = random.Random(seed)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(70 + 40 * seed)] + [(90, 91), (91, 90), (3, 90), (91, 4), (5, 5)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    for f in (graph.closure, graph.strong_components):
        assert sorted(map(tuple, f(e, limit).collect())) == sorted(map(tuple, f(e).collect()))


def test_a_long_path_takes_no_round_for_each_step(spark, plans):
    """A path of 60 edges beneath and above 300 loose ends, beyond the kernel's bound as a whole, within it as a rest: a fixpoint took 60 rounds."""
    pairs = [(i, i + 1) for i in range(60)] + [(1000 + i, i % 60) for i in range(150)] + [(i % 60, 2000 + i) for i in range(150)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.closure(e, limit=100)
    assert len(plans) <= 5 and not [p for p in plans if "Broadcast" in p]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.closure(e).collect()))
    plans.clear()
    e = e.union(spark.createDataFrame([(60, 0)], "src long, dst long"))
    assert len({x.comp for x in graph.strong_components(e, limit=100).collect()}) == 301
    assert len(plans) <= 5


def test_sets_of_candidates_are_made_once_for_their_groups(spark, monkeypatch):
    """Classes and distinct sets each made all sets and digests again."""
    seen, cut = [], portfolio.cut
    monkeypatch.setattr(portfolio, "cut", lambda df: seen.append(plan_of(df)) or cut(df))
    files = spark.createDataFrame([(c, p) for c in range(6) for p in range(c // 2, c // 2 + 5)], "cand long, path long")
    candidates = spark.createDataFrame([(c, float(c), "k") for c in range(6)], "id long, score double, kind string")
    got = portfolio.equivalence_groups(candidates, files, 0.6)
    assert sorted((x.id, x.seed, x.representative) for x in got.collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (4, 4, 5), (5, 4, 5)]
    assert len([p for p in seen if "sha2" in p]) == 1
