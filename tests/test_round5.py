"""Findings of round 3 at size: similar sets, closures, lockfiles and more, held to plain forms."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orebody import queries
from orebody.operators import graph, portfolio
from orebody.sources import lockfiles


def similar(sets: dict, least: float) -> list[tuple]:
    return sorted((a, b) for (a, s), (b, t) in itertools.combinations(sorted(sets.items()), 2) if len(s & t) / len(s | t) >= least)


def table_of(spark, sets: dict):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")


def test_similar_sets_at_the_very_bound(spark):
    """55 of 100 items are 0.55 of them, though 100 * 0.55 rounds up to 56; the 45 others are rarer."""
    sets = {1: set(range(100)), 2: set(range(45, 100))} | {i: {i % 55 + 45, i} for i in range(1000, 1400)}
    assert [(x.a, x.b) for x in portfolio.jaccard_pairs(table_of(spark, sets), 0.55).collect()] == similar(sets, 0.55) == [(1, 2)]


@pytest.mark.parametrize("least", [0.3, 0.7, 0.8])
def test_similar_sets_of_all_sizes(spark, least):
    """Small sets, large ones and the step between, much alike."""
    r = random.Random(5)
    base = r.sample(range(60), 40)
    sets = {i: frozenset(x for x in base[: r.choice([2, 5, 15, 16, 17, 18, 24, 40])] if r.random() < 0.93) | {r.randrange(60)} for i in range(160)}
    sets = {i: s for i, s in sets.items() if s not in list(sets.values())[:i]}
    assert sorted((x.a, x.b) for x in portfolio.jaccard_pairs(table_of(spark, sets), least).collect()) == similar(sets, least)


def test_items_of_many_small_sets_make_no_square(spark):
    """4,000 sets of four or five of 40 items: by one item each, 380,527 pairs would be compared."""
    r = random.Random(6)
    sets = dict(enumerate({frozenset(r.sample(range(40), r.choice([4, 5]))) for _ in range(4000)}))
    near = portfolio.near_pairs(table_of(spark, sets), 0.8)
    assert sorted((x.a, x.b) for x in portfolio.jaccard_pairs(table_of(spark, sets), 0.8).collect()) == similar(sets, 0.8)
    assert near.count() < 50_000


@pytest.mark.parametrize("walked", [1, 50, 100_000])
def test_a_closure_comes_in_batches(spark, monkeypatch, walked):
    """Sources share batches of pairs: one for each source took longer than the walk."""
    r = random.Random(7)
    pairs = sorted({(r.randrange(300), r.randrange(300)) for _ in range(260)})
    want = set(pairs)
    while len(more := want | {(a, d) for a, b in want for c, d in pairs if b == c}) > len(want):
        want = more
    monkeypatch.setattr(graph, "WALKED", walked)
    got = graph.closure(spark.createDataFrame(pairs, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, b in want if a != b)


def test_lockfiles_are_read_without_a_shuffle(spark):
    """A name again in a section, one without values, lines before the first importer, a second part; rendered in one shuffle by lockfile."""
    text = "a: 1\nimporters:\n    odd:\n  r1:\n    dependencies:\n      x:\n        specifier: ^1\n      x:\n        specifier: ^2\n        version: '9'\n      y:\n    dependencies:\n      z:\n        version: 3\n  r2: {}\nend:\n  r3: {}\nimporters:\n  r4: {}"
    locks = spark.createDataFrame([("l", text), ("none", "x"), ("bare", "importers:")], "lock string, text string")
    got, found = lockfiles.dependencies(locks), lockfiles.importers(locks)
    assert sorted(map(tuple, got.collect())) == [("l", "r1", "dependencies", "x", "^2", "9"), ("l", "r1", "dependencies", "y", None, None), ("l", "r1", "dependencies", "z", None, "3")]
    assert sorted((x.root, x.start, x.lines) for x in found.collect()) == [("r1", 3, 11), ("r2", 14, 1)]
    assert not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in (got, found))
    roots = spark.createDataFrame([("l", "b"), ("l", "a"), ("l", "a"), ("m", "c")], "lock string, root string")
    declared = spark.createDataFrame([("l", "a", "devDependencies", "k", "^1", "1"), ("l", "a", "dependencies", "@s/n", "^2", "link:../p:"), ("l", "gone", "dependencies", "q", "1", "1")], "lock string, root string, section string, name string, specifier string, version string")
    again = lockfiles.rendered(roots, declared)
    assert again._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    texts = {x.lock: x.text for x in again.collect()}
    assert texts["m"] == "lockfileVersion: '9.0'\n\nimporters:\n\n  c: {}\n\npackages:\n\n  end:\n    resolution: {}\n"
    assert "\n  a:\n    dependencies:\n      '@s/n':\n        specifier: ^2\n        version: 'link:../p:'\n    devDependencies:\n      k:\n        specifier: ^1\n        version: 1\n\n  b: {}\n" in texts["l"] and "gone" not in texts["l"]


def test_facts_of_candidates_repeat_no_rows(spark, monkeypatch):
    """Several distinct counts would put each row of each closure down once for each of them."""
    facts = []
    real = queries._facts
    monkeypatch.setattr(queries, "_facts", lambda *a: facts.append(real(*a)) or facts[0])
    monkeypatch.setattr(queries, "reused", lambda spark, name, inputs, settings, build: build())
    queries._candidates(spark, "/root/testdata/sf0.001")
    assert "Expand" not in facts[0]._jdf.queryExecution().executedPlan().toString()


def test_layers_write_each_node_once(spark, monkeypatch):
    """Two hundred nodes over a chain: those that wait aren't written in every round. A ring is refused."""
    pairs = [(i, i - 1) for i in range(1, 5)] + [(100 + i, 4 - i % 2) for i in range(200)]
    written = []
    real = graph.cut

    def cut(df):
        out = real(df)
        if out.columns == ["id"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.layers(graph.nodes(e).select(F.col("id").alias("comp")), e, limit=0)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(5)] + [(100 + i, 5 - i % 2) for i in range(200)]
    assert sum(written) == 205
    with pytest.raises(ValueError):
        graph.layers(graph.nodes(e).select(F.col("id").alias("comp")), spark.createDataFrame([(1, 0), (2, 3), (3, 2)], "src long, dst long"), limit=0)
