from __future__ import annotations

import random

import pytest

from orebody.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain_closure(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = {}
    for s in {x for p in pairs for x in p}:
        seen, work = set(), [s]
        while work:
            for w in near.get(work.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    work.append(w)
        out[s] = seen
    return out


def plain_components(pairs):
    reach = plain_closure(pairs)
    return {v: min([v, *(w for w in reach[v] if v in reach[w])]) for v in reach}


GR02 = [
    [(1, 0), (2, 3), (3, 2), (2, 0)],
    [(i, i + 1) for i in range(30)] + [(30, 10), (5, 5)],
    [(random.Random(7).randrange(60), random.Random(i).randrange(60)) for i in range(90)],
    [(random.Random(i).randrange(300), random.Random(i + 5000).randrange(300)) for i in range(420)],
]


@pytest.mark.parametrize("pairs", GR02)
def test_components_kernel(spark, pairs):
    got = {r.id: r.comp for r in graph.strong_components(frame(spark, pairs)).collect()}
    assert got == plain_components(pairs)


def test_components_and_layers_beyond_the_kernel(spark):
    pairs = GR02[0] + [(4, 1), (4, 2), (6, 7), (7, 8), (8, 6)]
    e = frame(spark, pairs)
    comps = graph.strong_components(e, limit=0)
    assert {r.id: r.comp for r in comps.collect()} == plain_components(pairs)
    ce = graph.condensed(e, comps)
    one = {r.comp: r.layer for r in graph.layers(comps.select("comp"), ce).collect()}
    assert one == {r.comp: r.layer for r in graph.layers(comps.select("comp"), ce, limit=0).collect()} == {0: 0, 1: 1, 2: 1, 4: 2, 6: 0}


@pytest.mark.parametrize("limit", [graph.KERNEL_EDGES, 0])
def test_closure(spark, limit):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (5, 5)]
    want = {(s, d) for s, x in plain_closure(pairs).items() for d in x if d != s}
    assert {tuple(r) for r in graph.closure(frame(spark, pairs), limit).collect()} == want


def test_layers_refuse_a_cycle(spark):
    e = frame(spark, [(1, 2), (2, 1)])
    with pytest.raises(ValueError):
        graph.layers(e.selectExpr("src as comp"), e)


def test_empty_and_null_edges(spark):
    e = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert graph.strong_components(e).count() == graph.closure(e).count() == graph.undirected(e).count() == 0


def test_communities_two_triangles_and_a_hub_in_any_order(spark):
    tri = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1")]
    hub = [(x, "hub") for x in ("a1", "a2", "a3", "b1", "b2", "b3")]
    apps = spark.createDataFrame([(x, "app") for x in ("a1", "a2", "a3", "b1", "b2", "b3", "hub")], "id string, app string")
    want = {x: x[0] + "1" for x in ("a1", "a2", "a3", "b1", "b2", "b3")}
    for pairs in (tri + hub, (tri + hub)[::-1]):
        e = spark.createDataFrame(pairs, "src string, dst string")
        assert {r.id: r.community for r in graph.communities(e, apps, 4).collect()} == want
        assert [tuple(r) for r in graph.hubs(e, 4).collect()] == [("hub", 6)]
