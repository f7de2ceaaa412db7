"""Findings of round 3 at size, continued: decisions, components of all edges, greedy selection and repeated operations, held to plain forms."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from orebody.operators import graph
from orebody.plans import journal, validation


def plan_of(df) -> str:
    """The physical plan before it adapts."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_decisions_are_judged_in_one_aggregation(spark):
    """Both relations are read once and nothing is joined; a key with a null is equal to none, on either side."""
    r = random.Random(8)
    key = lambda: (r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice(["dev", "runtime", None]))
    said = [(*key(), r.choice([0, 1, 1, 2, None])) for _ in range(60)]
    due = [key() for _ in range(30)]
    got = validation.decision_issues(spark.createDataFrame(said, "plan long, name string, decision string, reasons int"), spark.createDataFrame(due, "plan long, name string, decision string"))
    want = []
    for k in {s[:3] for s in said} | set(due):
        reasons = [s[3] for s in said if s[:3] == k]
        met = reasons and k in due and None not in k
        rules = [("repeated-decision", len(reasons) > 1), ("no-reason", 0 in reasons), ("missing-decision", k in due and not met), ("undeclared-decision", reasons and not met)]
        want += [(k[0], ":".join(x for x in k[1:] if x is not None), rule) for rule, holds in rules if holds]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in plan_of(got) and plan_of(got).count("HashAggregate") == 2


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that the graph operators write in rounds."""
    seen, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(plan_of(df)) or cut(df))
    return seen


def test_rounds_of_components_and_layers_broadcast_nothing(spark, plans):
    """Each round's broadcasts went through the driver, up to 10 MB of files each, and rounds add up."""
    r = random.Random(9)
    pairs = [(r.randrange(24), r.randrange(24)) for _ in range(30)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    comps = graph.cut(graph.strong_components(e, limit=0))
    layer = graph.layers(comps.select("comp"), graph.condensed(e, comps), limit=0)
    assert sorted(comps.collect()) == sorted(graph.strong_components(e).collect())
    assert sorted(layer.collect()) == sorted(graph.layers(comps.select("comp"), graph.condensed(e, comps)).collect())
    assert len(plans) > 10 and not [p for p in [*plans, plan_of(layer)] if "Broadcast" in p]


def test_operations_are_counted_in_tasks_by_their_number(spark, monkeypatch):
    """No count before the shuffle, beside the sorts of joins; as many tasks as there are thousands of operations."""
    r = random.Random(10)
    rows = [(r.choice(["write", "delete", None]), r.choice([None, *(f"src/{i}" for i in range(2000))])) for _ in range(6500)]
    monkeypatch.setattr(journal, "COUNTED", 1000)
    got = journal.duplicate_operations(spark.createDataFrame(rows, "kind string, path string"), len(rows))
    assert Counter({(x.kind, x.path): x.n for x in got.collect()}) == Counter({k: n for k, n in Counter(rows).items() if n > 1})
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and ", 7)" in plan and plan.rindex("HashAggregate") < plan.index("Exchange")
    assert journal.duplicate_operations(spark.createDataFrame([], "kind string, path string"), 0).count() == 0


def test_rounds_of_a_closure_read_written_edges(spark, plans):
    """A round made the edges again from their inputs, components and condensation included; a path of 20 edges takes 20 rounds."""
    pairs = [(i, i + 1) for i in range(20)] + [(3, 0), (7, 30), (30, 9)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.closure(e, limit=0)
    assert sorted(got.collect()) == sorted(graph.closure(e).collect())
    assert "ExistingRDD" in plans[0] and not [p for p in plans[1:] if "ExistingRDD" in p or "Broadcast" in p]
