"""Every engine query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import oracles  # noqa: E402

from orebody.catalog import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracles.connected(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert oracles.of_spark(QUERIES[name](spark, SF)) == oracles.of_sql(con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert ("pipeline" in e.queries()) == (importlib.util.find_spec("orebody.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None)
