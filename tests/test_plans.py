"""Plans of the catalogue: no Cartesian products, nested loops only with literal relations, no Python on the main path."""

import re

import pytest

from spanforge.__main__ import main
from spanforge.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Joined with a fixed relation of literals or one row: grids, seeds, classes, transforms.
LITERAL = {"routing_grid", "seed_search", "transform_plan_skips", "class_weights", "prf", "prf_by_source", "confusion"}


# canonical_rows is JSON by Python on purpose; temperature runs its own aggregates.
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"temperature", "canonical_rows"}))
def test_plan(spark, name):
    df = catalog.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan or name in LITERAL
    assert "BroadcastNestedLoopJoin" not in plan or name in LITERAL
    assert not re.search(r"Python|Pandas|Arrow", plan)


def test_flagship_has_few_exchanges(spark):
    plan = catalog.queries()["compile_segments"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(capsys):
    assert main(["list"]) == 0 and "compile_segments" in capsys.readouterr().out
    assert main(["show", "nothing", DATA]) == 2
    assert main(["run", "atoms", DATA, DATA]) == 2
