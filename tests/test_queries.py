"""Every registered query against its SQL on the smallest tables; the others must run and return rows."""
from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from foresift.plans.registry import QUERIES

# 10 station blocks at this scale: the rank p-value is exact, while the SQL has the normal approximation
ONLY_LARGER = {"h6_station_blocks"}
# iterative fits: a few representatives here, all of them in the full comparison script
HEAVY = {"r7_training_size", "r8_small_sizes", "r15_rolling_table", "m20_network_seeds"}


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in QUERIES and n not in ONLY_LARGER | HEAVY])
def test_query(spark, con, sf, name):
    took, rows, diff, _ = compare.check(spark, con, name, sf)
    if diff is None:
        assert rows > 0
    else:
        assert diff == []


def test_registry_is_complete():
    names = entry.queries()
    ids = {n.split("_")[0] for n in names if n in QUERIES}
    want = ({f"s{i}" for i in range(1, 8)} | {f"b{i}" for i in range(1, 19)} | {f"t{i}" for i in range(1, 15)}
            | {f"p{i}" for i in range(1, 7)} | {f"m{i}" for i in range(0, 22)} | {f"q{i}" for i in range(1, 17)}
            | {f"h{i}" for i in range(1, 13)} | {f"r{i}" for i in range(1, 22)})
    assert ids == want
    assert set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["method", "step_hours", "n", "crps", "upper_crps", "coverage_80pct", "interval_width"]
    assert df.count() == 15
