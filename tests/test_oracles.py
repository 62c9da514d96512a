"""Every query of the core that has DuckDB SQL gives its rows at the smallest scale."""

import pytest

from loamgrid.plans.catalog import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SLOW = {"small_patch_removal", "hole_fill", "wetland_patches"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLES[name], sf_dir)


def test_entry_runs_and_names_agree(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
