"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans import registry

SLOW = {"logo_cv_forest", "gbt_cv", "random_search", "subset_search", "tile_features"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def canon(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or pd.isna(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        return f"{v:.6f}" if isinstance(v, float | int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, small, duck, name):
    ours, theirs = registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["feature_table", "stream_path_stats"])
def test_no_frame_ends_with_the_column(spark, small, name):
    """Such a frame is summed anew for every row: time grows with the square of the raster's rows."""
    assert "unboundedfollowing" not in registry.QUERIES[name](spark, small)._jdf.queryExecution().toString().lower()


def test_only_points_have_paths(spark, small):
    plan = registry.QUERIES["feature_table"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_cells_of_paths_are_not_shuffled(spark, small):
    plan = registry.QUERIES["stream_path_stats"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan
    assert "Join" not in plan
