"""Cells are stored as places and joined with their scores where they are."""

import pytest
from pyspark.sql import functions as F

from strideframe import catalog
from strideframe.operators import graph
from strideframe.plans import publishing, scored_grid


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["cell_popups", "grid_rows_ordered", "grid_rows_by_resolutions", "publish_rows_grid", "score_summary"])
def test_cells_are_stored_by_place_and_not_shuffled(spark, small, monkeypatch, no_small_tables, name):
    stored, write = {}, scored_grid.written

    def note(df, table):
        stored[table] = df.columns
        return write(df, table)

    monkeypatch.setattr(scored_grid, "written", note)
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert stored["cells"] == ["resolution_m", "i", "j", "node_id"]
    assert "SortMergeJoin" not in plan


def test_segments_stay_where_they_are(spark, no_small_tables):
    nodes = spark.createDataFrame([(1, 53.0, -6.0), (2, 53.001, -6.0)], "node_id long, lat double, lon double")
    segments = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (None, 1)], "src long, dst long")
    for few in (2, 1):  # with a broadcast of the nodes and without
        made = graph.measured_segments(segments, nodes, local_nodes=few)
        assert ("SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()) == (few == 1)
        rows = {(r["src"], r["dst"]): r["length_m"] for r in made.collect()}
        assert len(rows) == 4 and rows[1, 2] == rows[2, 1] == pytest.approx(111.19, abs=0.1) and rows[1, 3] is None and rows[None, 1] is None


def test_positions_are_numbered_in_the_tasks_of_their_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("b"))
    made = publishing.numbered(rows, F.desc("a"), "b")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1  # over a row a range; no second shuffle of the rows
    found = sorted((r["k"], r["a"], r["b"]) for r in made.collect())
    wanted = sorted(((r["a"], r["b"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert found == [(k, *r) for k, r in enumerate(wanted, 1)]
