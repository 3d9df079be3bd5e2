"""A panel above what one task should hold is dealt to more tasks, with the rows it has otherwise."""

import oracle
import pytest

from barwright.operators import models
from barwright.plans import load_all
from barwright.sources import panel

QUERIES, ORACLES = load_all()
NAMES = ("interpolated_closes", "carried_forward_bars", "quality_checks", "quality_checks_each", "missing_date_ranges", "first_missing_dates", "reindexed_closes")


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(panel, "DEALT", 300)


@pytest.mark.parametrize("name", NAMES)
def test_dealt_panel_equals_sql(spark, con, sf_dir, small_tasks, name):
    n = panel.tasks(spark, sf_dir)
    assert n == -(-panel.table(spark, sf_dir, "lineitem").count() // 300) > 8
    df = QUERIES[name](spark, sf_dir)
    if name != "quality_checks_each":
        # Its checks are written when it is made, so its plan holds files only.
        assert f", {n}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert oracle.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == []


def test_small_panel_is_left_to_the_session(spark, sf_dir):
    assert panel.tasks(spark, sf_dir) is None
    assert "REPARTITION_BY_NUM" not in QUERIES["interpolated_closes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_learners_read_small_pieces(spark, tmp_path):
    """More pieces than the session would cut, whole row groups each, and the session's setting back afterwards."""
    key, path = "spark.sql.files.minPartitionNum", str(tmp_path / "frame")
    spark.range(2_000_000).selectExpr("rand(1) AS a", "rand(2) AS b").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        plain = spark.read.parquet(path).rdd.getNumPartitions()
        with models.read_in(spark, 24):
            sizes = spark.read.parquet(path).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) > plain and max(sizes) < 2_000_000 // 10 and sum(sizes) == 2_000_000
        with pytest.raises(RuntimeError), models.read_in(spark, 24):
            raise RuntimeError
        assert spark.conf.get(key, None) is None
        with models.read_in(spark, None):
            assert spark.conf.get(key, None) is None
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
