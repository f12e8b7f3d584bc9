import numpy as np
import pytest

from terrace import queries
from terrace.operators import points


def test_pairs_of_all_parts(spark):
    """Every part is asked for its neighbours; each one is its own at least."""
    sf = "/root/testdata/sf0.001"
    found = {r.left_id for r in queries.QUERIES["points_within"](spark, sf).select("left_id").distinct().collect()}
    assert found == {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    assert "%" not in queries.ORACLE_SQL["points_within"]


@pytest.mark.parametrize("left, right, pairs", [(10_000, 50_000, 4_000_000), (7, 11, 20), (7, 1000, 20), (1000, 11, 20)])
def test_a_dense_cell_is_met_in_blocks(spark, monkeypatch, left, right, pairs):
    """Pairs of one cell are spread over tasks, each pair once."""
    for name, value in (("LEFT", left), ("RIGHT", right), ("PAIRS", pairs)):
        monkeypatch.setattr(points, name, value)
    xy = np.random.default_rng(3).integers(0, 8, (150, 2)) / 4 + np.where(np.arange(150) < 120, 0, 4)[:, None]
    cloud = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "surface_id int, pt_id int, x double, y double")
    found = points.within(cloud.where("pt_id % 2 = 0"), cloud, 2.0)
    got = sorted((r.left_id, r.right_id) for r in found.collect())
    assert got == [(i, j) for i in range(0, 150, 2) for j in range(150) if np.hypot(*(xy[i] - xy[j])) <= 2]
    if pairs == 20:
        sizes = [len(part) for part in found.select("left_id").rdd.glom().collect()]
        assert max(sizes) < 0.5 * sum(sizes)
