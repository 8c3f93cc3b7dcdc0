"""Stacked landscapes against one window at a time."""

import numpy as np
import pytest

from tests.test_data import brute_heights
from tidemark.operators import topology


def test_stacks_are_single_clouds():
    clouds = np.random.default_rng(2).normal(size=(30, 9, 3))
    clouds[4, 3:6] = clouds[4, 3]  # repeated points
    clouds[5] = 1.0
    heights = topology.merge_heights(clouds)
    for cloud, found in zip(clouds, heights):
        assert sorted(found) == pytest.approx(sorted(brute_heights(cloud)))
    for velocity in (None, 5.0):
        stacked = topology.landscape(clouds, velocity)
        assert all(np.allclose(topology.landscape(c, velocity), s) for c, s in zip(clouds, stacked))
    assert np.allclose(topology.local_hurst(clouds[:, :, 0]), [topology.local_hurst(c) for c in clouds[:, :, 0]])


def test_windows_of_unlike_shapes(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=(n, d)).cumsum(0).tolist()) for i, (n, d) in enumerate([(9, 3), (12, 3), (9, 2), (1, 3), (9, 3), (6, 3), (40, 2)] * 3)] + [(90, []), (91, None)]
    table = spark.createDataFrame(rows, "key long, points array<array<double>>").repartition(2)
    found = {r.key: r for r in topology.window_landscapes(table, ["key"]).collect()}
    assert len(found) == len(rows)
    for key, points in rows:
        if not points:
            assert (found[key].hurst, found[key].triggered, max(found[key].landscape)) == (0.5, False, 0.0)
            continue
        cloud = np.array(points)
        hurst = topology.local_hurst(cloud[:, 0])
        assert found[key].hurst == pytest.approx(hurst) and found[key].triggered == (not 0.45 <= hurst <= 0.55)
        assert np.allclose(found[key].landscape, topology.landscape(cloud).ravel() if found[key].triggered else 0.0)
    daily = topology.daily_topology(topology.window_landscapes(table, ["key"]).selectExpr("key % 2 as day", "triggered", "landscape"), ["day"]).collect()
    for r in daily:
        own = [found[k] for k, _ in rows if k % 2 == r.day]
        assert (r.windows, r.triggered_windows) == (len(own), sum(f.triggered for f in own)) and np.allclose(r.tda, np.max([f.landscape for f in own], axis=0))
