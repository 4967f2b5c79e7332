"""Neighbours and windows of every point against brute force."""

import numpy as np

from tessella.plans import fixtures as fx
from tessella.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_point_is_a_centre(spark):
    points = sorted((r.pid, r.x, r.y) for r in fx.pts_orders(spark, SF).collect())
    pid, x, y = (np.array(c) for c in zip(*points, strict=True))
    wanted, spread = {}, {}
    for i, c in enumerate(pid):
        d2 = (x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i])
        near = np.lexsort((pid, d2))[:8]
        wanted |= {(c, k): (pid[j], d2[j]) for k, j in enumerate(near, 1)}
        spread[c] = (x[near].mean(), y[near].mean(), np.sqrt(x[near].var() + 1e-6), np.sqrt(y[near].var() + 1e-6))
    got = {(r.cid, r["rank"]): (r.pid, r.d2) for r in registry.QUERIES["knn_join_all"](spark, SF).collect()}
    assert got.keys() == wanted.keys() and all(got[k][0] == p and abs(got[k][1] - d) < 1e-11 for k, (p, d) in wanted.items())
    got = {r.cid: (r.mean_x, r.mean_y, r.sd_x, r.sd_y) for r in registry.QUERIES["knn_centroid_spread_all"](spark, SF).collect()}
    assert got.keys() == spread.keys() and all(np.allclose(got[c], spread[c], atol=2e-6) for c in spread)
    assert {r.qid for r in registry.QUERIES["area_windows_all"](spark, SF).collect()} == set(pid.tolist())
