"""Layouts never change answers; blocks partition the points."""

import random

import pytest

from tessella.operators import layouts, range_join
from tessella.plans.registry import BOUNDED, BUILDERS

BLOCK = 256


def edge_windows(spark, points):
    some = points[:6]
    rows = [(x, y, x + 0.1, y + 0.1) for x, y in some] + [(x - 0.1, y - 0.1, x, y) for x, y in some] + [(-9e3, -9e3, 9e3, 9e3), (0.5, 0.5, 0.5, 0.9), (0.6, 0.6, 0.4, 0.7), (50, 50, 60, 60), (0, 0, 0.001, 0.001)]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "qid long, lx double, ly double, hx double, hy double")


def cases():
    r = random.Random(6)
    yield "spread", [(r.random(), r.random()) for _ in range(1500)]
    yield "equal and tied", [(0.25, 0.75)] * 700 + [(round(r.random(), 1), round(r.random(), 1)) for _ in range(600)]
    yield "negative", [(r.uniform(-1000, 1000), r.gauss(0, 50)) for _ in range(900)]
    yield "few", [(0.1, 0.2), (0.3, 0.4)]
    yield "none", []


@pytest.mark.parametrize("kind", sorted(BUILDERS))
@pytest.mark.parametrize("name,points", list(cases())[1::2] + list(cases())[4:], ids=lambda v: v if isinstance(v, str) else "")
def test_answers_and_partition(spark, kind, name, points):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "pid long, x double, y double")
    w = edge_windows(spark, points)
    layout = BUILDERS[kind](p, w)
    wanted = {(q.qid, i) for q in w.collect() for i, (x, y) in enumerate(points) if q.lx <= x < q.hx and q.ly <= y < q.hy}
    assert {(r.qid, r.pid) for r in layouts.range_query(layout, w).collect()} == wanted
    check = layouts.partition_check(layout, p, BLOCK).first()
    assert (check.n or 0, check.outside, check.lost) == (len(points), 0, 0)
    if kind in BOUNDED:
        assert not check.over


@pytest.mark.parametrize("name,points", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_joins(spark, name, points):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "pid long, x double, y double")
    w = edge_windows(spark, points)
    for closed in (False, True):
        wanted = {q.qid: sum((q.lx <= x <= q.hx and q.ly <= y <= q.hy) if closed else (q.lx <= x < q.hx and q.ly <= y < q.hy) for x, y in points) for q in w.collect()}
        assert {r.qid: r.cnt for r in range_join.range_count_all(p, w, closed=closed).collect()} == wanted
    c = spark.createDataFrame([(0, 0.5, 0.5), (1, -3.0, 70.0)], "cid long, cx double, cy double")
    near = {}
    for r in range_join.knn_join(c, p, 3).collect():
        near.setdefault(r.cid, []).append((r.d2, r.pid))
    for cid, cx, cy in ((0, 0.5, 0.5), (1, -3.0, 70.0)):
        wanted = sorted(((x - cx) * (x - cx) + (y - cy) * (y - cy), i) for i, (x, y) in enumerate(points))[:3]
        assert sorted(near.get(cid, [])) == wanted


def test_plans_have_no_nested_loops(spark):
    from tessella.operators import estimate

    p = spark.createDataFrame([(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(2000)], "pid long, x double, y double")
    w = spark.createDataFrame([(i, i / 10, i / 12, i / 10 + 0.1, i / 12 + 0.2) for i in range(8)], "qid long, lx double, ly double, hx double, hy double")
    layout = layouts.str_tree(p, BLOCK)
    for df in (range_join.range_count_all(p, w), layouts.range_query(layout, w), layouts.scan_metrics(layout, w), layouts.covered_points(layout, w), estimate.overlap_counts(layout.meta, w), estimate.estimated(estimate.forest(p, 300), w)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_of_all_sizes_meet_once(spark):
    r = random.Random(4)

    def rects(n):
        out = []
        for i in range(n):
            x, y, s = r.uniform(-5, 5), r.uniform(-5, 5), 10 ** r.uniform(-6, 1.5)
            out.append((i, x, y, x + s * r.choice([0, 0.3, 1]), y + s * r.choice([0, 0.7, 1])))
        return out

    a, b = rects(60), rects(90)
    w = spark.createDataFrame(a, "qid long, lx double, ly double, hx double, hy double")
    boxes = spark.createDataFrame(b, "block_id long, x_lo double, y_lo double, x_hi double, y_hi double")
    wanted = sorted((p[0], q[0]) for p in a for q in b if max(p[1], q[1]) <= min(p[3], q[3]) and max(p[2], q[2]) <= min(p[4], q[4]))
    got = range_join.box_pairs(w, boxes)
    touching = got.where("greatest(lx, x_lo) <= least(hx, x_hi) and greatest(ly, y_lo) <= least(hy, y_hi)")
    assert sorted((x.qid, x.block_id) for x in touching.collect()) == wanted
    assert range_join.box_pairs(w.limit(0), boxes).count() == 0 and range_join.box_pairs(w, boxes.limit(0)).count() == 0


def test_slices_of_more_than_two_levels(spark):
    r = random.Random(5)
    points = [(i, round(r.random(), 2), round(r.random(), 3)) for i in range(3000)]

    def plain(part, dim):
        if len(part) <= 4:
            return [part]
        k = 16 if len(part) // 16 >= 4 else len(part) // 4 + 1
        part, out, at = sorted(part, key=lambda p: (p[1 + dim], p[0])), [], 0
        for j in range(k):
            n = len(part) // k + (j < len(part) % k)
            out += plain(part[at : at + n], 1 - dim)
            at += n
        return out

    blocks = {}
    for p in layouts.str_tree(spark.createDataFrame(points, "pid long, x double, y double"), 4).points.collect():
        blocks.setdefault(p.block_id, []).append(p.pid)
    assert sorted(map(sorted, blocks.values())) == sorted(sorted(p[0] for p in b) for b in plain(points, 0))
