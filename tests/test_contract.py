"""Rules of the workload generator, the greedy tree and the usefulness rules that no query's rows show."""

import weakref

import numpy as np

from tessella.operators import grids, metrics, recommend, trees, workload


def test_world_boxes():
    boxes = [workload.world_box(k) for k in range(400)]
    assert all(-90 <= a < b <= 90 and -180 <= c < d <= 180 for a, b, c, d in boxes)
    assert all(b - a <= 30 + 1e-9 and 5 - 1e-9 <= d - c <= 30 + 1e-9 for a, b, c, d in boxes)
    # sides are drawn; a box at a pole is cut off, not shifted
    assert len({round(d - c, 6) for _, _, c, d in boxes}) > 390 and len({round(b - a, 6) for a, b, _, _ in boxes}) > 390
    assert any(a == -90 or b == 90 for a, b, _, _ in boxes)
    tall = [workload.world_box(k, lat_sides=(30.0, 30.0)) for k in range(400)]
    assert any(b - a < 29 for a, b, _, _ in tall) and all(b - a >= 15 - 1e-9 for a, b, _, _ in tall)
    assert workload.world_box(7) == workload.world_box(7)
    wide = workload.world_box(1, lon_sides=(400.0, 400.0))
    assert wide[2:] == (-180.0, 180.0)


def test_greedy_cuts_leave_more_than_half_a_block_on_both_sides():
    rng = np.random.default_rng(1)
    xy = rng.random((5000, 2))
    corners = rng.random((200, 2)) * 0.05  # windows in a corner pull the cuts there
    tree = trees.grow(xy, 100, trees.greedy_split(np.hstack([corners, corners + 0.01]), 100))
    leaf = np.bincount(tree.route(xy[:, 0], xy[:, 1]))
    assert leaf.sum() == 5000 and leaf.max() <= 100 and leaf.min() >= 50


def test_usefulness_rules_of_models_without_a_choice(spark):
    rows = [(m, k % 3, k % 2, k % 5, 1 + k % 4, 1.0 + k / 10, useful(k)) for m, useful in {"all": lambda k: True, "none": lambda k: False, "some": lambda k: k % 3 == 1}.items() for k in range(30)]
    rows += [("lone", k, k, k, 1, 1.0, k == 0) for k in range(12)]  # no condition has two rows
    df = spark.createDataFrame(rows, "model string, dataset_entropy_id int, query_entropy_id int, sel_tag int, rank int, ratio double, useful boolean")
    got = {}
    for r in recommend.usefulness_rules(df).collect():
        got.setdefault(r.model, []).append(r)
    (whole,), (none,), (lone,) = got["all"], got["none"], got["lone"]
    assert (whole.rule, whole.precision, whole.coverage, whole.support, whole.useful_scenarios) == ("All measured scenarios", 1.0, 1.0, 30, 30) and round(whole.mean_ratio, 9) == 2.45
    assert (none.rule, none.precision, none.coverage, none.support, none.mean_rank, none.useful_scenarios) == ("No useful region found", 0.0, 0.0, 0, None, 0)
    assert (lone.rule, lone.support, lone.useful_scenarios, lone.total_scenarios) == ("No compact positive rule found", 0, 1, 12)
    best = max(got["some"], key=lambda r: (r.precision, r.coverage))
    assert (best.rule, best.precision, best.coverage, best.support) == ("dataset_entropy_id=1", 1.0, 1.0, 10) and all(r.precision > 0 for r in got["some"])
    assert recommend.usefulness_rules(df.where("false")).count() == 0


def test_samples_of_real_places_fill_the_unit_square(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform((-89, -179), (89, 179), (20_000, 2)))]
    places = spark.createDataFrame(rows, "pid long, lat double, lon double")
    grid = grids.world_grid(places).cache()
    points = workload.real_sample(places, grid, 60, 10_000, 40, 1).collect()
    assert len(points) == 40 and len({p.pid for p in points}) == 40
    assert all(0 <= v <= 1 for p in points for v in (p.x, p.y)) and {min(p.x for p in points), max(p.x for p in points)} == {0.0, 1.0}
    assert workload.real_sample(places, grid, 10**9, 10**10, 40, 1, tries=2) is None


def test_training_rows_where_the_best_latency_is_nothing(spark):
    rows = [("a", 1, 0.0), ("b", 1, 0.0), ("c", 1, 3.0), ("a", 2, 1.0), ("b", 2, 2.0), ("c", 2, 4.0)]
    df = spark.createDataFrame([(k, m, e, 1, 1, v) for k, (m, e, v) in enumerate(rows)], "event_id long, model string, dataset_entropy_id int, query_entropy_id int, sel_tag int, query_latency double")
    training = recommend.training_rows(metrics.ranked(df, "query_latency"))
    assert {r.event_id: round(r.weight, 6) for r in training.collect()} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 1.0, 4: 0.25, 5: 0.0625}
    assert recommend.recommend(recommend.fit_tree(training), df.select(*metrics.SCENARIO).distinct()).count() == 2


def test_unbalanced_trees_of_any_depth_hold_the_points_once():
    xy = np.stack([np.arange(3000.0), np.zeros(3000)], axis=1)
    held = []

    def sliver(part, box, depth):
        held.append(weakref.ref(part))
        assert sum(p() is not None for p in held) <= 2
        return 0, part[1, 0]

    tree = trees.grow(xy, 1, sliver)
    assert tree.leaves == 3000 and (tree.route(xy[:, 0], xy[:, 1]) == np.arange(3000)).all()


def test_perimeter_splits_are_even_enough_for_a_shallow_tree():
    rng = np.random.default_rng(5)
    spread = rng.random((6000, 2)) * (1, 0.4)
    tied = np.stack([rng.integers(0, 3, 6000) * (rng.random(6000) < 0.3), np.where(rng.random(6000) < 0.7, 5.0, rng.random(6000))], axis=1)
    wins = np.array([[0.1, 0.1, 0.3, 0.2], [0.6, 0.0, 0.9, 0.1]])
    for windows in (None, wins):
        for xy, shares in ((spread, 0.25), (tied, 0.0)):
            xy, depths, choose = xy[np.lexsort((xy[:, 1], xy[:, 0]))], [], trees.perimeter_split(8, windows)

            def split(part, box, depth):
                depths.append(depth)  # noqa: B023
                dim, value = choose(part, box, depth)  # noqa: B023
                below = (part[:, dim] < value).mean()
                assert shares <= below <= 1 - shares  # noqa: B023
                return dim, value

            tree = trees.grow(xy, 8, split)
            sizes = np.unique(tree.route(xy[:, 0], xy[:, 1]), return_counts=True)[1]
            assert sizes.sum() == 6000 and len(sizes) == tree.leaves
            assert max(depths) < 32
