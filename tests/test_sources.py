"""Files, configurations and streams."""

import json

import pytest

from tessella.operators import layouts, metrics, trees, workload
from tessella.sources import points as src
from tessella.streaming.windows import window_counts


def test_text_round_trips(spark, tmp_path):
    p = spark.createDataFrame([(0, 0.25, 0.5), (1, 1.0, 0.0)], "pid long, x double, y double")
    src.write_points(p, str(tmp_path / "p"))
    assert {(r.x, r.y) for r in src.read_points(spark, str(tmp_path / "p")).collect()} == {(0.25, 0.5), (1.0, 0.0)}
    w = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 0.4)], "qid long, lx double, ly double, hx double, hy double")
    src.write_windows(w, str(tmp_path / "w"))
    assert src.read_windows(spark, str(tmp_path / "w")).select("lx", "ly", "hx", "hy").collect() == [(0.1, 0.2, 0.3, 0.4)]
    (tmp_path / "empty").write_text("")
    with pytest.raises(src.EmptySource):
        src.read_points(spark, str(tmp_path / "empty"))
    (tmp_path / "e").write_text("1 2 0.5\n1 3 0.75\n")
    assert src.entropy_of(src.read_query_entropy(spark, str(tmp_path / "e")), 1, 3) == 0.75
    (tmp_path / "z").write_text("0 0 1 1\n0 0.5 0.25 1\n2 0.125 0.75 0\n")
    assert [tuple(r) for r in src.read_quad_nodes(spark, str(tmp_path / "z")).collect()] == [(0, 0.5, 0.25, True), (2, 0.125, 0.75, False)]


def test_layout_and_tree_round_trip(spark, tmp_path):
    p = spark.range(1000).selectExpr("id as pid", "cast(id % 37 as double) / 37 as x", "cast(id % 101 as double) / 101 as y")
    layout = layouts.kd(p, 64)
    src.write_layout(layout, str(tmp_path / "kd"), 4)
    again = src.read_layout(spark, str(tmp_path / "kd"))
    assert again.points.count() == 1000 and layouts.one_window(again, 0.2, 0.2, 0.4, 0.4).count() == p.where("x >= 0.2 and x < 0.4 and y >= 0.2 and y < 0.4").count()
    xy, _ = trees.bounded(p)
    tree = trees.grow(xy, 64, trees.kd_split)
    src.write_table(tree.nodes(spark), str(tmp_path / "nodes"))
    loaded = trees.Tree.of_nodes(src.read_split_nodes(spark, str(tmp_path / "nodes")))
    assert (loaded.route(xy[:, 0], xy[:, 1]) == tree.route(xy[:, 0], xy[:, 1])).all()


def test_config_profiles(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"experiments": {"synthetic": {"points": 5}, "real": {"points": 6}}, "block_sizes": [32, 64]}))
    assert src.read_config(str(path))["points"] == 5 and src.read_config(str(path), "real")["points"] == 6
    monkeypatch.setenv("EXPERIMENT_NAME", "real")
    assert src.read_config(str(path)).name == "real" and src.read_config(str(path)).block_sizes == (32, 64)


def test_count_windows_come_near_their_target(spark):
    p = workload.mixture(spark, 5000, 3, 1.3, 2, 1000)
    assert p.count() == 5000
    c = workload.centers_real(p, 20, 3, 32, 0.5, 1)
    rows = workload.count_windows(c, workload.prefix_array(p, 64), 100).collect()
    assert len(rows) == 20 and sum(abs(r.estimated_count - 100) < 60 for r in rows) >= 15


def test_metric_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"model": "KD", "selectivity": "01024", "query_latency": 100, "refinement_latency": 40, "result_size": 5000, "disk_backed_query_latency": 300, "disk_backed_result_size": 0, "block_size_quantiles": [1, 2, 3, 4, 5, 6]}))
    row = src.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (row.avg_block_size, row.scan_latency, row.query_latency_per_point, row.disk_backed_query_latency_per_point, row.selectivity) == (6, 60, 100.0, None, 0.1024)
    assert metrics.SCENARIO and src.text_report(spark.range(1)).startswith("id")


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([(0.1, 0.1, "2024-01-01 00:10:00"), (0.1, 0.2, "2024-01-01 00:50:00"), (0.9, 0.9, "2024-01-01 00:20:00"), (0.1, 0.1, "2024-01-01 02:00:00")], "x double, y double, ts string").selectExpr("x", "y", "cast(ts as timestamp) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    w = spark.createDataFrame([(7, 0.0, 0.0, 0.5, 0.5)], "qid long, lx double, ly double, hx double, hy double")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream, w).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.cnt for r in spark.table("counts").collect()) == [1, 2]
