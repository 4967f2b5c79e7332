"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.curve import morton
from ..operators import estimate, grids, layouts, metrics, range_join, recommend, trees, workload
from ..operators.ranks import global_rank
from ..sources import points as sources
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCK = 256


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = fx.sql(sql)
        return f

    return keep


INSIDE = "x >= lx and x < hx and y >= ly and y < hy"
COUNTS = f"select qid, count(*) as cnt from pts_orders, win_orders where {INSIDE} group by qid"
COUNTS_ALL = f"select qid, count(pid) as cnt from win_orders left join pts_orders on {INSIDE} group by qid"


def both(spark, sf):
    return fx.pts_orders(spark, sf), fx.win_orders(spark, sf)


# --- range scans and joins


@query("select pid, x, y from pts_orders where x >= 0.25e0 and x < 0.35e0 and y >= 0.2e0 and y < 0.5e0")
def range_scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    rect = g.Rect(*map(F.lit, (0.25, 0.2, 0.35, 0.5)))
    return fx.pts_orders(spark, sf).where(g.contains(rect, F.col("x"), F.col("y")))


@query(COUNTS)
def range_count_orders(spark, sf):
    return range_join.range_count(*both(spark, sf))


@query(COUNTS)
def range_count_nested(spark, sf):
    return range_join.range_pairs_nested(*both(spark, sf)).groupBy("qid").agg(F.count("*").alias("cnt"))


@query(COUNTS_ALL)
def range_count_with_zeros(spark, sf):
    return range_join.range_count_all(*both(spark, sf))


@query(f"select cast(sum(cnt) as bigint) as total from ({COUNTS})")
def range_total(spark, sf):
    return range_join.range_count(*both(spark, sf)).agg(F.sum("cnt").alias("total"))


@query(f"select pid, x, y from pts_orders where exists (select 1 from win_orders where {INSIDE})")
def range_semi(spark, sf):
    return range_join.range_semi(*both(spark, sf))


@query(f"select pid, x, y from pts_orders where not exists (select 1 from win_orders where {INSIDE})")
def range_anti(spark, sf):
    return range_join.range_anti(*both(spark, sf))


@query("select qid, count(pid) as cnt from win_orders left join pts_orders on x between lx and hx and y between ly and hy group by qid")
def range_count_closed(spark, sf):
    return range_join.range_count_all(*both(spark, sf), closed=True)


@query(f"select qid, count(*) as cnt from pts_lineitem, win_orders where {INSIDE} group by qid")
def range_count_multiset(spark, sf):
    return range_join.range_count(fx.pts_lineitem(spark, sf), fx.win_orders(spark, sf))


@query(f"select qid, count(*) as cnt from pts_embed, win_embed where {INSIDE} group by qid")
def range_count_negative_domain(spark, sf):
    return range_join.range_count(fx.pts_embed(spark, sf), fx.win_embed(spark, sf))


@query(f"select pid, x, y, count(qid) + 0.5e0 as weight from pts_orders left join win_orders on {INSIDE} group by pid, x, y")
def point_weights(spark, sf):
    return range_join.point_weights(*both(spark, sf))


def _pairs(spark, sf):
    w = fx.win_orders(spark, sf)
    a = w.select(F.col("qid").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("lx", "ly", "hx", "hy")))
    b = w.select(F.col("qid").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("lx", "ly", "hx", "hy")))
    return a, b, g.Rect(*(F.col(f"a_{c}") for c in ("lx", "ly", "hx", "hy"))), g.Rect(*(F.col(f"b_{c}") for c in ("lx", "ly", "hx", "hy")))


OVERLAP = "greatest(a.lx, b.lx) < least(a.hx, b.hx) and greatest(a.ly, b.ly) < least(a.hy, b.hy)"


@query(f"select a.qid as a, b.qid as b from win_orders a, win_orders b where a.qid < b.qid and {OVERLAP}")
def window_overlap_pairs(spark, sf):
    a, b, ra, rb = _pairs(spark, sf)
    return a.join(b, (F.col("a") < F.col("b")) & g.overlaps(ra, rb)).select("a", "b")


@query(
    f"""select a.qid as a, b.qid as b, round(greatest(0e0, least(a.hx, b.hx) - greatest(a.lx, b.lx)) * greatest(0e0, least(a.hy, b.hy) - greatest(a.ly, b.ly)), 9) as area,
    round(greatest(0e0, least(a.hx, b.hx) - greatest(a.lx, b.lx)) * greatest(0e0, least(a.hy, b.hy) - greatest(a.ly, b.ly)) / nullif((a.hx - a.lx) * (a.hy - a.ly), 0e0), 6) as share
    from win_orders a, win_orders b where a.qid < b.qid and {OVERLAP}"""
)
def window_overlap_area(spark, sf):
    a, b, ra, rb = _pairs(spark, sf)
    return a.join(b, (F.col("a") < F.col("b")) & g.overlaps(ra, rb)).select("a", "b", F.round(g.overlap_area(ra, rb), 9).alias("area"), F.round(g.overlap_ratio(ra, rb), 6).alias("share"))


@query(
    """select a.qid as a, b.qid as b from win_orders a, (select qid, lx + 0.015e0 as lx, ly + 0.02e0 as ly, hx - 0.015e0 as hx, hy - 0.02e0 as hy from win_orders) b
    where a.lx <= b.lx and a.hx > b.hx and a.ly <= b.ly and a.hy > b.hy"""
)
def window_covers(spark, sf):
    a, b, ra, rb = _pairs(spark, sf)
    b = b.select("b", (F.col("b_lx") + 0.015).alias("b_lx"), (F.col("b_ly") + 0.02).alias("b_ly"), (F.col("b_hx") - 0.015).alias("b_hx"), (F.col("b_hy") - 0.02).alias("b_hy"))
    return a.join(b, g.covers(ra, rb)).select("a", "b")


# --- geometry


@query("select min(x) as x_lo, min(y) as y_lo, max(x) as x_hi, max(y) as y_hi, count(*) as n from pts_orders")
def mbr_global(spark, sf):
    return fx.pts_orders(spark, sf).agg(F.min("x").alias("x_lo"), F.min("y").alias("y_lo"), F.max("x").alias("x_hi"), F.max("y").alias("y_hi"), F.count("*").alias("n"))


@query("select qid, round((hx - lx) * (hy - ly), 9) as area, round(2e0 * ((hx - lx) + (hy - ly)), 9) as perimeter from win_orders")
def rect_measures(spark, sf):
    return fx.win_orders(spark, sf).select("qid", F.round(g.area(g.window()), 9).alias("area"), F.round(g.perimeter(g.window()), 9).alias("perimeter"))


@query(
    """select qid, round(abs(hx - 0.5e0) + abs(lx - 0.5e0) - (hx - lx) + abs(hy - 0.5e0) + abs(ly - 0.5e0) - (hy - ly), 9) as growth,
    round((abs(hx - 0.5e0) + abs(lx - 0.5e0) + (hx - lx)) / 2e0 * ((abs(hy - 0.5e0) + abs(ly - 0.5e0) + (hy - ly)) / 2e0), 9) as area,
    least(lx, 0.5e0) as lx, least(ly, 0.5e0) as ly, greatest(hx, 0.5e0) as hx, greatest(hy, 0.5e0) as hy from win_orders"""
)
def mbr_expand_delta(spark, sf):
    x = y = F.lit(0.5)
    r = g.stretched(g.window(), x, y)
    return fx.win_orders(spark, sf).select("qid", F.round(g.perimeter_growth(g.window(), x, y), 9).alias("growth"), F.round(g.area_with(g.window(), x, y), 9).alias("area"), r.lx.alias("lx"), r.ly.alias("ly"), r.hx.alias("hx"), r.hy.alias("hy"))


@query("select pid, least(greatest(x * 2e0 - 0.5e0, 0e0), 1e0) as x, least(greatest(y, 0e0), 1e0) as y from pts_events")
def clip_unit(spark, sf):
    return fx.pts_events(spark, sf).select("pid", g.clip_unit(F.col("x") * 2.0 - 0.5).alias("x"), g.clip_unit(F.col("y")).alias("y"))


@query(
    """select pid, round(least(greatest((x - x0) / greatest(x1 - x0, 1e-9), 0e0), 1e0), 9) as x, round(least(greatest((y - y0) / greatest(y1 - y0, 1e-9), 0e0), 1e0), 9) as y
    from pts_events, (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pts_events)"""
)
def normalize_minmax(spark, sf):
    return grids.normalize(fx.pts_events(spark, sf)).select("pid", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(
    """select pid as qid, least(greatest(x - 0.016e0, 0e0), 1e0) as lx, least(greatest(y - 0.016e0, 0e0), 1e0) as ly,
    least(greatest(x + 0.016e0, 0e0), 1e0) as hx, least(greatest(y + 0.016e0, 0e0), 1e0) as hy from pts_orders where pid % 300 = 0"""
)
def area_windows(spark, sf):
    centers = fx.pts_orders(spark, sf).where("pid % 300 = 0").select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return workload.area_windows(centers, 0.001024)


@query(
    """select pid as qid, least(greatest(x - 0.016e0, 0e0), 1e0) as lx, least(greatest(y - 0.016e0, 0e0), 1e0) as ly,
    least(greatest(x + 0.016e0, 0e0), 1e0) as hx, least(greatest(y + 0.016e0, 0e0), 1e0) as hy from pts_orders"""
)
def area_windows_all(spark, sf):
    return workload.area_windows(_all_centers(spark, sf), 0.001024)


@query("select * from (values (0.000064e0, '00064'), (0.000256e0, '00256'), (0.001024e0, '01024'), (0.004096e0, '04096'), (0.016384e0, '16384'), (0.0000005e0, '0p000000500')) t(fraction, tag)")
def selectivity_tags(spark, sf):
    rows = spark.createDataFrame([(v,) for v in (0.000064, 0.000256, 0.001024, 0.004096, 0.016384, 0.0000005)], "fraction double")
    return rows.select("fraction", g.selectivity_tag(F.col("fraction")).alias("tag"))


# --- grids


def _cell(c: str, size: int) -> str:
    return f"cast(least(greatest(floor({c} * {float(size)}e0), 0), {size - 1}) as bigint)"


GRID32 = f"select {_cell('x', 32)} as cx, {_cell('y', 32)} as cy, count(*) as cnt from pts_orders group by all"


@query(GRID32)
def density_grid(spark, sf):
    return grids.density_grid(fx.pts_orders(spark, sf), 32)


@query(
    f"""with d as ({GRID32}), cells as (select i.range as cx, j.range as cy from range(32) i, range(32) j),
    dense as (select cells.cx, cells.cy, coalesce(cnt, 0) as cnt from cells left join d using (cx, cy))
    select cx, cy, cast(sum(row) over (partition by cy order by cx) as bigint) as total from (select cx, cy, sum(cnt) over (partition by cx order by cy) as row from dense)"""
)
def dense_prefix_sum(spark, sf):
    return grids.prefix_sums(grids.density_grid(fx.pts_orders(spark, sf), 32), 32)


@query(
    f"""with d as ({GRID32}) select w.qid,
    (select cast(coalesce(sum(cnt), 0) as bigint) from d where cx between {_cell('w.lx', 32)} and {_cell('w.hx', 32)} and cy between {_cell('w.ly', 32)} and {_cell('w.hy', 32)}) as estimate,
    (select count(*) from pts_orders p where p.x between w.lx and w.hx and p.y between w.ly and w.hy) as exact from win_orders w"""
)
def grid_estimate_vs_exact(spark, sf):
    p, w = both(spark, sf)
    return grids.grid_estimate(grids.density_grid(p, 32), w, 32).join(range_join.range_count_all(p, w, closed=True).withColumnRenamed("cnt", "exact"), "qid")


def _places(spark, sf):
    return fx.pts_embed(spark, sf).select("pid", (F.col("x") * 180.0).alias("lat"), (F.col("y") * 180.0).alias("lon"))


PLACES = "places as (select pid, x * 180e0 as lat, y * 180e0 as lon from pts_embed)"
WORLD = "select cast(floor((lat + 90e0) / 0.5e0) as bigint) as ci, cast(floor((lon + 180e0) / 0.5e0) as bigint) as cj, count(*) as cnt from places where lat >= -90 and lat < 90 and lon >= -180 and lon < 180 group by all"


@query(f"with {PLACES} {WORLD}")
def world_grid_count(spark, sf):
    return grids.world_grid(_places(spark, sf), 0.5, 0.5)


@query(f"with {PLACES}, w as ({WORLD}) select cast(coalesce(sum(cnt), 0) as bigint) as estimate from w where ci between 160 and 209 and cj between 330 and 389")
def world_box_estimate(spark, sf):
    return grids.box_estimate(grids.world_grid(_places(spark, sf), 0.5, 0.5), 14.75, -9.75, -14.75, 14.75, 0.5, 0.5)


@query(f"with {PLACES} select pid, lat, lon from places where lat between -10 and 15 and lon between -15 and 15")
def bbox_filter(spark, sf):
    return grids.box_filter(_places(spark, sf), 15, -10, -15, 15)


@query("select event_id, value from (select *, row_number() over (order by event_id) as r from events where value > 5) where r % 7 = 0")
def keep_every_n(spark, sf):
    return sources.keep_every(fx.table(spark, sf, "events").select("event_id", "value"), "event_id", 7, F.col("value") > 5)


@query(
    """with b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) n from pts_events),
    c as (select least(floor((x - x0) / (x1 - x0) * 64), 63) i, least(floor((y - y0) / (y1 - y0) * 64), 63) j, n, count(*) c from pts_events, b group by all)
    select round(sum(-(c / n) * log2(c / n)) + (64 * 64 - count(*)) * (-1e-9 * log2(1e-9)), 6) as entropy from c"""
)
def entropy_2d(spark, sf):
    return grids.entropy_2d(fx.pts_events(spark, sf), 64).select(F.round("entropy", 6).alias("entropy"))


@query()
def normalized_entropy(spark, sf):
    p = fx.pts_orders(spark, sf)
    flat = workload.gaussian(spark, (0.5, 0.5), [[1, 0], [0, 1]], p.count(), 5, 0, 1.0)
    return grids.normalized_entropy(p, flat, 64)


# --- nearest neighbours


def _all_centers(spark, sf):
    return fx.pts_orders(spark, sf).select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))


def _centers(spark, sf):
    return fx.pts_orders(spark, sf).where("pid % 1500 = 0").select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))


KNN = """knn as (select cid, pid, d2, r as rank from (select cid, pid, d2, row_number() over (partition by cid order by d2, pid) r from
    (select c.pid as cid, p.pid as pid, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) as d2 from pts_orders p, pts_orders c where c.pid % 1500 = 0)) where r <= 8)"""


@query(f"with {KNN} select cid, pid, round(d2, 12) as d2, cast(rank as int) as rank from knn")
def knn_join(spark, sf):
    return range_join.knn_join(_centers(spark, sf), fx.pts_orders(spark, sf), 8).select("cid", "pid", F.round("d2", 12).alias("d2"), "rank")


@query(
    f"""with {KNN} select cid, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y, round(sqrt(var_pop(x) + 1e-6), 6) as sd_x, round(sqrt(var_pop(y) + 1e-6), 6) as sd_y
    from knn join pts_orders using (pid) group by cid"""
)
def knn_centroid_spread(spark, sf):
    near = range_join.knn_join(_centers(spark, sf), fx.pts_orders(spark, sf), 8).join(fx.pts_orders(spark, sf), "pid")
    return grids.local_spread(near).select("cid", *(F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "sd_x", "sd_y")))


# Every point is a centre; SQL would take all pairs of points, so a test has brute force instead.


@query()
def knn_join_all(spark, sf):
    return range_join.knn_join(_all_centers(spark, sf), fx.pts_orders(spark, sf), 8).select("cid", "pid", F.round("d2", 12).alias("d2"), "rank")


@query()
def knn_centroid_spread_all(spark, sf):
    near = range_join.knn_join(_all_centers(spark, sf), fx.pts_orders(spark, sf), 8).join(fx.pts_orders(spark, sf), "pid")
    return grids.local_spread(near).select("cid", *(F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "sd_x", "sd_y")))


# --- layouts

META = "min(x) as x_lo, min(y) as y_lo, max(x) as x_hi, max(y) as y_hi, count(*) as n"
#: Two levels of slices, as sort-tile-recursive makes them of 16 * 16 * 256 points or fewer.
STR = f"""n0 as (select count(*) as n, case when count(*) <= {BLOCK} then 1 when count(*) // 16 >= {BLOCK} then 16 else count(*) // {BLOCK} + 1 end as k0 from pts_orders),
    z as (select *, row_number() over (order by x, pid) - 1 as r0 from pts_orders, n0),
    a as (select *, case when r0 < (n % k0) * (n // k0 + 1) then r0 // (n // k0 + 1) else n % k0 + (r0 - (n % k0) * (n // k0 + 1)) // greatest(n // k0, 1) end as s from z),
    b as (select *, count(*) over (partition by s) as m, row_number() over (partition by s order by y, pid) - 1 as r from a),
    c as (select *, case when m <= {BLOCK} then 1 else m // {BLOCK} + 1 end as k, max(m) over () as most from b),
    d as (select *, case when r < (m % k) * (m // k + 1) then r // (m // k + 1) else m % k + (r - (m % k) * (m // k + 1)) // greatest(m // k, 1) end as t from c),
    blocks as (select cast(case when most > {BLOCK} then s * 16 + t else s end as bigint) as block_id, pid, x, y from d), meta as (select block_id, {META} from blocks group by block_id)"""


@query(f"with {STR} select * from meta")
def layout_str_blocks(spark, sf):
    return layouts.str_tree(fx.pts_orders(spark, sf), BLOCK).meta


def _spread_sql(c: str) -> str:
    return " + ".join(f"(((({c}) >> {i}) & 1) << {2 * i})" for i in range(22)).join("()")


ZM = f"""r as (select pid, x, y, row_number() over (order by x, pid) - 1 as rx, row_number() over (order by y, pid) - 1 as ry from pts_orders),
    z as (select *, {_spread_sql('rx')} + 2 * {_spread_sql('ry')} as z from r),
    blocks as (select cast((row_number() over (order by z) - 1) // {BLOCK} as bigint) as block_id, pid, x, y, z from z)"""


@query(f"with {ZM} select block_id, {META} from blocks group by block_id")
def layout_zm_blocks(spark, sf):
    return layouts.zm(fx.pts_orders(spark, sf), BLOCK).meta


@query(f"with {ZM} select pid, cast(z as bigint) as z from z")
def morton_codes(spark, sf):
    return layouts.rank_space(fx.pts_orders(spark, sf)).select("pid", "z")


GRID = f"""k as (select count(*) n, greatest(1, cast(floor(sqrt(count(*) // {BLOCK})) as bigint)) k from pts_orders),
    tx as (select distinct v from (select x as v, row_number() over (order by x, pid) - 1 as r from pts_orders), k, range(1, 4096) j where j.range < k and r = j.range * (n // k) + least(j.range, n % k)),
    ty as (select distinct v from (select y as v, row_number() over (order by y, pid) - 1 as r from pts_orders), k, range(1, 4096) j where j.range < k and r = j.range * (n // k) + least(j.range, n % k)),
    blocks as (select pid, x, y, (select count(*) from tx where v <= x) * ((select count(*) from ty) + 1) + (select count(*) from ty where v <= y) as block_id from pts_orders),
    meta as (select block_id, {META} from blocks group by block_id)"""


@query(f"with {GRID} select * from meta")
def layout_grid_blocks(spark, sf):
    return layouts.grid(fx.pts_orders(spark, sf), BLOCK).meta


BUILDERS = {
    "grid": lambda p, w: layouts.grid(p, BLOCK),
    "str": lambda p, w: layouts.str_tree(p, BLOCK),
    "zm": lambda p, w: layouts.zm(p, BLOCK),
    "kd": lambda p, w: layouts.kd(p, BLOCK),
    "qd": lambda p, w: layouts.qd(p, w, BLOCK),
    "qd_greedy": lambda p, w: layouts.qd_greedy(p, w, BLOCK),
    "zindex": lambda p, w: layouts.zindex(p, BLOCK),
    "wazi": lambda p, w: layouts.wazi(p, w, BLOCK),
    "flood": lambda p, w: layouts.flood(p, w, BLOCK),
    "cur": lambda p, w: layouts.cur(p, w, BLOCK),
    "rstar": lambda p, w: layouts.rstar(p, BLOCK),
    "rw": lambda p, w: layouts.rw(p, w, BLOCK),
    "rsmi": lambda p, w: layouts.rsmi(p, BLOCK),
}

#: Layouts that promise no more than a block's points; the others cut space or weight.
BOUNDED = {"str", "zm", "kd", "qd", "qd_greedy", "zindex", "wazi", "rstar", "rw", "rsmi"}


def _layout_queries(kind: str) -> None:
    build = BUILDERS[kind]

    @query(COUNTS, f"layout_{kind}_range_count")
    def count(spark, sf):
        p, w = both(spark, sf)
        return layouts.range_query_count(build(p, w), w)

    check = "select count(*) as n, 0 as outside, 0 as lost from pts_orders" if kind not in BOUNDED else "select count(*) as n, 0 as over, 0 as outside, 0 as lost from pts_orders"

    @query(check.replace("0 as", "cast(0 as bigint) as"), f"layout_{kind}_partition_check")
    def partition(spark, sf):
        p, w = both(spark, sf)
        found = layouts.partition_check(build(p, w), p, BLOCK)
        return found if kind in BOUNDED else found.drop("over")


for _kind in BUILDERS:
    _layout_queries(_kind)


@query("select 0 as dim, round(min(x) + (max(x) - min(x)) / 2e0, 9) as value, count(*) filter (x < (select min(x) + (max(x) - min(x)) / 2e0 from pts_orders)) as below from pts_orders")
def kd_first_split(spark, sf):
    p = fx.pts_orders(spark, sf)
    xy, share = trees.bounded(p)
    tree = trees.grow(xy, max(1, BLOCK * share), trees.kd_split)
    return p.agg(F.lit(tree.dim[0]).alias("dim"), F.lit(round(tree.value[0], 9)).alias("value"), F.count_if(F.col("x") < tree.value[0]).alias("below"))


QUAD = """m as (select (select x from (select x, row_number() over (order by x) - 1 r from pts_orders), (select count(*) n from pts_orders) where r = n // 2) px,
    (select y from (select y, row_number() over (order by y) - 1 r from pts_orders), (select count(*) n from pts_orders) where r = n // 2) py),
    q as (select (select count(*) filter (x < px and y < py) from pts_orders) n_a, (select count(*) filter (x >= px and y < py) from pts_orders) n_b,
    (select count(*) filter (x < px and y >= py) from pts_orders) n_c, (select count(*) filter (x >= px and y >= py) from pts_orders) n_d,
    (select count(*) filter (lx < px and ly < py) from win_orders) s_a, (select count(*) filter (lx >= px and ly < py) from win_orders) s_b,
    (select count(*) filter (lx < px and ly >= py) from win_orders) s_c, (select count(*) filter (lx >= px and ly >= py) from win_orders) s_d,
    (select count(*) filter (hx < px and hy < py) from win_orders) e_a, (select count(*) filter (hx >= px and hy < py) from win_orders) e_b,
    (select count(*) filter (hx < px and hy >= py) from win_orders) e_c, (select count(*) filter (hx >= px and hy >= py) from win_orders) e_d from m)"""


def _median_point(p: DataFrame) -> tuple[float, float]:
    n = p.count()
    at = lambda c: global_rank(p, [c, "pid"], "r").where(F.col("r") == n // 2).select(c).first()[0]
    return at("x"), at("y")


@query(f"with {QUAD} select * from q")
def zindex_root_quadrants(spark, sf):
    p, w = both(spark, sf)
    return estimate.quadrants(p, w, *_median_point(p))


def _read_sql(n: str) -> str:
    return f"(case when {n} <= {BLOCK} then {BLOCK}e0 else (ceil(({n} - {BLOCK}) / (3e0 * {BLOCK})) * 3 + 1) * {BLOCK}e0 end)"


@query(
    f"""with {QUAD}, v as (select {', '.join(f'{_read_sql(f"n_{k}")} as n{k}, s_{k} + 1 as s{k}, e_{k} + 1 as e{k}' for k in 'abcd')} from q),
    c as (select na * (sa + ea) + nb * (sb + eb) + nc * (sc + ec) + nd * (sd + ed) as low, na * (eb + ec + ed) + nb * (sa + ed) + nc * (sa + ed) + nd * (sa + sb + sc) as common, ec + sb as yx, eb + sc as xy from v)
    select low + common + least(yx, xy) as cost, yx > xy as ordering from c"""
)
def wazi_objective_root(spark, sf):
    p, w = both(spark, sf)
    return estimate.split_objective(estimate.quadrants(p, w, *_median_point(p)), BLOCK)


MAY_HOLD = "b.x_lo < w.hx and b.x_hi >= w.lx and b.y_lo < w.hy and b.y_hi >= w.ly"


@query(f"with {STR} select w.qid, count(b.n) as refined_blocks, cast(coalesce(sum(b.n), 0) as bigint) as points_scanned from win_orders w left join meta b on {MAY_HOLD} group by w.qid")
def str_scan_metrics(spark, sf):
    p, w = both(spark, sf)
    return layouts.scan_metrics(layouts.str_tree(p, BLOCK), w)


@query(f"with {ZM}, meta as (select block_id, {META} from blocks group by block_id) select w.qid, b.block_id from win_orders w join meta b on {MAY_HOLD}")
def zm_candidate_blocks(spark, sf):
    p, w = both(spark, sf)
    return layouts.candidates(layouts.zm(p, BLOCK), w).select("qid", "block_id")


@query(
    f"""with {STR} select w.qid, cast(coalesce(sum(b.n), 0) as bigint) as covered from (select qid, lx - 0.1e0 as lx, ly - 0.1e0 as ly, hx + 0.1e0 as hx, hy + 0.1e0 as hy from win_orders) w
    left join meta b on w.lx <= b.x_lo and w.hx > b.x_hi and w.ly <= b.y_lo and w.hy > b.y_hi group by w.qid"""
)
def blocks_fully_covered_points(spark, sf):
    p, w = both(spark, sf)
    wide = w.select("qid", (F.col("lx") - 0.1).alias("lx"), (F.col("ly") - 0.1).alias("ly"), (F.col("hx") + 0.1).alias("hx"), (F.col("hy") + 0.1).alias("hy"))
    return layouts.covered_points(layouts.str_tree(p, BLOCK), wide)


@query(
    f"""with {GRID}, s as (select list(n order by n) as s, avg(n) as m from meta)
    select {', '.join(f"s[cast(floor(len(s) * {q}) as bigint) + 1] as q{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, cast(floor(m) as bigint) as avg from s"""
)
def block_size_quantiles(spark, sf):
    return layouts.size_quantiles(layouts.grid(fx.pts_orders(spark, sf), BLOCK).meta)


@query(f"with {STR} select b.block_id, count(w.qid) as queries from meta b left join win_orders w on greatest(b.x_lo, w.lx) < least(b.x_hi, w.hx) and greatest(b.y_lo, w.ly) < least(b.y_hi, w.hy) group by b.block_id")
def block_overlap_counts(spark, sf):
    p, w = both(spark, sf)
    return estimate.overlap_counts(layouts.str_tree(p, BLOCK).meta, w)


@query(
    f"""with {STR}, o as (select b.block_id, b.n, count(w.qid) as q from meta b left join win_orders w on greatest(b.x_lo, w.lx) < least(b.x_hi, w.hx) and greatest(b.y_lo, w.ly) < least(b.y_hi, w.hy) group by all)
    select round(sum((t - q) * n) / cast(max(t) * sum(n) as double), 9) as skipped from o, (select count(*) t from win_orders)"""
)
def qd_overlap_reward(spark, sf):
    p, w = both(spark, sf)
    return estimate.skipped_share(layouts.str_tree(p, BLOCK).meta, w).select(F.round("skipped", 9).alias("skipped"))


@query(
    f"""with a as (select pid, x, y, count(qid) + 0.5e0 as weight from pts_orders left join win_orders on {INSIDE} group by all)
    select cast(least(ceil(sum(weight) over (order by x, pid rows unbounded preceding) / ((select sum(weight) from a) / 16)) - 1, 15) as bigint) as slice, pid from a"""
)
def cur_weight_slices(spark, sf):
    weighted = range_join.point_weights(*both(spark, sf))
    total = weighted.agg(F.sum("weight").alias("total"))
    ranked = global_rank(weighted, ["x", "pid"], "r").withColumn("range", F.floor(F.col("r") / 4096))
    # running sums per run of ranks, shifted by the runs before: no single task sees all rows
    runs = ranked.groupBy("range").agg(F.sum("weight").alias("s"))
    before = runs.select("range", (F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    inner = F.sum("weight").over(Window.partitionBy("range").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranked.join(before, "range").withColumn("run", inner + F.col("before")).crossJoin(F.broadcast(total))
    return placed.select(F.least(F.ceil(F.col("run") / (F.col("total") / 16)) - 1, F.lit(15)).cast("bigint").alias("slice"), "pid")


@query()
def forest_estimates(spark, sf):
    p, w = both(spark, sf)
    return estimate.estimated(estimate.forest(p, 512), w)


@query()
def weighted_forest_estimates(spark, sf):
    p, w = both(spark, sf)
    return estimate.estimated(estimate.forest(range_join.point_weights(p, w), 512, weight="weight"), w)


@query()
def qd_trained_nodes(spark, sf):
    p, w = both(spark, sf)
    xy, share = trees.bounded(p)
    return trees.search_random(xy, trees.collected(w), max(1, BLOCK * share))[1].nodes(spark)


@query(COUNTS)
def qd_loaded_range_count(spark, sf):
    p, w = both(spark, sf)
    return layouts.range_query_count(layouts.qd_loaded(p, qd_trained_nodes(spark, sf), BLOCK), w)


@query("select pid, x, y from pts_orders where x >= 0.3e0 and x < 0.4e0 and y >= 0.3e0 and y < 0.6e0")
def stored_layout_scan(spark, sf):
    return layouts.one_window(layouts.str_tree(fx.pts_orders(spark, sf), BLOCK), 0.3, 0.3, 0.4, 0.6)


# --- workloads


@query()
def synthetic_points(spark, sf):
    return workload.mixture(spark, 2000, 5, 1.0, 1, 200)


@query("select 2000 as points, 2000 as ids, 2000 as inside, true as noise_first")
def synthetic_points_check(spark, sf):
    """What holds of every mixture: the points asked for, an id each, inside the open unit square, the noise among them."""
    inside = (F.col("x") > 0) & (F.col("x") < 1) & (F.col("y") > 0) & (F.col("y") < 1)
    return synthetic_points(spark, sf).agg(F.count("*").alias("points"), F.countDistinct("pid").alias("ids"), F.count_if(inside).alias("inside"), F.bool_or(F.col("pid") < 200).alias("noise_first"))


@query()
def synthetic_centers(spark, sf):
    return workload.centers_synthetic(fx.pts_orders(spark, sf), 50, 5, 0.5, 3)


@query()
def count_windows(spark, sf):
    p = fx.pts_orders(spark, sf)
    return workload.count_windows(workload.centers_real(p, 40, 5, 32, 0.5, 2), workload.prefix_array(p, 128), max(1, p.count() // 100))


# --- metrics

KEYS = ", ".join(metrics.RUN)
PREP = f"p as (select {KEYS}, avg(event_id) as event_id, avg(query_latency) as query_latency, avg(disk_backed_query_latency) as disk_backed_query_latency, avg(refinement_latency) as refinement_latency, avg(result_size) as result_size, avg(number_of_points_scanned) as number_of_points_scanned, avg(build_time) as build_time from metrics_v group by {KEYS})"


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


@query(
    f"""with {PREP} select {KEYS}, round(query_latency, 6) as query_latency, round(result_size, 6) as result_size, round(build_time, 6) as build_time,
    round(8e5 * sel_tag / 1e4, 6) as target, round((8e5 * sel_tag / 1e4 - result_size / 5e3) / nullif(8e5 * sel_tag / 1e4, 0e0), 6) as difference_from_target from p"""
)
def metrics_prepare(spark, sf):
    return _rounded(metrics.prepare(fx.metrics_v(spark, sf))).select(*metrics.RUN, "query_latency", "result_size", "build_time", "target", "difference_from_target")


def _best_sql(latency: str) -> str:
    c = ", ".join(metrics.CONFIGURATION)
    return f"with {PREP} select {c}, block_size, round({latency}, 6) as latency from (select *, row_number() over (partition by {c} order by round({latency}, 6), block_size) r from p) where r = 1"


def _best(spark, sf, latency):
    rows = metrics.prepare(fx.metrics_v(spark, sf)).withColumn("latency", F.round(latency, 6))
    return metrics.best_setting(rows, "latency").select(*metrics.CONFIGURATION, "block_size", "latency")


@query(_best_sql("query_latency"))
def metrics_argmin_memory(spark, sf):
    return _best(spark, sf, "query_latency")


@query(_best_sql("disk_backed_query_latency"))
def metrics_argmin_disk(spark, sf):
    return _best(spark, sf, "disk_backed_query_latency")


@query(
    f"""with {PREP}, m as (select block_size, model, dataset_entropy_id, query_entropy_id, sel_tag, round(avg(query_latency), 6) as l from p group by all)
    select block_size, model, dataset_entropy_id, query_entropy_id, sel_tag, l as query_latency from (select *, row_number() over (partition by model, dataset_entropy_id, query_entropy_id, sel_tag order by l, block_size) r from m) where r = 1"""
)
def metrics_measurable(spark, sf):
    means = metrics.means(metrics.prepare(fx.metrics_v(spark, sf)), ["block_size", "model", *metrics.SCENARIO], ["query_latency"]).withColumn("query_latency", F.round("query_latency", 6))
    return metrics.best_setting(means, "query_latency", ["model", *metrics.SCENARIO])


@query(
    """select 'best' as choice, model, block_size, cast(null as double) as mean_latency, round(query_latency, 6) as query_latency, event_id from metrics_v where sel_tag = 1024 and block_size = 32
    union all select 'average', model, cast(null as int), round(avg(query_latency), 6), cast(null as double), cast(null as bigint) from metrics_v where sel_tag = 1024 group by model"""
)
def metrics_best_vs_average(spark, sf):
    rows = fx.metrics_v(spark, sf)
    best = rows.where("block_size = 32").select("model", "block_size", "sel_tag", F.round("query_latency", 6).alias("query_latency"), "event_id")
    average = rows.groupBy("model", "sel_tag").agg(F.round(F.avg("query_latency"), 6).alias("mean_latency"))
    return metrics.best_and_average(best, average, 1024).drop("sel_tag")


@query("select model, dataset_entropy_id, query_entropy_id, round(avg(query_latency) / 1e6, 9) as query_latency from metrics_v group by all")
def metrics_mean_by_entropy(spark, sf):
    return _rounded(metrics.means(fx.metrics_v(spark, sf), ["model", "dataset_entropy_id", "query_entropy_id"], ["query_latency"], 1e-6), 9)


@query("select block_size, model, round(avg(query_latency), 6) as query_latency, round(avg(refinement_latency), 6) as refinement_latency from metrics_v group by all")
def metrics_mean_by_block(spark, sf):
    return _rounded(metrics.means(fx.metrics_v(spark, sf), ["block_size", "model"], ["query_latency", "refinement_latency"]))


@query("select model, round(avg(build_time), 6) as mean, round(stddev_samp(build_time), 6) as spread from metrics_v group by model")
def metrics_build_time_stats(spark, sf):
    return _rounded(metrics.build_time_stats(fx.metrics_v(spark, sf)))


SC = ", ".join(metrics.SCENARIO)


@query(
    f"""with s as (select model, {SC}, avg(build_time) as build, avg(query_latency) as latency from metrics_v group by all),
    j as (select a.model, 1e9 * (a.build - b.build) / nullif(b.latency - a.latency, 0e0) as q, a.build > b.build as dearer, a.latency < b.latency as faster from s a join s b using ({SC}) where b.model = 'click' and a.model <> 'click')
    select model, round(avg(q), 0) as queries, avg(dearer::int) >= 0.5 as dearer, avg(faster::int) >= 0.5 as faster, count(*) as scenarios from j group by model"""
)
def metrics_redemption(spark, sf):
    return metrics.redemption(fx.metrics_v(spark, sf), "click", metrics.SCENARIO).withColumn("queries", F.round("queries", 0))


@query(
    """with t as (select query_entropy_id as q, dataset_entropy_id as d, avg(query_latency) as v from metrics_v group by all), b as (select v as base from t where d = 1 and q = (select min(q) from t))
    select q as query_entropy_id, """
    + ", ".join(f"round(max((v - base) / nullif(base, 0e0) * 100e0) filter (d = {i}), 6) as e{i}" for i in range(1, 6))
    + " from t, b group by q"
)
def metrics_pivot_pct_change(spark, sf):
    return _rounded(metrics.change_table(fx.metrics_v(spark, sf), "query_latency", [1, 2, 3, 4, 5]))


RANKED = f"r as (select *, min(query_latency) over (partition by {SC}) as best, row_number() over (partition by {SC} order by query_latency, model, block_size, data_sample_num, event_id) as rank from metrics_v)"


@query(f"with {RANKED} select event_id, model, {SC}, cast(rank as int) as rank, round(query_latency / nullif(best, 0e0), 6) as ratio from r where rank <= 3")
def metrics_rank_topk(spark, sf):
    rows = metrics.ranked(fx.metrics_v(spark, sf), "query_latency").where("rank <= 3")
    return _rounded(rows.select("event_id", "model", *metrics.SCENARIO, "rank", "ratio"))


@query(f"with {RANKED} select model, count(*) filter (rank <= 3 or query_latency / nullif(best, 0e0) <= 1.5e0) as useful, count(*) as n from r group by model")
def metrics_usefulness(spark, sf):
    return metrics.usefulness(metrics.ranked(fx.metrics_v(spark, sf), "query_latency")).groupBy("model").agg(F.count_if("useful").alias("useful"), F.count("*").alias("n"))


@query(
    """select model, case dataset_entropy_id when 1 then 2 when 5 then 4 else dataset_entropy_id end as dataset_entropy_id, case query_entropy_id when 1 then 2 when 5 then 4 else query_entropy_id end as query_entropy_id,
    case sel_tag when 64 then 1 when 256 then 1 when 1024 then 2 else 3 end as sel_class, count(*) as n from metrics_v group by all"""
)
def metrics_classes(spark, sf):
    return metrics.classed(fx.metrics_v(spark, sf)).groupBy("model", "dataset_entropy_id", "query_entropy_id", "sel_class").agg(F.count("*").alias("n"))


MK = ["model", *metrics.SCENARIO]
MKS = ", ".join(MK)
LOOKUP = f"l as (select {MKS}, block_size as known from (select *, row_number() over (partition by {MKS} order by query_latency, block_size, event_id) r from metrics_v where data_sample_num = 1) where r = 1)"


def _lookup(rows):
    place = F.row_number().over(Window.partitionBy(*MK).orderBy("query_latency", "block_size", "event_id"))
    return rows.where("data_sample_num = 1").withColumn("r", place).where("r = 1").select(*MK, "block_size")


@query(f"with {LOOKUP} select event_id, {', '.join('m.' + k for k in MK)}, m.block_size, known is not null as matched from metrics_v m left join l using ({MKS}) where m.data_sample_num > 1 and (known is null or m.block_size = known)")
def metrics_block_filter(spark, sf):
    rows = fx.metrics_v(spark, sf)
    return metrics.at_known_best(rows.where("data_sample_num > 1"), _lookup(rows), MK).select("event_id", *MK, "block_size", "matched")


@query(f"with {LOOKUP} select distinct {MKS} from metrics_v m where data_sample_num > 1 and not exists (select 1 from l where l.model = m.model and l.dataset_entropy_id = m.dataset_entropy_id and l.query_entropy_id = m.query_entropy_id and l.sel_tag = m.sel_tag)")
def metrics_unmatched(spark, sf):
    rows = fx.metrics_v(spark, sf)
    return metrics.unmatched(rows.where("data_sample_num > 1"), _lookup(rows), MK)


@query(f"select cast(coalesce(sum(c), 0) as bigint) as n from (select count(*) c from metrics_v group by {MKS} having count(*) > 1)")
def metrics_duplicates(spark, sf):
    return metrics.duplicated(fx.metrics_v(spark, sf), MK)


@query(f"select count(*) as n from (select distinct {SC} from metrics_v)")
def metrics_scenarios(spark, sf):
    return fx.metrics_v(spark, sf).select(*metrics.SCENARIO).distinct().agg(F.count("*").alias("n"))


@query("select event_id, round(number_of_points_scanned - result_size / 5e3, 6) as false_positives, round(number_of_points_scanned * 1e2 / 8e6, 9) as scanned_percent, round(query_latency / nullif(cast(number_of_points_scanned as double), 0e0), 6) as latency_per_point from metrics_v")
def metrics_access_stats(spark, sf):
    rows = metrics.access_stats(fx.metrics_v(spark, sf), 8_000_000)
    return rows.select("event_id", F.round("false_positives", 6).alias("false_positives"), F.round("scanned_percent", 9).alias("scanned_percent"), F.round("latency_per_point", 6).alias("latency_per_point"))


@query("with d as (select disk_backed_query_latency / nullif(query_latency, 0e0) as delay from metrics_v) select cast(floor((round(delay, 6) - 1e0) / 0.1e0 + 1e-9) as bigint) as bin, count(*) as n from d where delay > 1 and delay < 7 group by 1")
def metrics_disk_delay_hist(spark, sf):
    return metrics.histogram(metrics.disk_delay(fx.metrics_v(spark, sf)).withColumn("delay", F.round("delay", 6)), "delay", 1.0, 0.1)


PREDICTED = f"with {RANKED}, v as (select model, rank = 1 or model = 'view' as hit, query_latency / nullif(best, 0e0) as regret, query_entropy_id as leaf from r where rank <= 5)"


def _predictions(spark, sf):
    rows = metrics.ranked(fx.metrics_v(spark, sf), "query_latency").where("rank <= 5")
    return rows.select("model", ((F.col("rank") == 1) | (F.col("model") == "view")).alias("hit"), F.col("ratio").alias("regret"), F.col("query_entropy_id").alias("leaf"))


@query(
    PREDICTED
    + """ select count(*) as scenarios, round(avg(hit::int), 6) as hit_rate, round(avg(regret), 6) as mean_regret, round(median(regret), 6) as median_regret, round(quantile_cont(regret, 0.9), 6) as p90_regret,
    round(max(regret), 6) as max_regret, round(avg((regret <= 1.1e0)::int), 6) as within_10, round(avg((regret <= 1.5e0)::int), 6) as within_50, count(distinct leaf) as leaves from v"""
)
def metrics_validation_summary(spark, sf):
    return _rounded(metrics.validation_summary(_predictions(spark, sf)))


@query(
    PREDICTED
    + """ select v.leaf, count(*) as support, round(avg(hit::int), 6) as hit_rate, round(avg(regret), 6) as mean_regret, any_value(models) as models from v
    join (select leaf, string_agg(m, ', ' order by m) as models from (select leaf, model || '=' || count(*) as m from v group by leaf, model) group by leaf) t on t.leaf = v.leaf group by v.leaf"""
)
def metrics_leaf_summary(spark, sf):
    return _rounded(metrics.leaf_summary(_predictions(spark, sf)))


@query(
    f"""with {RANKED}, u as (select model, query_entropy_id as leaf, rank, query_latency / nullif(best, 0e0) as ratio, rank <= 3 or query_latency / nullif(best, 0e0) <= 1.5e0 as useful from r),
    a as (select model, leaf, count(*) as support, count(*) filter (useful) as hits, round(avg(rank) filter (useful), 6) as mean_rank, round(avg(ratio) filter (useful), 6) as mean_ratio from u group by all),
    b as (select *, hits / nullif(sum(hits) over (partition by model), 0) as coverage, hits / support as "precision" from a)
    select model, leaf, support, hits, mean_rank, mean_ratio, round(coverage, 6) as coverage, round("precision", 6) as "precision" from (select *, row_number() over (partition by model order by "precision" desc, coverage desc, support desc, leaf) p from b) where p <= 2"""
)
def metrics_rule_quality(spark, sf):
    rows = metrics.usefulness(metrics.ranked(fx.metrics_v(spark, sf), "query_latency")).withColumn("leaf", F.col("query_entropy_id"))
    return _rounded(metrics.top_rules(metrics.rule_quality(rows, "leaf"), 2))


@query(
    """select row_number() over (order by a, b, c, d, e) as task_id, a as data_entropy_id, b as sample_num, c as block_size, d as selectivity, e as query_entropy_id
    from (select unnest([1, 2]) a), (select unnest([1, 2, 3]) b), (select unnest([128, 512]) c), (select unnest(['01024', '04096']) d), (select unnest([1, 2]) e)"""
)
def task_matrix(spark, sf):
    return sources.task_matrix(spark, [1, 2], [1, 2, 3], [128, 512], ["01024", "04096"], [1, 2])


@query(
    """with t as (select model, sel_tag, 'memory' as type, query_latency as latency from metrics_v union all select model, sel_tag, 'disk', disk_backed_query_latency from metrics_v)
    select model, sel_tag, type, round(avg(latency) / 1e6, 9) as latency from t group by all"""
)
def metrics_mean_ms_by_type(spark, sf):
    return _rounded(metrics.means(metrics.by_type(fx.metrics_v(spark, sf)), ["model", "sel_tag", "type"], ["latency"], 1e-6), 9)


@query("select sel_tag, model, round(avg(disk_backed_query_latency), 6) as latency from metrics_v group by all")
def metrics_mean_by_selectivity(spark, sf):
    return _rounded(metrics.means(metrics.by_type(fx.metrics_v(spark, sf)).where("type = 'disk'"), ["sel_tag", "model"], ["latency"]))


BLOCKS = "cast(ceil(number_of_points_scanned / (block_size * 1e0)) as bigint)"


@query(
    f"""with b as (select *, {BLOCKS} as blocks, number_of_points_scanned - result_size / 5e3 as fp from metrics_v)
    select event_id, fp * 1e2 / 8e6 as percent_false_positives, blocks * 1e2 / (8e6 / block_size) as percent_num_blocks,
    (query_latency - refinement_latency) / result_size as scan_latency_per_point, refinement_latency / nullif(blocks, 0) as refinement_latency_per_block from b"""
)
def metrics_block_stats(spark, sf):
    rows = fx.metrics_v(spark, sf).withColumns({"number_of_refined_blocks": F.expr(BLOCKS), "avg_block_size": F.col("block_size"), "scan_latency": F.col("query_latency") - F.col("refinement_latency")})
    found = metrics.block_stats(metrics.access_stats(rows, 8_000_000), 8_000_000)
    return found.select("event_id", "percent_false_positives", "percent_num_blocks", "scan_latency_per_point", "refinement_latency_per_block")


ORDERED = ["view", "purchase", "signup", "error", "login", "logout", "search"]


@query(
    f"""with s as (select model, {SC}, avg(build_time) as build, avg(query_latency) as m, avg(disk_backed_query_latency) as d from metrics_v group by all),
    j as (select a.model, a.build, a.build - b.build as dearer, b.m - a.m as gm, b.d - a.d as gd from s a join s b using ({SC}) where b.model = 'click' and a.model <> 'click'),
    g as (select model, round_even(avg(build), 1) as build_time, round_even(round_even(avg((dearer < 0)::int), 1), 0) > 0.5 as built, round_even(round_even(avg((gm > 0)::int), 1), 0) > 0.5 as sm, round_even(round_even(avg((gd > 0)::int), 1), 0) > 0.5 as sd,
    format('{{:.1e}}', abs(round_even(avg(1e9 * dearer / nullif(gm, 0e0)), 1))) as qm, format('{{:.1e}}', abs(round_even(avg(1e9 * dearer / nullif(gd, 0e0)), 1))) as qd from j group by model),
    t as (select *, split_part(qm, 'e', 1) || 'e' || cast(cast(split_part(qm, 'e', 2) as int) as varchar) as lm, split_part(qd, 'e', 1) || 'e' || cast(cast(split_part(qd, 'e', 2) as int) as varchar) as ld from g)
    select model, cast(list_position({ORDERED}, model) as bigint) as place, build_time, case when built and sm then '(+)' when built then '(-)' || lm when sm then '(+)' || lm else '(-)' end as memory,
    case when built and sd then '(+)' when built then '(-)' || ld when sd then '(+)' || ld else '(-)' end as disk from t where list_position({ORDERED}, model) > 0"""
)
def metrics_redemption_report(spark, sf):
    return metrics.redemption_report(fx.metrics_v(spark, sf), "click", metrics.SCENARIO, ORDERED)


@query(
    """with t as (select dataset_entropy_id, dataset_entropy_id * 2e0 + (event_id % 10) * 0.05e0 as e from metrics_v where data_sample_num = 1), a as (select dataset_entropy_id, event_id % 13 * 1e0 as e from metrics_v where data_sample_num > 1),
    r as (select dataset_entropy_id, min(e) as low, max(e) as high, count(*) as n from t group by 1), c as (select dataset_entropy_id, count(*) as asked from a group by 1), b as (select min(e) as l, max(e) as h from t)
    select dataset_entropy_id, low, high, n, coalesce(asked, 0) as asked, (select count(*) from a, b where e < l) as below, (select count(*) from a, b where e > h) as above from r full join c using (dataset_entropy_id)"""
)
def metrics_entropy_ranges(spark, sf):
    rows = fx.metrics_v(spark, sf)
    training = rows.where("data_sample_num = 1").select("dataset_entropy_id", (F.col("dataset_entropy_id") * 2.0 + (F.col("event_id") % 10) * 0.05).alias("dataset_entropy"))
    asked = rows.where("data_sample_num > 1").select("dataset_entropy_id", (F.col("event_id") % 13 * 1.0).alias("dataset_entropy"))
    return metrics.entropy_ranges(training, asked)


MODELS = f"m as (select {SC}, model, min(query_latency) as q, min(disk_backed_query_latency) as d from metrics_v group by all), p as (select *, row_number() over (partition by {SC} order by q, model) as place, row_number() over (partition by {SC} order by d, model) = 1 as actual from m)"


@query(f"with {MODELS}, h as (select {SC}, max((actual and place <= 2)::int) as hit from p group by all) select round(avg(hit), 9) as accuracy, count(*) as cases from h")
def metrics_top_k_accuracy(spark, sf):
    models = fx.metrics_v(spark, sf).groupBy(*metrics.SCENARIO, "model").agg(F.min("query_latency").alias("q"), F.min("disk_backed_query_latency").alias("d"))
    best = F.row_number().over(Window.partitionBy(*metrics.SCENARIO).orderBy("d", "model")) == 1
    return _rounded(metrics.top_k_accuracy(models.select(F.struct(*metrics.SCENARIO).alias("case"), F.col("model").alias("label"), (-F.col("q")).alias("score"), best.alias("actual")), 2), 9)


@query(f"with {RANKED}, l as (select query_entropy_id, avg((rank = 1)::int) as accuracy, count(*) as n from r where rank <= 3 group by 1) select round(sum(accuracy * n) / sum(n), 9) as mean from l")
def metrics_weighted_accuracy(spark, sf):
    rows = metrics.ranked(fx.metrics_v(spark, sf), "query_latency").where("rank <= 3")
    leaves = rows.groupBy("query_entropy_id").agg(F.avg((F.col("rank") == 1).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return _rounded(metrics.weighted_mean(leaves, "accuracy", "n"), 9)


@query("select event_id, model, cast(dense_rank() over (partition by model order by build_time) - 1 as int) as place from metrics_v")
def metrics_dense_place(spark, sf):
    return metrics.dense_place(fx.metrics_v(spark, sf), "build_time", ["model"]).select("event_id", "model", "place")


@query("with n as (select event_id, nullif(block_size, 64) as block_size, nullif(sel_tag, 256) as sel_tag from metrics_v) select count(*) filter (block_size is not null) as by_block, count(*) filter (block_size is not null and sel_tag is not null) as by_all from n")
def metrics_null_drop(spark, sf):
    rows = fx.metrics_v(spark, sf).select("event_id", F.nullif("block_size", F.lit(64)).alias("block_size"), F.nullif("sel_tag", F.lit(256)).alias("sel_tag"))
    return rows.na.drop(subset=["block_size"]).agg(F.count("*").alias("by_block")).crossJoin(rows.na.drop().agg(F.count("*").alias("by_all")))


@query(
    """with c as (select model as rule, min(block_size) as low, cast(null as int) as high from metrics_v where data_sample_num = 1 group by 1 union all select model, null, max(block_size) from metrics_v where data_sample_num = 2 and block_size < 4096 group by 1),
    s as (select rule, list_filter([32, 64, 128, 256, 512, 1024, 2048, 4096], lambda v: (low is null or v > low) and (high is null or v <= high)) as l from c),
    f as (select rule, unnest(l) as v from s), k as (select rule, v from f group by all having count(*) = 2) select rule, string_agg(v, ',' order by v) as allowed from k group by rule"""
)
def metrics_allowed_values(spark, sf):
    rows = fx.metrics_v(spark, sf)
    low = rows.where("data_sample_num = 1").groupBy(F.col("model").alias("rule")).agg(F.min("block_size").alias("low"), F.lit(None).cast("int").alias("high"))
    high = rows.where("data_sample_num = 2 and block_size < 4096").groupBy(F.col("model").alias("rule")).agg(F.lit(None).cast("int").alias("low"), F.max("block_size").alias("high"))
    return metrics.allowed_values(low.unionByName(high), [32, 64, 128, 256, 512, 1024, 2048, 4096]).select("rule", F.array_join(F.col("allowed").cast("array<string>"), ",").alias("allowed"))


@query(
    f"""with {STR}, per_window as (select w.qid, count(b.block_id) as blocks, coalesce(sum(b.n), 0) as scanned from win_orders w left join meta b on b.x_lo < w.hx and b.x_hi >= w.lx and b.y_lo < w.hy and b.y_hi >= w.ly group by w.qid)
    select cast(sum(blocks) as bigint) as blocks, cast(sum(scanned) as bigint) as scanned, avg(blocks) as avg_blocks, avg(scanned) as avg_scanned from per_window"""
)
def workload_averages(spark, sf):
    p, w = both(spark, sf)
    return layouts.workload_averages(layouts.scan_metrics(layouts.str_tree(p, BLOCK), w))


# --- recommendation

ENTROPY = "k as (select dataset_entropy_id, dataset_entropy_id * 2e0 + (event_id % 10) * 0.05e0 as dataset_entropy from metrics_v)"


@query(
    f"""with {ENTROPY}, m as (select dataset_entropy_id as id, avg(dataset_entropy) as m from k group by 1),
    b as (select id, coalesce((lag(m) over (order by m, id) + m) / 2, '-infinity'::double) as low, coalesce((lead(m) over (order by m, id) + m) / 2, 'infinity'::double) as high from m),
    q as (select event_id, event_id % 13 * 1e0 as dataset_entropy from metrics_v) select event_id, b.id as remapped_id from q left join b on dataset_entropy >= low and dataset_entropy < high"""
)
def entropy_remap(spark, sf):
    rows = fx.metrics_v(spark, sf)
    known = rows.select("dataset_entropy_id", (F.col("dataset_entropy_id") * 2.0 + (F.col("event_id") % 10) * 0.05).alias("dataset_entropy"))
    asked = rows.select("event_id", (F.col("event_id") % 13 * 1.0).alias("dataset_entropy"))
    return recommend.remap_entropy(asked, recommend.entropy_bounds(known)).select("event_id", "remapped_id")


@query()
def dt_recommend(spark, sf):
    rows = metrics.ranked(fx.metrics_v(spark, sf), "query_latency")
    model = recommend.fit_tree(recommend.training_rows(rows))
    return recommend.recommend(model, rows.select(*metrics.SCENARIO).distinct())


def _rules_sql() -> str:
    sets = [(f,) for f in recommend.FEATURES] + list(combinations(recommend.FEATURES, 2))
    named = lambda s: " || ' and ' || ".join(f"'{f}=' || {f}" for f in s)
    each = " union all ".join(f"select model, {named(s)} as rule, count(*) as support, count(*) filter (useful) as hits, avg(rank) filter (useful) as mean_rank, avg(ratio) filter (useful) as mean_ratio from u group by model, {', '.join(s)}" for s in sets)
    return f"""with {RANKED}, u as (select *, query_latency / nullif(best, 0e0) as ratio, rank <= 3 or query_latency / nullif(best, 0e0) <= 1.5e0 as useful from r),
    w as (select model, count(*) as n, count(*) filter (useful) as h, avg(rank) as all_rank, avg(ratio) as all_ratio from u group by model), c as ({each}),
    k as (select c.*, row_number() over (partition by model order by hits / support desc, hits / h desc, support desc, rule) as p from c join w using (model) where h between 1 and n - 1 and hits > 0 and support >= least(5, greatest(2, n // 10)))
    select model, coalesce(rule, case when h = 0 then 'No useful region found' when h = n then 'All measured scenarios' else 'No compact positive rule found' end) as rule,
    round(case when rule is not null then hits / support when h > 0 and h = n then 1e0 else 0e0 end, 6) as "precision", round(case when rule is not null then hits / h when h > 0 and h = n then 1e0 else 0e0 end, 6) as coverage,
    case when rule is not null then support when h = n then n else 0 end as support, round(case when rule is null and h > 0 and h = n then all_rank else mean_rank end, 6) as mean_rank,
    round(case when rule is null and h > 0 and h = n then all_ratio else mean_ratio end, 6) as mean_ratio, h as useful_scenarios, n as total_scenarios
    from w left join (select * from k where p <= 3) using (model)"""


@query(_rules_sql())
def usefulness_rules(spark, sf):
    return _rounded(recommend.usefulness_rules(metrics.usefulness(metrics.ranked(fx.metrics_v(spark, sf), "query_latency"))))


__all__ = ["QUERIES", "SQL", "morton"]
