"""Metric rows of experiments: preparation, best settings, rankings, trade-offs, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a configuration's measurements are averaged over, and what they are averaged to.
RUN = ["block_size", "model", "data_sample_num", "dataset_entropy_id", "query_entropy_id", "sel_tag"]
SCENARIO = ["dataset_entropy_id", "query_entropy_id", "sel_tag"]
CONFIGURATION = ["model", "data_sample_num", *SCENARIO]
LATENCY = {"memory": "query_latency", "disk": "disk_backed_query_latency"}
#: Windows behind a row's result size, and points behind a target, in the compatible constants.
QUERIES, TARGET = 5000, 8.0 * 10e4


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def derive(rows: DataFrame, n_queries: int = QUERIES) -> DataFrame:
    """Rows as read with the derived columns; selectivity becomes a percentage."""
    return rows.withColumns(
        {
            "avg_block_size": F.get("block_size_quantiles", F.lit(5)),
            "type": F.lit("memory"),
            "scan_latency": F.col("query_latency") - F.col("refinement_latency"),
            "disk_backed_scan_latency": F.col("disk_backed_query_latency") - F.col("refinement_latency"),
            "query_latency_per_point": ratio(F.col("query_latency") * F.lit(float(n_queries)), F.col("result_size").cast("double")),
            "disk_backed_query_latency_per_point": ratio(F.col("disk_backed_query_latency") * F.lit(float(n_queries)), F.col("disk_backed_result_size").cast("double")),
            "sel_tag": F.col("selectivity").cast("int"),
            "selectivity": F.col("selectivity").cast("int") / F.lit(10000.0),
        }
    )


def prepare(rows: DataFrame, keys: list[str] = RUN, n_queries: int = QUERIES, target: float = TARGET) -> DataFrame:
    """Means of the numeric columns over repeated runs, with the target and how far the results miss it."""
    numeric = [c for c, kind in rows.dtypes if c not in keys and kind in ("int", "bigint", "double", "float")]
    means = rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in numeric))
    wanted = F.lit(target) * F.col("sel_tag") / F.lit(10000.0)
    return means.withColumn("target", wanted).withColumn("difference_from_target", ratio(F.col("target") - F.col("result_size") / F.lit(float(n_queries)), F.col("target")))


def best_setting(prepared: DataFrame, latency: str, keys: list[str] = CONFIGURATION) -> DataFrame:
    """The row of the smallest latency in each group; ties go to the smaller block size."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(latency, "block_size"))
    return prepared.withColumn("_p", place).where("_p = 1").drop("_p")


def measurable_best(prepared: DataFrame, latency: str) -> DataFrame:
    """The best block size of each model and scenario by the mean over data samples."""
    means = prepared.groupBy("block_size", "model", *SCENARIO).agg(F.avg(latency).alias(latency))
    return best_setting(means, latency, ["model", *SCENARIO])


def best_and_average(best: DataFrame, average: DataFrame, sel_tag: int) -> DataFrame:
    """Rows of one selectivity from both, tagged, with all columns of either."""
    tagged = lambda d, tag: d.where(F.col("sel_tag") == sel_tag).withColumn("choice", F.lit(tag))
    return tagged(best, "best").unionByName(tagged(average, "average"), allowMissingColumns=True)


def means(rows: DataFrame, keys: list[str], columns: list[str], scale: float = 1.0) -> DataFrame:
    return rows.groupBy(*keys).agg(*((F.avg(c) * F.lit(scale)).alias(c) for c in columns))


def access_stats(rows: DataFrame, n_points: int, n_queries: int = QUERIES) -> DataFrame:
    """False positives and their shares, and latencies per point and block."""
    hits = F.col("result_size") / F.lit(float(n_queries))
    return rows.withColumns(
        {
            "false_positives": F.col("number_of_points_scanned") - hits,
            "scanned_percent": F.col("number_of_points_scanned") * F.lit(100.0) / F.lit(float(n_points)),
            "latency_per_point": ratio(F.col("query_latency"), F.col("number_of_points_scanned").cast("double")),
        }
    )


def disk_delay(rows: DataFrame, low: float = 1.0, high: float = 7.0) -> DataFrame:
    """delay: disk over memory latency, strictly between the bounds."""
    return rows.withColumn("delay", ratio(F.col("disk_backed_query_latency"), F.col("query_latency"))).where((F.col("delay") > low) & (F.col("delay") < high))


def histogram(rows: DataFrame, column: str, low: float, width: float) -> DataFrame:
    return rows.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width) + F.lit(1e-9)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def build_time_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.avg("build_time").alias("mean"), F.stddev_samp("build_time").alias("spread"))


def redemption(rows: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """queries: how many queries pay a model's extra build time back against the base model, mean over the scenarios that have the base;
    dearer and faster: whether most scenarios build longer and answer sooner."""
    of_base = rows.where(F.col("model") == base).groupBy(*keys).agg(F.avg("build_time").alias("b_build"), F.avg("query_latency").alias("b_latency"))
    each = rows.where(F.col("model") != base).groupBy("model", *keys).agg(F.avg("build_time").alias("build"), F.avg("query_latency").alias("latency")).join(of_base, keys)
    build, gain = F.col("build") - F.col("b_build"), F.col("b_latency") - F.col("latency")
    return each.withColumn("q", F.lit(1e9) * ratio(build, gain)).groupBy("model").agg(F.avg("q").alias("queries"), (F.avg((build > 0).cast("int")) >= 0.5).alias("dearer"), (F.avg((gain > 0).cast("int")) >= 0.5).alias("faster"), F.count("*").alias("scenarios"))


def change_table(rows: DataFrame, value: str, ids: list[int]) -> DataFrame:
    """Mean value by query entropy (rows, highest first) and data entropy (columns e1 ...), as percent change against the last row's first column."""
    table = rows.groupBy("query_entropy_id").pivot("dataset_entropy_id", ids).agg(F.avg(value))
    base = table.agg(F.min_by(F.col(str(ids[0])), "query_entropy_id").alias("_base"))
    return table.crossJoin(F.broadcast(base)).select("query_entropy_id", *((ratio(F.col(str(i)) - F.col("_base"), F.col("_base")) * 100.0).alias(f"e{i}") for i in ids))


def ranked(rows: DataFrame, latency: str, keys: list[str] = SCENARIO) -> DataFrame:
    """best, ratio and rank within each scenario, ties by model, block size and sample."""
    group = Window.partitionBy(*keys)
    order = [c for c in ("model", "block_size", "data_sample_num", "event_id") if c in rows.columns]
    return rows.withColumn("best", F.min(latency).over(group)).withColumn("ratio", ratio(F.col(latency), F.col("best"))).withColumn("rank", F.row_number().over(group.orderBy(latency, *order)))


def usefulness(ranked_rows: DataFrame, k: int = 3, near: float = 1.5) -> DataFrame:
    """useful: among the first k, or within `near` times the best; weight: the inverse square of the ratio."""
    return ranked_rows.withColumn("useful", (F.col("rank") <= k) | (F.col("ratio") <= near)).withColumn("weight", ratio(F.lit(1.0), F.col("ratio") * F.col("ratio")))


#: Scenario classes: entropy ids in three steps, selectivity tags in three.
ENTROPY_CLASS = {2: 1, 4: 5}
SELECTIVITY_CLASS = {64: 1, 256: 1, 1024: 2, 4096: 3, 16384: 3}


def classed(rows: DataFrame) -> DataFrame:
    """Entropy ids 1 and 2 are 2, 4 and 5 are 4; selectivity tags fall in three classes."""
    entropy = lambda c: F.when(F.col(c) == 1, 2).when(F.col(c) == 5, 4).otherwise(F.col(c)).cast("int")
    selectivity = F.create_map(*(F.lit(v) for pair in SELECTIVITY_CLASS.items() for v in pair))
    return rows.withColumns({"dataset_entropy_id": entropy("dataset_entropy_id"), "query_entropy_id": entropy("query_entropy_id"), "sel_class": F.try_element_at(selectivity, F.col("sel_tag"))})


def at_known_best(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose block size is the lookup's for their keys; matched tells whether the lookup has the keys at all."""
    known = lookup.select(*keys, F.col("block_size").alias("_known"), F.lit(True).alias("_has"))
    return rows.join(known, keys, "left").withColumn("matched", F.coalesce("_has", F.lit(False))).where(~F.col("matched") | (F.col("block_size") == F.col("_known"))).drop("_known", "_has")


def unmatched(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct().join(lookup.select(*keys).distinct(), keys, "left_anti")


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n: rows whose keys occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n"))


def validation_summary(predictions: DataFrame) -> DataFrame:
    """Hit rates and regret of predictions (hit, regret = ratio of the predicted model, leaf)."""
    r = F.col("regret")
    return predictions.agg(
        F.count("*").alias("scenarios"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg(r).alias("mean_regret"), F.median(r).alias("median_regret"), F.percentile(r, F.lit(0.9)).alias("p90_regret"), F.max(r).alias("max_regret"),
        F.avg((r <= 1.1).cast("int")).alias("within_10"), F.avg((r <= 1.5).cast("int")).alias("within_50"), F.count_distinct("leaf").alias("leaves"),
    )


def leaf_summary(predictions: DataFrame) -> DataFrame:
    """Per leaf: support, hit rate, mean regret and the actual models as model=count, by name."""
    counts = predictions.groupBy("leaf", "model").agg(F.count("*").alias("n"))
    texts = counts.groupBy("leaf").agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.concat("model", F.lit("="), F.col("n").cast("string"))))).alias("models"))
    return predictions.groupBy("leaf").agg(F.count("*").alias("support"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("regret").alias("mean_regret")).join(texts, "leaf")


def rule_quality(useful_rows: DataFrame, leaf: str) -> DataFrame:
    """precision, coverage and support of calling a model useful in a leaf, with mean rank and ratio of its useful rows."""
    total = Window.partitionBy("model")
    of = useful_rows.groupBy("model", leaf).agg(F.count("*").alias("support"), F.count_if("useful").alias("hits"), F.avg(F.when(F.col("useful"), F.col("rank"))).alias("mean_rank"), F.avg(F.when(F.col("useful"), F.col("ratio"))).alias("mean_ratio"))
    return of.withColumn("coverage", ratio(F.col("hits").cast("double"), F.sum("hits").over(total).cast("double"))).withColumn("precision", F.col("hits") / F.col("support"))


def top_rules(rules: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("model").orderBy(F.desc("precision"), F.desc("coverage"), F.desc("support"), *(c for c in rules.columns if c.endswith("leaf")))
    return rules.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= n).drop("_p")


def scientific(c: Column) -> Column:
    """The absolute value as mantissa and exponent of ten."""
    text = F.format_string("%.1e", F.abs(c))
    return F.concat(F.regexp_extract(text, r"^([^e]+)", 1), F.lit("e"), F.regexp_extract(text, r"e(.+)$", 1).cast("int").cast("string"))


def by_type(rows: DataFrame) -> DataFrame:
    """Two rows for each: type memory or disk, with the latency of that type."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("type"), F.col(column).alias("latency")) for kind, column in LATENCY.items()))
    return rows.select("*", F.inline(kinds))


def block_stats(rows: DataFrame, n_points: int) -> DataFrame:
    """Shares of the points and blocks (number_of_refined_blocks, avg_block_size) in percent, and latencies per point and per block."""
    blocks = F.col("number_of_refined_blocks").cast("double")
    return rows.withColumns(
        {
            "percent_false_positives": F.col("false_positives") * F.lit(100.0) / F.lit(float(n_points)),
            "percent_num_blocks": ratio(blocks * F.lit(100.0), F.lit(float(n_points)) / F.col("avg_block_size")),
            "scan_latency_per_point": ratio(F.col("scan_latency"), F.col("result_size").cast("double")),
            "refinement_latency_per_block": ratio(F.col("refinement_latency"), blocks),
        }
    )


def redemption_report(rows: DataFrame, base: str, keys: list[str], order: list[str]) -> DataFrame:
    """model, build_time, memory, disk: after how many queries a model's build time is paid back against the base model, as labels.

    Each scenario (keys) counts once; models outside `order` go. A label is (+) for a model that builds and answers sooner, (-) for one
    that does neither, and else has the number of queries behind the sign of answering sooner. Majorities are means of yes and
    no, rounded to even at one and then no digit.
    """
    each = rows.groupBy("model", *keys).agg(*(F.avg(c).alias(c) for c in ("build_time", *LATENCY.values())))
    of_base = each.where(F.col("model") == base).select(*keys, *(F.col(c).alias(f"base_{c}") for c in ("build_time", *LATENCY.values())))
    joined = each.where(F.col("model") != base).join(of_base, keys)
    dearer = F.col("build_time") - F.col("base_build_time")
    gain = {kind: F.col(f"base_{c}") - F.col(c) for kind, c in LATENCY.items()}
    of = [x for kind, g in gain.items() for x in (F.avg((g > 0).cast("int")).alias(f"{kind}_sooner"), F.avg(F.lit(1e9) * ratio(dearer, g)).alias(f"{kind}_queries"))]
    means = joined.groupBy("model").agg(F.avg("build_time").alias("build_time"), F.avg((dearer < 0).cast("int")).alias("built_sooner"), *of)
    told = means.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("model"))).na.drop(subset=["model"]).where("place > 0")
    most = lambda c: F.bround(F.bround(c, 1), 0) > 0.5

    def label(kind: str) -> Column:
        built, sooner, queries = most("built_sooner"), most(f"{kind}_sooner"), scientific(F.bround(f"{kind}_queries", 1))
        return F.when(built & sooner, "(+)").when(built, F.concat(F.lit("(-)"), queries)).when(sooner, F.concat(F.lit("(+)"), queries)).otherwise("(-)")

    return told.select("model", "place", F.bround("build_time", 1).alias("build_time"), *(label(kind).alias(kind) for kind in LATENCY))


def entropy_ranges(training: DataFrame, asked: DataFrame) -> DataFrame:
    """dataset_entropy_id, low, high, n of the training rows, asked rows by id, and how many asked rows lie below or above all training rows."""
    ranges = training.groupBy("dataset_entropy_id").agg(F.min("dataset_entropy").alias("low"), F.max("dataset_entropy").alias("high"), F.count("*").alias("n"))
    bounds = training.agg(F.min("dataset_entropy").alias("_low"), F.max("dataset_entropy").alias("_high"))
    outside = asked.crossJoin(F.broadcast(bounds)).agg(F.count_if(F.col("dataset_entropy") < F.col("_low")).alias("below"), F.count_if(F.col("dataset_entropy") > F.col("_high")).alias("above"))
    counts = asked.groupBy("dataset_entropy_id").agg(F.count("*").alias("asked"))
    return ranges.join(counts, "dataset_entropy_id", "full").withColumn("asked", F.coalesce("asked", F.lit(0)).cast("bigint")).crossJoin(F.broadcast(outside))


def top_k_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """accuracy: the share of cases (case, label, score, actual) of which the actual label is among the k of the highest scores, ties by label."""
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), "label"))
    hit = scored.withColumn("place", place).groupBy("case").agg(F.max((F.col("actual") & (F.col("place") <= k)).cast("int")).alias("hit"))
    return hit.agg(F.avg("hit").alias("accuracy"), F.count("*").alias("cases"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")).alias("mean"))


def dense_place(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """place: dense rank from 0 within the keys."""
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(column)) - 1)


def allowed_values(conditions: DataFrame, values: list[int]) -> DataFrame:
    """rule, allowed: the values that all conditions (rule, low, high: low < value <= high, null is open) of a rule leave, in order."""
    every = F.array(*map(F.lit, sorted(values)))
    left = conditions.select("rule", F.filter(every, lambda v: F.coalesce(v > F.col("low"), F.lit(True)) & F.coalesce(v <= F.col("high"), F.lit(True))).alias("left"))
    return left.groupBy("rule").agg(F.collect_set("left").alias("sets")).select("rule", F.array_sort(F.aggregate("sets", every, F.array_intersect)).alias("allowed"))
