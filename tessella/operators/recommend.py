"""Recommendation of a model for a scenario: decision trees, usefulness rules, entropy remapping."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["dataset_entropy_id", "query_entropy_id", "sel_tag"]


def training_rows(ranked: DataFrame, k: int = 3, latency: str = "query_latency") -> DataFrame:
    """The first k rows of each scenario, with weight (1 / ratio)^2 times the balance n / (classes * n of the class).

    Where the best latency is 0 and so no ratio is known, rows as quick as the best weigh 1 and slower ones, infinitely far off, 0.
    """
    known = 1 / (F.col("ratio") * F.col("ratio"))
    top = ranked.where(F.col("rank") <= k).withColumn("w", F.when(F.col("ratio").isNotNull(), known).otherwise((F.col(latency) <= F.col("best")).cast("double")))
    sizes = top.groupBy("model").agg(F.count("*").alias("n_class"))
    totals = sizes.agg(F.count("*").alias("classes"), F.sum("n_class").alias("n"))
    balanced = top.join(F.broadcast(sizes), "model").crossJoin(F.broadcast(totals))
    return balanced.withColumn("weight", F.col("w") * F.col("n") / (F.col("classes") * F.col("n_class"))).drop("w", "n", "classes", "n_class")


def fit_tree(rows: DataFrame, features: list[str] = FEATURES, depth: int = 4, least: int = 5, seed: int = 42):
    """A pipeline that predicts the model; entropy splits, at most depth 4, five rows a leaf."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol="model", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="features", weightCol="weight", impurity="entropy", maxDepth=depth, minInstancesPerNode=least, seed=seed)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="features"), tree, back]).fit(rows)


def recommend(model, scenarios: DataFrame) -> DataFrame:
    return model.stages[1].transform(scenarios).transform(model.stages[2].transform).transform(model.stages[3].transform).drop("features", "rawPrediction", "probability", "prediction")


def usefulness_rules(useful: DataFrame, features: list[str] = FEATURES, least: int = 5, n: int = 3) -> DataFrame:
    """model, rule, precision, coverage, support, mean_rank, mean_ratio (of the useful rows), useful_scenarios, total_scenarios: the best
    n conditions on one or two features for each model, with a useful row each and a support of `least`, or for models of
    fewer than 10 * least rows a tenth of these, 2 at least.

    All conditions "value of a feature" and "values of two features" are counted at once, which replaces a search by shallow
    trees with an exhaustive one. A model whose rows are all useful, or none, or that has no such condition, gets one row that says so.
    """
    measures = [F.count("*").alias("support"), F.count_if("useful").alias("hits"), F.avg(F.when(F.col("useful"), F.col("rank"))).alias("mean_rank"), F.avg(F.when(F.col("useful"), F.col("ratio"))).alias("mean_ratio")]
    sets = [(f,) for f in features] + list(combinations(features, 2))
    parts = [useful.groupBy("model", *s).agg(*measures).select("model", F.concat_ws(" and ", *(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in s)).alias("rule"), "support", "hits", "mean_rank", "mean_ratio") for s in sets]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    whole = useful.groupBy("model").agg(F.count("*").alias("total_scenarios"), F.count_if("useful").alias("useful_scenarios"), F.avg("rank").alias("all_rank"), F.avg("ratio").alias("all_ratio"))
    mixed = whole.where((F.col("useful_scenarios") > 0) & (F.col("useful_scenarios") < F.col("total_scenarios")))
    enough = F.least(F.lit(least), F.greatest(F.lit(2), F.floor(F.col("total_scenarios") / 10)))
    scored = every.join(F.broadcast(mixed.select("model", "total_scenarios", "useful_scenarios")), "model").where((F.col("support") >= enough) & (F.col("hits") > 0))
    scored = scored.select("model", "rule", (F.col("hits") / F.col("support")).alias("precision"), (F.col("hits") / F.col("useful_scenarios")).alias("coverage"), "support", "mean_rank", "mean_ratio")
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("precision"), F.desc("coverage"), F.desc("support"), "rule"))
    best = scored.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")
    none, full = F.col("useful_scenarios") == 0, F.col("useful_scenarios") == F.col("total_scenarios")
    share = F.when(full & ~none, 1.0).otherwise(0.0)
    said = F.when(none, "No useful region found").when(full, "All measured scenarios").otherwise("No compact positive rule found")
    return whole.join(best, "model", "left").select(
        "model",
        F.coalesce("rule", said).alias("rule"),
        F.coalesce("precision", share).alias("precision"),
        F.coalesce("coverage", share).alias("coverage"),
        F.coalesce("support", F.when(full, F.col("total_scenarios")).otherwise(0)).alias("support"),
        F.when(F.col("rule").isNull() & full & ~none, F.col("all_rank")).otherwise(F.col("mean_rank")).alias("mean_rank"),
        F.when(F.col("rule").isNull() & full & ~none, F.col("all_ratio")).otherwise(F.col("mean_ratio")).alias("mean_ratio"),
        "useful_scenarios",
        "total_scenarios",
    )


def entropy_bounds(known: DataFrame) -> DataFrame:
    """id, low, high: half-open ranges of entropy between the midpoints of neighbouring ids' means."""
    means = known.groupBy(F.col("dataset_entropy_id").alias("id")).agg(F.avg("dataset_entropy").alias("m"))
    by = Window.orderBy("m", "id")  # a row per id: a handful
    return means.select("id", F.coalesce((F.lag("m").over(by) + F.col("m")) / 2, F.lit(float("-inf"))).alias("low"), F.coalesce((F.lead("m").over(by) + F.col("m")) / 2, F.lit(float("inf"))).alias("high"))


def remap_entropy(rows: DataFrame, bounds: DataFrame, column: str = "dataset_entropy") -> DataFrame:
    """rows with remapped_id: the id in whose range the entropy falls."""
    hit = (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high"))
    return rows.join(F.broadcast(bounds), hit, "left").withColumnRenamed("id", "remapped_id").drop("low", "high")
