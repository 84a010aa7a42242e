"""Scene classification with a forest or boosted trees, and its evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EUROSAT_TO_COARSE
from ..session import materialise
from . import boosting
from .boosting import BoostedModel
from .stats import attach, exact_quantiles


def stratified_split(rows: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 42, in_place: bool = False) -> DataFrame:
    """Adds ``is_test``: the rows of each class whose seeded hash lies in its lowest share.

    The cut is an exact quantile of the hash per class, so a class of any size is
    split without ranking it in one task. The rows are written first: the cut reads them several
    times, and features would be computed anew each time. ``in_place`` writes the cuts of the classes too and sends
    them to the rows, which then keep their order and are not shuffled; a forest draws its samples by the order of rows, boosted trees do not.
    """
    rows = materialise(rows, "split-rows")
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    hashed = rows.withColumn("_h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12))
    cut = exact_quantiles(hashed, [label], "_h", {"_cut": test_share})
    if in_place:
        cut = materialise(cut, "split-cuts")
    return attach(hashed, cut, [label], n=cut.count() if in_place else None).withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def train(rows: DataFrame, label: str = "label", features: str = "features", algorithm: str = "forest", seed: int = 42,
          trees: int = 40, depth: int = 8) -> PipelineModel | BoostedModel:
    """A random forest over standardised features, or (``boosted``) trees of all classes boosted together, ``trees`` of each."""
    if algorithm == "boosted":
        return boosting.fit(rows, label, features, iterations=trees, depth=depth, seed=seed)
    if algorithm != "forest":
        raise ValueError("algorithm is forest or boosted")
    data = rows.withColumn("raw", array_to_vector(F.col(features))).withColumn("target", F.col(label).cast("string"))
    return Pipeline(stages=[
        StringIndexer(inputCol="target", outputCol="y", stringOrderType="alphabetAsc"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)]).fit(data)


def predict(model: PipelineModel | BoostedModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``predicted`` and ``confidence``, the largest class probability."""
    if isinstance(model, BoostedModel):
        return boosting.predict(model, rows, features).drop("probabilities")
    data = rows.withColumn("raw", array_to_vector(F.col(features)))
    for stage in model.stages[1:]:
        data = stage.transform(data)
    names = F.array(*map(F.lit, model.stages[0].labels))
    return data.select(*rows.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def map_coarse(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EUROSAT_TO_COARSE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit("unclassified"))


def class_distribution(tiles: DataFrame, by: list[str], label: str = "predicted") -> DataFrame:
    """Tiles, share, mean confidence and rank of each class."""
    over = f"OVER (PARTITION BY {', '.join(by)}"
    agg = tiles.groupBy(*by, label).agg(F.count("*").alias("tiles"), F.avg("confidence").alias("mean_confidence"))
    return agg.selectExpr("*", f"tiles / sum(tiles) {over}) AS fraction", f"row_number() {over} ORDER BY tiles DESC, {label}) AS rank").withColumn(
        "coarse_class", map_coarse(F.col(label)))


def scene_classes(tiles: DataFrame, by: list[str], label: str = "predicted") -> DataFrame:
    """Dominant class, its share, and mean and least confidence per scene."""
    dist = class_distribution(tiles, by, label).where("rank = 1").select(
        *by, F.col(label).alias("dominant_class"), F.col("fraction").alias("dominant_fraction"))
    return tiles.groupBy(*by).agg(F.count("*").alias("tiles"), F.avg("confidence").alias("mean_confidence"),
                                  F.min("confidence").alias("min_confidence")).join(dist, by)


def confusion(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def evaluate(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class precision, recall, f1 and support, with overall accuracy and macro f1 on every row."""
    cells = confusion(pred, label, predicted)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("guess")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("guess")))
    per = cells.select("n", (F.col("label") == F.col("predicted")).alias("hit"), F.inline(roles)).groupBy("class").agg(
        F.sum(F.col("n") * F.col("actual")).alias("support"), F.sum(F.col("n") * F.col("guess")).alias("guessed"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("actual")).otherwise(0)).alias("hits"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    per = per.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return per.selectExpr("class", "support", "precision", "recall", "f1", "sum(hits) OVER () / sum(support) OVER () AS accuracy",
                          "avg(f1) OVER () AS macro_f1")
