"""Win-probability model: second-order boosted trees on the time split, isotonic calibration,
held-out predictions, metrics against the rating baseline, importances.

The number of trees is chosen by patience on the validation slice while they grow
(``boost.fit``).  Results are judged by quality, not by value: row and feature sampling differ
from any other booster's.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.plans import boost
from scoreline.plans.evaluate import PSEUDO, Isotonic, fit_calibrator, prob_metrics
from scoreline.plans.features import FEATURES, TARGET

SEED = 7


@dataclass
class FittedModel:
    trees: boost.Booster
    calibrator: Isotonic
    floor: float     # calibrated probabilities stay this far from 0 and 1

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): mean gain of a feature's splits, as shares of one."""
        return spark.createDataFrame(
            [(f, round(v, 4)) for f, v in self.trees.gains.items()],
            "feature string, importance double").orderBy(F.desc("importance"), "feature")


def fit(split: DataFrame, features: list[str] = FEATURES, target: str = TARGET,
        seed: int = SEED, params: boost.Params = boost.Params(), key: str = "game_id") -> FittedModel:
    """Fit on the train slice with the validation slice as judge, then fit the isotonic
    calibrator on the raw validation predictions."""
    data = split.filter(F.col("split") != "test")
    trees = boost.fit(data, features, target, F.col("split") == "train", key, params, seed)
    valid = data.filter(F.col("split") == "valid").select(
        F.col(target).alias("y"), trees.probability().alias("p")).checkpoint()
    # n outcomes cannot show a rarer event than one in n + 2
    return FittedModel(trees, fit_calibrator(valid, pseudo=PSEUDO), 1.0 / (valid.count() + 2))


def score(model: FittedModel, df: DataFrame) -> DataFrame:
    """Add ``raw_prob`` and calibrated ``model_prob`` (whole frame, no per-row calls)."""
    raw = df.withColumn("raw_prob", model.trees.probability())
    return raw.withColumn("model_prob", F.least(F.greatest(
        model.calibrator.predict(F.col("raw_prob")), F.lit(model.floor)), F.lit(1.0 - model.floor)))


def heldout_predictions(model: FittedModel, split: DataFrame) -> DataFrame:
    """Test slice: ids, outcome, calibrated model probability and rating probability."""
    test = split.filter(F.col("split") == "test")
    return score(model, test).select(
        "game_id", F.date_format("game_date", "yyyy-MM-dd").alias("game_date"),
        "home_team_id", "away_team_id", TARGET, "raw_prob", "model_prob",
        F.col("elo_exp_home").alias("elo_prob"))


def heldout_metrics(preds: DataFrame) -> DataFrame:
    """Metrics for the rating baseline, raw trees and calibrated trees, one row each."""
    long = preds.select(F.col(TARGET).alias("y"), F.inline(F.array(
        F.struct(F.lit("elo_baseline").alias("model"), F.col("elo_prob").alias("p")),
        F.struct(F.lit("gbt_raw").alias("model"), F.col("raw_prob").alias("p")),
        F.struct(F.lit("gbt_calibrated").alias("model"), F.col("model_prob").alias("p")))))
    return prob_metrics(long)


def save(model: FittedModel, path: str, spark: SparkSession) -> None:
    """Trees, calibrator and importances as tables under ``path`` (replaced)."""
    t = model.trees
    trees = [(i, tree.feature.tolist(), tree.bin.tolist(), tree.cut.tolist(), tree.leaf.tolist())
             for i, tree in enumerate(t.trees)]
    spark.createDataFrame(trees, "number int, feature array<int>, bin array<int>, cut array<double>, "
                                 "leaf array<double>").write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame(list(zip(model.calibrator.x, model.calibrator.y)), "x double, y double"
                          ).write.mode("overwrite").parquet(f"{path}/calibrator")
    about = json.dumps({"features": t.features, "base": t.base, "gains": t.gains, "floor": model.floor})
    spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> FittedModel:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["number"])
    trees = [boost.Tree(np.array(r["feature"]), np.array(r["bin"]), np.array(r["cut"]), np.array(r["leaf"]))
             for r in rows]
    knots = sorted((r["x"], r["y"]) for r in spark.read.parquet(f"{path}/calibrator").collect())
    return FittedModel(boost.Booster(about["features"], trees, about["base"], about["gains"]),
                       Isotonic([x for x, _ in knots], [y for _, y in knots]), about["floor"])
