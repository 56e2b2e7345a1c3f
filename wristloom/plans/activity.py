"""Activity models: a balanced forest, a hidden Markov model over its predictions, and METs, kept together."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError
from ..operators import forest, hmm, labels, runs
from ..operators.hmm import Hmm
from ..sources.shared import written


@dataclass
class ActivityModel:
    forest: PipelineModel
    hmm: Hmm
    features: list[str]
    mets: dict[str, float]

    @property
    def labels(self) -> list[str]:
        return forest.labels_of(self.forest)


def train(table: DataFrame, features: list[str], label: str = "label", participant: str = "participant", order: str = "time", annotation: str | None = None, met: str | None = None, test: list[str] | None = None, folds: int = 10, trees: int = 1000, depth: int = 12) -> tuple[ActivityModel, DataFrame]:
    """(model, predictions on the participants in test).

    The Markov model's emissions come from cross-predicted probabilities, so they are those of unseen rows; folds are
    stratified by label.  A label that a fold's forest has not seen has probability 0 there; no row is left out.
    """
    usable = table.where(labels.finite(features) & F.col(label).isNotNull())
    own, held = forest.split_by_participant(usable, participant, test or [])
    model = forest.train(own, label, features, trees, depth)
    names = forest.labels_of(model)
    dealt = written(forest.stratified_folds(own, label, folds, participant, order), "folds")
    crossed = written(forest.cross_predict(dealt, label, features, F.col("fold"), folds, labels=names, trees=trees, depth=depth), "cross-predicted")
    wide = crossed.select(participant, order, label, *(F.col("probabilities")[k].alias(f"p{k}") for k in range(len(names))))
    states = hmm.fit(wide, participant, order, label, {x: f"p{k}" for k, x in enumerate(names)})
    mets = {r[label]: r["met"] for r in labels.met_values(own, label, annotation or label, met).collect()} if met else {}
    out = ActivityModel(model, states, features, mets)
    return out, classify(out, held, participant, order)


def classify(model: ActivityModel, epochs: DataFrame, key: str, order: str, enmo: str | None = None, sleep: str | None = None, sleep_rows: float = 0, short_sleep: str = "sedentary", cuts: dict[str, float] | None = None) -> DataFrame:
    """epochs with prediction (smoothed), a 0/1 column per label, MET where known, and cut-point columns where enmo is given.

    Runs of the label sleep that are shorter than sleep_rows become short_sleep, what the model calls rest without sleep.
    Epochs with a feature that is not finite get no label and are left out of the smoothing.
    """
    guessed = forest.predict(model.forest, epochs, model.features).drop("probabilities")
    smooth = hmm.smooth(guessed, key, order, "prediction", model.hmm).drop("prediction").withColumnRenamed("smoothed", "prediction")
    if sleep and sleep_rows:
        smooth = runs.relabel_short_streaks(smooth, key, order, "prediction", sleep, short_sleep, sleep_rows)
    out = smooth.withColumns(labels.one_hot(F.col("prediction"), model.labels))
    if model.mets:
        out = labels.with_met(out, "prediction", model.mets)
    if enmo:
        out = out.withColumns(labels.cut_point_columns(F.col(enmo), cuts, F.col("prediction").eqNullSafe(sleep) == F.lit(False) if sleep else None))
    return out


def save(model: ActivityModel, path: str, spark: SparkSession) -> None:
    """A Spark ML pipeline, and JSON of the rest, in any store that Spark writes."""
    model.forest.write().overwrite().save(f"{path}/forest")
    rest = json.dumps({"hmm": asdict(model.hmm), "features": model.features, "mets": model.mets})
    spark.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load(path: str, spark: SparkSession) -> ActivityModel:
    try:
        rest = json.loads(spark.read.text(f"{path}/model").first()["value"])
        return ActivityModel(PipelineModel.load(f"{path}/forest"), Hmm(**rest["hmm"]), rest["features"], rest["mets"])
    except Exception as e:
        raise ModelError(f"no model in {path}") from e
