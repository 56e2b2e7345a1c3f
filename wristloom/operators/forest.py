"""Random forests on Spark ML: balanced training, folds, cross-predicted probabilities, and scores of folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import finite


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: the inverse of the label's share, in place of per-tree undersampling."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n")).first()[0]
    # a row per label
    return df.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label"))).withColumn("weight", F.lit(least) / F.col("_n")).drop("_label", "_n")


#: Salts that a label's rows are dealt over when they are numbered.
SALTS = 256


def stratified_folds(df: DataFrame, label: str, k: int, *by: str) -> DataFrame:
    """df with fold, a number below k: each label's rows are spread over the folds as evenly as can be, in an order hashed from by.

    Rows are numbered within (label, salt), and the salts of a label follow each other, so no task holds a label's rows.
    """
    rows = df.withColumn("_h", F.xxhash64(*by)).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    sizes = rows.groupBy(F.col(label).alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most SALTS rows per label
    offsets = sizes.select("_l", "_s", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(label, "_salt").orderBy("_h", *by)) - 1
    numbered = rows.withColumn("_own", own).join(F.broadcast(offsets), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s")))
    return numbered.withColumn("fold", ((F.col("_before") + F.col("_own")) % k).cast("int")).drop("_h", "_salt", "_l", "_s", "_before", "_own")


def train(df: DataFrame, label: str, features: list[str], trees: int = 1000, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A balanced forest on rows whose features are all finite."""
    rows = balanced(df.where(finite(features) & F.col(label).isNotNull()), label)
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_pred"),
    ]).fit(rows)


# ---------------------------------------------------------------- undersampling per tree


def tree_weights(df: DataFrame, label: str, tree: int, by: list[str], seed: int = 42, most: int = 8) -> DataFrame:
    """The rows of one tree, with weight: how often a bootstrap of the tree's own has drawn them.

    Every label is drawn as often, on average, as the rarest one has rows.  A row's count is a Poisson number by a hash of the row
    (by), the tree and the seed, so any executor that computes it again finds the same.
    """
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n")).first()[0]
    u = (F.pmod(F.xxhash64(F.lit(tree), F.lit(seed), *by), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rate = F.lit(float(least or 0)) / F.col("_n")
    # a row per label
    rows = df.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l"))).withColumns({"_u": u, "_term": F.exp(-rate)})
    count, upto, term = F.lit(0), F.lit(0.0), F.col("_term")
    for k in range(most):
        upto = upto + term
        count = count + (F.col("_u") >= upto).cast("int")
        term = term * rate / (k + 1)
    return rows.withColumn("weight", count.cast("double")).where("weight > 0").drop("_l", "_n", "_u", "_term")


@dataclass
class UndersampledForest:
    """Trees that have each seen as much of every label."""

    trees: list[PipelineModel]
    labels: list[str]
    features: list[str]


def train_undersampled(df: DataFrame, label: str, features: list[str], trees: int = 100, depth: int = 12, seed: int = 42, by: list[str] | None = None) -> UndersampledForest:
    """A forest whose trees are trained one by one, each on tree_weights of its own; by names the columns that tell rows apart.

    Each tree is a distributed training over few rows: those of the rarest label, times the number of labels.
    """
    rows = df.where(finite(features) & F.col(label).isNotNull())
    names = sorted(str(r[0]) for r in rows.select(label).distinct().collect())
    found = []
    for k in range(trees):
        own = tree_weights(rows, label, k, by or features, seed)
        found.append(Pipeline(stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
            VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"),
            RandomForestClassifier(labelCol="_label", featuresCol="_features", weightCol="weight", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + k, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_pred"),
        ]).fit(own))
    return UndersampledForest(found, names, features)


def predict_undersampled(model: UndersampledForest, df: DataFrame) -> DataFrame:
    """Adds prediction and the array probabilities, the mean over the trees, in the order of model.labels; null where a feature is not finite."""
    ok = finite(model.features)
    rows = df.withColumn("_ok", ok).withColumns({f"_f_{c}": F.when(ok, F.col(c)).otherwise(0.0).cast("double") for c in model.features})
    rows = VectorAssembler(inputCols=[f"_f_{c}" for c in model.features], outputCol="_features").transform(rows)
    rows = rows.drop(*(f"_f_{c}" for c in model.features)).withColumn("_sum", F.array(*(F.lit(0.0) for _ in model.labels)))
    for tree in model.trees:
        rows = tree.stages[2].transform(rows).withColumn("_own", vector_to_array("_p"))
        rows = rows.withColumn("_sum", F.zip_with("_sum", aligned("_own", labels_of(tree), model.labels), lambda a, b: a + b)).drop("_own", "_raw", "_p", "_pred")
    share = F.transform("_sum", lambda v: v / F.lit(float(len(model.trees))))
    best = F.get(F.array(*map(F.lit, model.labels)), (F.array_position("_sum", F.array_max("_sum")) - 1).cast("int"))
    return rows.withColumns({"prediction": F.when(F.col("_ok"), best), "probabilities": F.when(F.col("_ok"), share)}).drop("_ok", "_features", "_sum")


# ---------------------------------------------------------------- predictions and folds


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds prediction and the array probabilities; null where a feature is not finite."""
    names = F.array(*map(F.lit, labels_of(model)))
    ok = finite(features)
    filled = df.withColumn("_ok", ok).withColumns({f"_f_{c}": F.when(ok, F.col(c)).otherwise(0.0).cast("double") for c in features})
    assembled = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_features").transform(filled)
    out = model.stages[2].transform(assembled)
    out = out.withColumn("prediction", F.when(F.col("_ok"), F.get(names, F.col("_pred").cast("int")))).withColumn("probabilities", F.when(F.col("_ok"), vector_to_array("_p")))
    return out.drop("_ok", "_features", "_raw", "_p", "_pred", *(f"_f_{c}" for c in features))


def aligned(probabilities: str, have: list[str], want: list[str]) -> F.Column:
    """An array of probabilities in the order of have, in that of want; 0 for labels that have lacks."""
    cells = [F.get(probabilities, F.lit(have.index(x))) if x in have else F.lit(0.0) for x in want]
    return F.when(F.col(probabilities).isNotNull(), F.array(*cells))


def cross_predict(df: DataFrame, label: str, features: list[str], fold, k: int = 10, labels: list[str] | None = None, **how) -> DataFrame:
    """Each fold's rows predicted by a model of the other folds; fold is a column of numbers below k.

    probabilities are in the order of labels (by default, all labels of df, sorted), also where a fold's model lacks some.
    """
    folds = df.withColumn("_fold", fold)
    if labels is None:
        labels = sorted(str(r[0]) for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    out = None
    for i in range(k):
        model = train(folds.where(F.col("_fold") != i), label, features, **how)
        part = predict(model, folds.where(F.col("_fold") == i), features)
        part = part.withColumn("probabilities", aligned("probabilities", labels_of(model), labels))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def leave_one_out(df: DataFrame, label: str, features: list[str], participant: str, **how) -> DataFrame:
    """Each participant's rows, with fold (its place among the sorted ones), predicted by a model of all the others.

    A model per participant: they are few, as each is labelled by hand.  Rows without a participant are in every model and are not predicted.
    """
    names = [r[0] for r in df.where(F.col(participant).isNotNull()).select(participant).distinct().orderBy(participant).collect()]
    place = F.array_position(F.array(*map(F.lit, names)), F.col(participant)).cast("int") - 1
    folds = df.withColumn("fold", F.coalesce(place, F.lit(-1)))
    return cross_predict(folds, label, features, F.col("fold"), len(names), **how)


def split_by_participant(df: DataFrame, participant: str, test: list[str]) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows; a null participant is in train."""
    inside = F.coalesce(F.col(participant).isin(test), F.lit(False))
    return df.where(~inside), df.where(inside)
