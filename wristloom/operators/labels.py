"""Activity labels as columns: cut points, one-hot columns, METs, agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT_POINTS = {"lpa": 0.045, "mpa": 0.100, "vpa": 0.400}
CUT_LABELS = ("CpSB", "CpLPA", "CpMPA", "CpVPA", "CpMVPA")


def cut_point_columns(enmo: Column, cuts: dict[str, float] | None = None, worn: Column | None = None) -> dict[str, Column]:
    """0/1 columns of intensity classes, upper bounds inclusive; null where enmo is, 0 where not worn."""
    cuts = cuts or CUT_POINTS
    worn = F.lit(True) if worn is None else F.coalesce(worn, F.lit(False))
    found = {
        "CpSB": enmo <= cuts["lpa"], "CpLPA": (enmo > cuts["lpa"]) & (enmo <= cuts["mpa"]),
        "CpMPA": (enmo > cuts["mpa"]) & (enmo <= cuts["vpa"]), "CpVPA": enmo > cuts["vpa"], "CpMVPA": enmo > cuts["mpa"],
    }
    return {k: F.when(enmo.isNotNull(), (v & worn).cast("double")) for k, v in found.items()}


def one_hot(label: Column, labels: list[str]) -> dict[str, Column]:
    return {x: (label == x).cast("double") for x in labels}


def split_other(label: Column, acc: Column, other: str, low: str, mid: str, high: str) -> Column:
    """A residual label told apart by acc (mg): from 100 on mid, above 400 high, else low."""
    own = F.when(acc > 400, high).when(acc >= 100, mid).otherwise(low)
    return F.when(label == other, own).otherwise(label)


def finite(columns: list[str]) -> Column:
    """No column null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return out


def met_values(table: DataFrame, label: str, annotation: str, met: str) -> DataFrame:
    """Per label, the mean over annotations of the mean MET."""
    return table.groupBy(label, annotation).agg(F.avg(met).alias("m")).groupBy(label).agg(F.avg("m").alias("met"))


def with_met(df: DataFrame, label: str, mets: dict[str, float]) -> DataFrame:
    table = F.create_map(*(x for k, v in mets.items() for x in (F.lit(k), F.lit(float(v)))))
    return df.withColumn("MET", F.element_at(table, F.col(label)))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Counts for every pair of labels that occurs on either side, zero included.

    The grid of labels is their number squared, not the rows'.
    """
    both = df.select(F.col(true).alias("l")).union(df.select(F.col(pred).alias("l"))).where("l IS NOT NULL").distinct()
    cells = both.select(F.col("l").alias("y_true")).crossJoin(both.select(F.col("l").alias("y_pred")))
    counts = df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, key: str, true: str, pred: str) -> DataFrame:
    """Per key: accuracy and Cohen's kappa."""
    cells = df.groupBy(key, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    rows, cols, all_ = Window.partitionBy(key, "t"), Window.partitionBy(key, "p"), Window.partitionBy(key)
    marks = cells.withColumns({"row": F.sum("n").over(rows), "all": F.sum("n").over(all_)})
    total = cells.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    truth = marks.groupBy(key, F.col("t").alias("l")).agg(F.sum("n").alias("n_true"))
    guess = cells.withColumn("col", F.sum("n").over(cols)).groupBy(key, F.col("p").alias("l")).agg(F.sum("n").alias("n_pred"))
    chance = truth.join(guess, [key, "l"]).groupBy(key).agg(F.sum(F.col("n_true") * F.col("n_pred")).alias("s"))
    out = total.join(chance, key, "left").withColumn("accuracy", F.col("hits") / F.col("total"))
    expected = F.coalesce("s", F.lit(0)) / (F.col("total") * F.col("total"))
    return out.select(key, "accuracy", F.when(expected < 1, (F.col("accuracy") - expected) / (1 - expected)).alias("kappa"))


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 per label."""
    counts = confusion(df, true, pred)
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    recall = counts.groupBy(F.col("y_true").alias("label")).agg(hit.alias("hits"), F.sum("n").alias("support"))
    made = counts.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    out = recall.join(made, "label").select("label", p.alias("precision"), r.alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def fold_scores(df: DataFrame, fold: str, true: str, pred: str) -> DataFrame:
    """Per fold, the macro F1 over the labels that are true or predicted in it, and its rows."""
    seen = F.explode(F.array(
        F.struct(F.col(true).alias("l"), F.lit(1).alias("support"), F.lit(0).alias("made")), F.struct(F.col(pred).alias("l"), F.lit(0).alias("support"), F.lit(1).alias("made")),
    ))
    rows = df.select(fold, (F.col(true).eqNullSafe(F.col(pred))).cast("int").alias("hit"), seen.alias("s")).where("s.l IS NOT NULL")
    per = rows.groupBy(fold, "s.l").agg(F.sum(F.col("hit") * F.col("s.support")).alias("hits"), F.sum("s.support").alias("support"), F.sum("s.made").alias("made"))
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("made"))
    return per.groupBy(fold).agg(F.avg(f1).alias("macro_f1"), F.sum("support").alias("n"))


def cross_validation(df: DataFrame, fold: str, true: str, pred: str) -> DataFrame:
    """One row: mean and quartiles of the folds' macro F1, and their number."""
    q = F.percentile("macro_f1", F.array(F.lit(0.25), F.lit(0.75)))
    scores = fold_scores(df, fold, true, pred).agg(F.avg("macro_f1").alias("cv_mean_score"), q.alias("q"), F.count("*").alias("folds"))
    return scores.select("cv_mean_score", F.col("q")[0].alias("cv_25th_score"), F.col("q")[1].alias("cv_75th_score"), "folds")


def macro_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    return class_report(df, true, pred).agg(F.avg("f1").alias("macro_f1"))
