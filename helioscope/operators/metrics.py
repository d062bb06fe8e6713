"""Evaluation metrics of label and score relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators.prefix import running


def _counts(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Positives and negatives at each score."""
    return df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) > 0.5, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) > 0.5, 0).otherwise(1)).alias("_n"))


def roc_curve(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score, the highest first. Labels over 0.5 are positive. Counted by score before the window."""
    c = _counts(df, label, score, by)
    if not by:
        x = running(c, "threshold", ["_p", "_n"], descending=True)
        return x.select("threshold", F.col("run__p").alias("tp"), F.col("run__n").alias("fp"), F.try_divide("run__p", "total__p").alias("tpr"), F.try_divide("run__n", "total__n").alias("fpr"))
    run = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    x = c.withColumns({"tp": F.sum("_p").over(run), "fp": F.sum("_n").over(run), "_tp": F.sum("_p").over(whole), "_tn": F.sum("_n").over(whole)})
    return x.select(*by, "threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("_tp")).alias("tpr"), F.try_divide(F.col("fp"), F.col("_tn")).alias("fpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area by the trapezoid rule: at each score, the step in false positives times the mean of the true positives before and after it."""
    c = _counts(df, label, score)
    x = running(c, "threshold", ["_p", "_n"], descending=True)
    area = F.col("_n") * (F.col("run__p") - F.col("_p") / 2) / (F.col("total__p") * F.col("total__n"))
    return x.agg(F.sum(area).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall)."""
    r = roc_curve(df, label, score)
    return r.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("tpr").alias("recall"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    x = running(_counts(df, label, score), "threshold", ["_p", "_n"], descending=True)
    step = F.col("_p") / F.col("total__p") * F.col("run__p") / (F.col("run__p") + F.col("run__n"))
    return x.agg(F.sum(step).alias("average_precision"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support); null where there is nothing to divide by."""
    c = confusion(df, truth, predicted)
    tp = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    t = c.groupBy(F.col("truth").alias("class")).agg(tp.alias("tp"), F.sum("n").alias("support"))
    p = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    x = t.join(p, "class", "full").select("class", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("called", F.lit(0)).alias("called"))
    return x.select("class", F.try_divide("tp", "called").alias("precision"), F.try_divide("tp", "support").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"), "support")


def _pairs(x):
    return x * (x - 1) / 2


def cluster_agreement(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Adjusted Rand index, Fowlkes-Mallows index, homogeneity, completeness and V-measure from the contingency table."""
    t = confusion(df, truth, predicted)
    a = t.groupBy("truth").agg(F.sum("n").alias("a"))
    b = t.groupBy("predicted").agg(F.sum("n").alias("b"))
    n = t.agg(F.sum("n").cast("double").alias("n"))
    cells = t.join(a, "truth").join(b, "predicted").crossJoin(n).agg(
        F.sum(_pairs(t["n"])).alias("same"),
        (-F.sum(t["n"] / n["n"] * F.ln(t["n"] / F.col("b")))).alias("h_tp"),
        (-F.sum(t["n"] / n["n"] * F.ln(t["n"] / F.col("a")))).alias("h_pt"),
    )
    sa = a.crossJoin(n).agg(F.sum(_pairs(F.col("a"))).alias("pa"), (-F.sum(F.col("a") / F.col("n") * F.ln(F.col("a") / F.col("n")))).alias("ha"))
    sb = b.crossJoin(n).agg(F.sum(_pairs(F.col("b"))).alias("pb"), (-F.sum(F.col("b") / F.col("n") * F.ln(F.col("b") / F.col("n")))).alias("hb"))
    x = cells.crossJoin(sa).crossJoin(sb).crossJoin(n)
    expected = F.col("pa") * F.col("pb") / _pairs(F.col("n"))
    top = (F.col("pa") + F.col("pb")) / 2
    h = F.when(F.col("ha") > 0, 1 - F.col("h_tp") / F.col("ha")).otherwise(1.0)
    c = F.when(F.col("hb") > 0, 1 - F.col("h_pt") / F.col("hb")).otherwise(1.0)
    y = x.select(F.when(top == expected, 1.0).otherwise((F.col("same") - expected) / (top - expected)).alias("ari"), (F.col("same") / F.sqrt(F.col("pa") * F.col("pb"))).alias("fmi"), h.alias("homogeneity"), c.alias("completeness"))
    return y.withColumn("v_measure", F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)))


def calibration(df: DataFrame, label: str, score: str, bins: int) -> DataFrame:
    """(bin, n, mean_score, rate) over equal bins of 0 to 1."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.when(F.col(label) > 0.5, 1.0).otherwise(0.0)).alias("rate"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae, r2, mape, max_error."""
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - mse / F.var_pop(y)).alias("r2"), F.avg(F.abs(F.try_divide(e, F.col(y)))).alias("mape"), F.max(F.abs(e)).alias("max_error"))


def ndcg(df: DataFrame, query: str, relevance: str, score: str, k: int) -> DataFrame:
    """NDCG at k by query; ties in score go to the higher relevance."""
    got = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.desc(relevance)))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance)))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    x = df.withColumns({"_g": got, "_b": best})
    at = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    return x.groupBy(query).agg(F.coalesce(F.try_divide(at("_g"), at("_b")), F.lit(0.0)).alias("ndcg"))


def multilabel(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(cardinality, density, hamming_loss) of two array<boolean> columns of one length: true labels a row, their share, and the share of labels that differ. Null labels count as false, rows without arrays or with arrays of unlike length don't count."""
    yes = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(False)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    t, p = yes(F.col(truth)), yes(F.col(predicted))
    rows = df.where((F.size(truth) > 0) & (F.size(truth) == F.size(predicted))).select(total(t).alias("n"), F.size(t).alias("size"), total(F.zip_with(t, p, lambda a, b: F.abs(a - b))).alias("wrong"))
    return rows.agg(F.avg("n").alias("cardinality"), (F.sum("n") / F.sum("size")).alias("density"), (F.sum("wrong") / F.sum("size")).alias("hamming_loss"))


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sparsity): the share of exact zeros among the values of the columns; nulls don't count."""
    zeros = sum((F.count_if(F.col(c) == 0) for c in columns), F.lit(0))
    return df.agg((zeros / sum((F.count(c) for c in columns), F.lit(0))).alias("sparsity"))
