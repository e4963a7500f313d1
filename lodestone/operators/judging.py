"""Statistics of binary judges, rubric scores, call metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _round(x: Column) -> Column:
    return F.round(x, 6)


def classification(truth: Column, prediction: Column) -> list[Column]:
    """Aggregates of 0/1 columns: counts, coverage, accuracies, precision, recall, specificity, F1, balanced accuracy, MCC, Cohen's kappa,
    positive rates. Rows without a prediction are wrong in strict accuracy and left out elsewhere; 0/0 is null."""

    def n(t: int, p: int) -> Column:
        return F.count_if((truth == t) & (prediction == p)).cast("double")

    tp, tn, fp, fn = n(1, 1), n(0, 0), n(0, 1), n(1, 0)
    rows, graded = F.count(truth).cast("double"), tp + tn + fp + fn
    div = F.try_divide
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    accuracy = div(tp + tn, graded)
    chance = div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), graded * graded)
    return [
        F.count(truth).alias("n_rows"),
        *(x.cast("long").alias(k) for k, x in (("tp", tp), ("tn", tn), ("fp", fp), ("fn", fn))),
        _round(div(graded, rows)).alias("coverage"),
        _round(div(tp + tn, rows)).alias("strict_accuracy"),
        _round(accuracy).alias("accuracy"),
        _round(precision).alias("precision"),
        _round(recall).alias("recall"),
        _round(specificity).alias("specificity"),
        _round(div(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        _round((recall + specificity) / 2).alias("balanced_accuracy"),
        _round(div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        _round(div(accuracy - chance, 1 - chance)).alias("kappa"),
        _round(div(tp + fn, graded)).alias("truth_rate"),
        _round(div(tp + fp, graded)).alias("prediction_rate"),
    ]


def call_batches(criteria: DataFrame, example: str, order: str, size: int) -> DataFrame:
    """Criteria of each example in calls of at most ``size``: batch_index from 0, position from 1, criteria in the call."""
    w = Window.partitionBy(example)
    i = F.row_number().over(w.orderBy(order)) - 1
    with_i = criteria.withColumn("_i", i).withColumn("batch_index", F.floor(F.col("_i") / size)).withColumn("position", F.col("_i") % size + 1)
    return with_i.withColumn("criteria_in_call", F.least(F.lit(size), F.count("*").over(w) - F.col("batch_index") * size)).drop("_i")


def breakdown(predictions: DataFrame, requested: str, actual: str, position: str, truth: str, prediction: str) -> DataFrame:
    """Classification by requested size, by requested and actual size, by requested size and position: grouping sets over one scan."""
    by = predictions.groupingSets([[F.col(requested)], [F.col(requested), F.col(actual)], [F.col(requested), F.col(position)]], requested, actual, position)
    kind = F.when(F.grouping(actual) == 0, "actual").when(F.grouping(position) == 0, "position").otherwise("requested")
    return by.agg(kind.alias("breakdown"), *classification(F.col(truth), F.col(prediction)))


def call_metrics(calls: DataFrame, by: list[str], seconds: str, error: str) -> DataFrame:
    """Success rate, mean, median, nearest-rank p95 and greatest of seconds."""
    ok, s = F.col(error).isNull(), F.col(seconds)
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), _round(F.try_divide(F.count_if(ok), F.count("*"))).alias("success_rate"), _round(F.avg(s)).alias("mean_seconds"), _round(F.median(s)).alias("median_seconds"), _round(F.expr(f"percentile_disc(0.95) within group (order by `{seconds}`)")).alias("p95_seconds"), F.max(s).alias("max_seconds"))


def error_histogram(calls: DataFrame, error: str) -> DataFrame:
    """Errors by what stands before the first colon."""
    return calls.where(F.col(error).isNotNull()).groupBy(F.substring_index(error, ":", 1).alias("error_type")).agg(F.count("*").alias("n"))


def usage(calls: DataFrame, by: list[str], tokens: str, cost: str) -> DataFrame:
    """Sums that skip nulls, null if all are; the mean over calls that reported."""
    return calls.groupBy(*by).agg(F.sum(tokens).alias("total_tokens"), _round(F.sum(cost)).alias("total_cost"), _round(F.avg(tokens)).alias("mean_tokens"), F.count(tokens).alias("calls_with_usage"))


def example_metrics(predictions: DataFrame, example: str, truth: str, prediction: str) -> DataFrame:
    """Examples, those with every criterion graded, and the share all of whose criteria are right."""
    each = predictions.groupBy(example).agg(F.bool_and(F.coalesce(F.col(prediction) == F.col(truth), F.lit(False))).alias("right"), F.bool_and(F.col(prediction).isNotNull()).alias("graded"))
    return each.agg(F.count("*").alias("examples"), F.count_if("graded").alias("complete"), F.count_if("right").alias("exact"), _round(F.try_divide(F.count_if("right"), F.count("*"))).alias("exact_rate"))


def compare(baseline: DataFrame, target: DataFrame, keys: list[str], truth: str, prediction: str) -> DataFrame:
    """A target's predictions against a baseline's on the same keys: accuracy delta, agreement, flips, regressions, improvements."""
    a = baseline.select(*keys, F.col(truth).alias("t"), F.col(prediction).alias("a"))
    both = a.join(target.select(*keys, F.col(prediction).alias("b")), keys)
    right_a, right_b = F.coalesce(F.col("a") == F.col("t"), F.lit(False)), F.coalesce(F.col("b") == F.col("t"), F.lit(False))
    same = F.col("a").eqNullSafe(F.col("b"))
    n = F.count("*")
    return both.agg(
        n.alias("pairs"),
        _round(F.try_divide(F.count_if(right_b) - F.count_if(right_a), n)).alias("accuracy_delta"),
        _round(F.try_divide(F.count_if(same), n)).alias("agreement"),
        _round(F.try_divide(F.count_if(~same), n)).alias("flip_rate"),
        F.count_if(right_a & ~right_b).alias("regressions"),
        F.count_if(~right_a & right_b).alias("improvements"),
        (F.count_if(~right_a & right_b) - F.count_if(right_a & ~right_b)).alias("net"),
    )


def rubric_score(df: DataFrame, by: list[str], score: str, weight: str, response: str | None = None) -> DataFrame:
    """The weighted mean of scores; a blank response scores 0 without a judge."""
    s = F.col(score).cast("double")
    if response:
        s = F.when(F.trim(F.coalesce(F.col(response), F.lit(""))) == "", 0.0).otherwise(s)
    return df.groupBy(*by).agg(_round(F.try_divide(F.sum(F.col(weight) * s), F.sum(F.col(weight)))).alias("score"))


def names_agree(expected: Column, got: Column) -> Column:
    """Whether a judge's names are those asked for, as multisets."""
    return F.array_sort(expected) == F.array_sort(got)


def score_table(rows: list[dict], columns: list[str]) -> str:
    """A few rows as fixed-width text, for people."""
    cells = [columns, *[["-" if r.get(c) is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]]
    wide = [max(len(x[i]) for x in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, wide, strict=True)).rstrip() for x in cells)
