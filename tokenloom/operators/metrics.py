"""Metrics of predictions, in one or two aggregations each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _by_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts of both classes for each distinct score: all that rank metrics need."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def _running(df: DataFrame, name: str, value: str) -> DataFrame:
    """Adds the sum of value over all rows with a larger s, by ranges of s: partial sums first, then within ranges.

    The order is cut into 64 ranges by a sketch of the quantiles; only their totals are summed in one place.
    """
    cuts = df.agg(F.percentile_approx("s", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000).alias("__c"))
    ranged = df.join(F.broadcast(cuts), how="cross").withColumn("__b", F.size(F.filter("__c", lambda c: c < F.col("s"))))
    totals = ranged.groupBy("__b").agg(F.sum(value).alias("__t"))
    ahead = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__a"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(ahead), "__b").withColumn(name, F.col("__a") + own).drop("__b", "__c", "__a")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(roc_auc): the share of pairs in the right order, ties half; null if a class is missing."""
    t = _running(_by_threshold(df, label, score), "above", "p")
    won = F.sum(F.col("n").cast("double") * (F.col("above") + F.col("p") / 2))
    return t.agg((won / F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """(average_precision): precision at each distinct threshold, weighted by the recall it adds."""
    t = _running(_running(_by_threshold(df, label, score), "tp", "p"), "fp", "n")
    tp = F.col("tp") + F.col("p")
    return t.agg((F.sum(F.col("p") * tp / (tp + F.col("fp") + F.col("n"))) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def f1_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    tp, wrong = F.count_if((y == 1) & (p == 1)), F.count_if(y != p)
    return df.agg(F.coalesce(2.0 * tp / F.nullif(2 * tp + wrong, F.lit(0)), F.lit(0.0)).alias("f1"), (F.count_if(y == p) / F.nullif(F.count("*"), F.lit(0))).alias("accuracy"))


def regression(df: DataFrame, label: str, predicted: str) -> DataFrame:
    e, y = F.col(label) - F.col(predicted), F.col(label)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_error"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class; 0 where a divisor is 0."""
    sides = F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("y"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("y"), F.lit(1).alias("p"), (F.col(label) == F.col(predicted)).cast("int").alias("h"))))
    c = df.select(sides.alias("x")).groupBy(F.col("x.class").alias("class")).agg(F.sum("x.y").alias("y"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return c.select("class", zero(F.col("h"), F.col("p")).alias("precision"), zero(F.col("h"), F.col("y")).alias("recall"), zero(2 * F.col("h"), F.col("p") + F.col("y")).alias("f1"), F.col("y").alias("support"))


def signed_ranks(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, w_plus, w_minus): paired signed ranks of a - b, zeros dropped, mid-ranks for ties.

    One group is one sample of paired runs, so ranks are taken within it.
    """
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d <> 0")
    ties = d.groupBy(*by, F.abs("__d").alias("__m")).agg(F.count_if(F.col("__d") > 0).alias("up"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = ties.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    return r.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"))


#: erfc(x) for x >= 0 as a polynomial in 1 / (1 + p x), times exp(-x * x), to 1.5e-7 (Abramowitz and Stegun 7.1.26; fixed values).
ERFC = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def normal_above(z: Column) -> Column:
    """The share of a standard normal distribution above z."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + ERFC[0] * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC[1]):
        poly = (poly + a) * t
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def rank_sum_tails(spark: SparkSession, most: int) -> DataFrame:
    """(n, w, at_most, at_least): the share of the 2**n signings of the ranks 1 to n whose positive ranks sum to at most, and at least, w.

    Counted by a dynamic programme over ranks: a sum of n ranks has rank n or hasn't. most**3 / 6 rows.
    """
    rows, counts = [], [1]
    for n in range(1, most + 1):
        counts = [(counts[w] if w < len(counts) else 0) + (counts[w - n] if w >= n else 0) for w in range(len(counts) + n)]
        below = 0
        for w, c in enumerate(counts):
            rows.append((n, float(w), (below + c) / 2**n, (2**n - below) / 2**n))
            below += c
    return spark.createDataFrame(rows, "n long, w double, at_most double, at_least double")


#: Pairs up to which the distribution of rank sums is counted out.
EXACT = 50


def signed_rank_test(df: DataFrame, a: str, b: str, by: list[str], method: str = "auto", exact: int = EXACT) -> DataFrame:
    """(by, n, w_plus, statistic, p_two_sided, p_less, p_greater, wins, total, method): paired signed ranks of a - b.

    Zeros are dropped (and count neither as wins nor in n); statistic: the lesser rank sum; wins: pairs with a > b; total: the sum of a - b.
    method: "auto" counts all signings of the ranks where at most ``exact`` differences are left and none are zero or tied, and takes the normal
    approximation elsewhere, with the correction for ties (p is 1 where nothing is left); "normal" takes it everywhere. The result says which.
    """
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d IS NOT NULL")
    whole = d.groupBy(*by).agg(F.count_if(F.col("__d") > 0).alias("wins"), F.sum("__d").alias("total"), F.count_if(F.col("__d") == 0).alias("__zeros"))
    ties = d.where("__d <> 0").groupBy(*by, F.abs("__d").alias("__m")).agg(F.count("*").alias("t"))
    ties = ties.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    r = whole.join(signed_ranks(df, a, b, by), by, "left").join(ties, by, "left")
    n, w = F.coalesce("n", F.lit(0)), F.coalesce("w_plus", F.lit(0.0))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("ties", F.lit(0)) / 48)
    z = F.coalesce((w - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))
    p = lambda c: F.when(n == 0, F.lit(1.0)).otherwise(c)
    out = r.select(*by, n.alias("n"), w.alias("w_plus"), F.least(w, F.coalesce("w_minus", F.lit(0.0))).alias("statistic"), p(2 * normal_above(F.abs(z))).alias("p_two_sided"), p(normal_above(-z)).alias("p_less"), p(normal_above(z)).alias("p_greater"), "wins", "total", (F.lit(method == "auto") & (n > 0) & (n <= exact) & (F.coalesce("ties", F.lit(0)) == 0) & (F.col("__zeros") == 0)).alias("__exact"))
    if method == "auto":
        tails = rank_sum_tails(df.sparkSession, exact).select(F.col("n").alias("__n"), F.col("w").alias("__w"), "at_most", "at_least")
        out = out.join(F.broadcast(tails), F.col("__exact") & (F.col("n") == F.col("__n")) & (F.col("w_plus") == F.col("__w")), "left")  # exact**3 / 6 rows
        both = F.when(F.col("at_most").isNotNull(), F.least(F.lit(1.0), 2 * F.least("at_most", "at_least")))  # least passes over nulls
        out = out.withColumns({c: F.coalesce(x, F.col(c)) for c, x in (("p_two_sided", both), ("p_less", F.col("at_most")), ("p_greater", F.col("at_least")))})
    return out.withColumn("method", F.when(F.col("__exact"), "exact").otherwise("normal")).drop("__exact", "__n", "__w", "at_most", "at_least")


def full_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``report`` with its averages: classes as text, then "macro avg" (plain means) and "weighted avg" (by support)."""
    r = report(df, label, predicted)
    names = ("precision", "recall", "f1")
    macro = r.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = r.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(c) for c in names], F.sum("support").alias("support"))
    return r.withColumn("class", F.col("class").cast("string")).unionByName(macro).unionByName(weighted)
