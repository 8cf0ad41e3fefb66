"""Discriminant analysis, logistic models, linkage and greedy splits.

Sums over rows are distributed; what comes to the driver is classes by dimensions, a histogram or a small matrix, and its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import relational as R
from tokenloom.operators import vectors as V


def _usable(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(all columns, __y, __v): rows with a label and a vector of finite components."""
    v = df.withColumn("__y", F.col(label)).withColumn("__v", V.doubles(vector))
    return v.where(F.col("__y").isNotNull() & F.col("__v").isNotNull() & F.forall("__v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def _class_means(v: DataFrame, most: int) -> tuple[dict, dict]:
    """({label: rows}, {label: mean vector}); vectors of different lengths, or more than most numbers, are an error."""
    import numpy as np

    e = v.select("__y", F.posexplode("__v").alias("pos", "x"))
    rows = e.groupBy("__y", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} means of classes and dimensions")
    counts, means = {}, {}
    for r in sorted(rows, key=lambda r: r.pos):
        if counts.setdefault(r["__y"], r.n) != r.n:
            raise ValueError("vectors of different lengths")
        means.setdefault(r["__y"], []).append(r.mean)
    if len({len(m) for m in means.values()}) > 1:
        raise ValueError("vectors of different lengths")
    return counts, {y: np.array(m) for y, m in means.items()}


def _within(v: DataFrame, means: dict, dims: int):
    """The sum of (x - mean of its class) outer itself: one matrix a task, summed after."""
    import numpy as np

    def part(batches):
        import pandas as pd

        total = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = np.stack(b["__v"].to_numpy()) - np.stack([means[y] for y in b["__y"]])
                total += x.T @ x
        yield pd.DataFrame({"pos": np.arange(dims * dims), "x": total.ravel()})

    sums = v.select("__y", "__v").mapInPandas(part, "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x"))
    out = np.zeros(dims * dims)
    for r in sums.collect():  # dims * dims numbers
        out[r.pos] = r.x
    return out.reshape(dims, dims)


def discriminant(df: DataFrame, key: str, label: str, vector: str, k: int = 2, most: int = 1_000_000) -> tuple[DataFrame, list[float]]:
    """(key, label, ld1, ...) and the ratio of the variance between classes to that within, of each.

    The within-class covariance of the result is the identity; directions without variance within classes are left out;
    signs: the largest coefficient is positive. Rows without a label or a finite vector are left out; fewer than two classes are an error.
    """
    import numpy as np

    v = _usable(df, label, vector)
    counts, means = _class_means(v, most)
    if len(means) < 2:
        raise ValueError("fewer than two classes")
    total, dims = sum(counts.values()), len(next(iter(means.values())))
    if dims * dims > most:
        raise ValueError(f"a matrix of more than {most} numbers")
    centre = sum(counts[y] * means[y] for y in means) / total
    values, axes = np.linalg.eigh(_within(v, means, dims) / max(total - len(means), 1))
    used = values > max(values.max(), 0.0) * 1e-10
    white = axes[:, used] / np.sqrt(values[used])
    between = sum(counts[y] * np.outer(means[y] - centre, means[y] - centre) for y in means) / (len(means) - 1)
    ratios, turned = np.linalg.eigh(white.T @ between @ white)
    first = np.argsort(-ratios)[: min(k, len(means) - 1)]
    scalings = white @ turned[:, first]
    scalings = scalings * np.sign(scalings[np.abs(scalings).argmax(axis=0), range(scalings.shape[1])])
    projected = [(V.dot(F.col("__v"), F.array(*[F.lit(float(x)) for x in s])) - float(centre @ s)).alias(f"ld{j + 1}") for j, s in enumerate(scalings.T)]
    return v.select(key, F.col("__y").alias("label"), *projected), [float(x) for x in ratios[first]]


def balanced_logistic(df: DataFrame, key: str, label: str, vector: str, iterations: int = 50) -> DataFrame:
    """(key, label, predicted, confidence) of a multinomial model of these rows, in which each class weighs the same.

    Rows without a label or a finite vector are left out; a single class is predicted without a model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = _usable(df, label, vector)
    sizes = v.groupBy("__y").agg(F.count("*").alias("n")).orderBy("__y").limit(10_001).collect()
    if len(sizes) > 10_000:
        raise ValueError("more than 10000 classes")
    if len(sizes) < 2:
        return v.select(key, F.col("__y").alias("label"), F.col("__y").alias("predicted"), F.lit(1.0).alias("confidence"))
    total = sum(r.n for r in sizes)
    kinds = df.sparkSession.createDataFrame([(r["__y"], float(i), total / (len(sizes) * r.n)) for i, r in enumerate(sizes)], f"__y {v.schema['__y'].dataType.simpleString()}, __i double, __w double")
    rows = v.join(F.broadcast(kinds), "__y").withColumn("__f", array_to_vector("__v"))  # at most 10,000 classes
    fitted = LogisticRegression(featuresCol="__f", labelCol="__i", weightCol="__w", maxIter=iterations, predictionCol="__p", probabilityCol="__s", rawPredictionCol="__r").fit(rows)
    named = kinds.select(F.col("__i").alias("__p"), F.col("__y").alias("predicted"))
    out = fitted.transform(rows).join(F.broadcast(named), "__p")
    return out.select(key, F.col("__y").alias("label"), "predicted", F.array_max(vector_to_array("__s")).alias("confidence"))


def complete_linkage(pairs: DataFrame, a: str, b: str, distance: str, most: int = 1000) -> DataFrame:
    """(step, left, right, height, size): the two nearest clusters are merged, by the largest distance between members, until one is left.

    pairs: a row for each two items. Items are numbered from 0 by their ids, clusters go on from there; ties go to the
    smallest numbers. More than most items, or a pair that is missing, are an error.
    """
    import numpy as np

    rows = pairs.select(a, b, F.col(distance).cast("double").alias("d")).limit(most * most + 1).collect()
    ids = sorted({x for r in rows for x in r[:2]})
    if len(rows) > most * most or len(ids) > most:
        raise ValueError(f"more than {most} items")
    at = {x: i for i, x in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.nan)
    for r in rows:
        d[at[r[0]], at[r[1]]] = d[at[r[1]], at[r[0]]] = r[2]
    np.fill_diagonal(d, np.inf)
    if np.isnan(d).any():
        raise ValueError("a pair without a distance")
    number, size, out = list(range(len(ids))), [1] * len(ids), []
    for step in range(len(ids) - 1):
        left, right, i, j = min((min(number[i], number[j]), max(number[i], number[j]), i, j) for i, j in np.argwhere(d == d.min()))
        out.append((step, left, right, float(d[i, j]), size[i] + size[j]))
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        number[i], size[i] = len(ids) + step, size[i] + size[j]
    return pairs.sparkSession.createDataFrame(out, "step int, left int, right int, height double, size int")


def greedy_split(df: DataFrame, key: str, group: str, train: float = 0.8, valid: float = 0.1, most: int = 1_000_000) -> DataFrame:
    """df with ``split``: whole groups, the largest first, go to train while they fit in its share, else to valid while they fit, else to test.

    Groups of one size follow each other by their largest first key, so all that fit go first: the driver needs only
    how many groups have each size (at most the root of twice the rows, and most). key: a numeric column of distinct values; a null group is a group.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__size"), (-F.min(key)).alias("__first"))
    histogram = sizes.groupBy("__size").agg(F.count("*").alias("c")).limit(most + 1).collect()
    if len(histogram) > most:
        raise ValueError(f"groups of more than {most} sizes")
    total = sum(r["__size"] * r.c for r in histogram)
    used, filled, limits = 0, 0, []
    for r in sorted(histogram, key=lambda r: -r["__size"]):
        n = r["__size"]
        first = min(r.c, max(0, int((train * total - used) // n)))
        used += first * n
        second = min(r.c - first, max(0, int(((train + valid) * total - used - filled) // n)))
        filled += second * n
        limits.append((n, first, first + second))
    bounds = df.sparkSession.createDataFrame(limits, "__size long, __t long, __v long")
    placed = R.ranks(sizes, "__first", "__k", ["__size"]).join(bounds, "__size")
    split = F.when(F.col("__k") <= F.col("__t"), "train").when(F.col("__k") <= F.col("__v"), "valid").otherwise("test")
    placed = placed.select("__g", split.alias("split"))
    return df.join(placed, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
