"""Exact neighbours and kernels over embedding arrays.

Queries and candidates meet by an equi-join on salts: each query goes to every salt, each candidate to one. Nothing is broadcast, and
the pairs are spread evenly however large the queries are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def pairs(queries: DataFrame, rows: DataFrame, salts: int | None = None) -> DataFrame:
    """Every query with every row; the column names of the two must differ. salts: the session's shuffle partitions, if not given."""
    salts = salts or max(8, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = queries.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return q.join(rows.withColumn("__s", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("array", "map"))]), F.lit(salts)).cast("int")), "__s").drop("__s")


def nearest(pairs_: DataFrame, query: str, other: str, distance: Column, k: int) -> DataFrame:
    """The k nearest of each query, ties to the smaller id."""
    d = pairs_.withColumn("dist", distance)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("dist", other))).where(F.col("rank") <= k)


def _weight() -> Column:
    """1 / distance; where a neighbour is at distance 0, only such ones count."""
    return F.when(F.col("__least") == 0, (F.col("dist") == 0).cast("double")).otherwise(1 / F.nullif(F.sqrt("dist"), F.lit(0.0)))


def votes(near: DataFrame, by: list[str], query: str, label: str, weights: str = "uniform") -> DataFrame:
    """(by, query, predicted): the label with the most votes of the neighbours, ties to the smaller; dist: squared distances.

    weights: "uniform", or "distance" for votes by 1 / distance (at distance 0 only such neighbours vote).
    """
    w = F.lit(1.0)
    if weights == "distance":
        near = near.withColumn("__least", F.min("dist").over(Window.partitionBy(*by, query)))
        w = _weight()
    n = near.groupBy(*by, query, label).agg(F.sum(w).alias("__w"))
    return n.groupBy(*by, query).agg(F.min_by(label, F.struct(-F.col("__w"), F.col(label))).alias("predicted"))


def means(near: DataFrame, query: str, value: str) -> DataFrame:
    """(query, predicted): the mean of the neighbours by 1 / distance (at distance 0 of such neighbours only)."""
    near = near.withColumn("__least", F.min("dist").over(Window.partitionBy(query)))
    return near.groupBy(query).agg((F.sum(F.col(value) * _weight()) / F.sum(_weight())).alias("predicted"))


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, pc1, ...) of the standardised vectors, and the share of the variance of each. Signs: the largest loading is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(doubles(vector)).alias("v"))
    v = StandardScaler(withMean=True, inputCol="v", outputCol="z").fit(v).transform(v)
    fitted = PCA(k=k, inputCol="z", outputCol="p").fit(v)
    loadings = fitted.pc.toArray()  # dimensions x k
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    p = vector_to_array("p")
    return fitted.transform(v).select(key, *[(p[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)]), [float(x) for x in fitted.explainedVariance.toArray()]


def standardized(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, z): each dimension to mean 0 and population deviation 1; moments are summed before the exchange."""
    e = df.select(key, F.posexplode(doubles(vector)).alias("pos", "x"))
    m = e.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return e.join(F.broadcast(m), "pos").select(key, "pos", F.coalesce((F.col("x") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)).alias("z"))
