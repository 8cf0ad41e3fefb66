"""Aggregates of the reporting workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, edges_of: DataFrame, edges_value: str, bins: int = 10) -> DataFrame:
    """(bin, cnt) of value in equal bins over the range of another series; the last bin is closed, values outside are left out."""
    e = edges_of.agg(F.min(edges_value).alias("lo"), F.max(edges_value).alias("hi"))
    b = df.join(F.broadcast(e), how="cross").where(F.col(value).between(F.col("lo"), F.col("hi")))  # one row
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col(value) - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1))
    counts = b.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("cnt"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, mean, sd): kept beside the data, so that other rows can be put on the same scale later."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def rescaled(df: DataFrame, kept: DataFrame, value: str, *by: str, flip: bool = False) -> DataFrame:
    """df with ``z``: (x - mean) / deviation by a table of moments; flip: with the sign turned, for errors. Null where the deviation is 0 or undefined.

    Groups' moments are summed before the exchange and joined, so a large group isn't one task.
    """
    k = kept.select(*[F.col(b).alias(f"__{b}") for b in by], "mean", "sd")
    z = (F.col(value) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    match = reduce(lambda a, b: a & b, [df[b].eqNullSafe(F.col(f"__{b}")) for b in by])
    return df.join(k, match, "left").withColumn("z", -z if flip else z).drop("mean", "sd", *[f"__{b}" for b in by])


def zscore(df: DataFrame, value: str, *by: str, flip: bool = False) -> DataFrame:
    return rescaled(df, moments(df, value, *by), value, *by, flip=flip)


def levels(df: DataFrame, level: Column, most: int = 10_000) -> list:
    """The distinct values of a column that becomes column names; more than ``most`` are an error."""
    found = [r[0] for r in df.select(level.alias("x")).where("x IS NOT NULL").distinct().orderBy("x").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values for columns")
    return found


def best(df: DataFrame, by: list[str], value: str, order: list[Column], largest: bool = True) -> DataFrame:
    """The row with the best value of each group; nulls never win over values."""
    first = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(first, *order))).where("__k = 1").drop("__k")


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def nonzero_mean(value: Column) -> Column:
    return F.coalesce(F.sum(value) / F.nullif(F.count_if(value != 0), F.lit(0)), F.lit(0.0))


def wide_mean(df: DataFrame, by: list[str], level: Column, value: str, names: list[str] | None = None) -> DataFrame:
    """Pivot of means: a column for each value of level, those that occur unless stated; one pass beside their look-up."""
    return df.groupBy(*by).agg(*[F.avg(F.when(level == n, F.col(value))).alias(n) for n in (levels(df, level) if names is None else names)])


def marks(df: DataFrame, keep: list[str], level: str) -> DataFrame:
    """keep, and a column for each value of level that occurs: "x" in the rows that have it, "" in others."""
    return df.select(*keep, *[F.when(F.col(level) == v, "x").otherwise("").alias(str(v)) for v in levels(df, F.col(level))])
