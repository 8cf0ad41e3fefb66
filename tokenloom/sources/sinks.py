"""Sinks: partitioned tables, CSV and text; Spark's commit protocol takes the place of manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).parquet(path)


def scores(df: DataFrame, path: str) -> None:
    """Appends rows to a table of scores; rows of runs that end at the same time stand beside each other."""
    df.write.mode("append").option("header", True).csv(path)


def maps(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested as the columns are."""
    df.write.json(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], **config) -> DataFrame:
    """The table that compute() gives for a configuration: read if it was written whole before, else computed and written."""
    at = f"{path}/{hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:32]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """A vocabulary (id, token, cnt) as a table that ``load_vocabulary`` reads."""
    vocab.select("id", "token", "cnt").coalesce(1).write.parquet(path)  # its size has a fixed bound


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, token string, cnt long").parquet(path)


def text_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.cast("string").alias("value")).write.text(path)


def fixed_width(widths: list[tuple[str, int]]) -> Column:
    """One line of a fixed-width report."""
    return F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths])
