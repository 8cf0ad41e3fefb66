"""Settings in names: parts between underscores, by their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(parts: Column, at: int, of: Column) -> Column:
    """The part at a place; a name without it fails."""
    missing = F.raise_error(F.concat(F.lit(f"no part {at + 1} in a name: "), of)).cast("string")
    return F.coalesce(F.get(parts, F.lit(at)), F.when(of.isNotNull(), missing))


def parse_tokenizer(name: Column, architecture: str | None = "bart") -> Column:
    """struct<embedding, tokenizer, dataset[, architecture]> of "embedding_tokenizer_dataset[_architecture]"; fewer than three parts fail, a null name gives null parts.

    architecture: what it is where the name has none; None leaves it out.
    """
    parts = F.split(name, "_")
    fields = [_part(parts, k, name).alias(n) for k, n in enumerate(("embedding", "tokenizer", "dataset"))]
    if architecture is not None:
        fields.append(F.when(name.isNotNull(), F.coalesce(F.get(parts, F.lit(3)), F.lit(architecture))).alias("architecture"))
    return F.struct(*fields)


def parse_hyperparams(name: Column, seed: bool = False) -> Column:
    """struct<learning_rate, dropout[, seed]> of "rate_dropout[_x[_seed]]": two numbers, which fail if they aren't; the fourth part is the seed, null where there is none."""
    parts = F.split(name, "_")
    fields = [_part(parts, k, name).cast("double").alias(n) for k, n in enumerate(("learning_rate", "dropout"))]
    return F.struct(*fields, *([F.get(parts, F.lit(3)).alias("seed")] if seed else []))


def grid(df: DataFrame, **lists) -> DataFrame:
    """Each row of df with every combination of the lists' values, a column for each list; an empty list gives no rows."""
    for name, values in lists.items():
        kind = df.sparkSession.createDataFrame([(v,) for v in values] or [(None,)], None if values else "x string").dtypes[0][1]
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")))
    return df
