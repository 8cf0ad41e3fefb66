"""Complete linkage by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.sources import corpora as C


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: each round begins there, not at the first."""
    path = C.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linkage(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """(step, left, right, height, size): the two nearest clusters are merged, by the largest distance between members, until one is left.

    pairs: a row for each two items, in any order; a pair that is missing or repeated is an error. Pairs of equal distance are ordered by their items' ids
    (smaller, then larger), so no two are equal. Items are numbered from 0 by their ids, clusters go on from there by steps; fewer than two items give no rows.

    All clusters that are each other's nearest are merged in one round: with the largest distance, merging two brings no third nearer, so
    these are merges of the step-by-step definition, too. A round is a few joins and sums over the pairs that are left, each written; there are about as many rounds as the tree is
    high (at most one per merge). Nothing but the number of pairs and items reaches the driver.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    table = pairs.select(low.alias("x"), high.alias("y"), F.struct(F.col(distance).cast("double").alias("d"), low.alias("p"), high.alias("q")).alias("key")).where("x IS NOT NULL AND x <> y")
    table = _kept(table, "linkage-pairs")
    items = _kept(table.select("x").union(table.select("y")).distinct(), "linkage-items")
    n, given, distinct = items.count(), table.count(), table.select("x", "y").distinct().count()
    if given != distinct or given != n * (n - 1) // 2 or table.where("key.d IS NULL OR isnan(key.d)").count():
        raise ValueError("a pair without a distance, or with two")
    sizes, merges, left = items.select("x", F.lit(1).cast("long").alias("size")), None, given
    while left:
        both = table.unionAll(table.select(F.col("y").alias("x"), F.col("x").alias("y"), "key"))
        near = both.groupBy("x").agg(F.min_by("y", "key").alias("y"), F.min("key").alias("key"))
        back = near.select(F.col("x").alias("y"), F.col("y").alias("x"))
        found = _kept(near.join(back, ["x", "y"]).where("x < y"), "linkage-found")
        size = lambda c: sizes.select(F.col("x").alias(c), F.col("size").alias(f"size_{c}"))
        new = _kept(found.join(size("x"), "x").join(size("y"), "y").select("x", "y", "key", (F.col("size_x") + F.col("size_y")).alias("size")), "linkage-merges")
        merges = new if merges is None else merges.unionAll(new)
        gone = found.select(F.col("y").alias("was"), F.col("x").alias("now"))
        grown = new.select("x", F.col("size").alias("grown"))
        sizes = _kept(sizes.join(gone, F.col("x") == F.col("was"), "left_anti").join(grown, "x", "left").select("x", F.coalesce("grown", "size").alias("size")), "linkage-sizes")
        renamed = lambda df, c: df.join(gone, F.col(c) == F.col("was"), "left").withColumn(c, F.coalesce("now", c)).drop("was", "now")
        moved = renamed(renamed(table, "x"), "y").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "key")
        table = _kept(moved.groupBy("x", "y").agg(F.max("key").alias("key")), "linkage-pairs")
        left = table.count()
    schema = "step int, left int, right int, height double, size long"
    if merges is None:
        return pairs.sparkSession.createDataFrame([], schema)
    # as many rows as items, of as many pairs as their square
    numbers = items.select("x", (F.row_number().over(Window.orderBy("x")) - 1).alias("number"))
    steps = merges.withColumn("step", F.row_number().over(Window.orderBy("key")) - 1)
    grew = Window.partitionBy("x").orderBy("step")
    before = steps.withColumn("mine", F.lag("step").over(grew))
    last = steps.groupBy(F.col("x").alias("y")).agg(F.max("step").alias("theirs"))
    named = before.join(numbers, "x").join(numbers.select(F.col("x").alias("y"), F.col("number").alias("other")), "y").join(last, "y", "left")
    first, second = F.coalesce(F.col("mine") + n, "number"), F.coalesce(F.col("theirs") + n, "other")
    return named.select("step", F.least(first, second).alias("left"), F.greatest(first, second).alias("right"), F.col("key.d").alias("height"), "size")
