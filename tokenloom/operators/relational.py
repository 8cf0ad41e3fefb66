"""Joins, deduplication, samples and splits; every choice of rows has a stated order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *key: Column) -> Column:
    """A reproducible pseudo-random order: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def cap_per_label(df: DataFrame, label: str, order: list[Column], limit: int, capped: list[str] | None = None) -> DataFrame:
    """At most limit rows of each label (of the labels given, if any), in order; others stay whole and unsorted."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    first = lambda rows: rows.withColumn("__k", rank).where(F.col("__k") <= limit).drop("__k")  # noqa: E731  limited before the exchange
    if capped is None:
        return first(df)
    named = F.coalesce(F.col(label).isin(capped), F.lit(False))
    return first(df.where(named)).unionAll(df.where(~named))


def ranks(df: DataFrame, by: str, name: str, within: list[str] = (), ranges: int = 64, tie: list[str] = ()) -> DataFrame:
    """Adds the rank from 1 by a numeric column (within the groups, if any), and ``<name>_of``, the number of rows ranked.

    by and tie together must be distinct, else rows that are equal get their ranks in any order.

    The order is cut into ranges by a sketch of the quantiles; a rank is the rows of the ranges before plus the place in
    one's own, so no task sorts a whole table or group.
    """
    cuts = df.agg(F.percentile_approx(by, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 1000).alias("__c"))
    r = df.join(F.broadcast(cuts), how="cross").withColumn("__b", F.size(F.filter("__c", lambda c: c < F.col(by)))).drop("__c")  # one row
    n = r.groupBy(*within, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*within)
    n = n.select(*within, "__b", F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__a"), F.sum("__n").over(w).alias(f"{name}_of"))
    own = F.row_number().over(Window.partitionBy(*within, "__b").orderBy(by, *tie))
    return r.join(n, [*within, "__b"]).withColumn(name, (F.col("__a") + own).cast("long")).drop("__a", "__b")


def plain_fold(df: DataFrame, by: str, folds: int = 3) -> DataFrame:
    """Adds ``fold``: consecutive parts of the order, the first ones longer by one row where the rows don't divide."""
    r = ranks(df, by, "__k")
    size, longer = F.floor(F.col("__k_of") / folds), F.col("__k_of") % folds
    at = F.col("__k") - 1
    fold = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return r.withColumn("fold", fold.cast("int")).drop("__k", "__k_of")


def predefined_fold(parts: dict[int, DataFrame]) -> DataFrame:
    """Union of frames with ``fold``: the number each was given, -1 for rows that are always trained on."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("fold", F.lit(k)) for k, df in parts.items()])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def outer_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join in which null keys match each other; clashing names get suffixes, keys are merged."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, s: [df[c].alias(c + s if c in clash else c) for c in df.columns if c not in keys]
    return left.join(right, null_safe(left, right, keys), "full").select(*[F.coalesce(left[k], right[k]).alias(k) for k in keys], *named(left, suffixes[0]), *named(right, suffixes[1]))


def diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, kind): left_only, right_only, changed or same."""
    a, b = left.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__l")), right.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    kind = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return outer_join(a, b, keys).select(*keys, kind.alias("kind"))


def last_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the last frame that has a key gives its row."""
    parts = [f.withColumn("__o", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, [F.desc("__o")]).drop("__o")


def group_fold(seed: int, group: Column, folds: int = 3) -> Column:
    """A fold per group, so no group is in two folds."""
    return F.conv(F.substring(seeded(seed, group), 1, 8), 16, 10).cast("long") % folds


def lookup(left: DataFrame, right: DataFrame, key: str, missing: str = "raise") -> DataFrame:
    """Each row of left with the row of its key in a table whose key is unique; a key that isn't fails when it is met.

    missing: what a row without one does: "raise" fails when it is met, "drop" leaves it out, "null" keeps it.
    """
    n = F.count("*").over(Window.partitionBy(key))
    right = right.withColumn("__n", n).withColumn(key, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} isn't unique: "), F.col(key).cast("string"))).cast(right.schema[key].dataType))).drop("__n")
    if missing == "drop":
        return left.join(right, key)
    joined = left.join(right.withColumn("__hit", F.lit(True)), key, "left")
    if missing == "raise":
        found = F.when(F.col("__hit"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(left.schema[key].dataType))
        joined = joined.withColumn(key, found)
    return joined.drop("__hit")


def with_status(df: DataFrame, checks: dict[str, Column], values: list[str], ok: str = "ok") -> DataFrame:
    """df with ``status``: the name of the first check that holds, else ok; values are null in rows that aren't ok. No row is lost, none raises."""
    status = F.lit(ok)
    for name, holds in reversed(checks.items()):
        status = F.when(holds, name).otherwise(status)
    df = df.withColumn("status", status)
    return df.withColumns({v: F.when(F.col("status") == ok, F.col(v)) for v in values})


def permuted(df: DataFrame, key: str, value: str, name: str, seed: int) -> DataFrame:
    """(key, name): the values dealt to the keys anew, in a reproducible order.

    Ranks come from counts by the leading hex digits of the order: no task orders the whole table.
    """

    def ranked(rows, seed, *cols):
        h = rows.select(*cols, seeded(seed, F.col(key)).alias("__h")).withColumn("__b", F.substring("__h", 1, 3))
        n = h.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__a", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return h.join(F.broadcast(n), "__b").withColumn("__k", F.col("__a") + F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).select(*cols, "__k")  # 4096 counts

    return ranked(df, 1, key).join(ranked(df, seed, key, value).select(F.col(value).alias(name), "__k"), "__k").select(key, name)
