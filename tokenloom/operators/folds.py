"""Folds that keep groups whole, and are balanced by rows or by the rows of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import relational as R


def deal(shapes: list[tuple[tuple[int, ...], int]], folds: int, steps: int) -> dict[tuple[int, ...], list[int]]:
    """How many groups of each shape (rows by class, number of groups) each fold gets.

    The largest shapes first, a group goes to the fold that shares least with it: the sum over classes of the fold's rows times the group's over the
    squared rows of all, which is what the group adds to the sum of the folds' squared shares; ties go to the fold with fewer rows, then to the first. Of
    shapes with many groups some are dealt at once, so that about ``steps`` decisions are taken: a share of what is left, so that the last ones go one by one.
    """
    classes = len(shapes[0][0]) if shapes else 0
    total = [sum(v[c] * n for v, n in shapes) for c in range(classes)]
    weight = [1 / (t * t) if t else 0.0 for t in total]
    held, out = [[0] * classes for _ in range(folds)], {}
    finest = max(8 * folds, steps // max(1, len(shapes)))
    for v, n in sorted(shapes, key=lambda x: (-sum(x[0]), [-y for y in x[0]])):
        given = out[v] = [0] * folds
        while n:
            some = max(1, n // finest)
            scores = []
            for f, x in enumerate(held):
                score = 0.0
                for c in range(classes):
                    score += x[c] * v[c] * weight[c]
                scores.append((score, sum(x), f))
            f = min(scores)[2]
            held[f] = [x + some * y for x, y in zip(held[f], v, strict=True)]
            given[f] += some
            n -= some
    return out


def group_folds(df: DataFrame, group: str, label: str | None = None, folds: int = 3, seed: int = 0, most: int = 100_000, classes: int = 1000, steps: int = 200_000) -> DataFrame:
    """df with ``fold``: whole groups, balanced by their rows, or by the rows of each class if a label is given.

    The driver sees how many groups have each shape (rows by class), never a group: at most ``most`` shapes of at most ``classes`` classes, beyond which it raises.
    Which groups of a shape go where is by a seeded order. A null group is a group, a null label a class; df has no column ``fold``.
    Without labels, the folds' rows differ by no more than the largest group's.
    """
    counts = F.array(F.count("*"))
    if label is not None:
        kinds = [r[0] for r in df.select(label).distinct().orderBy(label).limit(classes + 1).collect()]
        if len(kinds) > classes:
            raise ValueError(f"more than {classes} classes")
        counts = F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(k))) for k in kinds]) if kinds else F.array(F.count("*"))
    order = F.conv(F.substring(R.seeded(seed, F.col("__g")), 1, 15), 16, 10).cast("long")
    each = df.groupBy(F.col(group).alias("__g")).agg(counts.alias("__v")).withColumn("__h", order)
    shapes = [(tuple(r["__v"]), r.n) for r in each.groupBy("__v").agg(F.count("*").alias("n")).limit(most + 1).collect()]
    if len(shapes) > most:
        raise ValueError(f"groups of more than {most} shapes")
    given = []
    for v, by_fold in deal(shapes, folds, steps).items():
        given.append((list(v), [sum(by_fold[: f + 1]) for f in range(folds)]))
    ends = df.sparkSession.createDataFrame(given, "__v array<long>, __e array<long>")
    placed = R.ranks(each, "__h", "__k", ["__v"], tie=["__g"]).join(ends, "__v")
    placed = placed.select("__g", F.size(F.filter("__e", lambda e: e < F.col("__k"))).alias("fold"))
    return df.join(placed, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
