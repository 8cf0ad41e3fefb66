"""Operator 2: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Shards take row counts at most one apart. How many rows of each input partition go to each shard is drawn exactly: the multivariate
hypergeometric counts are split down a binary tree over the partitions, from seeds, so each task derives its own row of the
matrix and nothing but the partitions' sizes is sent (8 bytes a partition). A task permutes its shard numbers locally; rows are exchanged by shard and by
the leading bits of a random key drawn for each (a bucket of some ``BUCKET`` bytes), and each bucket is permuted again by the whole keys. A bucket's first slot is
the sum of the sizes of those before it in its shard; these are counted beforehand from the same seeds, without reading the rows. All orders of the rows are equally likely.

Draws from fewer than ``NUMPY_MOST`` rows are the library's; larger ones invert the distribution in decimal numbers of 60 digits, and start again with twice as many
where the outcome would depend on digits that aren't sure.

The input's partitions have to hold the same rows whenever they are computed, as scans of files and written tables do;
a task that finds another number of rows than was counted fails rather than give wrong sizes.

Law: ``rows``. Groups of equal texts are not kept together: the order is uniform.
Defined results: null and empty texts, rows without an id and repeated rows are rows like any other; texts of any length travel whole, once; columns named ``shard`` or
``slot`` are replaced, any others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SHARDS, SEED = 16, 20240229
#: Bytes of a bucket, by the plan's own estimate of its size; rows of a bucket where it has none.
BUCKET, BUCKET_ROWS = 1 << 20, 4_000
#: The library's sampler takes populations below this number.
NUMPY_MOST = 10**9
#: What a seed is for.
MATRIX, LOCAL = 1, 2


def _log_factorial(n: int) -> decimal.Decimal:
    """ln n! in the current precision: Stirling's series, carried up from a number large enough for its terms to fade."""
    digits = decimal.getcontext().prec
    shift, x = 0, n
    product = decimal.Decimal(1)
    while x < 4 * digits:
        x += 1
        shift += 1
        product *= x
    d = decimal.Decimal(x)
    pi = decimal.Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534211706798214808651")
    total = d * d.ln() - d + (2 * pi * d).ln() / 2
    for k, (a, b) in enumerate(BERNOULLI, 1):
        total += decimal.Decimal(a) / (decimal.Decimal(b) * 2 * k * (2 * k - 1)) / d ** (2 * k - 1)
    return total - product.ln()


def _bernoulli(most: int) -> list[tuple[int, int]]:
    """The Bernoulli numbers B2, B4, ... as fractions."""
    from fractions import Fraction

    b: list[Fraction] = []
    for m in range(2 * most + 1):
        b.append(Fraction(int(m == 0)) - sum((math.comb(m, k) * b[k] / (m - k + 1) for k in range(m)), Fraction(0)))
    return [(b[2 * k].numerator, b[2 * k].denominator) for k in range(1, most + 1)]


BERNOULLI = _bernoulli(24)


def _invert(u_bits: int, bits: int, good: int, bad: int, draws: int) -> int | None:
    """The outcome that a uniform number of that many bits stands for, outward from the mode; None if it is too close to call."""
    D = decimal.Decimal
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    f = _log_factorial
    up = p = down = (f(good) - f(mode) - f(good - mode) + f(bad) - f(draws - mode) - f(bad - draws + mode) - f(good + bad) + f(draws) + f(good + bad - draws)).exp()
    unsure = D(10) ** (30 - decimal.getcontext().prec)
    u, a, b, at = D(u_bits) / D(2**bits) - p, mode, mode, mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up = up * ((good - b) * (draws - b)) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            at, before, u = b, u, u - up
            if u <= 0:
                return None if min(-u, before) < unsure else at
        if a > low:
            down = down * (a * (bad - draws + a)) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            at, before, u = a, u, u - down
            if u <= 0:
                return None if min(-u, before) < unsure else at
    return None if abs(u) < unsure else at


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw for any sizes."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return min(draws, good)
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    bits, digits, u = 0, 60, 0
    while True:
        while bits < 4 * digits:
            u, bits = (u << 32) | int(rng.integers(0, 2**32)), bits + 32
        with decimal.localcontext() as c:
            c.prec = digits
            found = _invert(u, bits, good, bad, draws)
        if found is not None:
            return found
        digits *= 2
        if digits > 100:  # the constants have no more digits; the chance is below 1e-30
            raise ArithmeticError("a draw is too close to call")


def split(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """How many of draws rows fall to each shard with that much room left: multivariate hypergeometric."""
    if room.sum() < NUMPY_MOST:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for i, r in enumerate(room):
        out[i] = hypergeometric(rng, int(r), left - int(r), draws)
        draws -= int(out[i])
        left -= int(r)
    return out


def matrix_row(before: np.ndarray, part: int, room: np.ndarray, seed: int) -> np.ndarray:
    """The counts of one partition; before[p]: rows of the partitions ahead of p. One draw a shard and tree level."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, MATRIX, low, high]), room, int(before[middle] - before[low]))
        if part < middle:
            room, high = left, middle
        else:
            room, low = room - left, middle
    return room


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _bucket_bits(rows: DataFrame, n: int, shards: int, bucket: int | None) -> int:
    """Leading bits of the key that number the buckets of a shard."""
    each = bucket
    if each is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        each = max(1, n * BUCKET // size) if 0 < size < n << 26 else BUCKET_ROWS  # beyond 64 MB a row the plan doesn't know its size
    return max(0, math.ceil(math.log2(max(1, n / shards / each))))


def shuffle(rows: DataFrame, shards: int = SHARDS, bucket: int | None = None, seed: int = SEED) -> DataFrame:
    """rows with ``shard`` int and ``slot`` long, gapless from 0 in each shard. bucket: rows of a bucket (by the plan's size if not given)."""
    spark = rows.sparkSession
    shared.text_batches(spark)
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("shard", "slot")])
    n_parts = rows.rdd.getNumPartitions()
    lean = rows.select(F.lit(1).alias("one"))  # reads no columns

    def size(batches):
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(b.num_rows for b in batches)], pa.int64())], names=["part", "n"])

    counts = {r["part"]: r["n"] for r in lean.mapInArrow(size, "part int, n long").collect()}  # one number a partition
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(n_parts)])])
    n = int(before[-1])
    sizes, bits = shard_sizes(n, shards), _bucket_bits(rows, n, shards, bucket)
    sent = spark.sparkContext.broadcast(before)  # 8 bytes a partition
    c_bucket, c_key, c_row = shared.free([*rows.columns, "shard", "slot"], "bucket", "key", "row")
    own = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(c_bucket, T.LongType()), T.StructField(c_key, T.LongType()), T.StructField(c_row, T.LongType())])

    def deal(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), sent.value
        row = matrix_row(before, part, sizes, seed)
        order = np.random.default_rng([seed, LOCAL, part, 0]).permutation(np.repeat(np.arange(shards, dtype=np.int32), row))
        at, rng = 0, np.random.default_rng([seed, LOCAL, part, 1])
        for b in batches:
            mine = order[at : at + b.num_rows]
            if len(mine) < b.num_rows:
                raise RuntimeError(f"partition {part} has more rows than were counted: its input isn't repeatable")
            keys = rng.integers(0, 2**63, b.num_rows, np.int64)
            number = np.arange(before[part] + at, before[part] + at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine), pa.array(keys >> (63 - bits)), pa.array(keys), pa.array(number)], names=[*b.schema.names, *own.names])
        if at != len(order):
            raise RuntimeError(f"partition {part} has fewer rows than were counted: its input isn't repeatable")

    sums = lean.mapInArrow(deal, T.StructType([T.StructField("one", T.IntegerType()), *own])).groupBy("shard", c_bucket).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(c_bucket).rowsBetween(Window.unboundedPreceding, -1)
    (c_first,) = shared.free([*rows.columns, "shard", "slot", *own.names], "first")
    starts = sums.select("shard", c_bucket, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(c_first))
    starts = shared.written(starts, "shard-buckets")  # a row for each bucket's bytes
    # as many partitions as the input has, at least: what a task reads doesn't depend on the session's number
    dealt = rows.mapInArrow(deal, T.StructType(rows.schema.fields + own.fields)).repartition(max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard", c_bucket)
    ranked = dealt.withColumn(c_row, F.row_number().over(Window.partitionBy("shard", c_bucket).orderBy(c_key, c_row)))
    return ranked.join(starts, ["shard", c_bucket]).select(*rows.columns, "shard", (F.col(c_first) + F.col(c_row) - 1).cast("long").alias("slot"))
