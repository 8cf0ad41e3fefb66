"""Operator 8: exact top-k inner products by a three-phase uniform threshold.

Vectors are packed into blocks; every block of queries meets every block of candidates once, in a grid of groups. The dimensions of a
vector are dealt into m lists, whose scores add up to the inner product.

1. Each pair of blocks gathers the best entries of each list for each query and completes their sums; the k-th best
   sum of a query over all blocks is its cutoff, which no answer can be below. The pair also keeps each query's peak, the best score that it saw.
2. The cutoff t goes back to the pairs whose peak reaches it for some query, all others are passed over: an entry can only reach t if one of its m list scores reaches t / m,
   so the entries that do are sufficient. A query's answers lie in few blocks, so this is a small share of the pairs where there are many.
3. The remaining list scores of those entries are resolved exactly, and the k best are kept.

Components become floor(scale * x) (x as double), scores are exact integers: double-precision products are used
while every sum stays below 2**53, Python integers otherwise.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows without an id take no
part; only vectors of the query's own length are its candidates; rows with the query's id are never its candidates;
repeated query ids are one query (the smallest vector), repeated candidates are each ranked; ties go to the smaller id; a score that doesn't fit into 64 bits is an
error; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows of a block of candidates and of queries; lists.
CANDIDATES, QUERIES, LISTS = 4096, 512, 4
#: Blocks of candidates that share a group; each block of queries goes to every group of its length.
GROUP = 4
PACKED = "block string, dim int, n int, ids binary, data binary"
FOUND = "query_id long, vec_id long, score long"


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col("v")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(df[vec_id].cast("long").alias("id"), df[embedding].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size(e) > 0) & ~bad)


def _pack(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most size vectors of equal length, as float64 matrices of whole numbers."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def flush(dim):
            nonlocal k
            ids, vs = held.pop(dim)
            ids, vs = np.concatenate(ids), np.concatenate(vs)
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vs.tobytes()], pa.binary())], names=["block", "dim", "n", "ids", "data"])

        for b in batches:
            ids, v = b.column("id").to_numpy(), b.column("v")
            lengths = v.value_lengths().to_numpy()
            flat = np.floor(scale * v.flatten().to_numpy())
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                matrix = np.stack([flat[ends[i] - dim : ends[i]] for i in at])
                for a in range(0, len(at), size):
                    h = held.setdefault(int(dim), ([], []))
                    h[0].append(ids[at[a : a + size]])
                    h[1].append(matrix[a : a + size])
                    if sum(map(len, h[0])) >= size:
                        yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(run, PACKED)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _scores(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """The score matrix of each list of dimensions, exact."""
    bound = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * q.shape[1]
    cuts = np.array_split(np.arange(q.shape[1]), min(lists, q.shape[1]))
    if bound >= 2.0**53:
        q, c = (np.array([[int(x) for x in r] for r in m], dtype=object) for m in (q, c))
    return [q[:, d] @ c[:, d].T for d in cuts]


def _long(x) -> int:
    if not -(2**63) <= x < 2**63:
        raise OverflowError(f"the score {int(x)} doesn't fit into 64 bits: use a smaller scale")
    return int(x)


def _matrix(b: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b.column(f"{side}_ids")[i].as_py(), np.int64)
    return ids, np.frombuffer(b.column(f"{side}_data")[i].as_py(), np.float64).reshape(len(ids), -1)


FOUND_COLUMNS = ("query_id", "vec_id", "score")
FIRST = "q_block string, c_block string, peaks array<double>, query_id array<bigint>, vec_id array<bigint>, score array<bigint>"


def _gather(k: int, lists: int):
    """Phase 1: one row per pair of blocks, with the entries found and the peak of each query of the block."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, c) = _matrix(b, i, "q"), _matrix(b, i, "c")
                parts = _scores(q, c, lists)
                total = sum(parts)
                found, peaks = [], []
                for r in range(len(qi)):
                    own = np.flatnonzero(ci != qi[r])
                    seen = np.unique(np.concatenate([own[_best(p[r, own], ci[own], k)] for p in parts])) if len(own) else own
                    found += [(int(qi[r]), int(ci[seen[j]]), _long(total[r, seen[j]])) for j in _best(total[r, seen], ci[seen], k)]
                    # one step up, in case the double is below the integer
                    peaks.append(float(np.nextafter(float(total[r, own].max()), np.inf)) if len(own) else -np.inf)
                row = [[b.column("q_block")[i].as_py()], [b.column("c_block")[i].as_py()], [peaks], *[[[f[j] for f in found]] for j in range(3)]]
                kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["q_block", "c_block", "peaks", *FOUND_COLUMNS])

    return run


def _resolve(k: int, lists: int):
    """Phases 2 and 3 in the pairs that a cutoff reaches; cuts: the cutoffs of the block's queries, in their order, null without one."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, c) = _matrix(b, i, "q"), _matrix(b, i, "c")
                cuts, peaks = b.column("cuts")[i].as_py(), b.column("peaks")[i].as_py()
                reach = [r for r in range(len(qi)) if cuts[r] is None or peaks[r] >= cuts[r]]
                parts = _scores(q[reach], c, lists)
                found = []
                for at_row, r in enumerate(reach):
                    t = cuts[r]
                    enough = np.ones(len(ci), bool) if t is None else np.logical_or.reduce([p[at_row] * len(parts) >= t for p in parts])
                    at = np.flatnonzero(enough & (ci != qi[r]))
                    score = sum(p[at_row, at] for p in parts)
                    if t is not None:
                        at, score = at[score >= t], score[score >= t]
                    found += [(int(qi[r]), int(ci[at[j]]), _long(score[j])) for j in _best(score, ci[at], k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=list(FOUND_COLUMNS))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", lists: int = LISTS, candidates: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k best candidates."""
    shared.text_batches(vectors.sparkSession)
    wanted = _usable(queries, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v"))
    q = shared.written(_pack(wanted.select("id", "v"), query_rows, scale), "topk-queries")
    c = shared.written(_pack(_usable(vectors, vec_id, embedding), candidates, scale), "topk-candidates")
    groups = max(1, c.count() // GROUP)
    side = lambda df, s, *more: df.select(F.col("block").alias(f"{s}_block"), "dim", F.col("ids").alias(f"{s}_ids"), F.col("data").alias(f"{s}_data"), *more)
    qs = side(q, "q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    cs = side(c, "c", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"))
    # keys are a length and a group, so that no side has few keys; merged at every size: nothing is broadcast
    pairs = qs.hint("merge").join(cs, ["dim", "g"]).select("q_block", "c_block", "q_ids", "q_data", "c_ids", "c_data")
    first = shared.written(pairs.mapInArrow(_gather(k, lists), FIRST), "topk-first")

    def best(found: DataFrame) -> DataFrame:
        order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
        return found.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))

    gathered = first.select(F.explode(F.arrays_zip(*FOUND_COLUMNS)).alias("f")).select("f.*")
    cut = best(gathered).where(F.size("top") == k).select("query_id", (-F.element_at("top", k)["s"]).alias("cut"))
    # the cutoffs of each block's queries, in their order: at most query_rows of them
    cuts = wanted_blocks(q).join(cut, "query_id", "left").groupBy("q_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cut"))), lambda x: x["cut"]).alias("cuts"))
    reached = first.select("q_block", "c_block", "peaks").join(cuts, "q_block")
    reached = reached.where(F.exists(F.zip_with("cuts", "peaks", lambda t, p: t.isNull() | (p >= t)), lambda x: x))
    again = reached.join(side(q, "q").drop("dim"), "q_block").join(side(c, "c").drop("dim"), "c_block").select("q_ids", "q_data", "c_ids", "c_data", "cuts", "peaks")
    final = best(again.mapInArrow(_resolve(k, lists), FOUND))
    return final.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def wanted_blocks(q: DataFrame) -> DataFrame:
    """(q_block, at, query_id) of packed queries."""

    def run(batches):
        for b in batches:
            for name, ids in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["q_block", "at", "query_id"])

    return q.select("block", "ids").mapInArrow(run, "q_block string, at int, query_id long")
