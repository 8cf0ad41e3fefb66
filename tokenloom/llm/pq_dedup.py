"""Operator 13: near-duplicate embeddings by product quantisation.

Rows with equal vectors and labels are one class; classes are compared, and only if their labels are equal.

1. Fit: coarse centroids and, for each of ``SUBSPACES`` groups of dimensions, ``CODES`` codewords of residuals, by k-means on a sample
   of at most ``SAMPLE`` classes and ``SAMPLE_BYTES`` (the smallest hashes; the driver holds no more).
2. Index: every class goes to the inverted list of its label, length and nearest centroid, with the codes of its residual and
   the length of what the codes leave over. Lists are stored in chunks of at most about ``CHUNK`` classes.
3. Probes: vectors u and v of unit length with cosine s are sqrt(2 - 2s) = r apart, and so v can only be nearer to centroid j than to u's own
   centroid i if u is within r of the plane between them. A class probes exactly the lists for which that holds, and its own:
   probes are sufficient, so that of two linked classes each probes the other's list, and the one of the smaller centroid does it.
4. Distances: a table per class of the squared distances of its residual's parts to all codewords; a member's distance is the sum of the entries that its codes
   name. It is off by no more than what the codes leave over (triangle inequality), so a member farther than r plus that can't be linked.
5. What is left is reranked by the exact cosine of the whole vectors in double precision.

No link is lost: all bounds are proven, with ``SLACK`` for rounding; how well the sample fits decides the speed alone. A pair of chunks
returns a row per linked member (its number of links there, and a member of its component), so groups of near copies are
never expanded into pairs. Links are counted and components closed over those rows.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite entries, and rows without label or
id link with nothing: n_links 0, their own component, kept. Only vectors of one length are compared (the index reads as many entries as the commonest length
has, which can only shorten distances). Repeated rows and rows that share an id are vectors of their own; the component is the smallest id in it. An empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .near_dedup import components

SIMILAR = 0.98
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
SUBSPACES, CODES, LLOYD = 8, 256, 8
#: Classes of a chunk, and of the largest label for each centroid; bytes of a chunk's vectors; centroids at most.
CHUNK, CHUNK_BYTES, CENTROIDS = 1024, 8 << 20, 4096
SLACK = 1e-9
#: Classes of a chunk compared at a time.
AT_ONCE = 256


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _head(v: np.ndarray, d: int) -> np.ndarray:
    """The first d entries, zeros beyond the vector's end."""
    return v[:d] if len(v) >= d else np.append(v, np.zeros(d - len(v)))


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of to."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ to.T) + (to * to).sum(axis=1))


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    """At most k centroids."""
    at = np.unique(x, axis=0)
    c = at[rng.permutation(len(at))[:k]]
    for _ in range(LLOYD):
        near = np.concatenate([_nearest(x[a : a + 2048], c).argmin(axis=1) for a in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=col, minlength=len(c)) for col in x.T], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Centroids and codewords for the first d entries of unit vectors."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.d = sample.shape[1]
        self.centroids = _kmeans(sample, cells, rng)
        self.parts = np.array_split(np.arange(self.d), min(SUBSPACES, self.d))
        near = np.concatenate([_nearest(sample[a : a + 2048], self.centroids).argmin(axis=1) for a in range(0, len(sample), 2048)])
        rest = sample - self.centroids[near]
        self.words = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]
        self.apart = np.sqrt(_nearest(self.centroids, self.centroids))

    def place(self, u: np.ndarray, r: float) -> tuple[int, list[int], np.ndarray, float]:
        """A vector's list, the lists after it that it probes, its codes, what they leave over."""
        d2 = ((self.centroids - u) ** 2).sum(axis=1)
        own = int(d2.argmin())
        probes = np.flatnonzero(d2 - d2[own] <= 2 * r * self.apart[own] + SLACK)
        rest = u - self.centroids[own]
        codes = np.array([((w - rest[p]) ** 2).sum(axis=1).argmin() for p, w in zip(self.parts, self.words, strict=True)], np.uint8)
        left = rest - np.concatenate([w[c] for w, c in zip(self.words, codes, strict=True)])
        return own, [int(j) for j in probes if j > own], codes, float(np.sqrt(left @ left))

    def distances(self, heads: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """From each vector to what the codes of each member of a list say, by table lookup."""
        rest, out = heads - self.centroids[cell], np.zeros((len(heads), len(codes)))
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            out += _nearest(rest[:, p], w)[:, codes[:, k]]
        return np.sqrt(out)


def _classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, same), same null where a row links with nothing; the classes (node, label, same, v, copies, first)."""
    shared.text_batches(vectors.sparkSession)
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), vectors[embedding].cast("array<double>").alias("v")).withColumn("v", F.when(good, v))
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw = [None if x is None else np.asarray(x, np.float64) + 0.0 for x in b.column("v").to_numpy(zero_copy_only=False)]
            same = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(same, pa.binary()), pa.array([None if x is None else x.tobytes() for x in raw], pa.binary())], names=["vec_id", "label", "same", "v"])

    rows = shared.written(rows.mapInArrow(run, f"vec_id long, label {kind}, same binary, v binary"), "pq-rows")
    classes = rows.where("same IS NOT NULL").groupBy("label", "same").agg(F.min("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return rows, shared.written(classes.withColumn("node", F.monotonically_increasing_id()), "pq-classes")


def fit(classes: DataFrame, chunk: int, sample: int = SAMPLE) -> Index | None:
    """The index of a bounded sample; as many centroids as the largest label has chunks."""
    common = classes.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return None
    d = common["n"] // 8
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    most = min(sample, max(CODES, SAMPLE_BYTES // (8 * d)))
    rows = classes.where(F.length("v") == 8 * d).orderBy(F.xxhash64("same"), "node").select("v").limit(most).collect()
    return Index(np.stack([_unit(np.frombuffer(x["v"])) for x in rows]), min(CENTROIDS, len(rows), -(-largest // chunk)))


def lists(classes: DataFrame, index: Index, r: float, chunk: int) -> DataFrame:
    """The inverted lists (label, d, cell, chunk, block, nodes, copies, vectors, codes, over, probes): a row per chunk."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw = [np.frombuffer(x) for x in b.column("v").to_pylist()]
            placed = [index.place(_head(_unit(x), index.d), r) for x in raw]
            cols = [b.column("label"), pa.array([len(x) for x in raw], pa.int32()), pa.array([p[0] for p in placed], pa.int32()), b.column("node"), b.column("copies"), b.column("v"), pa.array([p[2].tobytes() for p in placed], pa.binary()), pa.array([p[3] for p in placed], pa.float64()), pa.array([p[1] for p in placed], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "d", "cell", "node", "copies", "v", "code", "over", "probes"])

    coded = shared.written(classes.select("label", "node", "copies", "v").mapInArrow(run, f"label {kind}, d int, cell int, node long, copies long, v binary, code binary, over double, probes array<int>"), "pq-coded")
    sizes = coded.groupBy("label", "d", "cell").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum(F.length("v")) / CHUNK_BYTES)).alias("chunks"))
    dealt = coded.join(sizes, ["label", "d", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    member = F.struct("node", "copies", "v", "code", "over", "probes")
    packed = dealt.groupBy("label", "d", "cell", "chunk").agg(F.collect_list(member).alias("m"), F.max("chunks").alias("chunks"))
    out = shared.written(packed.withColumn("block", F.monotonically_increasing_id()), "pq-lists")
    shared.drop(coded)
    return out


def _compare(index: Index, similar: float, r: float):
    """Of each pair of chunks (a, b): a row (node, hub, links) for each linked member."""

    def side(m):
        get = lambda f: m.field(f).to_numpy(zero_copy_only=False)
        v = np.stack([np.frombuffer(x) for x in m.field("v").to_pylist()])
        v = v / np.abs(v).max(axis=1)[:, None]
        return get("node"), get("copies"), v / np.sqrt((v * v).sum(axis=1))[:, None], np.frombuffer(b"".join(m.field("code").to_pylist()), np.uint8).reshape(len(m), -1), get("over"), m.field("probes").to_pylist()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a_cell, b_cell, alone = (batch.column(x)[i].as_py() for x in ("cell_a", "cell_b", "alone"))
                an, ac, av, _, _, probes = side(batch.column("ma")[i].values)
                bn, bc, bv, codes, over, _ = side(batch.column("mb")[i].values)
                asks = np.arange(len(an)) if a_cell == b_cell else np.array([k for k, p in enumerate(probes) if b_cell in p], int)
                heads = av[:, : index.d] if av.shape[1] >= index.d else np.hstack([av, np.zeros((len(av), index.d - av.shape[1]))])
                us, vs = [], []
                for k in range(0, len(asks), AT_ONCE):
                    own = asks[k : k + AT_ONCE]
                    u, v = np.nonzero(index.distances(heads[own], b_cell, codes) <= r + over + SLACK)
                    u = own[u]
                    if alone:  # a chunk with itself: each pair once
                        u, v = u[u < v], v[u < v]
                    for c in range(0, len(u), 8192):
                        cosine = np.einsum("ij,ij->i", av[u[c : c + 8192]], bv[v[c : c + 8192]])
                        linked = np.flatnonzero(cosine >= similar) + c
                        us.append(u[linked])
                        vs.append(v[linked])
                u, v = (np.concatenate(x) if x else np.zeros(0, int) for x in (us, vs))
                if not len(u):
                    continue
                shift = 0 if alone else len(an)
                nodes, copies = (an, ac) if alone else (np.append(an, bn), np.append(ac, bc))
                v = v + shift
                links = np.bincount(u, weights=copies[v], minlength=len(nodes)) + np.bincount(v, weights=copies[u], minlength=len(nodes))
                hub = np.arange(len(nodes))
                while True:
                    was = hub.copy()
                    least = np.minimum(hub[u], hub[v])
                    np.minimum.at(hub, u, least)
                    np.minimum.at(hub, v, least)
                    hub = hub[hub]
                    if (hub == was).all():
                        break
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[hub[at]]), pa.array(links[at].astype(np.int64))], names=["node", "hub", "links"])

    return run


def linked(stored: DataFrame, index: Index, similar: float, r: float) -> DataFrame:
    """(node, hub, links) of each pair of chunks that a probe brings together: links there, and a member of the component there."""
    light = stored.select("block", "label", "d", "cell", "chunk", "chunks", F.array_distinct(F.flatten(F.transform("m", lambda x: x["probes"]))).alias("probes"))
    within = light.select(F.col("block").alias("a"), "label", "d", F.col("cell").alias("to"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"))
    sizes = light.groupBy("label", "d", F.col("cell").alias("to")).agg(F.max("chunks").alias("chunks"))
    across = light.select(F.col("block").alias("a"), "label", "d", F.explode("probes").alias("to")).join(sizes, ["label", "d", "to"])
    across = across.select("a", "label", "d", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    ends = light.select("label", "d", F.col("cell").alias("to"), "chunk", F.col("block").alias("b"))
    pairs = within.unionAll(across).join(ends, ["label", "d", "to", "chunk"]).select("a", "b", F.col("to").alias("cell_b"), (F.col("a") == F.col("b")).alias("alone"))
    heavy = lambda s: stored.select(F.col("block").alias(s), F.col("m").alias(f"m{s}"), *([F.col("cell").alias("cell_a")] if s == "a" else []))
    met = pairs.join(heavy("a"), "a").join(heavy("b"), "b").select("cell_a", "cell_b", "alone", "ma", "mb")
    return met.mapInArrow(_compare(index, similar, r), "node long, hub long, links long")


def near_groups(vectors: DataFrame, similar: float = SIMILAR, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows, classes = _classes(vectors, vec_id, embedding, label)
    alone = rows.where("same IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    index, r = fit(classes, chunk, sample), float(np.sqrt(max(0.0, 2 - 2 * similar)))
    if index is None:
        return alone.withColumn("kept", F.lit(True))
    stored = lists(classes, index, r, chunk)
    found = shared.written(linked(stored, index, similar, r), "pq-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "label", "same", "copies", "first").join(counts, "node", "left").join(groups.select("node", F.col("label").alias("hub")), "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    smallest = named.groupBy("hub").agg(F.min("first").alias("component_id"))
    named = shared.written(named.join(smallest, "hub").select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "pq-found")
    shared.drop(stored, found, groups)
    out = rows.where("same IS NOT NULL").join(named, ["label", "same"]).select("vec_id", "n_links", "component_id")
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
