"""Rank tests, folds and machines against their definitions."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import folds as G
from tokenloom.operators import machines as X
from tokenloom.operators import metrics as M


def by_enumeration(d):
    """(two-sided, less, greater) over all signings of the ranks."""
    n = len(d)
    rank = {i: k + 1 for k, i in enumerate(sorted(range(n), key=lambda i: abs(d[i])))}
    w = sum(rank[i] for i in range(n) if d[i] > 0)
    sums = [sum(k + 1 for k in range(n) if s >> k & 1) for s in range(2**n)]
    less, greater = sum(x <= w for x in sums) / 2**n, sum(x >= w for x in sums) / 2**n
    return min(1, 2 * min(less, greater)), less, greater


def test_exact_signed_ranks_match_enumeration(spark):
    rng = np.random.default_rng(3)
    groups = {n: (rng.permutation(n) + 1.0) * rng.choice([-1, 1], n) for n in range(1, 13)} | {20: np.array([1, 2, 3, 4, 5, -6.0])}
    rows = [(g, float(x), 0.0) for g, d in groups.items() for x in d]
    got = {r.g: r for r in M.signed_rank_test(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ["g"]).collect()}
    for g, d in groups.items():
        r = got[g]
        assert (r.p_two_sided, r.p_less, r.p_greater) == pytest.approx(by_enumeration(d), abs=1e-12)
        assert r.method == "exact"
    assert got[20].p_two_sided == 0.4375


def test_signed_ranks_beyond_the_exact_case(spark):
    rows = [(1, 1.0, 0.0), (1, 1.0, 2.0), (1, 5.0, 0.0)]  # tied
    rows += [(2, 1.0, 1.0), (2, 3.0, 1.0), (2, 5.0, 1.0)]  # a zero
    rows += [(3, float(k + 1) * (-1) ** (k % 3), 0.0) for k in range(51)]  # too many
    rows += [(4, float(k + 1) * (-1) ** (k % 3), 0.0) for k in range(50)]
    rows += [(5, None, 1.0), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r.g: r for r in M.signed_rank_test(df, "a", "b", ["g"]).collect()}
    assert {g: r.method for g, r in got.items() if g != 5 and g is not None} == {1: "normal", 2: "normal", 3: "normal", 4: "exact"}
    assert 5 not in got
    normal = {r.g: r for r in M.signed_rank_test(df, "a", "b", ["g"], method="normal").collect()}
    assert abs(normal[4].p_two_sided - got[4].p_two_sided) < 0.01
    for g in (1, 2, 3):
        assert [got[g][c] for c in ("p_two_sided", "p_less", "p_greater")] == [normal[g][c] for c in ("p_two_sided", "p_less", "p_greater")]
    z = (4.5 - 3) / math.sqrt(14 / 4 - 6 / 48)  # ranks 1.5, 1.5 and 3
    assert got[1].p_greater == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-6)


def one_by_one(shapes, folds):
    """deal() for few groups: each group by itself, shares as fractions."""
    total = np.sum([np.array(v) * n for v, n in shapes], axis=0)
    held, out = np.zeros((folds, len(total))), Counter()
    for v, n in sorted(shapes, key=lambda x: (-sum(x[0]), [-y for y in x[0]])):
        for _ in range(n):
            f = min(range(folds), key=lambda f: (round(sum(held[f, c] * v[c] / total[c] ** 2 for c in range(len(v)) if total[c]), 12), held[f].sum(), f))
            held[f] += v
            out[v, f] += 1
    return out


def test_groups_are_dealt_one_by_one_while_they_are_few():
    rng = np.random.default_rng(5)
    shapes = [(tuple(int(x) for x in v), int(rng.integers(1, 6))) for v in {tuple(rng.integers(0, 9, 3)) for _ in range(60)} if sum(v)]
    got = G.deal(shapes, 3, 200_000)
    want = one_by_one(shapes, 3)
    assert all(got[v][f] == want[v, f] for v, _ in shapes for f in range(3))


def test_many_groups_are_balanced_in_few_decisions():
    shapes = [((1,), 50_000_000), ((7,), 3_000_001), ((100_000_000,), 1), ((2,), 5)]
    got = G.deal(shapes, 3, 1000)
    rows = [sum(v[0] * by[f] for v, by in got.items()) for f in range(3)]
    assert sum(rows) == sum(v[0] * n for v, n in shapes)
    assert max(rows) == 100_000_000
    assert abs(rows[1] - rows[2]) <= 2


@pytest.mark.parametrize("label", [None, "y"])
def test_group_folds(spark, label):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 97 == 0 else int(rng.integers(0, 60) ** 1.3), None if i % 50 == 0 else "ab"[int(rng.random() < 0.2)], "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g int, y string, __x string").repartition(3)
    got = G.group_folds(df, "g", label, 3, seed=4).collect()
    assert sorted(r.id for r in got) == list(range(3000))
    assert all(len({r.fold for r in got if r.g == g}) == 1 for g in {r.g for r in got})
    biggest = max(Counter(r.g for r in got).values())
    sizes = Counter(r.fold for r in got)
    assert set(sizes) == {0, 1, 2}
    assert max(sizes.values()) - min(sizes.values()) <= biggest
    if label:
        for y in ("a", "b", None):
            share = [sum(r.y == y for r in got if r.fold == f) / sizes[f] for f in range(3)]
            assert max(share) - min(share) < 0.03
    assert got and sorted((r.id, r.fold) for r in G.group_folds(df.repartition(5), "g", label, 3, seed=4).collect()) == sorted((r.id, r.fold) for r in got)


def test_group_folds_edges(spark):
    empty = spark.createDataFrame([], "g int, y string")
    assert G.group_folds(empty, "g").collect() == []
    assert G.group_folds(empty, "g", "y").collect() == []
    one = spark.createDataFrame([(1, "a"), (1, "b")], "g int, y string")
    assert {r.fold for r in G.group_folds(one, "g", "y").collect()} == {0}
    with pytest.raises(ValueError, match="shapes"):
        G.group_folds(spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "g int, y string"), "g", most=1)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4))
    ring = (np.linalg.norm(x, axis=1) > 1.85).astype(int)
    k = np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    e, u = np.linalg.eigh(k)
    exact = u * np.sqrt(np.maximum(e, 0))  # inner products are the kernel itself
    y = np.sin(x[:, 0]) + x[:, 1]
    rows = [(i, x[i].tolist(), exact[i].tolist(), int(ring[i]), "abc"[int(np.argmax(x[i, :3]))], float(y[i]), i % 3) for i in range(240)]
    return spark.createDataFrame(rows, "id int, v array<double>, exact array<double>, ring int, kind string, y double, fold int").repartition(3).cache()


def predicted(df, label, vector, kind, c):
    m = X.fit(df, label, vector, kind, [c])
    return [(r[0], r[1]) for r in df.select(label, m.predicted(m.margins(F.col(vector)))).collect()]


def r2(pairs):
    y, p = np.array(pairs).T
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def accuracy(pairs):
    return np.mean([a == b for a, b in pairs])


def test_fourier_features_stand_for_the_kernel(spark, points):
    rows = points.select("v", X.fourier("v", 4, 4000, gamma=0.25, seed=3).alias("z")).limit(40).collect()
    x, z = np.array([r.v for r in rows]), np.array([r.z for r in rows])
    assert np.abs(z @ z.T - np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 0.08


def test_kernel_machines_match_the_exact_kernel(points):
    mapped = points.withColumn("z", X.fourier("v", 4, 300, seed=2)).cache()
    ours, theirs = (accuracy(predicted(mapped, "ring", c, "classify", 10.0)) for c in ("z", "exact"))
    assert theirs > 0.9
    assert ours > theirs - 0.05
    assert accuracy(predicted(points, "ring", "v", "classify", 10.0)) < 0.8  # no line does it
    ours, theirs = (r2(predicted(mapped, "y", c, "regress", 10.0)) for c in ("z", "exact"))
    assert theirs > 0.95
    assert ours > theirs - 0.03


def test_linear_regression_is_at_its_optimum(points):
    """No small step lowers the absolute loss by more than the rounded corners hide."""
    m = X.fit(points, "y", "v", "regress", [2.0], epsilon=0.1, steps=200, tolerance=1e-7)
    x, y = (np.array(a) for a in zip(*[(r.v, r.y) for r in points.select("v", "y").collect()], strict=True))
    objective = lambda w: (w[:-1] ** 2).sum() / 2 + 2.0 * np.maximum(0, np.abs(x @ w[:-1] + w[-1] - y) - 0.1).sum()
    w = m.coefficients[:, 0]
    hidden = 2.0 * 240 * X.CORNER * y.std() / 2
    rng = np.random.default_rng(0)
    assert all(objective(w + rng.normal(size=5) * s) > objective(w) - hidden for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_models_of_many_settings_are_those_of_each_alone(points):
    together = X.fit(points, "kind", "v", "classify", [0.1, 5.0], "fold", steps=200, tolerance=1e-6)
    assert together.classes == ["a", "b", "c"]
    assert together.settings == [(c, f) for c in (0.1, 5.0) for f in (0, 1, 2)]
    alone = X.fit(points.where("fold <> 1"), "kind", "v", "classify", [5.0], steps=200, tolerance=1e-6)
    assert np.abs(together.coefficients[:, 12:15] - alone.coefficients).max() < 1e-3


def test_balanced_weights_raise_the_rare_class(spark):
    rng = np.random.default_rng(6)
    rows = [([float(rng.normal() + 1.2 * y)], int(y)) for y in (rng.random(600) < 0.06)]
    df = spark.createDataFrame(rows, "v array<double>, y int").repartition(2).cache()
    found = {}
    for balanced in (True, False):
        m = X.fit(df, "y", "v", "classify", balanced=balanced)
        found[balanced] = sum(r.p for r in df.select(m.predicted(m.margins(F.col("v"))).alias("p")).collect())
    assert found[True] > 3 * max(1, found[False])


@pytest.mark.parametrize(("scoring", "kind", "label"), [("accuracy", "classify", "kind"), ("roc_auc", "classify", "ring"), ("neg_rmse", "regress", "y")])
def test_grid_search_scores_are_those_of_held_out_folds(points, scoring, kind, label):
    got = {r.c: r for r in X.grid_search(points, label, "v", "fold", kind, scoring, [0.01, 1.0]).collect()}
    assert sorted(r.rank for r in got.values()) == [1, 2]
    assert max(got.values(), key=lambda r: r.score).rank == 1
    scores = []
    for f in range(3):
        m = X.fit(points.where(F.col("fold") != f), label, "v", kind, [1.0])
        rows = points.where(F.col("fold") == f).select(F.col(label).alias("y"), m.margins(F.col("v")).alias("m"), m.predicted(m.margins(F.col("v"))).alias("p")).collect()
        if scoring == "accuracy":
            scores.append(np.mean([r.y == r.p for r in rows]))
        elif scoring == "neg_rmse":
            scores.append(-np.sqrt(np.mean([(r.y - r.p) ** 2 for r in rows])))
        else:
            pairs = list(itertools.product([r.m[0] for r in rows if r.y == 1], [r.m[0] for r in rows if r.y == 0]))
            scores.append(np.mean([(a > b) + (a == b) / 2 for a, b in pairs]))
    assert got[1.0].score == pytest.approx(np.mean(scores), abs=0.01)
    assert got[1.0].sd == pytest.approx(np.std(scores), abs=0.01)


def test_machines_on_edges(spark):
    schema = "v array<double>, y int"
    with pytest.raises(ValueError, match="no rows"):
        X.fit(spark.createDataFrame([(None, 1), ([float("nan")], 1), ([1.0], None)], schema), "y", "v", "regress")
    with pytest.raises(ValueError, match="lengths"):
        X.fit(spark.createDataFrame([([1.0], 1), ([1.0, 2.0], 1)], schema), "y", "v", "regress")
    one = spark.createDataFrame([([1.0], 4), ([2.0], 4)], schema)
    odd = spark.createDataFrame([(None, 1), ([1.0, 2.0], 1), ([0.5], 1)], schema)
    assert [r.z is None for r in odd.select(X.fourier("v", 1, 3).alias("z")).collect()] == [True, True, False]
    m = X.fit(one, "y", "v", "classify")
    assert {r.p for r in one.select(m.predicted(m.margins(F.col("v"))).alias("p")).collect()} == {4}
    m = X.fit(one, "y", "v", "regress")
    assert [round(r.p, 2) for r in one.select(m.predicted(m.margins(F.col("v"))).alias("p")).collect()] == [4, 4]


def test_vectors_made_in_python_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<double>")
    def vector(x: pa.Array) -> pa.Array:
        made.add(len(x))
        v = np.asarray(x, float)
        return pa.FixedSizeListArray.from_arrays(pa.array(np.stack([np.sin(v), np.cos(v)], axis=1).ravel()), 2).cast(pa.list_(pa.float64()))

    df = spark.range(0, 300, 1, 3).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("f"), vector("id").alias("v"))
    X.grid_search(df, "y", "v", "f", "classify", "roc_auc", [1.0], steps=2).collect()
    assert made.value == 300


@pytest.mark.parametrize(("width", "rows"), [(128, 1024), (2048, 128), (10**7, 1)])
def test_blocks_of_a_batch_are_bounded(width, rows):
    v = pa.array([[k, -k] for k in range(3000)], pa.list_(pa.float32())).slice(5)
    blocks = list(X._blocks(v, width))
    assert max(len(x) for _, x in blocks) == rows and all(x.dtype == np.float64 for _, x in blocks)
    assert np.array_equal(np.concatenate([x for _, x in blocks])[:, 0], np.arange(5, 3000)) and blocks[-1][0].stop == 2995


def test_features_of_null_and_short_vectors_are_null(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0])], "k int, v array<double>").coalesce(1)
    z = {r.k: r.z for r in df.select("k", X.fourier("v", 2, 8).alias("z")).collect()}
    assert z[1] is None and z[2] is None and len(z[0]) == 8 and z[0] == z[4] and np.isnan(z[3]).all()
