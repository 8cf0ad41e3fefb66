"""Whitening, phrase collocations and embedding near-duplicates against brute force, and on edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import phrases, pq_dedup, queries, whitening

VECTORS = "vec_id long, embedding array<double>, label int, X string, V int, Node string, whitened int"
BAD = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 1.0]]


def frame(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, "x", 1, "n", 2) for r in rows], schema).repartition(3)


def whitened(rows, k):
    """By numpy's own eigenvectors, from exact integers: {component: (value, share)}, vectors by row, deviations."""
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    d = len(x) * x - x.sum(axis=0)
    c = d / len(x)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e / (c**2).sum() * len(x), c @ u / np.sqrt(e), (d.astype(object) ** 2).sum(axis=1)


@pytest.mark.parametrize(("dims", "components"), [(5, 3), (64, 32), (150, 4)])
def test_whitening_matches_numpy(spark, dims, components):
    rng = np.random.default_rng(dims)
    v = (rng.normal(size=(400, dims)) * np.linspace(1, 3, dims)).tolist()
    got = {r["vec_id"]: r for r in whitening.whiten(frame(spark, [(i, x, 0) for i, x in enumerate(v)]), components).collect()}
    share, z, deviation = whitened(v, components)
    mine = np.array([got[i]["whitened"] for i in range(400)])
    turn = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * turn - z).max() < 1e-7
    assert np.abs(np.array(got[0]["explained"]) / share - 1).max() < 1e-8
    assert all(int(got[i]["deviation"]) == deviation[i] for i in range(400))
    assert got[7]["n"] == 400
    assert got[7]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    rows = [(i, b, 0) for i, b in enumerate(BAD)] + [(9, [1.0, 2.0], 0), (10, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0, 0.0], None)]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in out) == [(False, 10), (False, 10), (True, None)]
    assert {len(r["whitened"]) for r in out} == {1}  # one direction has variance
    assert all(r["explained"] == [pytest.approx(1)] for r in out)
    assert {r["n"] for r in out} == {3}
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r["whitened"], int(r["deviation"])) for r in same] == [([], 0)] * 2
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 0)])).collect() == []


def test_whitening_deviation_beyond_64_bits(spark):
    out = whitening.whiten(frame(spark, [(1, [1e9], 0), (2, [-1e9], 0), (3, [0.0], 0)])).collect()
    x = [int(64e9), int(-64e9), 0]
    assert {r["vec_id"]: int(r["deviation"]) for r in out} == {i + 1: (3 * y) ** 2 for i, y in enumerate(x)}


def test_lobpcg_equal_and_close_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    values = np.concatenate([[5.0, 5.0, 5.0, 4.999999, 3.0], np.linspace(1, 0, 115)])
    e, x, residual = whitening.lobpcg(lambda w: q * values @ (q.T @ w), 120, 5)
    assert np.allclose(e, values[:5], atol=1e-12)
    assert np.allclose(x.T @ x, np.eye(5), atol=1e-12)
    assert residual.max() < 1e-9


def test_whitening_query(spark):
    out = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    n = out.select("vec_id").distinct().count()
    assert out.count() == 32 * n
    assert out.schema.simpleString() == "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"


def collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for text, lang in docs:
        x = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[x] += len(w)
            for k in range(1, 5):
                f[x].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for x, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i : i + k]]}
        rows = []
        for p in found.keys() - inside:
            s, k = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(x, i + 1, p.decode(), -a, lo, r, n[x], -s) for i, (s, a, p, lo, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = ["a", "B", "the", "É", "漢", "x-y", "\x0bq", "new york", "of the", "aa aa", "😀", "Z z"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\t", "\n", ";;", "?"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("...", "xx"), ("a " * 5000, "en"), ("B b. " * 3000, "de"), ("no end " * 2000, "one"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("least", "top", "block"), [(30, 2000, phrases.BLOCK), (3, 7, 500), (2, 2000, 1)])
def test_collocations_match_brute_force(spark, texts, least, top, block):
    docs = spark.createDataFrame([(i, t, x, "w", 1, "p", 0) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, Words string, id int, phrase string, A int").repartition(4)
    assert sorted(map(tuple, phrases.collocations(docs, least=least, top=top, block=block).collect())) == collocations(texts, least, top)


def test_collocations_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def test_vertical_lists_round_trip():
    rng = np.random.default_rng(1)
    key, at = rng.integers(0, 50, 3000), np.sort(rng.choice(2**31, 3000, replace=False))
    distinct, lengths, steps = phrases._lists(key, at)
    which, position = phrases._positions(lengths, steps)
    assert sorted(zip(distinct[which], position, strict=True)) == sorted(zip(key, at, strict=True))


def near(rows):
    """[(vec_id, n_links, component, kept)] by all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and label is not None and i is not None for i, v, label in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            (_, x, la), (_, y, lb) = rows[a], rows[b]
            if ok[a] and ok[b] and la == lb and len(x) == len(y):
                x, y = (np.array(z) / np.abs(z).max() for z in (x, y))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), least, i == least))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(9)
    rows = []
    for g in range(40):
        base = rng.normal(size=20)
        for _ in range(int(rng.choice([1, 2, 5, 40]))):
            rows.append((len(rows), (base + rng.normal(size=20) * rng.choice([0, 0.05, 0.12, 0.3])).tolist(), g % 3))
    rows += [(1000 + i, b, 0) for i, b in enumerate(BAD)] + [(1010, [0.0] * 20, 0), (1011, rows[0][1], None), (None, rows[0][1], 0), (1012, [0.0] * 20, 1)]
    rows += [rows[0], rows[3], (1, rows[60][1], rows[60][2])]  # repeated rows; an id with two vectors
    rows += [(2000 + i, (np.array(rows[5][1]) * s).tolist(), rows[5][2]) for i, s in enumerate([1e-200, 1e200, 2.0, -1.0])]
    rows += [(3000, [1.0, 2.0, 0.5], 0), (3001, [1.0, 2.0, 0.51], 0), (3002, rows[0][1] + [0.0], 0), (3003, rows[0][1] + [0.01], 0)]
    return rows


@pytest.mark.parametrize(("chunk", "sample"), [(16, 20_000), (64, 30), (5000, 20_000)])
def test_near_embeddings_match_all_pairs(spark, crowd, chunk, sample):
    got = pq_dedup.near_groups(frame(spark, crowd), chunk=chunk, sample=sample).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr) == [(*r[:3], r[3]) for r in near(crowd)]


def test_near_embeddings_edges(spark):
    assert pq_dedup.near_groups(frame(spark, [])).collect() == []
    only_bad = pq_dedup.near_groups(frame(spark, [(i, b, 0) for i, b in enumerate(BAD)])).collect()
    assert sorted(map(tuple, only_bad)) == [(i, 0, i, True) for i in range(len(BAD))]
    alone = pq_dedup.near_groups(frame(spark, [(4, [1.0, 0.0], 7)])).collect()
    assert list(map(tuple, alone)) == [(4, 0, 4, True)]


def test_probes_and_distances_are_bounds(spark):
    """No vector within reach is in a list that isn't probed, or farther by its codes than they allow."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    x[300:] = x[:300] + 0.05 * rng.normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, r = pq_dedup.Index(x[:200], 10), 0.2
    placed = [index.place(v, r) for v in x]
    for a in range(600):
        for b in np.flatnonzero(np.linalg.norm(x - x[a], axis=1) <= r):
            low, high = sorted((a, b), key=lambda k: placed[k][0])
            assert placed[low][0] == placed[high][0] or placed[high][0] in placed[low][1]
            distance = index.distances(x[a : a + 1], placed[b][0], placed[b][2][None])[0, 0]
            assert distance <= r + placed[b][3] + 1e-9


def test_near_embeddings_query_has_all_rows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert queries.op13_pq_dedup(spark, "/root/testdata/sf0.001").select("vec_id").exceptAll(vectors.select("vec_id")).count() == 0
    assert vectors.where(F.col("vec_id").isNull()).count() == 0
