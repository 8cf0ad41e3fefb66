"""Linkage in rounds against the step-by-step definition."""

import itertools

import numpy as np
import pytest

from tokenloom.operators import clusters


def step_by_step(rows):
    key = {(min(a, b), max(a, b)): (d, min(a, b), max(a, b)) for a, b, d in rows}
    ids = sorted({x for p in key for x in p})
    parts, out = {i: [x] for i, x in enumerate(ids)}, []
    far = lambda s, t: max(key[min(x, y), max(x, y)] for x in parts[s] for y in parts[t])
    while len(parts) > 1:
        s, t = min(itertools.combinations(sorted(parts), 2), key=lambda p: far(*p))
        out.append((len(out), s, t, far(s, t)[0], len(parts[s]) + len(parts[t])))
        parts[len(ids) + len(out) - 1] = parts.pop(s) + parts.pop(t)
    return out


@pytest.mark.parametrize(("n", "kind"), [(2, "random"), (9, "random"), (14, "random"), (10, "ties"), (8, "same"), (9, "chain")])
def test_linkage_matches_the_definition(spark, n, kind):
    rng = np.random.default_rng(n)
    value = {"random": lambda i, j: float(rng.random()), "ties": lambda i, j: float(rng.integers(1, 4)), "same": lambda i, j: 1.0, "chain": lambda i, j: float(abs(2.0**i - 2.0**j))}[kind]
    rows = [(*((i * 3, j * 3) if (i + j) % 2 else (j * 3, i * 3)), value(i, j)) for i, j in itertools.combinations(range(n), 2)]
    got = clusters.linkage(spark.createDataFrame(rows, "u long, v long, d double").repartition(3), "u", "v", "d").collect()
    assert sorted(map(tuple, got)) == step_by_step(rows)


def test_linkage_on_edges(spark):
    schema = "u string, v string, d double"
    assert clusters.linkage(spark.createDataFrame([], schema), "u", "v", "d").collect() == []
    for rows in ([("a", "b", 1.0), ("b", "c", 1.0)], [("a", "b", 1.0), ("b", "a", 2.0)], [("a", "b", None)], [("a", "b", float("nan"))]):
        with pytest.raises(ValueError, match="without a distance"):
            clusters.linkage(spark.createDataFrame(rows, schema), "u", "v", "d")
    got = clusters.linkage(spark.createDataFrame([("b", "a", 1.0), ("a", "c", 3.0), ("c", "b", 2.0)], schema), "u", "v", "d").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, 1.0, 2), (1, 2, 3, 3.0, 3)]
