"""Linear and kernel machines, trained by sums over rows: many settings, classes and folds at once.

A model is a column of a matrix; one pass over the rows gives the loss and the gradient of every column, each with its own C, its own class
weights and the fold that it doesn't see, summed by task and then by cell. Columns are minimised side by side by L-BFGS, each with its own steps. So a grid search costs
as many passes as its slowest model, not as many as all of them, and only matrices of dimensions by models reach the driver.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators import metrics as M
from tokenloom.operators import vectors as V

#: Numbers of a parameter matrix at most; half the width of the rounded corners of the absolute loss, as a share of the labels' deviation.
MOST, CORNER = 4_000_000, 0.01
#: Rows and numbers of a block at most: what a task's Python holds besides the batch it reads and the one it writes.
ROWS, NUMBERS = 1024, 1 << 18


def _blocks(vectors, width: int):
    """(place, matrix) of arrow lists of equal lengths, some rows at a time, without an object for each; width: numbers that a row leads to."""
    step = max(1, min(ROWS, NUMBERS // max(1, width)))
    for k in range(0, len(vectors), step):
        x = vectors.slice(k, step)
        yield slice(k, k + len(x)), x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), -1)


def _mapped(vector: Column, dims: int, width: int, f) -> Column:
    """f of matrices of vectors, row by row, to width numbers each; null for a null vector or one of another length."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), dims), False)
        own, kept = fits.to_numpy(zero_copy_only=False), v.filter(fits)
        out = np.empty((len(kept), width))
        for at, x in _blocks(kept, max(dims, width)):
            out[at] = f(x)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own * width)]), pa.int32()), pa.array(out.ravel()), mask=pa.array(~own))

    return run(vector)


def fourier(vector: str, dims: int, features: int = 256, gamma: float | None = None, seed: int = 0) -> Column:
    """Random Fourier features: their inner products estimate exp(-gamma * squared distance), with an error of about 1 / sqrt(features). gamma: 1 / dims, if not given."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * (gamma or 1 / dims)), size=(dims, features))
    shift = rng.uniform(0, 2 * np.pi, features)
    return _mapped(V.doubles(vector), dims, features, lambda x: np.cos(x @ w + shift) * np.sqrt(2 / features))


@dataclasses.dataclass
class Machines:
    """Coefficients (dimensions + 1, the last the intercept, by models); settings: (C, fold that was left out or None) of each group of models; classes: of each model of a group."""

    coefficients: np.ndarray
    settings: list[tuple[float, int | None]]
    classes: list | None
    passes: int

    def margins(self, vector: Column) -> Column:
        """array of a value per model; null for a null vector or one of another length."""
        w = self.coefficients
        return _mapped(vector, len(w) - 1, w.shape[1], lambda x: x @ w[:-1] + w[-1])

    def predicted(self, margins: Column, setting: int = 0) -> Column:
        """The value, or the class with the largest margin (the first of equal ones), of one setting."""
        if self.classes is None:
            return F.get(margins, F.lit(setting))
        k = len(self.classes)
        if k <= 2:
            return F.when(F.get(margins, F.lit(setting)) > 0, F.lit(self.classes[-1])).otherwise(F.lit(self.classes[0]))
        own = F.slice(margins, setting * k + 1, k)
        return F.get(F.array(*[F.lit(c) for c in self.classes]), F.array_position(own, F.array_max(own)).cast("int") - 1)


def _lbfgs(evaluate, w: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, int]:
    """Minimises every column of w by itself; evaluate(w) gives the values and the gradients of all columns."""
    f, g = evaluate(w)
    passes, history, first = 1, [], np.maximum(1.0, np.abs(g).max(axis=0))
    for _ in range(steps):
        if (np.abs(g).max(axis=0) <= tolerance * first).all():
            break
        q, kept = g.copy(), []
        for s, y, rho in reversed(history):
            a = rho * (s * q).sum(axis=0)
            q -= a * y
            kept.append(a)
        if history:
            s, y, _ = history[-1]
            yy = (y * y).sum(axis=0)
            q *= np.where(yy > 0, (s * y).sum(axis=0) / np.where(yy > 0, yy, 1), 1.0)
        else:
            q /= np.maximum(1.0, np.linalg.norm(g, axis=0))
        for (s, y, rho), a in zip(history, reversed(kept), strict=True):
            q += s * (a - rho * (y * q).sum(axis=0))
        slope = -(g * q).sum(axis=0)
        q = np.where(slope < 0, q, g)
        slope = -(g * q).sum(axis=0)
        t, done = np.ones(w.shape[1]), np.zeros(w.shape[1], bool)
        new_f, new_g, new_w = f.copy(), g.copy(), w.copy()
        for _ in range(12):
            trial = np.where(done, new_w, w - t * q)
            tf, tg = evaluate(trial)
            passes += 1
            ok = ~done & (tf <= f + 1e-4 * t * slope + 1e-12 * np.abs(f))
            new_f[ok], new_g[:, ok], new_w[:, ok] = tf[ok], tg[:, ok], trial[:, ok]
            done |= ok
            if done.all():
                break
            t = np.where(done, t, t / 2)
        if not done.any():
            break
        s, y = new_w - w, new_g - g
        sy = (s * y).sum(axis=0)
        history = [*history, (s, y, np.where(sy > 1e-300, 1 / np.where(sy > 1e-300, sy, 1), 0.0))][-memory:]
        w, f, g = new_w, new_f, new_g
    return w, passes


def fit(df: DataFrame, label: str, vector: str, kind: str, cs: list[float] = (1.0,), fold: str | None = None, balanced: bool = True, epsilon: float = 0.0, steps: int = 60, tolerance: float = 1e-4, classes: int = 1000) -> Machines:
    """A linear machine for each C, and with a column of folds for each fold left out; settings go by C, then fold.

    kind "classify": squared hinge loss, classes against the rest (two classes: one model), each side of a model weighing the same if balanced. kind "regress": absolute loss beyond
    epsilon, its corners rounded. The objective is |w|**2 / 2 + C * the sum of losses; the intercept isn't penalised. Rows without a label or a finite vector are left out;
    vectors of different lengths, no rows, or more than ``classes`` classes are an error. The rows are kept while it runs.
    """
    kept = _kept(df, label, vector, fold).persist()
    try:
        return _fit(_sound(kept), kind, cs, fold, balanced, epsilon, steps, tolerance, classes)
    finally:
        kept.unpersist()


def _kept(df: DataFrame, label: str, vector: str, fold: str | None) -> DataFrame:
    """What a fit reads. It is kept before rows are left out: a filter on a vector made in Python would be pushed below it and make the vector twice, in more processes."""
    sound = F.col(label).isNotNull() & F.forall(V.doubles(vector), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.select(F.col(label).alias("__y"), V.doubles(vector).alias("__v"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__f"), sound.alias("__ok"))


def _sound(kept: DataFrame) -> DataFrame:
    return kept.where("__ok").select("__y", "__v", "__f")


def _fit(v: DataFrame, kind: str, cs: list[float], fold: str | None, balanced: bool = True, epsilon: float = 0.0, steps: int = 60, tolerance: float = 1e-4, classes: int = 1000) -> Machines:
    lengths = [r.d for r in v.select(F.size("__v").alias("d")).distinct().limit(2).collect()]
    if len(lengths) != 1:
        raise ValueError("no rows" if not lengths else "vectors of different lengths")
    d, kinds = lengths[0], None
    if kind == "classify":
        sizes = v.groupBy("__y", "__f").agg(F.count("*").alias("n")).limit(100 * classes).collect()
        kinds = sorted({r["__y"] for r in sizes})
        if len(kinds) > classes:
            raise ValueError(f"more than {classes} classes")
        v = v.withColumn("__y", F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("__y")).cast("double") - 1)
        folds = sorted({r["__f"] for r in sizes}) if fold else [None]
    else:
        v = v.withColumn("__y", F.col("__y").cast("double"))
        folds = sorted(r["__f"] for r in v.select("__f").distinct().collect()) if fold else [None]
        spread = v.agg(F.stddev_pop("__y").alias("s")).first()["s"] or 1.0
    settings = [(float(c), f) for c in cs for f in folds]
    targets = [None] if kinds is None else ([1] if len(kinds) <= 2 else list(range(len(kinds))))
    models = [(c, f, t) for c, f in settings for t in targets]
    if (d + 1) * len(models) > MOST:
        raise ValueError(f"more than {MOST} numbers")
    c_of, left_out = np.array([m[0] for m in models]), np.array([-2 if m[1] is None else m[1] for m in models])
    up = down = np.ones(len(models))
    if kinds is not None and balanced:
        count = lambda t, f, own: sum(r.n for r in sizes if (kinds.index(r["__y"]) == t) == own and r["__f"] != f)
        own, rest = (np.array([count(t, f, side) for _, f, t in models], float) for side in (True, False))
        up, down = ((own + rest) / (2 * np.maximum(x, 1)) for x in (own, rest))
    aims = np.array([-1 if t is None else t for _, _, t in models])
    corner = CORNER * spread if kinds is None else 0.0

    def losses(x: np.ndarray, y: np.ndarray, of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = x @ w[:-1] + w[-1]
        weight = (of[:, None] != left_out) * c_of
        if kinds is None:
            e = margin - y[:, None]
            over = np.maximum(0, np.abs(e) - epsilon)
            value = np.where(over < corner, over**2 / (2 * corner), over - corner / 2)
            slope = np.sign(e) * np.minimum(over / corner, 1)
        else:
            sign = np.where(y[:, None] == aims, 1.0, -1.0)
            weight = weight * np.where(sign > 0, up, down)
            short = np.maximum(0, 1 - sign * margin)
            value, slope = short**2, -2 * sign * short
        g = weight * slope
        return (weight * value).sum(axis=0), np.vstack([x.T @ g, g.sum(axis=0)])

    def evaluate(w):
        def part(batches):
            total = np.zeros((d + 2, w.shape[1]))
            for b in batches:
                y, of = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__y", "__f"))
                for at, x in _blocks(b.column("__v"), max(d, w.shape[1])):
                    value, g = losses(x, y[at], of[at], w)
                    total += np.vstack([value, g])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

        out = np.zeros((d + 2) * w.shape[1])
        for r in v.mapInArrow(part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            out[r["cell"]] = r["value"]
        out = out.reshape(d + 2, -1)
        return out[0] + (w[:-1] ** 2).sum(axis=0) / 2, out[1:] + np.vstack([w[:-1], np.zeros(w.shape[1])])

    w, passes = _lbfgs(evaluate, np.zeros((d + 1, len(models))), steps, tolerance)
    return Machines(w, settings, kinds, passes)


def grid_search(df: DataFrame, label: str, vector: str, fold: str, kind: str, scoring: str, cs: list[float] = (0.1, 1.0, 10.0), **more) -> DataFrame:
    """(c, score, sd, rank): each C judged on the folds that its models don't see, best first; score and sd: the mean and population deviation over folds.

    scoring: "accuracy", "roc_auc" (two classes) or "neg_rmse"; a fold in which it isn't defined is left out. Rows without a label, a fold or a vector count nowhere.
    """
    kept = _kept(df.where(F.col(label).isNotNull() & F.col(fold).isNotNull()), label, vector, fold).persist()
    scored = None
    try:
        rows = _sound(kept)
        m = _fit(rows, kind, cs, fold, **more)
        scored = rows.select(F.col("__y").alias("y"), F.col("__f").alias("of"), m.margins(F.col("__v")).alias("m")).persist()
        if scoring == "roc_auc":
            if m.classes is None or len(m.classes) != 2:
                raise ValueError("roc_auc needs two classes")
            found = []
            for at, (c, f) in enumerate(m.settings):  # a setting at a time, each without a whole order in one task
                own = scored.where(F.col("of") == f).select((F.col("y") == F.lit(m.classes[1])).cast("int").alias("y"), F.get("m", F.lit(at)).alias("s"))
                found.append((c, f, M.roc_auc(own, "y", "s").first()["roc_auc"]))
            each = df.sparkSession.createDataFrame(found, "c double, of int, s double")
        else:
            options = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f"), m.predicted(F.col("m"), at).alias("p")) for at, (c, f) in enumerate(m.settings)]))
            judged = scored.select("y", "of", options.alias("x")).where("of = x.f").select("y", F.col("x.c").alias("c"), "of", F.col("x.p").alias("p"))
            score = F.avg((F.col("y") == F.col("p")).cast("double")) if scoring == "accuracy" else -F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))))
            each = df.sparkSession.createDataFrame([tuple(r) for r in judged.groupBy("c", "of").agg(score.alias("s")).collect()], "c double, of int, s double")  # a row per setting
    finally:
        kept.unpersist()
        if scored is not None:
            scored.unpersist()
    total = each.groupBy("c").agg(F.avg("s").alias("score"), F.stddev_pop("s").alias("sd"))
    return total.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("score"))))
