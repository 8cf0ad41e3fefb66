"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words (whole words, their
beginnings and an ending, so that unseen inflections count), and a document's is the noisy-or of its sentences:
1 - prod(1 - p). Only documents carry labels; the likelihood of the noisy-or trains the sentence scores, which then locate
the offending sentences. Weights are non-negative: words can only add to a sentence's probability, so harmless
words around an offending one don't hide it.

Training is on the driver, on a bounded sample: at most ``per_class`` documents of each label and ``max_bytes`` of text, taken in the order
of a hash of the id; classes are weighted back to their true shares. The lasso's weight is the one of ``SHRINKS`` with the best likelihood on folds of
training rows (at most ``FOLD_ROWS`` a class); rows held out of training have no part in it. The fitted weights have at most ``BINS`` entries, so their
broadcast has a fixed bound. Scoring reads every whole text of every document.

Defined results: null and empty texts have no sentences and score 0; rows without a label or without an id aren't trained on; of rows that share an id
the greatest text and label are; if no training row has one of the classes, all scores are the share of label 1; if a class has rows, but each of its texts is
larger than the sample, that is an error; repeated rows are scored each; very long texts are scored whole; an empty table gives an empty result; other columns pass
through, except that columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Bounds of the training sample and of the weights; bytes of a generation of a worker's cached words; the score from which a document counts as toxic.
PER_CLASS, MAX_BYTES, BINS, CACHE, THRESHOLD = 3000, 16 << 20, 1 << 18, 64 << 20, 0.3
ROUNDS, RATE, LEAST_DOCS = 80, 0.15, 3
#: Weights of the lasso to choose from; folds, and rows of a class, for the choice.
SHRINKS, FOLDS, FOLD_ROWS = (0.1, 0.5, 2.0), 2, 300
SENTENCE = re.compile(r"[.!?\n]+")
STRIP = ",;:\"'()[]|*#%<>&"


def features(word: str) -> list[str]:
    w = word.strip(STRIP).lower()
    return ["=" + w, *(f"{k}{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), *(["~" + w[-4:]] if len(w) > 4 else [])] if w else []


def bins_of(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BINS for f in features(word)]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text that hold more than white space."""
    text, at, out = text or "", 0, []
    for m in SENTENCE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


class Model:
    def __init__(self, bias: float, weights: np.ndarray, constant: float | None = None):
        self.bias, self.weights, self.constant = bias, weights.astype(np.float32), constant
        self._prepare()

    def _prepare(self) -> None:
        self.words = shared.TwoGenerations(self._word, CACHE, each=130)

    def __getstate__(self):
        return self.bias, self.weights, self.constant

    def __setstate__(self, state):
        self.bias, self.weights, self.constant = state
        self._prepare()

    def _word(self, word: str) -> float:
        return float(sum(self.weights[b] for b in bins_of(word)))

    def logit(self, sentence: str) -> float:
        return self.bias + sum(map(self.words.__getitem__, sentence.split()))

    def score(self, text: str | None) -> float:
        """The noisy-or over the sentences."""
        if self.constant is not None:
            return self.constant
        total = 0.0
        for s in SENTENCE.split(text or ""):
            if words := s.split():
                z = self.bias + sum(map(self.words.__getitem__, words))
                total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
        return min(1.0, max(0.0, -math.expm1(-total)))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that reach least; the likeliest one if none does."""
        if self.constant is not None:
            return []
        found = [(a, b, 1 / (1 + math.exp(-max(-700.0, min(700.0, self.logit(text[a:b])))))) for a, b in sentences(text)]
        return [f for f in found if f[2] >= least] or sorted(found, key=lambda f: (-f[2], f[0]))[:1]


def log_loss(model: Model, rows: list[tuple[str | None, int, float]]) -> float:
    """The weighted mean of -ln of the probability of the label."""
    p = [min(1 - 1e-6, max(1e-6, model.score(text))) for text, _, _ in rows]
    return -sum(w * math.log(q if y else 1 - q) for q, (_, y, w) in zip(p, rows, strict=True)) / sum(w for *_, w in rows)


def choose(rows: list[tuple[str | None, int, float]], shrinks: tuple[float, ...] = SHRINKS) -> float:
    """The lasso's weight with the least loss on folds of the rows: each is judged by a model that didn't see it."""
    few = [r for y in (0, 1) for r in [r for r in rows if r[1] == y][:FOLD_ROWS]]
    if min(sum(r[1] == y for r in few) for y in (0, 1)) < 2 * FOLDS or len(shrinks) < 2:
        return shrinks[len(shrinks) // 2]
    fold = [k % FOLDS for k in range(len(few))]
    loss = {s: sum(log_loss(fit([r for r, f in zip(few, fold, strict=True) if f != k], s), [r for r, f in zip(few, fold, strict=True) if f == k]) for k in range(FOLDS)) for s in shrinks}
    return min(shrinks, key=lambda s: loss[s])


def fit(rows: list[tuple[str | None, int, float]], shrink: float | None = None) -> Model:
    """rows: (text, label, weight). Full-batch projected Adam on the noisy-or likelihood with a lasso, whose weight is chosen if not given."""
    share = sum(w * y for _, y, w in rows) / max(1e-9, sum(w for *_, w in rows)) if rows else 0.0
    if len({y for _, y, _ in rows}) < 2:
        return Model(0.0, np.zeros(BINS), float(share))
    shrink = choose(rows) if shrink is None else shrink
    ids: dict[str, int] = {}
    word_at, sentence_words, doc_sentences = [], [], []
    for text, _, _ in rows:
        n = 0
        for s in SENTENCE.split(text or ""):
            if words := s.split():
                word_at += [ids.setdefault(w, len(ids)) for w in words]
                sentence_words.append(len(words))
                n += 1
        doc_sentences.append(n)
    word_at, sent_of = np.array(word_at, np.int32), np.repeat(np.arange(len(sentence_words), dtype=np.int32), sentence_words)
    doc_of = np.repeat(np.arange(len(rows), dtype=np.int32), doc_sentences)
    bins = [bins_of(w) for w in ids]
    word_of_bin = np.repeat(np.arange(len(bins), dtype=np.int32), [len(b) for b in bins])
    bin_at = np.array([x for b in bins for x in b], np.int32)
    # bins that too few documents have say nothing; each (document, word) counts once
    pairs = np.unique(doc_of[sent_of].astype(np.int64) * len(ids) + word_at)
    docs_with = np.bincount(bin_at, np.bincount(pairs % len(ids), minlength=len(ids))[word_of_bin], minlength=BINS)
    keep = docs_with[bin_at] >= LEAST_DOCS
    word_of_bin, bin_at = word_of_bin[keep], bin_at[keep]
    y, weight = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    weight /= weight.sum()
    params, m, v = np.zeros(BINS + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)
    params[-1] = -6.0
    n_sent, n_docs = len(sentence_words), len(rows)
    for t in range(1, ROUNDS + 1):
        by_word = np.bincount(word_of_bin, params[bin_at], minlength=len(ids))
        z = params[-1] + np.bincount(sent_of, by_word[word_at], minlength=n_sent)
        total = np.bincount(doc_of, np.logaddexp(0, z), minlength=n_docs)
        pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * weight
        g_sent = pull[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        g_word = np.bincount(word_at, g_sent[sent_of], minlength=len(ids))
        g = np.append(np.bincount(bin_at, g_word[word_of_bin], minlength=BINS), g_sent.sum())
        g[:-1] += shrink / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        np.maximum(params[:-1], 0, out=params[:-1])
    return Model(float(params[-1]), params[:-1])


def held_out(doc_id):
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> list[tuple[str | None, int, float]]:
    """The bounded sample: (text, label, weight)."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = docs.select("doc_id", F.octet_length("text").alias("n")).join(usable, "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n"))
    known = shared.written(known.withColumn("order", F.xxhash64("doc_id")), "toxic-labels")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, int] = {}
    for y in sorted(counts):
        size = 0
        # texts that never fit are passed over before the limit, so they don't take the places of others
        for r in known.where((F.col("y") == y) & (F.coalesce("n", F.lit(0)) <= max_bytes // 2)).orderBy("order", "doc_id").limit(per_class).collect():
            if size + (r["n"] or 0) > max_bytes // 2:
                continue
            size += r["n"] or 0
            chosen[r["doc_id"]] = y
    n = {y: sum(1 for v in chosen.values() if v == y) for y in counts}
    if none := [y for y in counts if counts[y] and not n[y]]:
        raise ValueError(f"all texts of label {none} are longer than the sample holds: raise max_bytes ({max_bytes})")
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")  # at most 2 * per_class ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    shared.drop(known)
    return [(r["text"], chosen[r["doc_id"]], counts[chosen[r["doc_id"]]] / n[chosen[r["doc_id"]]]) for r in sorted(texts, key=lambda r: r["doc_id"])]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, located: bool = False, name: str = "score") -> DataFrame:
    """docs with ``score`` (or another name); located: also ``offending``, the spans of the offending sentences of documents over the threshold."""
    spark = docs.sparkSession
    shared.text_batches(spark)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    new = [T.StructField(name, T.DoubleType())] + ([T.StructField("offending", spans)] if located else [])
    keep = shared.without(docs.columns if keep is None else keep, [f.name for f in new])
    (body,) = shared.free(keep, "text_to_score")
    source = docs.select(*[docs[c] for c in keep], docs[text].alias(body))
    sent = spark.sparkContext.broadcast(model)  # BINS floats
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        shared.only("toxicity")
        m = sent.value
        for b in shared.small(batches):
            texts = b.column(body).to_pylist()
            scores = [m.score(x) for x in texts]
            cols = [b.column(k) for k in keep] + [pa.array(scores, pa.float64())]
            if located:
                cols.append(pa.array([[{"start": a, "end": e, "p": p} for a, e, p in m.locate(x)] if s >= THRESHOLD else [] for x, s in zip(texts, scores, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(cols, names=keep + [f.name for f in new])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep] + new))
