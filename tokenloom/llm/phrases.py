"""Operator 12: phrase collocations by vertical positional inverted lists.

Texts are dealt into blocks of about ``BLOCK`` bytes of one language. A block's vertical index holds, for each of its phrases, the sorted
positions at which the phrase starts; the places between pieces are positions without a word. A block's lists stay with it:

1. Words: each block's lists, word by word. List lengths are summed over blocks; words (and later phrases) below ``least`` occurrences
   go, the others get an id.
2. Phrases of k + 1 words: the positions of the frequent phrases of k words are merge-joined with the positions next to them at which such a
   phrase starts too, whose last word is the adjacent word. (A frequent phrase's first k and last k words are frequent, so
   nothing is lost.) The positions that meet, by first phrase and adjacent word, are the new lists, and their lengths the exact frequencies.
3. Frequencies are summed by a window over the lengths (block, first phrase, word, length), which are exchanged once; what is frequent goes back to its blocks.
   The frequencies of both parts of every cut are joined on.

Ids are exact keys, not hashes. Everything that travels is lengths of lists, but for a block's lists when they meet the ids of its
frequent phrases; these are written as differences, byte by byte of all entries, which compress well.

Defined results: null texts are empty, a null language is ``und``; A-Z are lower-cased; texts are split at ``[.,;:!?`` and line ends ``]`` into pieces, these at spaces and
tabs into words; null ids don't matter, repeated rows count as often as they are there; an empty table, or one without
frequent phrases, gives an empty result. A text longer than a block is cut between pieces. Columns that aren't needed are left out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
#: Bytes of text of a block, and of those turned into words at a time.
BLOCK, STEP = 32 << 20, 1 << 20
#: Keys over which a language's best phrases are found before they meet.
SALTS = 64
_END = re.compile(rb"[.,;:!?\n-\r]")
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as bytes: all lowest bytes first."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _lists(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Vertical lists: the distinct keys, the lengths of their lists, and the positions, sorted by key: differences to the one before, each list's first as it is."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    return key[first], _packed(np.diff(first, append=len(key))), _packed(step)


def _positions(lengths: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(list, position) of each entry of vertical lists, in 32 bits: sums over all lists go round, differences come out right."""
    n, total = _unpacked(lengths).astype(np.int64), np.cumsum(_unpacked(steps), dtype=np.uint32)
    ends = np.cumsum(n)
    if len(n):
        total -= np.repeat(np.concatenate([np.zeros(1, np.uint32), total[ends[:-1] - 1]]), n)
    return np.repeat(np.arange(len(n), dtype=np.int32), n), total


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self) - 2
        return n


class _Block:
    """The words of one language's texts, as numbers; -1 between pieces."""

    def __init__(self):
        self.words, self.parts, self.size = _Words({b"": -2, b"\n": -1}), [], 0

    def add(self, data: bytes) -> None:
        tokens = (data + b"\n").translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(ids[ids != -2])
        self.size += len(data)

    def row(self, lang: str) -> pa.RecordBatch:
        words = pa.array([w.decode("utf-8", "surrogatepass") for w, n in self.words.items() if n >= 0], pa.string())
        ids = np.concatenate(self.parts)
        self.words = self.parts = None
        at = np.flatnonzero(ids >= 0)
        _, lengths, steps = _lists(ids[at], at)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(at)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([lengths], pa.binary()), pa.array([steps], pa.binary())], names=["lang", "n", "words", "lengths", "steps"])


def index(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """The blocks (block, lang, n, words, lengths, steps): lists of the positions of each word."""
    shared.text_batches(docs.sparkSession)
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))

    step = min(STEP, block)

    def pieces(data: bytes):
        """data in parts of about STEP bytes, cut at ends of pieces."""
        at = 0
        while len(data) - at > step and (end := _END.search(data, at + step)):
            yield data[at : end.end()]
            at = end.end()
        yield data[at:]

    def run(batches):
        shared.only("phrases")
        held: dict[str, _Block] = {}
        total = 0
        for b in batches:
            for part in shared.small([b]):
                waiting: dict[str, list] = {}
                for x, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    waiting.setdefault(x, []).append(t.encode("utf-8", "surrogatepass").lower())
                for x, texts in waiting.items():
                    for data in pieces(b"\n".join(texts)):
                        held.setdefault(x, _Block()).add(data)
                        total += len(data)
                        if total >= block:  # the largest goes
                            most = max(held, key=lambda k: held[k].size)
                            total -= held[most].size
                            yield held.pop(most).row(most)
        for x, h in held.items():
            yield h.row(x)

    rows = source.mapInArrow(run, "lang string, n long, words array<string>, lengths binary, steps binary")
    return shared.written(rows.withColumn("block", F.monotonically_increasing_id()), "phrase-index")


def _frequent(lengths: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(block, *keys, id, a) of the keys that occur at least so often, in each block that has them; (id, *keys, a) once for each.

    A key's id is the smallest of its rows' numbers: its rows are together for the sum already, so the lengths are exchanged once.
    """
    together = Window.partitionBy(*keys)
    often = lengths.withColumn("a", F.sum("c").over(together)).where(F.col("a") >= least).drop("c")
    kept = shared.written(often.withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(together)).drop("row"), "phrase-kept")
    return kept, shared.written(kept.groupBy("id").agg(*[F.max(k).alias(k) for k in (*keys, "a")]), "phrase-ids")


def _by_block(kept: DataFrame, *columns: str) -> DataFrame:
    """What is frequent in each block: no more than its positions."""
    return kept.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("kept"))


def _blocks(batches):
    """(row as columns, the kept structs) of each block."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i] for c in b.schema.names if c != "kept"}, b.column("kept")[i].values


LISTS = "block long, ids array<bigint>, words array<bigint>, lengths binary, steps binary"


def _row(block, ids, words, lengths, steps) -> pa.RecordBatch:
    longs = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), longs(ids), longs(words), pa.array([lengths], pa.binary()), pa.array([steps], pa.binary())], names=["block", "ids", "words", "lengths", "steps"])


def _first_lists(batches):
    """The lists of the frequent words, by their ids."""
    for row, kept in _blocks(batches):
        at, position = _positions(row["lengths"].as_py(), row["steps"].as_py())
        ids = np.full(len(row["words"]), -1)
        ids[kept.field("local").to_numpy()] = kept.field("id").to_numpy()
        ids = ids[at]
        distinct, lengths, steps = _lists(ids[ids >= 0], position[ids >= 0])
        yield _row(row["block"].as_py(), distinct, distinct, lengths, steps)


def _merge(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place where a list's phrase and, one word on, another's start: the first's number, the last's, the position; and the last words of all lists."""
    which, position = _positions(row["lengths"].as_py(), row["steps"].as_py())
    order = np.argsort(position)
    which, position = which[order], position[order]
    del order
    hit = np.flatnonzero(position[1:] == position[:-1] + np.uint32(1))
    return which[hit].astype(np.int64), which[hit + 1], position[hit], row["words"].values.to_numpy()


def _candidates(batches):
    """(block, first, word, c) of each block: how often a phrase stands before a word."""
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in b.schema.names}
            first, last, _, words = _merge(row)
            distinct, local = np.unique(words, return_inverse=True)
            first *= max(1, len(distinct))
            first += local[last]
            del last, _
            first.sort()
            starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
            key, c = first[starts], np.diff(starts, append=len(first))
            del first, starts
            ids = row["ids"].values.to_numpy()
            cols = [np.full(len(key), row["block"].as_py()), ids[key // max(1, len(distinct))], distinct[key % max(1, len(distinct))], c]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["block", "first", "word", "c"])


def _next_lists(batches):
    """The lists of the frequent phrases of one word more."""
    for row, kept in _blocks(batches):
        first, last, position, words = _merge(row)
        get = lambda f: kept.field(f).to_numpy()
        distinct, local = np.unique(words, return_inverse=True)
        ids = row["ids"].values.to_numpy()
        width = max(1, len(distinct))
        known = np.searchsorted(ids, get("first")) * width + np.searchsorted(distinct, get("word"))
        order = np.argsort(known)
        known, new, adjacent = known[order], get("id")[order], get("word")[order]
        key = first * width + local[last]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[place] == key
        found, lengths, steps = _lists(new[place[hit]], position[hit])
        by_id = np.argsort(new)
        yield _row(row["block"].as_py(), found, adjacent[by_id[np.searchsorted(new[by_id], found)]], lengths, steps)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n); and for each length (id, lang, phrase, w1, ..., a, l1, r1, ...): l and r are the frequencies of the parts that the cut after so many words gives."""
    blocks = index(docs, text, lang, block)
    spark = docs.sparkSession
    totals = shared.written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")

    def lengths(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, n = b.column("words")[i].values, _unpacked(b.column("lengths")[i].as_py()).astype(np.int64)
                same = lambda x, kind: pa.array([x.as_py()] * len(words), kind)
                yield pa.RecordBatch.from_arrays([same(b.column("block")[i], pa.int64()), same(b.column("lang")[i], pa.string()), words, pa.array(np.arange(len(words), dtype=np.int32)), pa.array(n)], names=["block", "lang", "phrase", "local", "c"])

    counted = blocks.select("block", "lang", "words", "lengths").mapInArrow(lengths, "block long, lang string, phrase string, local int, c long")
    kept, once = _frequent(counted, ["lang", "phrase"], least)
    lists = shared.written(blocks.select("block", "words", "lengths", "steps").hint("merge").join(_by_block(kept, "local", "id").hint("merge"), "block").mapInArrow(_first_lists, LISTS), "phrase-lists")
    shared.drop(blocks, kept)
    levels = [once.select("id", "lang", "phrase", F.col("id").alias("w1"), "a")]
    for k in range(2, longest + 1):
        kept, once = _frequent(lists.mapInArrow(_candidates, "block long, first long, word long, c long"), ["first", "word"], least)
        if k < longest:
            new = shared.written(lists.hint("merge").join(_by_block(kept, "first", "word", "id").hint("merge"), "block").mapInArrow(_next_lists, LISTS), "phrase-lists")
        shared.drop(lists, kept)
        lists = new if k < longest else None
        before = levels[-1]
        own = [F.col(f"w{i}") for i in range(1, k)]
        heads = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.col("a").alias("head_a"), *own, *[F.col(f"l{i}") for i in range(1, k - 1)])
        words = levels[0].select(F.col("id").alias("word"), F.col("phrase").alias("tail"), F.col("a").alias(f"r{k - 1}"))
        found = once.join(heads, "first").join(words, "word").withColumnRenamed("word", f"w{k}").withColumnRenamed("head_a", f"l{k - 1}")
        for cut in range(1, k - 1):  # the rest after the cut: k - cut words
            rest = levels[k - cut - 1].select(*[F.col(f"w{i}").alias(f"w{cut + i}") for i in range(1, k - cut + 1)], F.col("a").alias(f"r{cut}"))
            found = found.join(rest, [f"w{cut + i}" for i in range(1, k - cut + 1)])
        # l of the cut after i words is the frequency of the first i words, whatever follows: heads carry theirs
        cuts = [c for i in range(1, k) for c in (f"l{i}", f"r{i}")]
        levels.append(shared.written(found.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), *[f"w{i}" for i in range(1, k + 1)], "a", *cuts), "phrase-level"))
        shared.drop(once)
    return totals, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to longest words.

    score: floor(2000000 * a / (l + r)) of the cut at which it is lowest; phrases go that lie in a longer frequent one that has share % of their occurrences.
    """
    totals, levels = frequent_phrases(docs, least, longest, text, lang, block)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    out = None
    for k in range(2, longest + 1):
        frame = levels[k - 1]
        own = [f"w{i}" for i in range(1, k + 1)]
        inside = None
        for m in range(k + 1, longest + 1):
            for start in range(m - k + 1):
                part = levels[m - 1].select(*[F.col(f"w{start + i}").alias(f"w{i}") for i in range(1, k + 1)], F.col("a").alias("longer"))
                inside = part if inside is None else inside.unionAll(part)
        if inside is not None:
            most = inside.groupBy(*own).agg(F.max("longer").alias("longer"))
            frame = frame.join(most, own, "left").where(F.col("longer").isNull() | (100 * whole("longer") < share * whole("a")))
        scored = frame
        for i in range(1, k):
            scored = scored.withColumn(f"s{i}", F.expr(f"(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l{i} as decimal(19,0)) + cast(r{i} as decimal(19,0)))"))
        worst = F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, k)]))
        part = scored.select("lang", "phrase", "a", worst.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
        out = part if out is None else out.unionAll(part)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = out.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
