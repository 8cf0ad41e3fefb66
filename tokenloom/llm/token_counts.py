"""Operator 4: exact token counts by prefix dynamic programming.

A BPE result is the one token sequence in which each neighbouring pair is itself a BPE result. So the
last token of a prefix is the one vocabulary entry that ends there and fits the last token of the prefix
before it, and one pass gives the exact count of *every* prefix. The text is cut first where no vocabulary entry spans the seam
(before a word mark, between characters that no entry holds side by side), so counts add up over the parts; those of words are kept in
a cache bounded in bytes. Every document keeps its count at each word's end (``word_ends``, ``word_tokens``): a budget question is
a search in them and, inside one word, a look at that word's own prefix counts. Nothing is encoded again.

The rules are those of the sentencepiece BPE model with byte fallback: a word mark in front of the text,
each space a word mark, characters outside the vocabulary as their UTF-8 bytes, no begin or end token.
Runs of word marks have equal scores and are counted by simulating the merges from the left, all lengths in one pass.

Defined results: null text counts as empty (0 tokens, no words); control strings in a text are ordinary text; a text without any space is
one word, of any length (time and memory grow in proportion to it); an empty table gives an empty result; repeated rows are counted
each; other columns pass through, except that columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of a generation of cached words with a mark in front; of pairs of tokens.
CACHE, PAIRS = 192 << 20, 300_000
#: Word marks in a row whose counts are kept between texts.
RUNS = 1 << 16


class PrefixCounter:
    def __init__(self, name: str = MODEL):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=shared.tokenizer_path(name))
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.rank) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.rank):
            raise ValueError("entries that span words aren't supported")
        # every ending of an entry, and whether it is an entry itself; neighbours inside entries
        self.endings: dict[str, bool] = {p[k:]: False for p in self.rank for k in range(len(p))}
        self.endings |= dict.fromkeys(self.rank, True)
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        # lengths of the entries that are word marks alone, and whether merging any of them counts the same
        self.marks = {len(p) for p in self.rank if not p.strip(MARK)}
        self.even = len({self.rank[MARK * k] for k in self.marks if k > 1}) <= 1
        self.runs = array("l", [0])
        self.table: tuple[str, list[int], list[str], list[int], list[int]] = ("", [0], [""], [0], [0])
        # totals of words with and without the mark in front
        self.marked = shared.TwoGenerations(self._total_marked, CACHE, each=130)
        self.bare = shared.TwoGenerations(self._total_bare, CACHE // 4, each=130)

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first, then leftmost; for short texts."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, word: str) -> list[str]:
        """The word, cut where no entry spans the seam."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _total_marked(self, word: str) -> int:
        """Tokens of mark + word."""
        first, *rest = self._parts(word)
        return self.prefixes(MARK + first)[-1] + sum(map(self.bare.__getitem__, rest))

    def _total_bare(self, word: str) -> int:
        parts = self._parts(word)
        return self.prefixes(word)[-1] if len(parts) == 1 else sum(map(self.bare.__getitem__, parts))

    def _fit(self, a: str, b: str) -> bool:
        """Whether a, b is the BPE result of a + b: the merges of a + b never cross the seam."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        parts, rank, seam = list(a + b), self.rank, len(a)  # seam: parts before it
        scores = [rank.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                known = len(parts) == 2
                break
            if at == seam - 1:
                known = False
                break
            parts[at] += parts.pop(at + 1)
            scores.pop(at)
            seam -= at < seam
            if at:
                scores[at - 1] = rank.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = rank.get(parts[at] + parts[at + 1])
        self.fits[a, b] = known
        return known

    def runs_of_marks(self, n: int) -> array:
        """counts[k]: tokens of k word marks alone, for all k up to n at least; in one pass, kept up to ``RUNS``."""
        if n < len(self.runs):
            return self.runs
        if not self.even:  # unequal scores: merged out, each length by itself
            counts = array("l", [len(self.merge(MARK * k)) for k in range(n + 1)])
        else:
            counts = self._even_runs(max(n, min(RUNS, 2 * len(self.runs) + 256)))
        if n <= RUNS:
            self.runs = counts
        return counts

    def _even_runs(self, n: int) -> array:
        """With equal scores the leftmost pair that can merge does. So marks are taken from the left, by pairs where two merge, and what
        has been taken doesn't depend on how many follow, but for a last single mark: one stack gives the counts of all lengths. A token
        has a bounded length, so each mark looks back at a bounded part of the stack.
        """
        can = self.marks.__contains__
        out: list[int] = []
        counts = array("l", [0])
        while len(counts) <= n:
            if out and can(out[-1] + 1):
                out[-1] += 1
                taken = 1
            else:
                taken = 2 if can(2) else 1
                if taken == 2:  # as many as now and one: the single mark merges back as far as it can
                    top, k = 1, len(out)
                    while k and can(out[k - 1] + top):
                        k -= 1
                        top += out[k]
                    counts.append(k + 1)
                out.append(taken)
            while len(out) > 1 and can(out[-2] + out[-1]):
                out[-2:] = [out[-2] + out[-1]]
            counts.append(len(out))
        return counts

    def prefixes(self, chunk: str) -> list[int]:
        """counts[i]: tokens of the first i characters, for a chunk with at most one mark, in front; ``heads[i]`` then is the length of the first.

        The table of the chunk before is kept: what both begin with isn't computed again, so that sorted
        words cost their differing ends only.
        """
        rank, endings, fits = self.rank, self.endings, self.fits
        old, counts, last, starts, heads = self.table
        same, most = 0, min(len(old), len(chunk))
        while same < most and old[same] == chunk[same]:
            same += 1
        for kept in (counts, last, starts, heads):
            del kept[same + 1 :]
        start = starts[same]  # the prefix that no token reaches across
        for i in range(same + 1, len(chunk) + 1):
            c = chunk[i - 1]
            if c not in rank:
                counts.append(counts[-1] + len(c.encode("utf-8", "surrogatepass")))
                last.append("")
                starts.append(start := i)
                heads.append(heads[i - 1] or 1)
                continue
            found = []
            for j in range(i - 1, start - 1, -1):
                entry = endings.get(t := chunk[j:i])
                if entry is None:
                    break
                if entry:
                    found.append((j, t))
            while found:
                j, t = found.pop()  # the longest first
                if j == start:
                    fit = self._whole(t)
                else:
                    pair = (last[j], t)
                    fit = fits[pair] if pair in fits else self._fit(*pair)
                if fit:
                    counts.append(counts[j] + 1)
                    last.append(t)
                    starts.append(start)
                    heads.append(heads[j] or i)
                    break
            else:
                raise AssertionError(f"no token ends {chunk[:i]!r}")
        self.table = (chunk, counts, last, starts, heads) if len(chunk) <= 4096 else ("", counts[:1], last[:1], starts[:1], heads[:1])
        self.heads = heads
        return counts

    def learn(self, texts: list[str | None]) -> None:
        """Puts the words of many texts into the caches, in sorted order."""
        marked: set[str] = set()
        bare: set[str] = set()
        for x in texts:
            if x:
                first, *lines = x.replace(MARK, " ").split("\n")
                marked.update(first.split(" "))
                for line in lines:
                    head, *rest = line.split(" ")
                    bare.add(head)
                    marked.update(rest)
        for words, known in ((marked, self.marked), (bare, self.bare)):
            for w in sorted(w for w in words if w not in known):
                if w and len(w) <= known.longest:
                    known[w]

    def _whole(self, t: str) -> bool:
        """Whether the entry t is its own BPE result (some entries can't be reached by merges)."""
        if (known := self.fits.get((t, ""))) is None:
            known = self.fits[t, ""] = self.merge(t) == [t]
        return known

    # -- whole texts

    def _words(self, text: str) -> list[tuple[int, int, str]]:
        """(marks in front, start in the marked text, word) of each word of the text with its first mark."""
        marked = MARK + text.replace(" ", MARK)
        return [(len(m[1]), m.start(), m[2]) for m in re.finditer(f"({MARK}*)([^{MARK}]*)", marked) if m[0]]

    def _with_run(self, marks: int, word: str) -> list[int]:
        """Prefix counts of some marks and a word."""
        if marks <= 1:
            return self.prefixes(MARK * marks + word)
        # the run's last mark is the first token of mark + word, alone or with the word's beginning
        runs, alone = self.runs_of_marks(marks), self.prefixes(MARK + word)
        return [*runs[: marks + 1], *(runs[marks - 1] + n if head > 1 else runs[marks] + n - 1 for n, head in zip(alone[2:], self.heads[2:], strict=True))]

    def word_counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): the end of each word (characters of the text), and the tokens of the text up to there.

        Without runs of spaces a word begins at a space or line end, or with the text; with them, words are cut as ``_words`` does.
        """
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if MARK in text:
            text = text.replace(MARK, " ")
        marked, bare = self.marked, self.bare
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = self._words(text)
            totals = [self._word_total(m, w) for m, _, w in words]
            return np.array([start + m + len(w) - 1 for m, start, w in words], np.int64), np.cumsum(np.array(totals, np.int64))
        if "\n" in self.rank:
            words = text.split(" ")
            totals = [marked[w] for w in words]
        else:  # a line end is outside the vocabulary: one byte, and no token spans it
            words, totals = [], []
            for line in text.split("\n"):
                own = line.split(" ")
                head = own[0]
                totals.append((1 + bare[head] if head else 1) if words else marked[head])
                totals += [marked[w] for w in own[1:]]
                words += own
        ends, counts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1, np.cumsum(np.array(totals, np.int64))
        return (ends, counts) if words[0] else (ends[1:], counts[1:])  # a line end in front: its mark counts with the next word

    def count(self, text: str | None) -> int:
        counts = self.word_counts(text)[1]
        return int(counts[-1]) if len(counts) else 0

    def all_prefixes(self, text: str | None) -> np.ndarray:
        """counts[i]: the tokens of text[:i], for every i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        out, base = [], 0
        for m, _, w in self._words(text.replace(MARK, " ")):
            own = list(self._with_run(m, w))
            out += [base + x for x in own[1:]]
            base += own[-1]
        return np.array([0, *out[1:]], np.int64)  # the mark in front belongs to no character

    def _word_total(self, marks: int, word: str) -> int:
        """Tokens of some marks and a word."""
        if marks > 1 or not word:
            runs = self.runs_of_marks(marks)
            if not word or marks <= 1:
                return runs[marks] if not word else self._with_run(marks, word)[-1]
            n = self.prefixes(MARK + word)[-1]
            return runs[marks - 1] + n if self.heads[-1] > 1 else runs[marks] + n - 1
        if "\n" in self.rank:
            return self.marked[word]
        head, *lines = word.split("\n")
        return self.marked[head] + len(lines) + sum(self.bare[x] for x in lines if x)

    def longest(self, text: str | None, budget: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """The most characters that text can be cut to so that the cut text has at most budget tokens; known: its ``word_counts``.

        Counts at word ends only grow, so the cut lies in the first word whose end is over the budget; that word's own prefixes decide.
        """
        if not text or budget < 0:
            return 0
        ends, counts = self.word_counts(text) if known is None else known
        at = int(np.searchsorted(counts, budget, side="right"))
        if at == len(counts):
            return len(text)
        start, before = (int(ends[at - 1]), int(counts[at - 1])) if at else (0, 0)
        word = text[start : int(ends[at])].replace(MARK, " ")
        if not at:  # the mark in front belongs to no character
            marks = len(word) - len(word.lstrip(" ")) + 1
            own = self._with_run(marks, word[marks - 1 :])[1:]
            own[0] = 0
        elif word[0] == "\n":
            own = [0, *(1 + n for n in self.prefixes(word[1:]))]
        else:
            marks = len(word) - len(word.lstrip(" "))
            own = self._with_run(marks, word[marks:])
        return start + int(np.flatnonzero(np.array(own) <= budget - before)[-1])


_counters: dict[str, PrefixCounter] = {}


shared.caches("token_counts", _counters.clear)


def counter(name: str = MODEL) -> PrefixCounter:
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL, limit: int | None = None, keep: list[str] | None = None, words: bool = True) -> DataFrame:
    """docs with ``n_bytes`` and ``n_tokens``; with a limit, ``over_limit`` and ``fits_chars``: how many characters to keep.

    words: also ``word_ends`` and ``word_tokens``, the ends of the words and the count of the text up to each.
    """
    shared.text_batches(docs.sparkSession)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    if limit is not None:
        new += [T.StructField("over_limit", T.BooleanType()), T.StructField("fits_chars", T.LongType())]
    if words:
        new += [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("word_ends", "word_tokens")]
    names = {f.name for f in new}
    keep = shared.without(docs.columns if keep is None else keep, names)
    (body,) = shared.free(keep, "text_to_count")
    source = docs.select(*[docs[c] for c in keep], docs[text].alias(body))

    def run(batches):
        shared.only("token_counts")
        c = counter(model)
        for b in shared.small(batches):
            texts = b.column(body).to_pylist()
            c.learn(texts)
            known = [c.word_counts(x) for x in texts]
            n = [int(k[1][-1]) if len(k[1]) else 0 for k in known]
            cols = [b.column(k) for k in keep] + [pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())]
            if limit is not None:
                cols += [pa.array([k > limit for k in n], pa.bool_()), pa.array([c.longest(x, limit, w) if k > limit else len(x or "") for x, k, w in zip(texts, n, known, strict=True)], pa.int64())]
            if words:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k[0]) for k in known])]).astype(np.int32))
                cols += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k[j] for k in known]).astype(np.int32) if known else np.zeros(0, np.int32))) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [f.name for f in new])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep] + new))
