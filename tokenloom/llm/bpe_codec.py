"""Operator 10: BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until the pieces are short, wherever the cuts fall. The halves are encoded on their own, and at each join
a window around the seam is encoded again and grows until both sides agree with it:

* within a text, a window holds whole words (runs between ASCII white space, which no token spans and the pre-tokenizer drops): it starts with the
  two words that touch the seam and doubles until its first word's encoding is the left half's and its last word's the right half's there;
* within a word longer than ``LONG`` characters, the halves are runs of tokens, and a window doubles until its first token equals the left side's
  there and its last token the right side's: then every neighbouring pair of the joined sequence also stands in some BPE result, which makes
  the whole sequence the BPE result. Leaves of such a word are encoded in parallel threads (the library releases the interpreter lock).

Encodings of words of up to ``LONG`` characters, and of windows of one, come from the library once each and are kept in a cache bounded in bytes.

Defined results: null text counts as empty (no ids, empty decoding); special strings in a text become the
tokenizer's special tokens, as its library does by default; texts and words of any length are encoded whole; an empty table gives an empty
result; repeated rows are encoded each; other columns pass through, except that columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

TOKENIZER = "word_bpe_49k.json"
#: Characters of a word beyond which it is encoded as a tree; of a leaf of such a word; of a leaf of a text; bytes of a generation of cached words.
LONG, LEAF, SPAN, CACHE = 512, 256, 1024, 96 << 20
Encoded = tuple[int, bytes, bytes]  # number of ids, the ids in decimal joined by spaces, the decoded text


class TreeBpe:
    """encode(text) gives ids and tokens exactly as the library does with add_special_tokens=False."""

    def __init__(self, name: str = TOKENIZER, long: int = LONG, leaf: int = LEAF, span: int = SPAN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = shared.tokenizer_path(name)
        self.tok, self.inner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.suffix = self.tok.model.end_of_word_suffix or ""
        if self.suffix:
            self.inner.model.end_of_word_suffix = None
        # the rules under which plain letters are one piece each
        self.ordinary = "[\\p{L}]+|" in self.tok.pre_tokenizer.__getstate__().decode().replace("\\\\", "\\") and self.suffix != ""
        if self.tok.decoder is not None:
            raise ValueError("a tokenizer with a decoder of its own isn't supported")
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.long, self.leaf, self.span = long, max(leaf, 2), max(span, 2)
        self.words = shared.TwoGenerations(self._word, CACHE, longest=64, each=330)
        #: joins of halves of texts, and of halves of long words; windows that had to grow
        self.joins, self.word_joins, self.grown = 0, 0, 0

    # -- one unsplit piece, already in the tokenizer's own alphabet

    def _raw(self, piece: str, last: bool) -> list[tuple[int, str]]:
        return [(t.id, t.value) for t in (self.tok if last else self.inner).model.tokenize(piece)]

    def _plain(self, value: str, last: bool) -> str:
        return value.removesuffix(self.suffix) if last and self.suffix else value

    def _join(self, left: list, right: list, last: bool) -> list:
        """left and right encode neighbouring text; right ends the word if last."""
        a = b = 2
        self.word_joins += 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            ends = last and b == len(right)
            inside = [v for _, v in left[-a:] + right[:b]]
            inside[-1] = self._plain(inside[-1], ends)
            window = self._raw("".join(inside), ends)
            agree_left = a == len(left) or window[0] == left[-a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = (a if agree_left else 2 * a), (b if agree_right else 2 * b)

    def tree(self, piece: str, last: bool = True, pool: ThreadPoolExecutor | None = None) -> list[tuple[int, str]]:
        """The tokens of one unsplit piece, by halves."""
        if len(piece) <= self.leaf:
            return self._raw(piece, last)
        cuts = [*range(0, len(piece), self.leaf), len(piece)]
        spans = [(piece[i:j], last and j == len(piece)) for i, j in zip(cuts, cuts[1:], strict=False)]
        level = list(pool.map(lambda s: self._raw(*s), spans)) if pool else [self._raw(*s) for s in spans]
        while len(level) > 1:
            pairs = [(level[i], level[i + 1], last and i + 2 == len(level)) for i in range(0, len(level) - 1, 2)]
            tail = level[2 * len(pairs) :]
            level = (list(pool.map(lambda p: self._join(*p), pairs)) if pool else [self._join(*p) for p in pairs]) + tail
        return level[0]

    # -- words between ASCII white space

    def _long_word(self, word: str) -> tuple[list[int], list[str]]:
        """A long word: cut at special strings, then by the library's own rules into pieces, which the tree encodes."""
        out: list[tuple[int, str]] = []
        with ThreadPoolExecutor(2) as pool:
            for part in self.cut.split(word) if self.cut else [word]:
                if part in self.special:
                    out.append((self.special[part], part))
                    continue
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    out += self.tree(piece, True, pool if len(piece) > self.long else None)
        return [i for i, _ in out], [v for _, v in out]

    def _word(self, word: bytes) -> Encoded:
        if word.isascii() and self.ordinary and len(word) <= self.long:
            if word.isalpha():
                if not word.islower():
                    return self.words[word.lower()]
                found = self.tok.model.tokenize(word.decode())
                return len(found), b" ".join([b"%d" % t.id for t in found]), " ".join([t.value for t in found]).encode()
            if len(word) > 1 and word[-1:] in b".,|" and word[-2:-1].isalpha():  # a piece of its own
                a, b = self.words[word[:-1]], self.words[word[-1:]]
                return a[0] + b[0], a[1] + b" " + b[1], a[2] + b" " + b[2]
        text = word.decode()
        if len(text) > self.long:
            ids, tokens = self._long_word(text)
        else:
            e = self.tok.encode(text, add_special_tokens=False)
            ids, tokens = e.ids, e.tokens
        return len(ids), " ".join(map(str, ids)).encode(), " ".join(tokens).encode()

    # -- whole texts: spans of bytes, as the words they hold and their encodings

    def _leaf(self, data: bytes) -> tuple[list[bytes], list[Encoded]]:
        words = data.split()  # ASCII white space
        return words, [self.words[w] for w in words]

    def _join_text(self, data: bytes, low: int, cut: int, high: int, left: tuple, right: tuple) -> tuple[list[bytes], list[Encoded]]:
        """left and right encode data[low:cut] and data[cut:high]."""
        (lw, le), (rw, re_) = left, right
        if not lw or not rw:
            return right if not lw else left
        self.joins += 1
        split = not (data[cut - 1 : cut].isspace() or data[cut : cut + 1].isspace())  # the seam is inside a word
        a = b = 1
        while True:
            a, b = min(a, len(lw)), min(b, len(rw))
            words = [*lw[len(lw) - a : -1], lw[-1] + rw[0], *rw[1:b]] if split else [*lw[len(lw) - a :], *rw[:b]]
            window = [self.words[w] for w in words]
            agree_left = a == len(lw) or window[0] == le[len(lw) - a]
            agree_right = b == len(rw) or window[-1] == re_[b - 1]
            if agree_left and agree_right:
                return lw[: len(lw) - a] + words + rw[b:], le[: len(le) - a] + window + re_[b:]
            self.grown += 1
            a, b = (a if agree_left else 2 * a), (b if agree_right else 2 * b)

    def _text(self, data: bytes, low: int, high: int) -> tuple[list[bytes], list[Encoded]]:
        if high - low <= self.span:
            return self._leaf(data[low:high])
        cut = (low + high) // 2
        while data[cut] & 0xC0 == 0x80:  # not inside a character
            cut -= 1
        word_from, word_to = cut, cut
        while word_from > low and not data[word_from - 1 : word_from].isspace() and cut - word_from <= self.long:
            word_from -= 1
        while word_to < high and not data[word_to : word_to + 1].isspace() and word_to - word_from <= self.long:
            word_to += 1
        if word_to - word_from > self.long:  # a word with a tree of its own stays whole
            word_from = next((i for i in range(cut, low, -1) if data[i - 1 : i].isspace()), low)
            word_to = next((i for i in range(cut, high) if data[i : i + 1].isspace()), high)
            cut = word_from if word_from > low else word_to
            if cut in (low, high):
                return self._leaf(data[low:high])
        return self._join_text(data, low, cut, high, self._text(data, low, cut), self._text(data, cut, high))

    def parts(self, text: str | None) -> Encoded:
        """Number of ids, the ids in decimal joined by spaces, the decoded text."""
        data = (text or "").encode()
        kept = [x for x in self._text(data, 0, len(data))[1] if x[0]]
        return sum(x[0] for x in kept), b" ".join([x[1] for x in kept]), b" ".join([x[2] for x in kept])


_codecs: dict[tuple, TreeBpe] = {}


shared.caches("bpe_codec", _codecs.clear)


def codec(name: str = TOKENIZER) -> TreeBpe:
    """This worker's codec, with the words it has seen."""
    if name not in _codecs:
        _codecs[name] = TreeBpe(name)
    return _codecs[name]


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """docs with ``n_tokens`` long and, as asked for, ``ids`` array<int>, ``decoded`` string; always the two digests.

    keep: the columns to pass through (all by default).
    """
    shared.text_batches(docs.sparkSession)
    new = [("n_tokens", T.LongType())] + ([("ids", T.ArrayType(T.IntegerType(), False)), ("decoded", T.StringType())] if ids else []) + [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names = {n for n, _ in new}
    keep = shared.without(docs.columns if keep is None else keep, names)
    (body,) = shared.free(keep, "text_to_encode")
    source = docs.select(*[docs[c] for c in keep], docs[text].alias(body))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in new])

    def run(batches):
        shared.only("bpe_codec")
        c = codec(tokenizer)
        for b in shared.small(batches):
            rows = [c.parts(x) for x in b.column(body).to_pylist()]
            cols = [b.column(k) for k in keep] + [pa.array([r[0] for r in rows], pa.int64())]
            if ids:
                cols += [pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2].decode() for r in rows], pa.string())]
            cols += [pa.array([hashlib.sha256(r[k]).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [n for n, _ in new])

    return source.mapInArrow(run, schema)
