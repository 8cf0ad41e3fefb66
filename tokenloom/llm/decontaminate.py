"""Operator 9: benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask selects some of the tokens of a window and ignores the others, so a substitution at an ignored position doesn't
hide a match. The hashes of all masks at all positions of the benchmark items are joined with those of the documents;
a hit fixes an alignment, which is then verified token by token: a document is contaminated by an item if
``WINDOW`` aligned tokens in a row (all of a shorter item) have at most a fifth of substitutions.

Of the benchmark only (hash, item number, position, size) is broadcast, 24 bytes of fixed width each, in groups of items of at most ``MOST_SEEDS``
hashes, so what is sent has a fixed bound in bytes whatever the items' lengths; a larger benchmark takes more passes over the documents. The items' tokens are
joined to the alignments found. Documents' tokens are never exchanged, only the aligned tokens of hits are, once per alignment (per item, where an item
is so short that any hit is a match).

An item's masks are those of its window's length, and only items of that length get them, so an item's findings don't depend on the others. At least one of them
fits between the allowed substitutions wherever these are, so no qualifying alignment goes without a hit (a test goes through all patterns).
Tokens are the runs of letters and digits of the text in lower case. A document of any length is one row; its token array and hashes are held by one task.

Defined results: null and empty texts have no tokens and neither match nor are matched; rows that share an id are compared each by its own
text and reported together (the best alignment of any); a null id is reported as null; repeated items are one; items that share an id
are compared each and reported together; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks by the window's length (fixed values): 1 selects a token, 0 ignores it. Windows of up to 4 tokens allow no substitution.
TEN, SIX = ("1111011", "11001111", "1110100011", "1101010101", "10110111"), ("11111", "111101", "111011", "110111", "101111")
MASKS = {n: ("1" * n,) for n in range(1, 5)} | {
    5: ("1111", "11101", "11011", "10111"), 6: SIX, 7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"), 9: ("1111011", "1101111"), 10: TEN, 11: TEN, 12: TEN,
    13: ("11110111", "1110100111", "1111111", "11101111"),
}
WINDOW, SUBSTITUTED, MOST_SEEDS = 13, 0.2, 500_000
#: Items of up to so many tokens allow no substitution and have one mask, of their length: a hit is a match.
EXACT = 4


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def needed(length: int) -> tuple[int, int]:
    """(window, matches it needs) for an item of that many tokens."""
    window = min(WINDOW, length)
    return window, math.ceil(round((1 - SUBSTITUTED) * window, 6))


def _seeds(rows: DataFrame, masks: list[str], keep: list[str], own: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """rows (t: tokens, ...) -> one row per position and mask that fits: keep, pos, seed. own: the masks by window, if rows are items."""
    t, pos, least = F.col("t"), F.col("pos"), min(map(len, masks))
    # outer, with null for short texts: a filter on the size would be pushed below and tokenize a second time
    places = F.when(F.size("t") >= least, F.sequence(F.lit(0), F.size("t") - least))
    at = rows.select(*keep, "t", F.explode_outer(places).alias("pos")).where("pos IS NOT NULL")
    seeds = []
    for k, m in enumerate(masks):
        fits = pos + len(m) <= F.size("t")
        if own:
            fits &= F.least(F.lit(WINDOW), F.size("t")).isin([n for n, ms in own.items() if m in ms])
        seeds.append(F.when(fits, F.xxhash64(F.lit(k), *[F.get(t, pos + p) for p, c in enumerate(m) if c == "1"])))
    return at.select(*keep, "t", "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str | list[str] = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens): the best alignment of each contaminated document and item.

    doc_id: the column, or columns, that tell documents apart; they come back under their names.
    """
    keys = [doc_id] if isinstance(doc_id, str) else list(doc_id)
    items = benchmark.select(benchmark[item_id].alias("item_id"), tokens(benchmark[item_text]).alias("it")).where(F.size("it") > 0).distinct()
    items = items.withColumn("ik", F.xxhash64("item_id", "it"))
    sizes = items.groupBy(F.least(F.lit(WINDOW), F.size("it")).alias("n")).agg(F.sum(F.size("it").cast("long")).alias("all")).collect()  # WINDOW rows at most
    own_masks = {r["n"]: MASKS[r["n"]] for r in sizes}
    masks = sorted({m for ms in own_masks.values() for m in ms} or set(MASKS[WINDOW]))
    n_seeds = sum(r["all"] * len(own_masks[r["n"]]) for r in sizes)
    passes = max(1, math.ceil(n_seeds / MOST_SEEDS))
    # dk: rows of one id are told apart by their texts
    source = docs.select(*[docs[k].alias(f"d{i}") for i, k in enumerate(keys)], F.xxhash64(docs[text]).alias("dk"), tokens(docs[text]).alias("t"))
    own_keys = [f"d{i}" for i in range(len(keys))]
    found = None
    for k in range(passes):
        mine = items.where(F.pmod("ik", F.lit(passes)) == k) if passes > 1 else items
        own = _seeds(mine.withColumn("t", F.col("it")).withColumn("n", F.size("it")), masks, ["ik", "n"], own_masks).select("ik", "n", F.col("pos").alias("item_pos"), "seed")
        hits = _seeds(source, masks, [*own_keys, "dk"]).join(F.broadcast(own), "seed")
        shift = F.col("pos") - F.col("item_pos")
        aligned = F.slice("t", F.greatest(shift, F.lit(0)) + 1, F.when(shift < 0, F.col("n") + shift).otherwise(F.col("n")))
        hits = hits.select(*own_keys, "dk", "ik", F.when(F.col("n") > EXACT, shift).alias("at"), F.struct(shift.alias("shift"), aligned.alias("aligned")).alias("a"))
        found = hits if found is None else found.unionByName(hits)
    once = found.groupBy(*own_keys, "dk", "ik", "at").agg(F.min("a").alias("a"))
    ahead = F.greatest(-F.col("a.shift"), F.lit(0))  # item tokens before the document begins
    same = F.zip_with("a.aligned", F.slice("it", ahead + 1, F.size("a.aligned")), lambda a, b: F.when(a == b, 1).otherwise(0))
    v = once.join(items, "ik").select(*own_keys, "item_id", F.size("it").alias("n"), same.alias("same"))
    window = F.least(F.lit(WINDOW), F.col("n"))
    need = F.element_at(F.array(*[F.lit(needed(n)[1]) for n in range(1, WINDOW + 1)]), window)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    good = F.exists(F.sequence(F.lit(0), F.size("same") - window), lambda k: total(F.slice(F.col("same"), k + 1, window)) >= need)
    v = v.where(F.size("same") >= window).where(good)
    v = v.groupBy(*own_keys, "item_id").agg(F.max("n").cast("long").alias("item_tokens"), F.max(total(F.col("same"))).cast("long").alias("matched_tokens"))
    return v.select(*[F.col(o).alias(k) for o, k in zip(own_keys, keys, strict=True)], "item_id", "item_tokens", "matched_tokens")
