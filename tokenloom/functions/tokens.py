"""Token functions on strings and arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Atom-level token pattern (a fixed value).
ATOM_PATTERN = r"(<unk>|\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"
#: The same matches: alternatives of one character as a class, which is tried once a place (the others begin with other characters, so their order is free).
_ATOM_CLASSES = r"([NOSPFIbcnosp().=#\-+\\/:~@?*$0-9]|Br?|Cl?|\[[^\]]+]|>>?|%[0-9]{2}|<unk>)"
#: Special tokens, in the order of their ids (fixed values).
SPECIALS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>", "<cls>", "<sep>"]
#: A token with one of these characters carries structure, not an atom (fixed values).
STRUCTURE = r"[()=:~0-9#/\\]"
FENCE = "\u0001"


def tokenize(text: Column, pattern: str = ATOM_PATTERN) -> Column:
    """Lossless tokens: matches of the pattern, and what lies between them; no empty tokens."""
    pattern = _ATOM_CLASSES if pattern == ATOM_PATTERN else pattern
    return F.array_remove(F.split(F.regexp_replace(text, pattern, f"{FENCE}$1{FENCE}"), FENCE), "")


def clean_tokens(tokens: Column) -> Column:
    """array<struct<pos, token>> of the tokens that stand for atoms other than hydrogen."""
    with_pos = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    return F.filter(with_pos, lambda x: ~x["token"].isin("H", "h", "-") & (F.trim(x["token"]) != "") & ~x["token"].rlike(STRUCTURE))


def vocabulary(tokens: DataFrame, token: str, size: int = 1000, specials: list[str] = SPECIALS) -> DataFrame:
    """(id, token, cnt): specials first, then the commonest tokens, ties by token."""
    counts = tokens.where(~F.col(token).isin(specials)).groupBy(F.col(token).alias("token")).agg(F.count("*").alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), "token").limit(size - len(specials))
    ids = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("cnt"), "token")) + len(specials) - 1)
    fixed = tokens.sparkSession.createDataFrame([(i, s, 0) for i, s in enumerate(specials)], "id int, token string, cnt long")
    return fixed.unionByName(ids.select("id", "token", "cnt"))


#: Buckets of a vocabulary: a map is searched entry by entry, so each is kept small.
BUCKETS = 1024


def _bucket(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(BUCKETS))


def buckets(vocab: DataFrame) -> DataFrame:
    """One row with ``v``: array of BUCKETS maps token -> id. The vocabulary has a fixed most size."""
    maps = vocab.groupBy(_bucket(F.col("token")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m"))
    every = vocab.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.map_entries("m").alias("e")))), lambda x: F.coalesce(x["e"], F.array())).alias("e")).select(F.transform("e", F.map_from_entries).alias("v"))


def encode(tokens: Column, vocab: Column, unknown: int = SPECIALS.index("<unk>")) -> Column:
    """Ids of tokens; vocab: what ``buckets`` gives."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.get(vocab, _bucket(t)), t), F.lit(unknown)))


def truncate(ids: Column, most: int = 126, first: int = 0, last: int = 2) -> Column:
    """Sentinels around at most that many ids."""
    return F.concat(F.array(F.lit(first)), F.slice(ids, 1, most), F.array(F.lit(last)))


def rotate(ids: Column) -> Column:
    """The last element in front of the others; empty arrays stay."""
    return F.when(F.size(ids) == 0, ids).otherwise(F.concat(F.slice(ids, -1, 1), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))))


def gather(values: Column, positions: Column) -> Column:
    """Elements at positions from 0; null beyond the end."""
    return F.transform(positions, lambda p: F.get(values, p))


def first_letter_group(kind: Column) -> Column:
    """cl and br by themselves, other kinds by their first letter."""
    return F.when(kind.isin("cl", "br"), kind).otherwise(F.substring(kind, 1, 1))


def leading_symbol(token: Column) -> Column:
    return F.substring(F.upper(F.ltrim(token, F.lit("["))), 1, 1)


def _last_of_each(entries: Column, name: str) -> Column:
    """Entries whose field doesn't come again; for maps of some hundreds of entries."""
    keys = F.transform(entries, lambda e: e[name])
    return F.filter(entries, lambda e, i: i == F.size(keys) - F.array_position(F.reverse(keys), e[name]))


def inverted(pairs: Column) -> Column:
    """map value -> key; of keys with equal values the last one of the map stays."""
    return F.map_from_entries(F.transform(_last_of_each(F.map_entries(pairs), "value"), lambda e: F.struct(e["value"], e["key"])))


def merged(first: Column, second: Column) -> Column:
    """One map of both; the second's entries win."""
    return F.map_from_entries(_last_of_each(F.concat(F.map_entries(first), F.map_entries(second)), "key"))


def decode_label(target: Column, one_first: Column) -> Column:
    """Class of a target id: ids begin at 4, and the dictionary holds "1" before "0" or after it."""
    return F.when(one_first, 5 - target).otherwise(target - 4)


def map_checks(tokens: Column, items: Column) -> Column:
    """struct of four booleans about a token map, null where tokens or items are: ``distinct_from``, ``distinct_to``, ``complete``, ``same_letters``.

    tokens: of one notation. items: array<struct<pos, token, at>>, of which pos and token are those of the other notation and at is a position in tokens, from 0.
    distinct_from: no pos occurs twice. distinct_to: no at does. complete: every token of letters only is some item's. same_letters: where an item's
    token in tokens has letters, its letters and @ signs, in capitals, stand in the other's token side by side; an at beyond the tokens has none.
    Sets are of positions, so time grows with the length. Empty arrays pass.
    """
    at = F.transform(items, lambda x: x["at"])
    pos = F.transform(items, lambda x: x["pos"])
    letters = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^\p{L}+$"), i)), lambda i: i.isNotNull())
    own = lambda x: F.get(tokens, x["at"])
    differs = F.exists(items, lambda x: F.coalesce(own(x).rlike(r"\p{L}") & ~F.contains(x["token"], F.upper(F.regexp_replace(own(x), r"[^\p{L}@]", ""))), F.lit(False)))
    known = tokens.isNotNull() & items.isNotNull()
    return F.when(known, F.struct((F.size(F.array_distinct(pos)) == F.size(pos)).alias("distinct_from"), (F.size(F.array_distinct(at)) == F.size(at)).alias("distinct_to"), (F.size(F.array_except(letters, at)) == 0).alias("complete"), (~differs).alias("same_letters")))
