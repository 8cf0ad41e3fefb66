"""Checks of a map between the tokens of two notations."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import tokens as K

GOOD = [(0, "[C]", 0), (1, "[=O]", 2), (2, "[C@@H1]", 3)]
TOKENS = ["C", "(", "O", "[C@@H]", "1"]


@pytest.mark.parametrize(
    ("tokens", "items", "expected"),
    [
        (TOKENS, GOOD, (True, True, True, True)),
        (TOKENS, GOOD + [(2, "[C]", 4)], (False, True, True, True)),
        (TOKENS, GOOD + [(5, "[C]", 0)], (True, False, True, True)),
        (TOKENS, GOOD[1:], (True, True, False, True)),
        (TOKENS, [(0, "[N]", 0), *GOOD[1:]], (True, True, True, False)),
        (TOKENS, [*GOOD[:2], (2, "[C@H1]", 3)], (True, True, True, False)),
        (TOKENS, GOOD + [(9, "[X]", 50)], (True, True, True, True)),
        (["c", "ü"], [(0, "[C]", 0), (1, "[Ü]", 1)], (True, True, True, True)),
        ([], [], (True, True, True, True)),
        (None, GOOD, None),
        (TOKENS, None, None),
    ],
)
def test_checks(spark, tokens, items, expected):
    df = spark.createDataFrame([(tokens, items)], "t array<string>, m array<struct<pos:int,token:string,at:int>>")
    got = df.select(K.map_checks(F.col("t"), F.col("m")).alias("c")).first().c
    assert (got and tuple(got)) == expected


def test_long_texts(spark):
    n = 300_000
    df = spark.range(1).select(F.array_repeat(F.lit("C"), n).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("pos"), F.lit("[C]").alias("token"), i.alias("at"))).alias("m"))
    assert tuple(df.select(K.map_checks(F.col("t"), F.col("m")).alias("c")).first().c) == (True,) * 4


def test_classes_of_the_atom_pattern_match_the_same(spark):
    rng = random.Random(1)
    pieces = [*"BrClNOSPFIbcnosp()[].=#-+\\/:~@?*$%0123456789<unk>>a \nHé", "<unk>", "[C@]", "%12", "[]", "]]"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.array_remove(F.split(F.regexp_replace("text", K.ATOM_PATTERN, f"{K.FENCE}$1{K.FENCE}"), K.FENCE), "")
    assert df.where(~plain.eqNullSafe(K.tokenize(F.col("text")))).count() == 0
    assert K._ATOM_CLASSES.count("|") == 6
