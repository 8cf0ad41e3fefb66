"""Settings in names, and reports that must fail or be whole."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import configs as N
from tokenloom.sources import text as S


def test_tokenizer_names(spark):
    df = spark.createDataFrame([("smiles_atom_isomers",), ("selfies_trained_standard_roberta",), (None,)], "n string")
    assert [tuple(r.t) for r in df.select(N.parse_tokenizer(F.col("n")).alias("t")).collect()] == [("smiles", "atom", "isomers", "bart"), ("selfies", "trained", "standard", "roberta"), (None,) * 4]
    assert df.select(N.parse_tokenizer(F.col("n"), None).alias("t")).first()["t"].asDict() == {"embedding": "smiles", "tokenizer": "atom", "dataset": "isomers"}
    with pytest.raises(Exception, match="no part 3"):
        spark.createDataFrame([("smiles_atom",)], "n string").select(N.parse_tokenizer(F.col("n")).alias("t")).collect()


def test_hyperparameter_names(spark):
    df = spark.createDataFrame([("5e-06_0.2_based_norm",), ("1e-05_0.1",), ("1e-05_0.1_x",)], "n string")
    assert [tuple(r.h) for r in df.select(N.parse_hyperparams(F.col("n"), True).alias("h")).collect()] == [(5e-06, 0.2, "norm"), (1e-05, 0.1, None), (1e-05, 0.1, None)]
    assert df.select(N.parse_hyperparams(F.col("n")).alias("h")).schema["h"].dataType.names == ["learning_rate", "dropout"]
    for bad in ("x_0.1", "0.1"):
        with pytest.raises(Exception, match="CAST_INVALID|no part 2"):
            spark.createDataFrame([(bad,)], "n string").select(N.parse_hyperparams(F.col("n")).alias("h")).collect()


def test_grid(spark):
    rows = N.grid(spark.range(2), a=["x", "y"], b=[0.5]).collect()
    assert sorted(map(tuple, rows)) == [(i, a, 0.5) for i in (0, 1) for a in "xy"]
    assert N.grid(spark.range(2), a=[]).collect() == []


def test_files_without_a_marker_fail(spark):
    rows = spark.createDataFrame([("a", 0, " mark "), ("a", 1, " v "), ("a", 2, "mark")], "path string, line_no int, line string")
    assert sorted(map(tuple, S.after_marker(rows, "mark").collect()), key=repr) == [("a", "v"), ("a", None)]
    with pytest.raises(Exception, match="no line 'mark' in b"):
        S.after_marker(rows.union(spark.createDataFrame([("b", 0, "x"), ("b", 1, None)], rows.schema)), "mark").collect()
