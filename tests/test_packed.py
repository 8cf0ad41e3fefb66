"""Packed ids: written and read back, split by ranges, and made by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from tokenloom.sources import packed as P


@pytest.mark.parametrize("code", [3, 4, 5, 8])
def test_round_trip(spark, tmp_path, code, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 90)
    monkeypatch.setattr(P, "RANGE", 40)
    rows = spark.range(500, numPartitions=2).select("id", F.when(F.col("id") % 7 != 0, F.transform(F.sequence(F.lit(0), (F.col("id") % 5).cast("int")), lambda x: x * 13 + F.col("id"))).alias("ids"))
    manifest = P.write_packed(rows, F.col("ids"), str(tmp_path / "a"), code)
    assert manifest.agg(F.sum("n")).first()[0] == 500
    got = {r.row: r.ids for r in P.read_packed(spark, str(tmp_path / "a")).collect()}
    assert got == {r.id: r.ids or [] for r in rows.collect()}


def test_a_failed_attempts_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    P.write_packed(spark.range(3).select(F.array("id").alias("x")), F.col("x"), path)
    (tmp_path / "a" / "part-000000-00000-a999999.idx").write_bytes(b"junk")
    assert sorted(r.ids for r in P.read_packed(spark, path).collect()) == [[0], [1], [2]]


def index(code, sizes, starts):
    return P.MAGIC + struct.pack("<QBQ", 1, code, len(sizes)) + struct.pack(f"<{len(sizes)}i", *sizes) + struct.pack(f"<{len(starts)}q", *starts)


def test_files_made_elsewhere(spark, tmp_path):
    (tmp_path / "b.idx").write_bytes(index(8, [2, 0, 1], [0, 4, 4]))
    (tmp_path / "b.bin").write_bytes(struct.pack("<3H", 7, 65535, 9))
    (tmp_path / "c.idx").write_bytes(index(5, [1], [0]))
    (tmp_path / "c.bin").write_bytes(struct.pack("<q", -(2**40)))
    (tmp_path / "d.idx").write_bytes(index(4, [], []))
    (tmp_path / "d.bin").write_bytes(b"")
    assert sorted(map(tuple, P.read_packed(spark, str(tmp_path)).collect())) == [(0, [7, 65535]), (1, []), (2, [9]), (3, [-(2**40)])]


@pytest.mark.parametrize(("idx", "bin", "says"), [(b"", b"", "no index"), (index(4, [3], [0]), b"1234", "cut off"), (index(6, [1], [0]), b"1234", "type 6"), (index(4, [1, 1], [0]), b"1234", "2 rows")])
def test_bad_files(spark, tmp_path, idx, bin, says):
    (tmp_path / "a.idx").write_bytes(idx)
    (tmp_path / "a.bin").write_bytes(bin)
    with pytest.raises(Exception, match=says):
        P.read_packed(spark, str(tmp_path)).collect()


def test_bad_rows_and_empty_tables(spark, tmp_path):
    for k, (x, says) in enumerate([(F.array(F.lit(None).cast("int")), "null id"), (F.array(F.lit(40000)), "beyond")]):
        with pytest.raises(Exception, match=says):
            P.write_packed(spark.range(1).select(x.alias("x")), F.col("x"), str(tmp_path / str(k)), 3)
    P.write_packed(spark.range(0).select(F.array("id").alias("x")), F.col("x"), str(tmp_path / "none"))
    assert P.read_packed(spark, str(tmp_path / "none")).count() == 0


def test_dictionary(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("C 120\n= 7\n<pad> 3 #fairseq:overwrite\na b 1\n")
    got = sorted(map(tuple, P.dictionary(spark, str(tmp_path / "dict.txt")).collect()))
    assert got[3:] == [(3, "<unk>", 0), (4, "C", 120), (5, "=", 7), (6, "<pad>", 3), (7, "a b", 1)]
    (tmp_path / "bad.txt").write_text("C\n")
    with pytest.raises(Exception, match="no count"):
        P.dictionary(spark, str(tmp_path / "bad.txt")).collect()
