"""Structure-data files, files of exact numbers of lines, shards with a manifest."""

import pytest
from pyspark.sql import functions as F

from tokenloom.sources import corpora as C

GOOD = "benzene\n  made\n\n  6  6  0  0\n 0 0 0 C\nM  END\n> <SMILES>\nc1ccccc1\n\n>  25  <NOTE> (x)\ntwo\nlines\n\n> <EMPTY>\n\n"


def test_sdf_records(spark, tmp_path):
    records = [GOOD, "cut off\n\n\n  1  0\n", "bad\n\n\n  x  0\nM  END\n", "\n\n\n  1  0\nM  END\n> <A>\n1\n\n> <A>\n2\n\n", "plain\n\n\n  2  1\nM  END\n"]
    (tmp_path / "a.sdf").write_text("$$$$\n".join(records) + "$$$$\n\n")
    (tmp_path / "b.sdf").write_bytes((GOOD + "$$$$").replace("\n", "\r\n").encode())
    got = sorted(C.sdf(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.title, r.status))
    assert len(got) == 6
    by = {(r.path[-5:], r.title): r for r in got}
    r = by["a.sdf", "benzene"]
    assert (r.atoms, r.bonds, r.status) == (6, 6, "ok")
    assert r.properties == {"SMILES": "c1ccccc1", "NOTE": "two\nlines", "EMPTY": ""}
    assert r.structure.endswith(" 0 0 0 C\n")
    assert by["b.sdf", "benzene"].properties == r.properties
    assert (by["a.sdf", "cut off"].status, by["a.sdf", "cut off"].structure) == ("no structure end", None)
    assert by["a.sdf", "bad"].status == "bad counts"
    assert (by["a.sdf", ""].status, by["a.sdf", ""].properties) == ("repeated property", {"A": "2"})
    assert (by["a.sdf", "plain"].status, by["a.sdf", "plain"].properties) == ("ok", {})


def test_sdf_round_trip_is_split_inside_a_file(spark, tmp_path):
    rows = spark.range(3000).select("id", F.repeat(F.lit("C"), (F.col("id") % 50).cast("int")).alias("smiles"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    structure = F.concat(F.lit("\n\n"), F.lit("  1  0"))
    C.write_sdf(rows.coalesce(1), C.sdf_record(F.col("id").cast("string"), structure, {"smiles": F.col("smiles"), "x": F.col("x")}), str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = C.property_columns(C.sdf(spark, str(tmp_path / "out")), {"smiles": "string", "x": "double"})
        assert read.rdd.getNumPartitions() > 3
        got = sorted((int(r.title), r.smiles, r.x, r.status) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(r.id, r.smiles, r.x, "ok") for r in rows.orderBy("id").collect()]


@pytest.mark.parametrize(("n", "size"), [(7, 40), (100, 300), (5000, 1000), (1000, 10_000_000)])
def test_lines_are_split_in_order(spark, tmp_path, n, size):
    lines = [f"line {i}" * (i % 4) for i in range(1000)]  # some are empty
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:600]) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[600:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        C.split_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = []
    for k in range(-(-1000 // n)):
        files = sorted((tmp_path / "out" / f"chunk={k}").glob("part-*"))
        assert len(files) == 1
        own = files[0].read_text().removesuffix("\n").split("\n")
        assert len(own) == min(n, 1000 - k * n)
        got += own
    assert got == lines
    assert len(list((tmp_path / "out").glob("chunk=*"))) == -(-1000 // n)


def test_split_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("")
    C.split_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), 3)
    assert not list((tmp_path / "out").glob("chunk=*"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_shards_are_merged(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(ValueError, match="no shards"):
        C.merge_shards(spark, path, f"{path}/all")
    C.add_shard(spark.range(3), path)
    C.add_shard(spark.range(3, 5).withColumn("more", F.lit("x")), path)
    spark.range(100).write.parquet(f"{path}/shards/not-entered")
    assert ids(C.merge_shards(spark, path, f"{path}/kept")) == list(range(5))
    assert len(C.shards(spark, path)) == 2
    merged = C.merge_shards(spark, path, f"{path}/all", remove=True, files=1)
    assert ids(merged) == list(range(5)) and sorted(merged.columns) == ["id", "more"]
    assert C.shards(spark, path) == []
    assert ids(C.merge_shards(spark, path, f"{path}/all", remove=True)) == list(range(5))


@pytest.mark.parametrize("stop", range(7))
def test_a_stopped_merge_can_be_run_again(spark, tmp_path, monkeypatch, stop):
    """Stops at the stop-th change to the file system after the plan, whichever that is; a shard comes in between."""
    path = str(tmp_path / "c")
    for k in range(2):
        C.add_shard(spark.range(k * 10, k * 10 + 3), path)
    want, done, real = [0, 1, 2, 10, 11, 12], [0], C._delete

    def fails(spark, at):
        done[0] += 1
        if done[0] == stop:
            raise OSError("stopped")
        real(spark, at)

    monkeypatch.setattr(C, "_delete", fails)
    if stop == 0:  # the table is only half written
        names = C.shards(spark, path)
        C._put(spark, f"{path}/all.plan.json", __import__("json").dumps(names))
        spark.range(999).write.parquet(f"{path}/all")
        (tmp_path / "c" / "all" / "_SUCCESS").unlink()
        stopped = True
    else:
        try:
            C.merge_shards(spark, path, f"{path}/all", remove=True)
            stopped = False
        except OSError:
            stopped = True
    assert stopped == (stop < 6)  # two entries, two shards, the plan
    C.add_shard(spark.range(100, 101), path)
    monkeypatch.setattr(C, "_delete", real)
    assert ids(C.merge_shards(spark, path, f"{path}/all", remove=True)) == want
    assert len(C.shards(spark, path)) == 1
    assert not list(tmp_path.glob("c/all.plan*"))
