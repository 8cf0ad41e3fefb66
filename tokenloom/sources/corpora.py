"""Large files: records split inside a file, files of exact numbers of lines, shards with a manifest."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ends a record of a structure-data file, and what ends its structure (fixed values).
RECORD_END, STRUCTURE_END = "\n$$$$\n", r"(?m)^M\s+END\s*$"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset and Spark runs in this one process, below a folder of this machine."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpora-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- structure-data files


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, atoms, bonds, structure, properties, status) of each record; properties: a map of text.

    Records end at a line of four dollar signs, at which files are split too, so a file is read by many tasks. status: "ok", else what a record
    lacks, with nulls for what can't be read: "no structure end", "bad counts" (the fourth line's first two numbers, three characters each), "repeated
    property" (the last one stays). No record is dropped, none raises; white space after the last record is none.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n", "\n").alias("r"))
    r = F.regexp_replace("r", r"\n?\$\$\$\$\s*\z", "")
    rows = raw.select("path", r.alias("r")).where(F.length(F.regexp_replace("r", r"\s", "")) > 0)
    line = F.split("r", "\n")
    counts = F.get(line, F.lit(3))
    number = lambda at: F.trim(F.substring(counts, at, 3)).try_cast("int")
    parts = F.split("r", STRUCTURE_END, 2)
    found = F.regexp_extract_all(F.get(parts, F.lit(1)), F.lit(r"(?ms)^>[^\n<]*<([^>\n]+)>[^\n]*\n(.*?)(?=\n[ \t]*(?:\n|\z)|\z)"), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r"<([^>\n]+)>", 1).alias("key"), F.regexp_replace(p, r"\A[^\n]*\n", "").alias("value"))
    entries = F.transform(found, entry)
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    n_atoms, n_bonds = number(1), number(4)
    status = F.when(F.size(parts) < 2, "no structure end").when(n_atoms.isNull() | n_bonds.isNull(), "bad counts").when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated property").otherwise("ok")
    return rows.select("path", F.trim(F.get(line, F.lit(0))).alias("title"), n_atoms.alias("atoms"), n_bonds.alias("bonds"), F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("structure"), F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>"))).alias("properties"), status.alias("status"))


def property_columns(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """records with a column for each property named, cast to its type; null where it is absent or isn't of the type."""
    return records.withColumns({n: F.try_element_at("properties", F.lit(n)).try_cast(kind) for n, kind in names.items()})


def sdf_record(title: Column, structure: Column, properties: dict[str, Column]) -> Column:
    """The text of a record without its end line, for ``write_sdf``; structure: the lines after the title up to its end line; null properties are left out."""
    body = F.concat(title, F.lit("\n"), structure, F.lit("\nM  END\n"))
    return F.concat(body, *[F.coalesce(F.concat(F.lit(f"> <{n}>\n"), v.cast("string"), F.lit("\n\n")), F.lit("")) for n, v in properties.items()])


def write_sdf(df: DataFrame, record: Column, path: str) -> None:
    df.select(F.regexp_replace(record, r"\n\z", "").alias("value")).write.option("lineSep", RECORD_END).text(path)


# -- files of exact numbers of lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, line): the lines of all files, in the order of their paths.

    Files are read in parts, and a line's number is the lines of the parts before plus its place in its own: only a count per part is summed in one place. Lines end at line feeds.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("__p"), F.col("_metadata.file_block_start").alias("__s")]
    rows = read.select(F.col("value").alias("line"), *at, F.monotonically_increasing_id().alias("__i"))
    parts = rows.groupBy("__p", "__s").agg(F.count("*").alias("n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p", "__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(parts.withColumn("__b", before).drop("n"), ["__p", "__s"]).select((F.col("__b") + F.col("__i") - F.col("__first")).alias("line_no"), "line")


def split_lines(spark: SparkSession, path: str, out: str, n: int) -> None:
    """Writes files of exactly n lines (the last may be shorter) below out, in folders ``chunk=0``, ``chunk=1``, ...: every line once, in order.

    A task writes whole files and holds none: a file of n lines is sorted by line number on its way, which spills.
    """
    rows = numbered_lines(spark, path).withColumn("chunk", F.floor(F.col("line_no") / n))
    rows.repartition("chunk").sortWithinPartitions("chunk", "line_no").select("chunk", "line").write.partitionBy("chunk").option("lineSep", "\n").text(out)


# -- shards


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: under another name first."""
    fs, at = _fs(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(new, at):
        raise OSError(f"{path} can't be written")


def _read(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def add_shard(df: DataFrame, path: str) -> str:
    """Writes df as a shard of the collection at path, under a name of its own, and then enters it in the manifest: a shard that fails isn't in it."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/shards/{name}")
    _put(spark, f"{path}/manifest/{name}.json", json.dumps({"shard": name}))
    return name


def shards(spark: SparkSession, path: str) -> list[str]:
    """The names in the manifest."""
    fs, at = _fs(spark, f"{path}/manifest")
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removesuffix(".json") for n in found if n.endswith(".json"))


def merge_shards(spark: SparkSession, path: str, out: str, remove: bool = False, files: int | None = None) -> DataFrame:
    """The shards entered so far as one table at out; remove: they are deleted then, with their entries.

    Which shards are merged is written down first, the table is committed next, and only then are shards deleted. Stopped at any point, it can be run again with the same result:
    an uncommitted table is written anew from the same list, a committed one is left, and what is left of the list is deleted. Shards that are added meanwhile stay. Without shards it raises.
    """
    plan = f"{out}.plan.json"
    if not _exists(spark, plan):
        if _exists(spark, f"{out}/_SUCCESS"):
            return spark.read.parquet(out)  # merged before, and what was to be deleted is
        names = shards(spark, path)
        if not names:
            raise ValueError("no shards")
        _put(spark, plan, json.dumps(names))
    names = json.loads(_read(spark, plan))
    if not _exists(spark, f"{out}/_SUCCESS"):
        whole = spark.read.option("mergeSchema", True).parquet(*[f"{path}/shards/{n}" for n in names])
        (whole.repartition(files) if files else whole).write.mode("overwrite").parquet(out)
    if remove:
        for n in names:  # the entry first: a shard without one is never read
            _delete(spark, f"{path}/manifest/{n}.json")
            _delete(spark, f"{path}/shards/{n}")
    _delete(spark, plan)
    return spark.read.parquet(out)
