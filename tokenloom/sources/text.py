"""Text sources: lines, sections, flags and tables inside text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a stated schema; columns are taken by position, as the header may differ."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line)."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out by rows if fewer partitions hold rows than there are cores (a file with one row group is one task otherwise).

    Counts in a job that reads no columns; a table with as many filled partitions as cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if held >= cores else df.repartition(cores)


def named_files(spark: SparkSession, path: str, glob: str | None = None, holding: str | None = None) -> DataFrame:
    """(path, name) of the files below a folder; glob: a pattern of file names, holding: text that the path has. Contents aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path")
    found = found.where(F.contains("path", F.lit(holding))) if holding else found
    return found.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"))


def json_maps(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(name, key, value): the entries of a folder's JSON files, each one map; value: its type. A file that isn't a map fails."""
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    entries = F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})
    return f.select(name.alias("name"), F.explode(entries).alias("key", "value"))


def estimator_report(content: Column) -> Column:
    """struct<estimator, params> of a report: its first line, then a literal of names and scalars that may go over lines."""
    line = F.split(content, "\n")
    rest = F.array_join(F.transform(F.slice(line, 2, F.size(line)), lambda x: F.trim(x)), "")
    pairs = F.regexp_extract_all(rest, F.lit(r"'([^']*)'\s*:\s*('[^']*'|[^,{}]+)"), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^'([^']*)'", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^'[^']*'\s*:\s*", ""), "'", "")).alias("value"))
    good = rest.rlike(r"(?s)^\s*\{.*\}\s*$")
    params = F.when(good, F.map_from_entries(F.transform(pairs, entry))).otherwise(F.raise_error(F.lit("not a report of parameters")).cast("map<string,string>"))
    return F.struct(F.trim(F.get(F.split(content, "\n"), F.lit(0))).alias("estimator"), params.alias("params"))


def wide_cells(line: Column) -> Column:
    """Cells of a line that are two or more blanks apart; empty ones are left out."""
    return F.filter(F.transform(F.split(line, r"\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")


#: Cells of a classification report by line (of those that aren't empty) and place (fixed positions).
REPORT = {"0p": (1, 1), "0r": (1, 2), "0f": (1, 3), "1p": (2, 1), "1r": (2, 2), "1f": (2, 3), "accuracy": (3, 1), "precision": (4, 1), "recall": (4, 2), "f1": (4, 3), "wp": (5, 1), "wr": (5, 2), "wf": (5, 3)}


def report_table(content: Column) -> Column:
    """struct<estimator, 0p, ...> of a printed classification report of two classes, from its first eight lines; a missing cell fails."""
    rows = F.transform(F.filter(F.slice(F.split(content, "\n"), 1, 8), lambda x: F.trim(x) != ""), wide_cells)
    cell = lambda i, j: F.coalesce(F.get(F.get(rows, F.lit(i)), F.lit(j)), F.raise_error(F.lit(f"no cell {i}, {j}")).cast("string"))
    return F.struct(cell(0, 0).alias("estimator"), *[cell(*at).cast("double").alias(n) for n, at in REPORT.items()])


def label_vector(spark: SparkSession, path: str) -> DataFrame:
    """(row from 0, label): numbers of one text file, one a line; blank lines are left out."""
    whole = spark.read.text(path, wholetext=True)
    numbers = F.filter(F.transform(F.split("value", r"\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return whole.select(F.posexplode(F.transform(numbers, lambda x: x.cast("double"))).alias("row", "label"))


def atom_types(content: Column) -> Column:
    """Column 5 of the lines between the ATOM and BOND marks of a mol2 text, hydrogens dropped."""
    section = F.regexp_extract(content, r"(?s)@<TRIPOS>ATOM[^\n]*\n(.*?)@<TRIPOS>BOND", 1)
    rows = F.filter(F.split(section, "\n"), lambda r: F.trim(r) != "")
    types = F.transform(rows, lambda r: F.get(F.split(F.trim(r), r"\s+"), F.lit(5)))
    return F.filter(types, lambda t: ~t.rlike("^[Hh]"))


def flag_and_max(content: Column, flag: str, number: str) -> Column:
    """struct<ok, most>: ok unless the flag occurs, then the largest number that the pattern captures, 0 if none."""
    found = F.transform(F.regexp_extract_all(content, F.lit(number), F.lit(1)), lambda x: x.cast("double"))
    ok = ~F.contains(content, F.lit(flag))
    return F.struct(ok.alias("ok"), F.when(ok, F.coalesce(F.array_max(found), F.lit(0.0))).alias("most"))


def cells(row: Column) -> Column:
    """Cells of a markdown table row without the first two and the last."""
    parts = F.transform(F.split(F.trim(row), r"\|"), lambda x: F.trim(x))
    return F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0)))


def attention_tables(rows: DataFrame, file: str = "path", no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, molecule, kind, tokens, relative, absolute) of a report: rows 1, 3 and 4 below each mark."""
    w = Window.partitionBy(file).orderBy(no)
    r = rows.select(file, no, F.trim(line).alias("l"), *[F.lead(line, k).over(w).alias(f"l{k}") for k in (1, 3, 4)])
    r = r.withColumn("molecule", F.last(F.when(F.col("l") == "## Molecule", F.trim("l1")), ignorenulls=True).over(w))
    marks = r.where(F.col("l").isin("## SMILES", "## SELFIES"))
    return marks.select(file, "molecule", F.substring("l", 4, 20).alias("kind"), cells(F.col("l1")).alias("tokens"), cells(F.col("l3")).alias("relative"), cells(F.col("l4")).alias("absolute"))


def after_marker(rows: DataFrame, marker: str, file: str = "path", no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, value): the line after each marker line, null where none follows; a file without a marker fails."""
    w = Window.partitionBy(file).orderBy(no)
    marked = F.coalesce(F.trim(line) == marker, F.lit(False))
    r = rows.withColumns({"value": F.lead(line).over(w), "__n": F.count_if(marked).over(Window.partitionBy(file)), "__m": marked, "__k": F.row_number().over(w)})
    missing = F.raise_error(F.concat(F.lit(f"no line {marker!r} in "), F.col(file).cast("string"))).cast("string")
    return r.where(F.col("__m") | ((F.col("__n") == 0) & (F.col("__k") == 1))).select(file, F.when(F.col("__n") == 0, missing).otherwise(F.trim("value")).alias("value"))
