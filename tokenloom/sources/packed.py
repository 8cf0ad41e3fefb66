"""Rows of ids in packed files: an index (.idx) with each row's length and place, and the ids (.bin) one after the other; dictionaries of their tokens."""

from __future__ import annotations

import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.sources import corpora as C

#: How an index begins, its version, and the integer types by code (fixed values of the format).
MAGIC, VERSION, HEAD = b"MMIDIDX\x00\x00", 1, 26
TYPES = {1: "<u1", 2: "<i1", 3: "<i2", 4: "<i4", 5: "<i8", 8: "<u2", 9: "<u4"}
#: The first tokens of a dictionary, which its file doesn't list (fixed values).
FIRST = ["<s>", "<pad>", "</s>", "<unk>"]
#: Rows and bytes after which a pair of files is closed; rows that a task reads at a time; bytes of ids handed over at a time.
ROWS, BYTES, RANGE, HANDED = 1_000_000, 256 << 20, 100_000, 4 << 20
PAIR = "file string, part int, pair int, n long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", path)))


class _Pair:
    """Two files, in sight when they are whole; their name holds the task attempt's number."""

    def __init__(self, folder: str, part: int, pair: int, code: int, attempt: int):
        self.file, self.code, self.part, self.pair = f"part-{part:06d}-{pair:05d}-a{attempt}", code, part, pair
        self.fs, self.folder = _fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.hidden = f"{self.folder}/_{self.file}.{uuid.uuid4().hex}"
        self.out, self.sizes, self.bytes = self.fs.open_output_stream(self.hidden, compression=None), [], 0

    def add(self, ids: np.ndarray) -> None:
        kind = np.dtype(TYPES[self.code])
        if len(ids) and (ids.min() < np.iinfo(kind).min or ids.max() > np.iinfo(kind).max):
            raise ValueError(f"an id is beyond {kind.name}")
        self.out.write(ids.astype(kind).tobytes())
        self.sizes.append(len(ids))
        self.bytes += len(ids) * kind.itemsize

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        self.fs.move(self.hidden, f"{self.folder}/{self.file}.bin")
        sizes = np.array(self.sizes, "<i4")
        ends = np.cumsum(sizes, dtype="<i8") * np.dtype(TYPES[self.code]).itemsize
        with self.fs.open_output_stream(self.hidden, compression=None) as f:
            f.write(MAGIC + struct.pack("<QBQ", VERSION, self.code, len(sizes)))
            f.write(sizes.tobytes())
            f.write(np.concatenate([np.zeros(min(1, len(ends)), "<i8"), ends[:-1]]).tobytes())
        self.fs.move(self.hidden, f"{self.folder}/{self.file}.idx")
        return self.file, self.part, self.pair, len(sizes)


def write_packed(df: DataFrame, ids: Column, path: str, code: int = 4) -> DataFrame:
    """Writes an array column as pairs of files, a partition's rows in their order; returns the manifest (file, part, pair, n), a table that Spark commits.

    Null arrays are empty rows; a null id, or one beyond the type (``TYPES``), is an error. Pairs of attempts that failed are in no manifest and never read.
    A task holds a batch of rows and the lengths of a pair's rows.
    """

    def run(batches):
        from pyspark import TaskContext

        part, attempt, done, pair = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), [], None
        for b in batches:
            column = b.column(0)
            for k in range(len(column)):
                pair = pair or _Pair(path, part, len(done), code, attempt)
                row = column[k].values
                if row is not None and row.null_count:
                    raise ValueError("a null id")
                pair.add(np.zeros(0, "<i8") if row is None else row.to_numpy(zero_copy_only=False))
                if len(pair.sizes) >= ROWS or pair.bytes >= BYTES:
                    done.append(pair.close())
                    pair = None
        if pair:
            done.append(pair.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["file", "part", "pair", "n"])

    df.select(ids.cast("array<long>").alias("ids")).mapInArrow(run, PAIR).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(PAIR).parquet(f"{path}/manifest")


def _head(f, name: str) -> tuple[int, int]:
    head = f.read(HEAD)
    if len(head) < HEAD or head[:9] != MAGIC:
        raise ValueError(f"{name}: no index")
    version, code, n = struct.unpack("<QBQ", head[9:])
    if version != VERSION or code not in TYPES:
        raise ValueError(f"{name}: version {version}, type {code}")
    if f.size() != HEAD + 12 * n:
        raise ValueError(f"{name}: {n} rows in {f.size()} bytes")
    return code, n


def _heads(batches):
    for b in batches:
        rows = []
        for path in b.column("file").to_pylist():
            fs, at = _fs(path)
            with fs.open_input_file(at + ".idx") as f:
                rows.append((path, *_head(f, path)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["file", "code", "n"])


def _ranges(batches):
    """The rows of each (file, first, before) range, read from where the index says they begin."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["row", "ids"])

    for b in batches:
        for path, first, before in zip(*(b.column(c).to_pylist() for c in ("file", "first", "before")), strict=True):
            fs, at = _fs(path)
            with fs.open_input_file(at + ".idx") as f:
                code, n = _head(f, path)
                m = min(RANGE, n - first)
                f.seek(HEAD + 4 * first)
                sizes = np.frombuffer(f.read(4 * m), "<i4")
                f.seek(HEAD + 4 * n + 8 * first)
                starts = np.frombuffer(f.read(8 * m), "<i8")
            rows, held, kind = [], 0, np.dtype(TYPES[code])
            with fs.open_input_file(at + ".bin") as f:
                for k, (size, start) in enumerate(zip(sizes.tolist(), starts.tolist(), strict=True)):
                    f.seek(start) if f.tell() != start else None
                    data = f.read(size * kind.itemsize)
                    if len(data) < size * kind.itemsize:
                        raise ValueError(f"{path}: row {first + k} is cut off")
                    rows.append((before + first + k, np.frombuffer(data, kind).astype("<i8")))
                    held += 8 * size + 64
                    if held > HANDED:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(row from 0, ids) of a folder's pairs: those of its manifest in the order of partitions, where there is one, else all in the order of their paths.

    A file is read by as many tasks as it has ranges of rows; a task reads its range's part of the index and holds a batch of rows. Files that aren't of the format, or are cut off, are errors.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        files = spark.read.schema(PAIR).parquet(f"{path}/manifest").select(F.concat(F.lit(f"{path}/"), "file").alias("file"), F.struct("part", "pair").alias("at"), "n")
    else:
        fs, folder = C._fs(spark, path)  # Spark's own listing leaves out empty files, which are errors here
        found = sorted(s.getPath().toString() for s in fs.listStatus(folder))
        names = [(f.removesuffix(".idx"),) for f in found if f.endswith(".idx")]
        tasks = max(1, min(len(names), 10_000))
        files = spark.createDataFrame(names, "file string").repartition(tasks).mapInArrow(_heads, "file string, code int, n long").select("file", F.col("file").alias("at"), "n")
    # a row per file
    placed = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = placed.where("n > 0").select("file", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))).alias("first"))
    n = ranges.count()
    return ranges.repartition(max(1, min(n, 50_000))).mapInArrow(_ranges, "row long, ids array<long>")


def dictionary(spark: SparkSession, path: str, first: list[str] = FIRST) -> DataFrame:
    """(id, token, cnt) of a dictionary file: a token and its count a line, ids in the order of lines after the first tokens; a line without a count is an error."""
    lines = C.numbered_lines(spark, path).where("line <> ''")
    cnt = F.regexp_extract("line", r" (\d+)(?: #fairseq:overwrite)?$", 1)
    bad = F.raise_error(F.concat(F.lit("no count: "), "line"))
    own = lines.select((F.col("line_no") + len(first)).alias("id"), F.regexp_replace("line", r" \d+(?: #fairseq:overwrite)?$", "").alias("token"), F.when(cnt != "", cnt.cast("long")).otherwise(bad.cast("long")).alias("cnt"))
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(first)], "id long, token string, cnt long").unionAll(own)
