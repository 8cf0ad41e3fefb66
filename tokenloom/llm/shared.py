"""Things every operator of this subpackage needs: the shared folder, written tables, tokenizer files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows taken from an Arrow batch at a time: 256 texts of 100 kB are 25 MB.
TEXT_BATCH = 256
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Where both are unset and Spark runs in this one process (tests), a folder of this machine serves;
    on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base := base or getattr(spark, "_tokenloom_dir", None):
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark._tokenloom_dir = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
    return spark._tokenloom_dir


def _own(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/tokenloom/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and lost executors cost nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tokenloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, neither now nor in a frame still to be computed."""
    for t in tables:
        delete(t.sparkSession, t._tokenloom_path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables and archives of this application; for when its results have been saved."""
    delete(spark, _own(spark))


def free(columns, *names: str) -> list[str]:
    """The names, each lengthened until no column (in any case of letters) has it."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(columns, names) -> list[str]:
    """The columns that none of the names replaces, whatever the case of their letters."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches at ``BATCH_BYTES``: a task holds a few of them, on both sides, beside its own work."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).lower())
    if most is None or int(most[1]) * 1024 ** "bkmg".index(most[2] or "b") > BATCH_BYTES or int(most[1]) == 0:
        spark.conf.set(key, str(BATCH_BYTES))


def small(batches):
    """Arrow batches in pieces of few rows: what Python objects are made of at a time."""
    for b in batches:
        for k in range(0, b.num_rows, TEXT_BATCH):
            yield b.slice(k, TEXT_BATCH)


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: What drops the caches of each operator in a worker process, and the operator that works in it.
_droppers: dict = {}
_working: list = [None]


def caches(operator: str, drop) -> None:
    """Registers drop(), which lets go of what the operator keeps in a worker process between tasks."""
    _droppers[operator] = drop


def only(operator: str) -> None:
    """Called in a worker by an operator that begins: workers are reused, and the caches of others would stay beside its own."""
    if _working[0] != operator:
        _working[0] = operator
        for other, drop in _droppers.items():
            if other != operator:
                drop()


class TwoGenerations(dict):
    """A cache bounded in bytes: when a generation is full it becomes the old one, whose hits move back in.

    Keys longer than ``longest`` are computed each time. Values are taken to cost ``each`` bytes beside their own and the key's length.
    """

    def __init__(self, make, most: int, longest: int = 64, each: int = 200):
        super().__init__()
        self.make, self.most, self.longest, self.each, self.held, self.old = make, most, longest, each, 0, {}

    def forget(self) -> None:
        self.clear()
        self.held, self.old = 0, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += len(key) + self.each + (sum(len(x) for x in value if isinstance(x, bytes)) if isinstance(value, tuple) else 0)
        self[key] = value
        return value
