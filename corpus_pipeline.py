"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and, but for the last, returns the columns of docs;
between stages the rows are written as Parquet and read again. Rows with null ids are judged like any other, but for near-duplicates, where they
all stay (they can't be named); of rows that share an id but not the text, the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import bpe_codec, decontaminate, near_dedup, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go; the scores are learned from sf_dir's labels."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    (name,) = shared.free(docs.columns, "toxic_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    An id stays if one of its rows does; of rows that share it, the one with the smallest text. Rows without an id stay. The ids
    grow with the input, so they are merged with the documents at every size, never broadcast; documents are exchanged once.
    """
    gone, nth = shared.free(docs.columns, "id_gone", "nth")
    going = near_dedup.near_groups(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias("stays")).where("NOT stays")
    going = shared.written(going.select(gone), "going")
    named = docs.where("doc_id IS NOT NULL").join(going.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti")
    first = named.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1)
    return first.select(*docs.columns).unionAll(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    of, c_id, c_hit = shared.free(docs.columns, "text_md5", "leak_id", "leak_md5")
    keyed = docs.withColumn(of, F.md5("text"))
    hits = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id", of])
    leaks = shared.written(hits.select(F.col("doc_id").alias(c_id), F.col(of).alias(c_hit)).distinct(), "leaks")
    return keyed.join(leaks, F.col("doc_id").eqNullSafe(F.col(c_id)) & F.col(of).eqNullSafe(F.col(c_hit)), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the text they decode to, and digests of both."""
    return bpe_codec.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: No SQL states a trained classifier or a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, name)
    return docs
