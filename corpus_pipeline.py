"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.llm.common import key_words, maybe_among, table, written
from meshlight.llm.decontaminate import decontaminate
from meshlight.llm.minhash import near_duplicates
from meshlight.llm.mixing import mixed
from meshlight.llm.quality import filter_quality
from meshlight.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling selects.

    Null and empty texts have weight one; rows of one doc_id share its draw, as do
    all rows without one; equal rows stay or go together.  An empty table stays empty.
    """
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each near-duplicate class that has the least doc_id.

    Of several rows of a doc_id one stays, that with the least hash of its columns;
    rows without a doc_id all stay.  Null text reads as empty, and empty texts are
    equal.  An empty table stays empty.
    """
    classes = written(near_duplicates(docs), "classes").where("doc_id is not null")
    gone = classes.where("not keep").select("doc_id").distinct()
    twice = classes.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Only rows that may go or that share their id are exchanged.
    marked = maybe_among(docs, key_words(gone.union(twice), F.xxhash64("doc_id")), F.xxhash64(F.col("doc_id").cast("long")))
    names = [f"`{n}`" for n in docs.columns]
    alone = marked.where("not __mesh_maybe or doc_id is null").select(*names)
    rest = marked.where("__mesh_maybe and doc_id is not null").select(*names)
    left = rest.join(gone, "doc_id", "left_anti")
    row = F.struct(*names)
    one = left.groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text", "source", "lang")).alias("__mesh_row"))
    return alone.union(one.select(*(F.col("__mesh_row").getField(n).alias(n) for n in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Each row is judged by its own text, whatever its id; null and empty texts stay.
    Without benchmark items every row stays.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text by its kind.

    All rows stay, each treated alone; null text stays null.
    """
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, all columns, with the words taken and their source's target.

    Null and empty texts have no words, so they are not taken; the null source is a
    source; ties are broken by the text, so reruns agree.  An empty table stays empty.
    """
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixing", mixture),
]
#: Gumbel sampling, signatures and automata have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
