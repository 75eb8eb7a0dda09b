"""The queries of the corpus operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import SQL as CLUSTER_SQL
from .centroids import clusters
from .common import table
from .decontaminate import SQL as CONTAMINATION_SQL
from .decontaminate import contamination
from .html import main_text
from .media import read_texts, store_texts
from .minhash import near_duplicates
from .mixing import SQL as MIX_SQL
from .mixing import mix
from .quality import select
from .secrets import report
from .sharding import SQL as SHARD_SQL
from .sharding import shards
from .substring import repeated_runs
from .toxicity import toxicity
from .variants import SQL as VARIANT_SQL
from .variants import variants
from .warc import SQL as WARC_SQL
from .warc import round_trip


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(store_texts(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_media, op3_warc, op4_toxicity, op5_secrets, op6_decontaminate, op7_mix, op8_quality, op9_html, op10_substring,
        op11_variants, op12_centroids, op13_shards,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": WARC_SQL, "op6_decontaminate": CONTAMINATION_SQL, "op7_mix": MIX_SQL,
    "op11_variants": VARIANT_SQL, "op12_centroids": CLUSTER_SQL, "op13_shards": SHARD_SQL,
}
