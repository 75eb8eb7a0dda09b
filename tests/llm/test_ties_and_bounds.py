"""Repeated and null ids, ties and clashing names: one result, whatever the partitions."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from meshlight.llm import media, mixing, substring, toxicity


def _rows(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_mixed_keeps_the_same_texts_in_any_number_of_partitions(spark):
    # ids and sizes repeat, texts differ; the mix takes a part of the source only
    rows = [(i % 3 or None, f"w{i} a b c d", "a" if i < 40 else "b") for i in range(43)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [_rows(mixing.mixed(docs.repartition(n)), "doc_id", "text", "taken") for n in (1, 7)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 43
    assert _rows(mixing.mix(docs.repartition(1)), "doc_id", "size", "taken") == _rows(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken")


def test_one_row_of_an_id_stays_after_near_dedup(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "own words of one", "en", "a", 1), (1, "other words of one", "en", "a", 1), (2, text, "en", "a", 1), (3, text, "en", "b", 1), (None, text, "en", "c", 1), (None, None, "en", "c", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__mesh_row", F.lit(1))
    kept = [_rows(corpus_pipeline.near_dedup(spark, docs.repartition(n), ""), "doc_id", "text") for n in (1, 7)]
    assert kept[0] == kept[1]
    ids = collections.Counter(d for (d, _), n in kept[0].items() for _ in range(n))
    assert ids == {1: 1, 2: 1, 4: 1, None: 2}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").isEmpty()


def test_the_rows_of_a_sample_are_bounded(spark):
    docs = spark.range(1000).selectExpr("cast(pmod(id, 2) + 7 as long) doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    found = toxicity.training_rows(docs, labels, 40)
    assert found.count() <= 2 and found.count() == found.select("doc_id").distinct().count()
    assert _rows(found, "doc_id", "text") == _rows(toxicity.training_rows(docs.repartition(7), labels, 40), "doc_id", "text")


def test_null_and_empty_media_give_nulls(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    stored = media.store_texts(docs).union(spark.createDataFrame([(4, None), (5, bytearray())], "doc_id long, media binary"))
    got = {r.doc_id: r for r in media.read_texts(stored).collect()}
    assert [got[i].n_bytes for i in range(1, 6)] == [9, 0, 0, None, None] and got[4].feature is None and got[2].media_sha256 == got[3].media_sha256


def test_columns_of_any_name_survive_the_removal_of_repeats(spark):
    run = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, run, 5), (2, f"x {run}", 6), (None, run, 7)], "doc_id long, text string, _removed long")
    assert {(r.doc_id, r._removed) for r in substring.remove_repeats(docs).collect()} == {(1, 5), (2, 6), (None, 7)}
