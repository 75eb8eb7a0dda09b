"""The optional neural ranking, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the features, and where the two layers lie in a file of weights (fixed values).
WIDTH = 32
LAYER_1, LAYER_2 = (0, WIDTH * WIDTH), (WIDTH * WIDTH, WIDTH * WIDTH + WIDTH)
#: A file of weights is read whole, so it may not be larger.
LARGEST_FILE = 64 << 20


def gnn_weight(i):
    """Fallback weight i of the flat weight vector (fixed rule)."""
    return 0.002 + (i % 17) * 0.0003


W1 = [[gnn_weight(i * WIDTH + j) for j in range(WIDTH)] for i in range(WIDTH)]
W2 = [gnn_weight(WIDTH * WIDTH + j) for j in range(WIDTH)]


def gnn_weights(spark: SparkSession, paths: list[str]) -> tuple[list[list[float]], list[float]]:
    """The two layers of the first of ``paths`` that holds weights: little-endian 32-bit floats, what follows the layers unused.

    A path that is missing, larger than ``LARGEST_FILE`` or too short for both layers
    is passed over; without any the fallback is returned.
    """
    for path in paths:
        try:
            files = spark.read.format("binaryFile").load(path).where(F.col("length") <= LARGEST_FILE)
            found = files.orderBy("path").select("content").first()
        except AnalysisException:
            continue
        flat = np.frombuffer(bytes(found.content)[: 4 * LAYER_2[1]], "<f4").astype(float) if found else np.zeros(0)
        if len(flat) == LAYER_2[1]:
            return flat[slice(*LAYER_1)].reshape(WIDTH, WIDTH).tolist(), flat[slice(*LAYER_2)].tolist()
    return W1, W2


def gnn_features(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Log degrees, total degree over the largest one, and a mark of types."""
    top = degrees.agg(F.max("degree").alias("top"))
    rows = degrees.join(nodes.select("id", "kind"), "id").join(F.broadcast(top))
    return rows.select(
        "id", F.round(F.log1p("in_degree"), 6).alias("f_in"), F.round(F.log1p("out_degree"), 6).alias("f_out"),
        F.round(F.col("degree").cast("double") / F.col("top"), 6).alias("f_total"), F.when(F.col("kind") == "struct_item", 1).otherwise(0).alias("is_type"),
    )


def gnn_forward(features: DataFrame, edges: DataFrame, w1: list[list[float]] = W1, w2: list[float] = W2) -> DataFrame:
    """``(id, score)``: X W1, the mean over a node and its neighbours on either side (repeats counted), tanh, dot W2.

    The product is linear, so it is made once per node before the mean, a matrix
    product for each batch; the mean is summed on the map side, so a node with many
    neighbours is no hot task.  Of longer feature vectors the first values count, as
    many as W1 has rows; the network is as wide as its weights.
    """
    n, depth = len(w2), len(w1)
    weights = np.array(w1, float)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, depth)
                rows = pa.FixedSizeListArray.from_arrays(pa.array((x @ weights).ravel()), n).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "h"])

    kind = features.schema["id"].dataType.simpleString()
    x = features.select("id", F.transform(F.slice("x", 1, depth), lambda v: v.cast("double")).alias("x"))
    made = x.mapInArrow(product, f"id {kind}, h array<double>")
    hidden = made.select("id", *[F.col("h")[j].alias(f"h{j}") for j in range(n)])
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).union(features.select(F.col("id"), F.col("id")))
    sent = both.join(hidden.withColumnRenamed("id", "src"), "src")
    mean = sent.groupBy("dst").agg(*[F.avg(f"h{j}").alias(f"h{j}") for j in range(n)])
    return mean.select(F.col("dst").alias("id"), sum(F.tanh(f"h{j}") * w2[j] for j in range(n)).alias("score"))


def diversity(ranked: DataFrame, factor: float = 0.15) -> DataFrame:
    """Score times ``factor`` for rows whose file or kind an earlier row of ``(id, file, kind, score)`` has."""
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), "id"))
    rows = ranked.withColumn("a", by("file")).withColumn("b", by("kind"))
    return rows.withColumn("score", F.when((F.col("a") > 1) | (F.col("b") > 1), F.col("score") * factor).otherwise(F.col("score"))).drop("a", "b")


def neural_apply(
    features: DataFrame, edges: DataFrame, text_scores: DataFrame, blend: float = 0.1, weights: tuple[list[list[float]], list[float]] = (W1, W2)
) -> DataFrame:
    """Text score and neural score blended 0.9 to 0.1, for rows with a text score."""
    scores = gnn_forward(features, edges, *weights)
    return text_scores.join(scores, "id", "left").select("id", (F.col("text_score") * (1 - blend) + F.coalesce("score", F.lit(0.0)) * blend).alias("score"))
