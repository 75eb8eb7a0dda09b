"""Lloyd clustering of distinct quantised vectors with multiplicities.

Vectors are turned into whole numbers, equal ones are grouped and counted, and the
rounds run over the distinct vectors alone: each goes to its nearest centroid and
adds its components times its multiplicity to whole-number sums, so the means are
exact in whatever order tasks end.  The assignments are then joined back to the
rows.  Only centroids, of a fixed number, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import lean, tune, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Components beyond this are held at it, so that squared distances fit 64 bits.
BOUND = 1 << 27
#: Vectors that make up at least this share of the rows are joined by broadcast: at most its inverse of them exist.
HOT_SHARE = 1000
_EXACT = 1 << 52

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q)`` of the kept rows: ``floor(scale * x)`` of each component, for vectors of exactly ``dimensions`` finite ones."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = (F.size("embedding") == dimensions) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    held = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale).cast("double"), F.lit(float(BOUND))), F.lit(float(-BOUND))).cast("int"))
    return vectors.where("embedding is not null").where(usable).select("vec_id", held.alias("q"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(q, weight)``: each different vector with the number of its rows."""
    return rows.groupBy("q").agg(F.count("*").alias("weight"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centroid, the first of equals, and the squared distance; exact."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * top * top * q.shape[1] < _EXACT else np.int64
    a, c = q.astype(kind), centroids.astype(kind)
    d = ((a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)).astype(np.int64)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def _summing(centroids: np.ndarray) -> Kernel:
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                q, weight = _matrix(batch.column(0), dimensions), batch.column(1).to_numpy()
                at, _ = nearest(q, centroids)
                for j in np.unique(at):
                    here = at == j
                    sums[j] += weight[here] @ q[here]
                    rows[j] += weight[here].sum()
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "rows", "sums"])

    return lean(run)


def _assigning(centroids: np.ndarray) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = nearest(_matrix(batch.column(0), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d)], [*batch.schema.names, "cluster", "distance"])

    return lean(run)


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the weighted means of what is nearest to each centroid; one that nothing is nearest to stays."""
    sums = StructType([StructField("cluster", IntegerType()), StructField("rows", LongType()), StructField("sums", ArrayType(LongType()))])
    parts = distinct.select("q", "weight").mapInArrow(_summing(centroids), sums)
    total = parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])))
    new = centroids.copy()
    for r in total.collect():  # a row per centroid
        new[r.cluster] = [r[f"s{i}"] // r.rows for i in range(centroids.shape[1])]
    return new


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the ``clusters`` rows whose id has the least hash; of one id, the least vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.withColumn("__mesh_key", key).orderBy("__mesh_key", "q").select("q").limit(clusters).collect()
    return np.array([r.q for r in found], np.int64)


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(
    vectors: DataFrame, n_clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each kept row of ``vectors(vec_id, embedding)``.

    Rows whose embedding is null, has another length or a null or non-finite
    component are left out.  Components beyond ``BOUND`` are held at it, inertia
    at the largest long.  A null vec_id is hashed as empty and kept; repeated rows
    count as often as they stand; equal distances go to the smaller number.  With
    fewer kept rows than clusters each is a centroid; an empty table gives an
    empty result.  Other columns are ignored.
    """
    tune(vectors.sparkSession)
    rows = quantised(vectors, dimensions, scale)
    distinct = written(distinct_vectors(rows), "vectors")
    centroids = first_centroids(rows, n_clusters, seed)
    if not len(centroids):
        out = "vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256"
        return rows.selectExpr(*out).limit(0)
    for _ in range(rounds):
        centroids = lloyd_round(distinct, centroids)
    schema = StructType([*distinct.schema.fields, StructField("cluster", IntegerType()), StructField("distance", LongType())])
    nearest_to = written(distinct.mapInArrow(_assigning(centroids), schema), "assigned")
    return _joined_back(rows, nearest_to, centroids)


def _long(total: Column) -> Column:
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def _joined_back(rows: DataFrame, nearest_to: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = rows.sparkSession
    spent = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight"))
    totals = nearest_to.groupBy("cluster").agg(spent.alias("d"), F.sum("weight").alias("rows")).collect()  # a row per centroid
    whole, n = sum(r.d for r in totals), sum(r.rows for r in totals)
    facts = [(r.cluster, r.d, whole, _digest(centroids[r.cluster])) for r in totals]
    about = spark.createDataFrame(facts, "cluster int, d decimal(38,0), whole decimal(38,0), centroid_sha256 string")
    about = about.select("cluster", _long(F.col("d")).alias("cluster_inertia"), _long(F.col("whole")).alias("inertia"), "centroid_sha256")
    is_hot = F.col("weight") * HOT_SHARE >= n
    hot = F.broadcast(nearest_to.where(is_hot).select("q", "cluster", "distance"))
    rest = nearest_to.where(~is_hot).select("q", "cluster", "distance")
    back = rows.join(hot, "q").union(rows.join(hot, "q", "left_anti").join(rest.hint("shuffle_merge"), "q"))
    return back.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    step = """
a{i} AS (SELECT d.q, d.w, arg_min({{'c': c.c, 'd': {dist}}}, {{'d': {dist}, 'c': c.c}}) AS m FROM d CROSS JOIN c{i} AS c GROUP BY d.q, d.w)"""
    new = """,
u{i} AS (SELECT m.c AS c, i, sum(q[i] * w) AS s, sum(w) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM u{i} GROUP BY c),
c{j} AS (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c)),"""
    dist = "CAST(list_sum(list_transform(list_zip(d.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    rounds = "".join(step.format(i=i, dist=dist) + (new.format(i=i, j=i + 1) if i < ROUNDS else "") for i in range(ROUNDS + 1))
    return f"""
WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
d AS (SELECT q, CAST(count(*) AS BIGINT) AS w FROM k GROUP BY q),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256(concat('1:', vec_id)) AS h, q FROM k ORDER BY h, q LIMIT 16)),{rounds},
s AS (SELECT m.c AS c, CAST(sum(m.d * w) AS BIGINT) AS inertia FROM a{ROUNDS} GROUP BY m.c)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, s.inertia AS cluster_inertia,
       CAST((SELECT sum(inertia) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.q, ',')) AS centroid_sha256
FROM k JOIN a{ROUNDS} USING (q) JOIN s ON s.c = m.c JOIN c{ROUNDS} ON c{ROUNDS}.c = m.c
"""


SQL = _sql()
