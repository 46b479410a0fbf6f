"""Centroid clustering: float32 screening with rigorous rounding-error intervals, exact integers where they overlap.

Vectors are quantised once to integers and written. A round is one job over them: a matrix product in single precision
gives every centroid's distance up to an error that is bounded beforehand, each such interval is compared with the
lowest upper end, and where several centroids remain their distances are taken again in exact integers, the smallest
number first. A task returns its sums for each cluster, Spark adds them up, and the driver holds the centroids, which
are as many as asked for, whatever the number of vectors.

The error: a product of n single-precision numbers is off by at most g = (n + 2) u / (1 - (n + 2) u) times the product
of the norms, in any order of summation, fused or not, with u = 2^-24 and 2 for the rounding of both inputs. Norms are
taken in double precision and enlarged by a part in a million, which also covers the last additions.

Vectors of another length and those with null or non-finite components are left out, null vectors too. Components are
held within 2^27, so that every distance fits a long; sums of distances that don't are null. Rows with a null id are
clustered too but start no centroid before the others do. Repeated ids are rows of their own, ordered by vector where a
start is chosen. Fewer vectors than centroids: as many centroids as vectors. Other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize

# The contract's dimensions, scale, centroids, rounds and seed.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
MOST = 1 << 27
ROWS = 8192  # vectors that are compared at once


def quantise(batches: Iterator[pa.RecordBatch], dimensions: int, scale: float) -> Iterator[pa.RecordBatch]:
    """id, v of the vectors that are whole and finite: floor(scale * x) of every component."""
    for batch in batches:
        v = batch.column(1)
        count = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        right = np.flatnonzero(count == dimensions)
        flat = v.take(pa.array(right)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # null becomes nan
        good = np.isfinite(x).all(axis=1)
        q = np.clip(np.floor(scale * x[good]), -MOST, MOST).astype(np.int32)
        ends = np.arange(len(q) + 1, dtype=np.int32) * dimensions
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[good])), pa.ListArray.from_arrays(ends, q.ravel())], ["id", "v"])


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of integer rows, and how many rows needed exact integers.

    Both inputs are int64 within MOST. The smallest number wins among equally near centroids.
    """
    n = x.shape[1]
    u = 2.0**-24
    g = (n + 2) * u / (1 - (n + 2) * u)
    x64, c64 = x.astype(np.float64), centroids.astype(np.float64)
    own, norm = np.sqrt((x64 * x64).sum(axis=1)), np.sqrt((c64 * c64).sum(axis=1))
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    near = norm * norm - 2 * product  # distance without the row's own square, the same for all centroids
    error = (2 * g * own[:, None] * norm + 1e-12 * (norm * norm + own[:, None] * norm)) * (1 + 1e-6)
    bound = (near + error).min(axis=1)
    listed = near - error <= bound[:, None]
    cluster = listed.argmax(axis=1)
    several = np.flatnonzero(listed.sum(axis=1) > 1)
    if len(several):
        row, number = np.nonzero(listed[several])  # by row, then number
        apart = np.empty(len(row), np.int64)
        for k in range(0, len(row), ROWS):
            diff = x[several[row[k : k + ROWS]]] - centroids[number[k : k + ROWS]]
            apart[k : k + ROWS] = (diff * diff).sum(axis=1)
        order = np.lexsort((number, apart, row))
        first = np.append(True, row[order][1:] != row[order][:-1])
        cluster[several] = number[order][first]
    diff = x - centroids[cluster]
    return cluster, (diff * diff).sum(axis=1), len(several)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.astype(np.int64).reshape(part.num_rows, -1)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every non-empty cluster: a row for each task and cluster is shuffled."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, x in _vectors(batches):
            cluster, _, _ = nearest(x, centroids)
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            total[own] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(count)
        ends = np.arange(len(has) + 1, dtype=np.int32) * dimensions
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(count[has]), pa.ListArray.from_arrays(ends, total[has].ravel())], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dimensions))).alias("total"))
    return {r.cluster: (r.n, r.total) for r in sums.collect()}  # at most k rows


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", name.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after the rounds; vectors: id, v. An empty cluster's centroid stays where it is."""
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in cluster_sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _vectors(batches):
            cluster, distance, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of every kept vector as a written table, and the centroids."""
    kind = embeddings.schema[key].dataType.simpleString()
    raw = embeddings.select(key, F.col(vector).cast("array<double>").alias("v"))
    vectors = materialize(raw.mapInArrow(lambda b: quantise(b, dimensions, scale), f"id {kind}, v array<int>"), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    assigned = materialize(assign(vectors, centroids) if len(centroids) else vectors.selectExpr("id", "0 AS cluster", "0L AS distance"), "assigned")
    discard(vectors)
    return assigned, centroids


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # at most as many rows as centroids
    fits = lambda d: int(d) if d < 1 << 63 else None
    whole = sum(r.d for r in sums)
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids.tolist()]
    about = spark.createDataFrame([(r.cluster, fits(r.d), fits(whole), names[r.cluster]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [f"""q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS r, vec_id, v FROM (SELECT vec_id, sha256('{SEED}:' || vec_id) AS h, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q),
c0 AS MATERIALIZED (SELECT r AS c, i, x AS y FROM x WHERE r < {CENTROIDS})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)")
        if n < ROUNDS:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), y) AS y FROM c{n} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, i) USING (c, i))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{ROUNDS} JOIN q USING (r) JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS name FROM c{ROUNDS} GROUP BY c) USING (c)
"""


OP11_SQL = _sql()
