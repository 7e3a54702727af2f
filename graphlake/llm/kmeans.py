"""Exact centroid clustering of integer vectors, by Yinyang filters.

Centroids are put into groups once.  A vector keeps one lower bound for each group: no centroid of it but the vector's own
is nearer.  When centroids move, the bounds move by the largest drift of their group.  A vector whose distance to its own
centroid stays below all bounds is settled at once (global filter); otherwise only groups whose bound that distance reaches
are looked at (group filter), and of these only centroids whose own drift lets them come near enough are measured, in
integers.  Bounds are compared strictly and with a margin for rounding, so ties go to the smaller number, as in a full scan.

A round is one pass: it reads the vectors with their bounds and writes them with new ones, and each task adds the sums of what
changed cluster, in a partition of the same table.  Only k * dim sums come to the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, table


@dataclass(frozen=True)
class Yinyang:
    """k centroids; rounds of assignment and update; groups of centroids (None: a quarter of k); scale: components become floor(scale * x); dim: the length that takes part; salt: of the hash that picks the start; step: numbers held at once for the distances of a batch."""

    k: int = 16
    rounds: int = 3
    groups: int | None = None
    scale: float = 64.0
    dim: int = 64
    salt: str = "1:"
    step: int = 1 << 21

    @property
    def limit(self) -> int:
        """Components as integers stay below this, so that squared distances fit 63 bits."""
        return math.isqrt((1 << 62) // max(self.dim, 1)) // 2


@dataclass
class Clustering:
    """rows(vec_id, cluster, distance); centroids: a row of integers each; inertia of each cluster; measured: distances computed in each pass."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    measured: list[int]


def quantised(vector: Column, p: Yinyang) -> Column:
    """The vector as integers; null if it has another length, null or non-finite components, or one beyond the limit."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * p.scale) >= p.limit))
    return F.when((F.size(vector) == p.dim) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * p.scale).cast("int")))


def grouped(centroids: np.ndarray, n: int) -> np.ndarray:
    """The group of each centroid: a few steps of k-means over the centroids themselves, from evenly spaced ones."""
    c = centroids.astype(float)
    heads = c[np.linspace(0, len(c) - 1, n).astype(int)]
    for _ in range(5):
        near = ((c[:, None] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([c[near == g].mean(0) if (near == g).any() else heads[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]


_FAR = np.iinfo(np.int64).max
_MARGIN = 1e-9


def assign(x: np.ndarray, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray, own: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, lower bounds, distances measured) of integer vectors x.

    own: their clusters so far, -1 for none; lower: their bounds by group before the centroids moved by ``drift``.
    """

    def squared(rows: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        d = x[rows] - centroids[c]
        return np.einsum("ij,ij->i", d, d)

    t = lower.shape[1]
    known = np.flatnonzero(own >= 0)
    best, who, reach = np.full(len(x), _FAR), own.copy(), np.full(len(x), np.inf)
    best[known] = squared(known, own[known])
    reach[known] = np.sqrt(best[known].astype(float)) * (1 + _MARGIN)
    measured = len(known)
    most = np.array([drift[groups == g].max(initial=0.0) for g in range(t)])
    before, lower = lower, np.maximum(lower - most, 0)
    rows = np.flatnonzero(reach >= lower.min(1))  # the global filter settles the others
    value = np.full((len(rows), len(centroids)), np.inf)  # a distance, or a bound of it
    exact = np.full((len(rows), len(centroids)), _FAR)
    old = np.flatnonzero(own[rows] >= 0)
    exact[old, own[rows[old]]] = best[rows[old]]
    value[old, own[rows[old]]] = np.sqrt(best[rows[old]].astype(float)) * (1 - _MARGIN)
    scanned = reach[rows, None] >= lower[rows]
    for g in range(t):
        at = np.flatnonzero(scanned[:, g])
        for c in np.flatnonzero(groups == g):
            other = at[own[rows[at]] != c]
            bound = np.maximum(before[rows[other], g] - drift[c], 0)
            value[other, c] = bound
            look = other[bound <= reach[rows[other]]]
            exact[look, c] = d = squared(rows[look], c)
            value[look, c] = np.sqrt(d.astype(float)) * (1 - _MARGIN)
            measured += len(look)
    if len(rows):
        first = exact.argmin(1)  # of equal ones the smaller number
        best[rows], who[rows] = exact[np.arange(len(rows)), first], first
        value[np.arange(len(rows)), first] = np.inf
        for g in range(t):
            rest = value[:, groups == g].min(1, initial=np.inf)
            lower[rows, g] = np.where(scanned[:, g], rest, np.minimum(lower[rows, g], rest))
    return who, best, lower, measured


def _pass(centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray, step: int):
    k, dim = centroids.shape
    t = int(groups.max()) + 1
    rows_at_once = max(1, step // (k + dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia, measured = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for s in range(0, batch.num_rows, rows_at_once):
                b = batch.slice(s, rows_at_once)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                own = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if (own >= 0).any() else np.zeros((len(x), t))
                who, best, lower, m = assign(x, centroids, groups, drift, own, lower)
                measured += m
                np.add.at(inertia, who, best)
                to = np.flatnonzero(who != own)
                out = to[own[to] >= 0]
                np.add.at(n, who[to], 1)
                np.add.at(n, own[out], -1)
                np.add.at(sums, who[to], x[to])
                np.subtract.at(sums, own[out], x[out])
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * t)
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("x"), pa.array(who, pa.int32()), pa.array(best), pa.ListArray.from_arrays(ends, pa.array(lower.ravel())), none, pa.nulls(len(x), pa.list_(pa.int64())), none, pa.array(np.zeros(len(x), np.int32))], _NAMES
                )
        if measured:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), pa.array(inertia), pa.nulls(k, pa.list_(pa.float64())), pa.array(n), pa.array(list(sums), pa.list_(pa.int64())), pa.array(np.r_[measured, np.zeros(k - 1, np.int64)]), pa.array(np.ones(k, np.int32))], _NAMES
            )

    return run


_NAMES = ["vec_id", "x", "cluster", "distance", "lower", "n", "sums", "measured", "part"]
_SCHEMA = "vec_id bigint, x array<int>, cluster int, distance bigint, lower array<double>, n bigint, sums array<bigint>, measured bigint, part int"


def cluster(vectors: DataFrame, p: Yinyang = Yinyang()) -> Clustering | None:
    """Clusters vectors(vec_id, vector) after p.rounds rounds and one more assignment; None if no vector takes part.

    The first centroids are the vectors with the smallest SHA-256 of salt and vec_id, in hash order (repeated ids: the smaller
    vector first; a null vec_id starts none; fewer vectors, fewer centroids).  An update takes floor(sum / count) of each component; a
    centroid without vectors stays.  Vectors that are null, of another length, with null or non-finite components, or with one of
    which floor(scale * x) reaches p.limit take no part.  Repeated rows and repeated ids are vectors of their own.  Other columns are not read.
    If vectors take part but none has an id, there is nothing to start from, and that is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kmeans")
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("vector"), p).alias("x")).where("x is not null")
    key = F.sha2(F.concat(F.lit(p.salt), F.col("vec_id").cast("string")), 256)
    start = base.where("vec_id is not null").orderBy(key, "x").limit(p.k).collect()  # k rows
    if not start:
        if base.limit(1).count():
            raise ValueError("no vector with an id to start from")
        return None
    centroids = np.array([r["x"] for r in start], np.int64)
    k = len(centroids)
    groups = grouped(centroids, max(1, min(k, p.groups or -(-k // 4))))
    n, sums, drift = np.zeros(k, np.int64), np.zeros((k, p.dim), np.int64), np.zeros(k)
    rows = base.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(None).cast("array<double>").alias("lower"))
    measured = []
    for r in range(p.rounds + 1):
        path = f"{scratch.path}/{r}"
        rows.select("vec_id", "x", "cluster", "lower").mapInArrow(_pass(centroids, groups, drift, p.step), _SCHEMA).write.partitionBy("part").parquet(path)
        written = spark.read.schema(_SCHEMA).parquet(path)
        rows, changes = written.where("part = 0"), written.where("part = 1")
        if r:
            scratch.drop(str(r - 1))
        totals = {c["cluster"]: c for c in changes.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("inertia"), F.sum("measured").alias("measured")).collect()}
        measured.append(sum(c["measured"] for c in totals.values()))
        if r == p.rounds:
            return Clustering(rows.select("vec_id", "cluster", "distance"), centroids, [totals[c]["inertia"] for c in range(k)], measured)
        for c in changes.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect():  # k * dim rows
            sums[c["cluster"], c["i"]] += c["s"]
        n += np.array([totals[c]["n"] for c in range(k)])
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        d = moved - centroids
        drift = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float)) * (1 + _MARGIN)
        centroids = moved


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of embeddings: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; see cluster for odd rows.  No vector, no rows."""
    out = cluster(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("embedding", "vector"))
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if out is None:
        return spark.createDataFrame([], schema)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in out.centroids.tolist()]
    facts = spark.createDataFrame([(c, out.inertia[c], sum(out.inertia), s) for c, s in enumerate(sha)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _rounds(n: int) -> str:
    """a0 to a<n>(rid, c, d): assignments to the centroids c0 to c<n>(c, i, v), each from the one before."""
    out = []
    for r in range(n + 1):
        out.append(f"""d{r} AS MATERIALIZED (SELECT rid, c, CAST(sum((q.v - m.v) * (q.v - m.v)) AS BIGINT) AS d FROM q JOIN c{r} m ON m.i = q.i GROUP BY rid, c),
a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS k FROM d{r}) WHERE k = 1)""")
        if r < n:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(u.v, m.v) AS v FROM c{r} m LEFT JOIN (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS v FROM (SELECT a.c, q.i, CAST(sum(q.v) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN q ON q.rid = a.rid GROUP BY a.c, q.i)) u ON u.c = m.c AND u.i = m.i)""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(x) AS v FROM kept),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT 16),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(x) AS v FROM s),
{_rounds(3)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a3 a JOIN kept ON kept.rid = a.rid JOIN h ON h.c = a.c"""
