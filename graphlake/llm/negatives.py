"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2), all vectors get the length M and all queries a zero: the squared distance is then
|q|^2 + M^2 - 2 q.x, so the greatest inner product is the least distance, and a window of scores is an annulus around the query.
Rows are dealt to shards of bounded size; a task builds a tree over one shard (vantage points, medians, and for each side the
least and greatest distance) and takes a block of queries through it.  The triangle inequality bounds the distance of a query
to each leaf from both sides: leaves outside the annulus are never opened, the others are opened nearest first, one at a
time, until a query has k rows and the next leaf cannot hold a better one.  Scores are integers; bounds carry a margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm.common import Scratch, table


@dataclass(frozen=True)
class Mining:
    """positives: of an anchor; k: negatives of each positive, whose scores are within ``low`` to ``high`` per cent of the positive's; scale: components become floor(scale * x); shard, queries: rows and queries that meet in one task; leaf: rows of a tree's leaf."""

    positives: int = 5
    k: int = 3
    low: int = 50
    high: int = 95
    scale: float = 256.0
    shard: int = 8192
    queries: int = 8192
    leaf: int = 128


@dataclass
class Tree:
    """Rows in the order of the leaves; starts of leaves; vantage points (rows); for each leaf and level its vantage point and the least and greatest distance to it."""

    order: np.ndarray
    starts: np.ndarray
    points: np.ndarray
    vantage: np.ndarray
    least: np.ndarray
    most: np.ndarray
    length: float


def build(x: np.ndarray, leaf: int) -> Tree:
    """A balanced tree over integer rows x: each node's rows are halved by their distance to the row farthest from the node's first one."""
    norms = np.einsum("ij,ij->i", x, x)
    top = int(norms.max())
    levels = max(0, math.ceil(math.log2(max(1, len(x) / leaf))))
    order, edges = np.arange(len(x)), np.array([0, len(x)])
    vantage, least, most, points = [], [], [], []

    def distance(v: int, rows: np.ndarray) -> np.ndarray:
        extra = math.sqrt(top - norms[v]) * np.sqrt((top - norms[rows]).astype(float))
        return np.sqrt(np.maximum(0.0, 2 * (top - (x[rows] @ x[v]) - extra)))

    for _ in range(levels):
        cuts, v_, lo, hi = [0], [], [], []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            rows = order[s:e]
            v = int(rows[distance(rows[0], rows).argmax()])
            d = distance(v, rows)
            by = d.argsort(kind="stable")
            order[s:e], d = rows[by], d[by]
            half = (e - s) // 2
            cuts += [s + half, e]
            v_ += [len(points)] * 2
            points.append(v)
            lo += [d[0], d[half]]
            hi += [d[half - 1], d[-1]]
        edges = np.array(cuts)
        vantage, least, most = ([np.repeat(c, 2) for c in cols] for cols in (vantage, least, most))
        vantage.append(np.array(v_))
        least.append(np.array(lo))
        most.append(np.array(hi))
    rows = lambda cols: np.stack(cols) if cols else np.zeros((0, 1))
    return Tree(order, edges, np.array(points, np.int64), rows(vantage).astype(np.int64), rows(least), rows(most), float(top))


_NONE = np.iinfo(np.int64).min


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k rows of greatest score, ties to the smaller id, with lo <= score <= hi; and the leaves opened.

    same: only rows with the query's label and another id, otherwise only rows with another label.
    """
    norm = np.einsum("ij,ij->i", q, q).astype(float)
    margin = 1e-6 * (1 + np.sqrt(norm) + math.sqrt(tree.length))
    radius = lambda s: np.sqrt(np.maximum(0.0, norm + tree.length - 2 * s))
    outer, inner = radius(lo.astype(float)) + margin, radius(hi.astype(float)) - margin
    leaves = len(tree.starts) - 1
    near, far = np.zeros((len(q), leaves)), np.full((len(q), leaves), np.inf)
    if len(tree.points):
        to = np.sqrt(np.maximum(0.0, norm[:, None] + tree.length - 2.0 * (q @ x[tree.points].T)))
        for v, least, most in zip(tree.vantage, tree.least, tree.most, strict=True):
            d = to[:, v]
            np.maximum(near, np.maximum(d - most, least - d), out=near)
            np.minimum(far, d + most, out=far)
    near[(near > outer[:, None]) | (far < inner[:, None])] = np.inf
    turn = near.argsort(1, kind="stable")
    best, who = np.full((len(q), k), _NONE), np.full((len(q), k), -1)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    active, opened = np.arange(len(q)), 0
    for step in range(leaves):
        leaf = turn[active, step]
        bound = near[active, leaf]
        kth = best[active, k - 1]
        limit = np.where(kth == _NONE, np.inf, np.sqrt(np.maximum(0.0, norm[active] + tree.length - 2.0 * np.where(kth == _NONE, 0, kth))) + margin[active])
        go = (bound <= limit) & np.isfinite(bound)
        active, leaf = active[go], leaf[go]  # leaves come by rising bounds, so who stops is done
        if not len(active):
            break
        opened += len(active)
        by = leaf.argsort(kind="stable")
        active, leaf = active[by], leaf[by]
        begins = np.r_[0, np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
        for s, e in zip(begins[:-1], begins[1:], strict=True):
            a, rows = active[s:e], tree.order[tree.starts[leaf[s]] : tree.starts[leaf[s] + 1]]
            score = q[a] @ x[rows].T
            equal = q_labels[a][:, None] == labels[rows]
            fits = (score >= lo[a][:, None]) & (score <= hi[a][:, None]) & ((equal & (q_ids[a][:, None] != ids[rows])) if same else ~equal)
            score = np.where(fits, score, _NONE)
            last = best[a, k - 1][:, None]
            hit = np.flatnonzero(((score > last) | ((score == last) & fits & (ids[rows] < best_id[a, k - 1][:, None]))).any(1))
            if not len(hit):
                continue
            a = a[hit]
            scores = np.concatenate((best[a], score[hit]), 1)
            all_ids = np.concatenate((best_id[a], np.broadcast_to(ids[rows], (len(a), len(rows)))), 1)
            all_rows = np.concatenate((who[a], np.broadcast_to(rows, (len(a), len(rows)))), 1)
            top = np.lexsort((all_ids, -np.maximum(scores, _NONE + 1)), axis=1)[:, :k]
            best[a], best_id[a], who[a] = (np.take_along_axis(m, top, 1) for m in (scores, all_ids, all_rows))
            gone = best[a] == _NONE
            best_id[a] = np.where(gone, np.iinfo(np.int64).max, best_id[a])
    at, j = np.nonzero(best != _NONE)
    return at, who[at, j], best[at, j], opened


def _deal(dim: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((task << 40) + n), pa.array((task * 7919 + n) % shards), *b.columns], ["row", "shard", *b.schema.names])

    return run


def mine(vectors: DataFrame, anchors: DataFrame | None = None, p: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among vectors(vec_id, vector, label).

    anchors: a boolean column of vectors; every row without it.  Components become floor(scale * x), a score is an inner product of these; higher
    scores come first, ties by smaller vec_id.  An anchor's positives are its first p.positives rows of the same label and another vec_id, and the
    negatives of each the first p.k rows of another label with low * positive_score <= 100 * score <= high * positive_score; all, if fewer.
    Rows with a null label or id, a vector that is null, empty or has null or non-finite components, components whose products would not fit 62 bits, or
    another length than the most common one (ties: the longer) take no part.  Rows that repeat an id are rows of their own, each an
    anchor if the id is one; equal rows tie, and any of them comes first.  Other columns are not read; an empty table gives no rows.

    Every shard meets every block of queries, so cost grows with rows times anchors; both sides of a task are bounded.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    asked = F.coalesce(F.lit(True) if anchors is None else anchors, F.lit(False)).alias("anchor")
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), asked, v).where((F.size(v) > 0) & ~bad & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dim, n = sizes["dim"], sizes["n"]
    limit = math.isqrt((1 << 61) // dim)
    rows = rows.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: F.abs(x.cast("double") * p.scale) >= limit))
    rows = rows.select("vec_id", "label", "anchor", F.transform("vector", lambda x: F.floor(x.cast("double") * p.scale).cast("bigint")).alias("x"))
    shards = max(1, -(-n // p.shard))
    dealt = scratch.write(rows.mapInArrow(_deal(dim, shards), "row bigint, shard bigint, vec_id bigint, label bigint, anchor boolean, x array<bigint>"), "dealt")
    ask = dealt.where("anchor").select("row", F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), F.col("x").alias("q"))
    anchors_n = ask.count()
    side = dealt.select("shard", "vec_id", "label", "x")

    def meet(queries: DataFrame, count: int, k: int, same: bool) -> DataFrame:
        """(row, window, vec_id, score): the k best over all shards for each of queries(row, q_id, q_label, q, windows(window, lo, hi))."""
        blocks = max(1, -(-count // p.queries))
        left = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

        def run(v: pa.Table, q: pa.Table) -> pa.Table:
            if not v.num_rows or not q.num_rows:
                return pa.table({"row": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            x, y = matrix(v, "x"), matrix(q, "q")
            if max(np.abs(x).max(), np.abs(y).max()) < math.isqrt((1 << 52) // dim):  # then products of floats are exact, and faster
                x, y = x.astype(float), y.astype(float)
            windows = q.column("windows").combine_chunks()
            each = np.repeat(np.arange(q.num_rows), np.diff(windows.offsets.to_numpy()))
            w = windows.flatten()
            window, lo, hi = (w.field(c).to_numpy() for c in ("window", "lo", "hi"))
            ids, labels = v.column("vec_id").to_numpy(), v.column("label").to_numpy()
            at, r, score, _ = search(build(x, p.leaf), x, ids, labels, y[each], q.column("q_id").to_numpy()[each], q.column("q_label").to_numpy()[each], lo, hi, k, same)
            return pa.table({"row": q.column("row").to_numpy()[each[at]], "window": pa.array(window[at], pa.int32()), "vec_id": ids[r], "score": pa.array(score.astype(np.int64))})

        met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "row bigint, window int, vec_id bigint, score bigint")
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    wide = F.lit(1 << 62).cast("bigint")
    everything = F.array(F.struct(F.lit(0).alias("window"), (-wide).alias("lo"), wide.alias("hi")))
    found = scratch.write(meet(ask.withColumn("windows", everything), anchors_n, p.positives, True).select("row", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * s <= high * p as bounds of s, in whole numbers.
    per = F.col("positive_score").cast("decimal(38, 0)")
    up = lambda x: -((-x - F.pmod(-x, F.lit(100).cast("decimal(38, 0)"))) / 100)
    down = lambda x: (x - F.pmod(x, F.lit(100).cast("decimal(38, 0)"))) / 100
    windows = found.select("row", F.struct("window", up(per * p.low).cast("bigint").alias("lo"), down(per * p.high).cast("bigint").alias("hi")).alias("w")).where("w.lo <= w.hi")
    windows = windows.groupBy("row").agg(F.collect_list("w").alias("windows"))  # as many as positives
    took = meet(ask.join(windows, "row"), anchors_n * p.positives, p.k, False)
    took = took.select("row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(ask.select("row", F.col("q_id").alias("anchor_id")), "row")
    return took.join(named, ["row", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings for anchors whose vec_id is divisible by 50; where vec_id is divisible by 7, label first becomes (label + 1) % 10.  See mine for odd rows."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).withColumnRenamed("embedding", "vector")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0),
p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s WHERE same AND vec_id <> anchor_id) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.k ORDER BY n.score DESC, n.vec_id) AS k
  FROM p JOIN s n ON n.rid = p.rid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score) WHERE k <= 3"""
