"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, less the mean of all, is rotated at random into ``bits`` dimensions and kept as the signs
there: packed bits, and two correction scalars made of its norm and of the inner product of the signs with the direction
they stand for.  From these an inner product with a query is estimated without bias, with an error bound that shrinks as
1 / sqrt(bits).

Only codes and scalars (48 bytes for 256 bits, whatever the dimension) meet the queries, in blocks, twice.  First each query's best
estimates are scored exactly: the k-th of these scores is its floor.  Then every code whose upper bound reaches the
floor survives, and just the survivors' own vectors are fetched, once for a block of queries, and reranked by exact inner products.
The mean and the rotation are all there is to fit; every row is coded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from graphlake.llm.common import Scratch, table


@dataclass(frozen=True)
class OneBit:
    """bits of a code (a multiple of 8, at least the dimension); error: standard deviations in a bound; shard, queries: codes and queries that meet in one task; step: codes unpacked at once; probes: best estimates scored for the floor."""

    bits: int = 256
    error: float = 3.0
    seed: int = 11
    shard: int = 65_536
    queries: int = 8192
    step: int = 1024
    probes: int = 40


def rotation(dim: int, p: OneBit) -> np.ndarray:
    """(dim, bits): orthonormal rows of a random rotation, for vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((max(p.bits, dim), dim)))
    return (q * np.sign(np.diag(r))).T


def valid(vector: F.Column) -> F.Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode(x: np.ndarray, turn: np.ndarray, mean: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, factor, margin) of vectors: the estimate is factor times the signs' inner product, and its bound margin times the query's length."""
    bits = turn.shape[1]
    r = (x - mean) @ turn
    norm = np.linalg.norm(r, axis=1)
    signs = np.abs(r / np.where(norm > 0, norm, 1)[:, None]).sum(1) / np.sqrt(bits)  # of the mean itself: 0
    factor = norm / np.where(signs > 0, signs, 1)
    # Estimates are in single precision; the margin takes in its rounding.
    margin = factor * error * np.sqrt(np.maximum(0, 1 - signs**2)) / np.sqrt(bits - 1) + 1e-5 * norm
    return np.packbits(r > 0, axis=1), factor, margin


class Codes:
    """A shard of codes that queries meet."""

    def __init__(self, codes: np.ndarray, factor: np.ndarray, margin: np.ndarray, turn: np.ndarray, mean: np.ndarray, step: int):
        """The estimate is linear in the signs, so each step of unpacked bits is turned back at once, to the queries' own dimension."""
        bits, self.mean, self.step = turn.shape[1], mean, step
        back = (turn.T / np.sqrt(bits)).astype(np.float32)
        self.table = np.empty((len(codes), len(turn) + 2), np.float32)
        for s in range(0, len(codes), step):
            cut = slice(s, s + step)
            signs = np.unpackbits(codes[cut], axis=1, count=bits).astype(np.float32) * 2 - 1
            self.table[cut] = np.column_stack(((signs @ back) * factor[cut, None], np.ones(len(signs)), margin[cut]))

    def scan(self, queries: np.ndarray, upper: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, estimates or upper bounds of all its codes) by steps of queries: a product of (query, along the mean, length) with (direction, 1, margin)."""
        along, length = queries @ self.mean, np.linalg.norm(queries, axis=1)
        left = np.column_stack((queries, along, (length + 1e-5 * np.abs(along)) * upper)).astype(np.float32)
        rows = max(1, (self.step << 11) // max(len(self.table), 1))
        for s in range(0, len(left), rows):
            yield s, left[s : s + rows] @ self.table.T


def _lists(row: np.ndarray, q: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The rows hit and, for each, the list of its queries."""
    order = np.argsort(row, kind="stable")
    at, start = np.unique(row[order], return_index=True)
    return at, pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(values[q[order]]))


def _meet(codes: pa.Table, asked: pa.Table, turn: np.ndarray, mean: np.ndarray, p: OneBit) -> tuple[Codes, np.ndarray]:
    blob = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
    return Codes(blob, codes.column("factor").to_numpy(), codes.column("margin").to_numpy(), turn, mean, p.step), _rows(asked.column("vector"))


def _likely(turn: np.ndarray, mean: np.ndarray, most: int, p: OneBit):
    """Each query's `most` best estimates of a shard."""

    def run(codes: pa.Table, asked: pa.Table) -> pa.Table:
        q, v, e = [], [], []
        if codes.num_rows and asked.num_rows:
            shard, x = _meet(codes, asked, turn, mean, p)
            for s, estimate in shard.scan(x, upper=False):
                k = min(most, estimate.shape[1])
                top = np.argpartition(estimate, -k, axis=1)[:, -k:]
                q.append(np.repeat(np.arange(s, s + len(top)), k))
                v.append(top.ravel())
                e.append(np.take_along_axis(estimate, top, 1).ravel())
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"q": asked.column("q").to_numpy()[join(q, int)], "row": codes.column("row").to_numpy()[join(v, int)], "estimate": join(e, np.float32)})

    return run


def _surviving(turn: np.ndarray, mean: np.ndarray, p: OneBit):
    """The codes of a shard whose upper bound reaches the floor of any query, with the list of these."""
    kind = pa.schema([("row", pa.int64()), ("qs", pa.list_(pa.int64()))])

    def run(codes: pa.Table, asked: pa.Table) -> pa.Table:
        if not codes.num_rows or not asked.num_rows:
            return kind.empty_table()
        shard, x = _meet(codes, asked, turn, mean, p)
        floor = asked.column("floor").to_numpy()
        floor = np.maximum(floor - 1e-6 * (1 + np.abs(floor)), np.finfo(np.float32).min).astype(np.float32)
        q, v = [], []
        for s, upper in shard.scan(x, upper=True):
            i, j = np.nonzero(upper >= floor[s : s + len(upper), None])
            q.append(i.astype(np.int32) + s)
            v.append(j.astype(np.int32))
        at, lists = _lists(np.concatenate(v), np.concatenate(q), asked.column("q").to_numpy())
        return pa.table({"row": codes.column("row").to_numpy()[at], "qs": lists}, schema=kind)

    return run


def _score(k: int):
    """Exact inner products of the vectors fetched with the queries of their lists; of each query the k best ids but its own: greatest score, then smallest id."""
    kind = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int32()), ("score", pa.float64())])

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        if not found.num_rows or not asked.num_rows:
            return kind.empty_table()
        found, qn = found.combine_chunks(), asked.column("q").to_numpy()
        order = np.argsort(qn)
        x, y = _rows(asked.column("vector")), _rows(found.column("vector"))
        hits, copies = (found.column(c).combine_chunks() for c in ("qs", "ids"))
        q = order[np.searchsorted(qn[order], hits.flatten().to_numpy())]
        v = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
        start, flat = copies.offsets.to_numpy() - copies.offsets[0].as_py(), copies.flatten()
        ids, n, own = flat.field("vec_id").to_numpy(), flat.field("n").to_numpy(), asked.column("query_id").to_numpy()
        # Vectors of no id but the query's own go first; of the others, which all bring a row, k are enough.
        other = (start[v + 1] - start[v] > 1) | (ids[start[v]] != own[q])
        q, v = q[other], v[other]
        score = np.concatenate([(x[q[s : s + 50_000]] * y[v[s : s + 50_000]]).sum(1) for s in range(0, len(q), 50_000)] or [np.empty(0)])
        keep = _best(q, score, np.zeros(len(q)), k, ties=True)
        q, v, score = q[keep], v[keep], score[keep]
        many = start[v + 1] - start[v]
        at = np.repeat(start[v] - np.cumsum(many) + many, many) + np.arange(many.sum())
        q, score = np.repeat(q, many), np.repeat(score, many)
        other = ids[at] != own[q]
        q, score, at = q[other], score[other], at[other]
        keep = _best(q, score, ids[at], k)
        return pa.table({"q": qn[q[keep]], "vec_id": ids[at[keep]], "n": n[at[keep]], "score": score[keep]}, schema=kind)

    return run


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, ties: bool = False) -> np.ndarray:
    """Positions of the k best of each query by score, then smaller id; with ties also of all that score like the k-th."""
    order = np.lexsort((ids, -score, q))
    q, score = q[order], score[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    if ties and len(q):
        last = np.minimum(start + k - 1, np.r_[start[1:], len(q)] - 1)
        keep = score >= np.repeat(score[last], np.diff(np.r_[start, len(q)]))
    return order[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, p: OneBit = OneBit()) -> DataFrame:
    """For every row of queries(query_id, vector) its k nearest of vectors(vec_id, vector) but those of its own id: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; fewer than k
    candidates are all returned.  Vectors null, zero or holding null or non-finite components
    take no part, nor do null ids, nor vectors of another length than the most common one (ties: the longer).
    Every row is a candidate and every row of queries is answered, also where an id or a whole row repeats: then ranks repeat, too.
    Empty tables give no rows.  Other columns are not read.

    Equal vectors are coded once, with their k + 1 least ids (no list needs more), so copies make no pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    kind = "float" if isinstance(vectors.schema["vector"].dataType.elementType, FloatType) else "double"
    clean = lambda df, i, kind: df.select(F.col(i).cast("bigint").alias(i), F.col("vector").cast(f"array<{kind}>").alias("vector")).where(F.col(i).isNotNull() & valid(F.col("vector")))
    rows = clean(vectors, "vec_id", kind)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("vector") == dim)

    counted = rows.groupBy("vector", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    alike = Window.partitionBy("vector")  # of one partitioning, so the second window shuffles nothing
    first = counted.withColumn("at", F.row_number().over(alike.orderBy("vec_id"))).where(F.col("at") <= k + 1)
    items = first.withColumn("ids", F.collect_list(F.struct("vec_id", "n")).over(alike)).where(F.col("at") == 1).select("vector", F.sort_array("ids").alias("ids"), F.monotonically_increasing_id().alias("row"))
    items = scratch.write(items, "items")  # row numbers stay as written
    asked = clean(queries, "query_id", "double").where(F.size("vector") == dim).groupBy("query_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    asked = scratch.write(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    n, n_asked = items.count(), asked.count()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(_rows(b.column("vector")).sum(0))], ["i", "s"])

    total = items.select("vector").mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    mean, turn = total.column("s").to_numpy() / n, rotation(dim, p)
    shards, blocks = max(1, -(-n // p.shard)), max(1, -(-n_asked // p.queries))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, factor, margin = encode(_rows(b.column("vector")), turn, mean, p.error)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), pa.array(margin)], ["row", "code", "factor", "margin"])

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    in_shard, in_block = (F.pmod(F.xxhash64(c), F.lit(m)).cast("int") for c, m in (("row", shards), ("q", blocks)))
    codes = scratch.write(items.select("row", "vector").mapInArrow(coded, "row bigint, code binary, factor double, margin double"), "codes")
    # A shard of codes meets a block of queries in one task; both are bounded, whatever the tables' sizes.
    left = codes.withColumn("shard", in_shard).withColumn("block", each(blocks)).groupBy("block", "shard")
    right = lambda asked: asked.withColumn("block", in_block).withColumn("shard", each(shards)).groupBy("block", "shard")

    def exact(found: DataFrame) -> DataFrame:
        """The k best of found(block, row, qs) for each query: q, rank, vec_id, score."""
        fetched = found.join(items, "row").withColumn("shard", in_shard)
        scored = fetched.groupBy("block", "shard").cogroup(right(asked)).applyInArrow(_score(k), "q bigint, vec_id bigint, n int, score double")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        alike = scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        return alike.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "vec_id", "score")

    most = max(p.probes, k + 1)
    likely = left.cogroup(right(asked)).applyInArrow(_likely(turn, mean, most, p), "q bigint, row bigint, estimate float")
    likely = likely.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("estimate"), "row"))).where(F.col("at") <= most)
    probed = exact(likely.groupBy(in_block.alias("block"), "row").agg(F.collect_list("q").alias("qs")))
    floors = probed.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    bounded = scratch.write(asked.join(floors, "q", "left").select("q", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "floors")
    block_of = F.pmod(F.xxhash64(F.col("qs")[0]), F.lit(blocks)).cast("int")  # a list is of one block
    survivors = left.cogroup(right(bounded)).applyInArrow(_surviving(turn, mean, p), "row bigint, qs array<bigint>").withColumn("block", block_of)
    answers = exact(survivors).join(asked.select("q", "query_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")), "q")
    return answers.select("query_id", "rank", "vec_id", "score")


def op1_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of embeddings for each vec_id divisible by 20: query_id, rank, vec_id, score; see search for odd rows."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("embedding", "vector")
    return search(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), p=OneBit(error=2.0))
