"""Streaming partition in many streams at once, from stale sizes.

The stream is cut into rounds, and a round is dealt to shards.  Each shard is one task and places its nodes one at a time, in the order of
the stream: it sees its own placements at once, and of all others what was known when the round began, the parts of their
nodes and the sizes.  It takes the others to fill parts as it does itself, and may fill of each part an equal share of the room that was left,
so shards together never overfill one.  Between rounds the placements are merged.  A task holds the nodes of its shard, their edges
within it, and of the rest k sums for each node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.functions.store import cut, drop
from graphlake.operators.batching import degree_order, hex_id, number
from graphlake.operators.layout import degree, normalise_weights
from graphlake.operators.partition import Fennel, _fill, default_alpha

#: Edges that a shard holds on average.
TASK_EDGES = 4_000_000


def place(order: np.ndarray, outside: np.ndarray, ptr: np.ndarray, near: np.ndarray, w: np.ndarray, size: np.ndarray, share: np.ndarray, shards: int, alpha: float, gamma: float) -> np.ndarray:
    """Parts of the nodes 0 to n - 1 in ``order``, -1 where no share is left.

    outside[v]: weight of v's neighbours elsewhere, by part; near[ptr[v] : ptr[v + 1]], w: neighbours here and their weights; size: parts
    without the round's nodes; share: how many of a part's places are this shard's.
    """
    k = len(size)
    part, took = np.full(len(order), k), np.zeros(k, np.int64)
    for v in order:
        pull = outside[v] + np.bincount(part[near[ptr[v] : ptr[v + 1]]], w[ptr[v] : ptr[v + 1]], minlength=k + 1)[:k]
        open_ = took < share
        if not open_.any():
            break
        score = pull - alpha * gamma * (size + shards * took) ** (gamma - 1)
        best = int(np.where(open_, score, -np.inf).argmax())
        part[v] = best
        took[best] += 1
    return np.where(part < k, part, -1)


def concurrent_partition(nodes: DataFrame, edges: DataFrame, p: Fennel = Fennel(), shards: int | None = None, rounds: int = 8, order: str = "degree", start: DataFrame | None = None) -> DataFrame:
    """(id, part) by concurrent streams, for graphs of any size; parameters are those of streaming_partition.  edges may carry ``w``.

    shards: tasks of a round; unless given, 8 or as many as leave TASK_EDGES edges to each.  More rounds are closer to one stream and take more
    passes.  No part holds more than its capacity; nodes for which a shard has no place left fill what others left over.
    """
    n, k = nodes.count(), p.k
    if "w" in edges.columns:
        edges = normalise_weights(edges)
    m = edges.count()
    shards = shards or max(8, -(-m // (rounds * TASK_EDGES)))
    cap = max(int(n / k * p.slack), -(-n // k))
    alpha = p.alpha if p.alpha is not None else default_alpha(max(n, 1), m, k, p.gamma)
    pos = degree_order(degree(nodes, edges)) if order == "degree" else number(nodes.select("id"), hex_id(F.col("id")), "pos", levels=(8, 12))
    seq = cut(pos.select("id", "pos", F.least(F.floor(F.col("pos") / max(n, 1) * rounds), F.lit(rounds - 1)).cast("int").alias("round"), (F.col("pos") % shards).cast("int").alias("shard")))
    place_of = lambda c, a: seq.select(F.col("id").alias(c), F.struct("round", "shard").alias(a))
    e = edges.select("src", "dst", (F.col("w") if "w" in edges.columns else F.lit(1.0)).cast("double").alias("w"))
    e = e.join(place_of("src", "s"), "src").join(place_of("dst", "d"), "dst").select("src", "dst", "w", F.col("d.round").alias("round"), (F.col("s") == F.col("d")).alias("here"))
    e = cut(e.repartitionByRange("round", "dst").sortWithinPartitions("round"))
    now = cut(start.select("id", F.col("part").cast("int").alias("part")) if start is not None else seq.select("id", F.lit(0).alias("part")).limit(0))
    for run in range(p.runs):
        for r in range(rounds):
            mine = seq.where(F.col("round") == r)
            others = now.join(mine.select("id"), "id", "left_anti")
            sizes = {x["part"]: x["n"] for x in others.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
            size = np.array([sizes.get(i, 0) for i in range(k)], np.int64)
            room = np.maximum(cap - size, 0)
            toward = e.where(F.col("round") == r)
            votes = toward.where("not here").join(now.select(F.col("id").alias("src"), "part"), "src").groupBy(F.col("dst").alias("id"), "part").agg(F.sum("w").alias("w"))
            votes = votes.groupBy("id").agg(F.collect_list(F.struct("part", "w")).alias("outside"))  # k entries at most
            local = toward.where("here").groupBy(F.col("dst").alias("id")).agg(F.collect_list(F.struct("src", "w")).alias("near"))
            rows = mine.select("id", "pos", "shard").join(votes, "id", "left").join(local, "id", "left")
            placed = cut(rows.groupBy("shard").applyInArrow(_kernel(size, room, shards, alpha * p.beta**run, p.gamma, k), "id bigint, part int"))
            fits = placed.where("part >= 0")
            left = placed.where("part < 0").select("id", F.lit(0).alias("b"))
            if left.limit(1).count():
                took = fits.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
                free = nodes.sparkSession.createDataFrame([(0, i, int(x)) for i, x in enumerate(room)], "b int, part int, room bigint").join(took, "part", "left")
                fits = fits.union(_fill(left, free.select("b", "part", (F.col("room") - F.coalesce("n", F.lit(0))).alias("room"))))
            after = cut(others.union(fits))
            drop(now)
            drop(placed)
            now = after
    return now


def _kernel(size: np.ndarray, room: np.ndarray, shards: int, alpha: float, gamma: float, k: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, shard = t.column("id").to_numpy(), t.column("shard")[0].as_py()
        # Of each part's room the shards get equal shares; what does not divide goes to other shards for each part.
        share = (room + (shard + np.arange(k)) % shards) // shards
        outside = np.zeros((len(ids), k))
        votes = t.column("outside").combine_chunks()
        lens = np.diff(votes.offsets.to_numpy()) if len(votes) else np.empty(0, np.int64)
        flat = votes.flatten()
        outside[np.repeat(np.arange(len(ids)), np.where(votes.is_valid().to_numpy(zero_copy_only=False), lens, 0)), flat.field("part").to_numpy()] = flat.field("w").to_numpy()
        near = t.column("near").combine_chunks()
        valid = near.is_valid().to_numpy(zero_copy_only=False)
        ptr = np.r_[0, np.cumsum(np.where(valid, np.diff(near.offsets.to_numpy()), 0))]
        flat = near.flatten()
        part = place(t.column("pos").to_numpy().argsort(), outside, ptr, np.searchsorted(ids, flat.field("src").to_numpy()), flat.field("w").to_numpy(), size, share, shards, alpha, gamma)
        return pa.table({"id": ids, "part": pa.array(part, pa.int32())})

    return run
