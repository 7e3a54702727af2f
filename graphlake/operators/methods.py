"""Partitions by name."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.concurrent import concurrent_partition
from graphlake.operators.multilevel import multilevel_partition
from graphlake.operators.partition import Fennel, block_streaming_partition, hash_partition, streaming_partition
from graphlake.operators.scoring import edge_importance

METHODS = ("rand", "metis", "metis-tb", "metis-w", "metis-wtb", "fennel", "fennel-w", "fennel-lb", "fennel-wlb")
STREAMS = ("blocks", "concurrent", "one")


def partition(nodes: DataFrame, edges: DataFrame, method: str, k: int, runs: int = 3, slack: float = 1.1, streams: str = "blocks", blocks: int = 16) -> DataFrame:
    """(id, part) by name.  nodes(id, label, split).

    ``metis*`` names give the multilevel partitioner, which keeps the contract (an assignment, balance, few cut edges), not the
    library's output.  -w weighs edges by their importance to the training nodes; -tb and -lb balance the training nodes; -lb also
    stratifies by training label, other nodes being a class of their own.  streams: how fennel names stream, at any size of the graph:
    ``blocks`` of the stream at once (see block_streaming_partition; its caps are kept), ``concurrent`` streams (concurrent_partition; not for -lb, whose strata it
    does not know), or ``one`` node at a time, in one task, which refuses graphs beyond its limit; blocks: how many, or rounds of concurrent streams.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if streams not in STREAMS or streams == "concurrent" and method.endswith("lb"):
        raise ValueError(f"{method} does not stream by {streams!r}; known: {', '.join(STREAMS)}")
    if method == "rand":
        return hash_partition(nodes, k)
    if method.endswith(("-w", "-wtb", "-wlb")):
        edges = edge_importance(nodes, edges, nodes.where("split = 'train'").select("id"), 2)
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    if method.startswith("metis"):
        return multilevel_partition(nodes.withColumn("_b", train.cast("int")), edges, Fennel(k=k, slack=slack), balance="_b" if method.endswith("tb") else None)
    p, by = Fennel(k=k, runs=runs, slack=slack), {}
    if method.endswith("lb"):
        top = nodes.agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0] + 1
        nodes = nodes.withColumn("_s", F.when(train, F.coalesce("label", F.lit(top))).otherwise(top)).withColumn("_b", train.cast("int"))
        p, by = Fennel(k=k, runs=runs, slack=slack, scan=1 / 4), {"strata": "_s", "balance": "_b"}
    if streams == "concurrent":
        return concurrent_partition(nodes, edges, p, rounds=blocks)
    if streams == "one":
        # One stream with classes goes by id, and its caps are soft: the least penalised part takes a node, full or not.
        return streaming_partition(nodes, edges, replace(p, strict=False), "id", **by) if by else streaming_partition(nodes, edges, p)
    return block_streaming_partition(nodes, edges, p, blocks, **by)
