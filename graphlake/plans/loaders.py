"""Whole epochs of mini-batches as plans: seeds, sampled or collated subgraphs, and the features that go with them.

A loader returns tables keyed by batch, so one plan makes every batch of an epoch, and a trainer reads the
batches it wants by filtering on the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.model import Graph, PartitionedGraph, Pivots
from graphlake.operators import batching, collate, sampling


@dataclass(frozen=True)
class Epoch:
    """nodes and edges of every batch; features of the nodes, if the graph has any."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame | None = None


def _sampled(edges: DataFrame, seeds: DataFrame, features: DataFrame | None, fanouts: list[int], seed: int) -> Epoch:
    nodes, took = sampling.sample(edges, seeds, fanouts, seed)
    return Epoch(nodes, took, None if features is None else sampling.gather(nodes, features))


def node_loader(g: Graph, fanouts: list[int], size: int, split: str = "train", epoch: int = 0, seed: int = 0) -> Epoch:
    """Seeds of a split, shuffled over all and evenly split; each batch samples its neighbours, nodes(batch, hop, id)."""
    seeds = batching.global_batches(g.split(split), size, epoch, seed).select("batch", "id")
    return _sampled(g.edges, seeds, g.features, fanouts, seed)


def seed_loader(g: Graph, fanouts: list[int], size: int, split: str = "train", epoch: int = 0, seed: int = 0) -> Epoch:
    """Like node_loader, but only training seeds are shuffled; those of other splits go by id, so that evaluation sees them in order."""
    if split == "train":
        return node_loader(g, fanouts, size, split, epoch, seed)
    ids = g.split(split)
    placed = batching.number(ids, batching.hex_id(F.col("id")), "pos", levels=(8, 12))
    seeds = placed.select(batching.even_chunk(F.col("pos"), ids.count(), size).alias("batch"), "id")
    return _sampled(g.edges, seeds, g.features, fanouts, seed)


def batch_key(superblock: Column, batch: Column) -> Column:
    """One number for a batch within a superblock."""
    return F.shiftleft(superblock.cast("bigint"), 32) + batch


def hierarchical_loader(g: Graph, assign: DataFrame, num_blocks: int, fanouts: list[int], size: int, split: str = "train", epoch: int = 0, seed: int = 0) -> Epoch:
    """Blocks of assign(id, part) are shuffled and merged into superblocks; batches of a superblock's seeds sample within it.

    batch is batch_key(superblock, batch).  A node is in one superblock only, so the induced
    subgraphs lie apart and one sampling pass over all of them never leaves one.
    """
    members = assign.select("id", F.col("part").alias("block"))
    inside = batching.hier_subgraph(g.edges, members, num_blocks, epoch, seed).select("src", "dst")
    order = batching.superblocks(members, num_blocks, epoch, seed)
    own = members.join(g.split(split), "id", "left_semi").join(order, "block").select("id", "superblock")
    own = batching.shuffle(own, "id", epoch, seed, ["superblock"])
    sizes = own.groupBy("superblock").agg(F.count(F.lit(1)).alias("n"))
    seeds = own.join(sizes, "superblock").select(batch_key(F.col("superblock"), batching.even_chunk(F.col("pos"), F.col("n"), size)).alias("batch"), "id")
    return _sampled(inside, seeds, g.features, fanouts, seed)


def partition_loader(g: PartitionedGraph, size: int, split: str = "train", pivots: Pivots | None = None, epoch: int = 0, seed: int = 0) -> Epoch:
    """Parts in random order, ``size`` to a batch, collated with local ids; with pivots, these are added to every batch."""
    batches = batching.part_batches(g.k, size, g.nodes.sparkSession, epoch, seed)
    if pivots is not None:
        nodes, edges = collate.collate_with_pivots(g, pivots, batches, split)
    else:
        nodes, edges = collate.batch_nodes(g, batches, split), collate.batch_edges(g, batches)
    features = None if g.features is None else nodes.select("batch", "local_id", "new_id").join(g.features, "new_id")
    return Epoch(nodes, edges, features)
