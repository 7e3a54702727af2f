"""The graph engine's queries, each over the whole graph derived from the tables.

K parts, the batch of parts and the seeds are parameters of the queries; none of them limits what is read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import user
from graphlake.functions.store import cut, folder
from graphlake.model import PartitionedGraph
from graphlake.operators import aggregate, batching, chain, collate, concurrent, layout, methods, metrics, multilevel, runlog, sampling, scoring
from graphlake.operators import partition as parting
from graphlake.plans import loaders
from graphlake.sources import graphs
from graphlake.streaming import events as streams

K = 16
BATCH = [11, 3, 7]
ALL: dict = {}


class Context:
    """The derived graph and what most queries need of it, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.g = spark, sf_dir, graphs.star_schema(spark, sf_dir)
        self.nodes, self.edges = self.g.nodes, self.g.edges

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def assign(self) -> DataFrame:
        return parting.hash_partition(self.nodes, K)

    @property
    def train(self) -> DataFrame:
        return self.g.split("train")

    @property
    def parted(self) -> PartitionedGraph:
        return layout.partition_graph(self.g, self.assign, K)

    @property
    def batch(self) -> DataFrame:
        return self.spark.createDataFrame([(0, p, i) for i, p in enumerate(BATCH)], "batch int, part int, seq int")

    @property
    def pivot_ids(self) -> DataFrame:
        return scoring.pivots(self.nodes, self.edges, self.train, 0.05, 1)

    def runlog(self) -> DataFrame:
        """Six runs of forty epochs: the shares of an epoch's orders that are finished, dear and urgent stand for its accuracies."""
        o = self.table("orders").select((F.col("o_orderkey") % 6).cast("int").alias("run"), F.floor(F.col("o_orderkey") / 6 % 40).cast("int").alias("iter"), "o_orderstatus", "o_totalprice", "o_orderpriority")
        share = lambda c: (F.count(F.when(c, 1)) / F.count(F.lit(1)))
        accs = {"val/acc": F.col("o_orderstatus") == "F", "test/acc": F.col("o_totalprice") > 150_000, "train/acc": F.col("o_orderpriority").startswith("1")}
        return o.groupBy("run", "iter").agg(*(share(c).alias(k) for k, c in accs.items())).unpivot(["run", "iter"], list(accs), "label", "value").select("run", "label", "iter", "value")

    def runs(self) -> DataFrame:
        """A run for every clerk's remainder: its last order's day, and a configuration of one of three shapes."""
        o = self.table("orders").groupBy((F.col("o_custkey") % 60).cast("int").alias("run")).agg(F.max("o_orderdate").alias("at"), F.count(F.lit(1)).alias("n"))
        fanout, p = F.col("run") % 3, F.col("run") % 4
        texts = ['{"sample": {"P": %d, "fanout": [%d, 10, 5]}, "model": "sage"}', '{"sample": {"P": "%d", "fanout": [%d]}, "lr": 1e-3}', '{"sample": {"P": %d.0, "fanout": [%d, 10]}, "model": "sage", "layers": {"n": 3}}']
        config = F.when(F.col("run") % 5 == 0, F.format_string(texts[1], p, fanout)).when(F.col("run") % 5 == 1, F.format_string(texts[2], p, fanout)).otherwise(F.format_string(texts[0], p, fanout))
        return runlog.with_configs(o.select("run", "at", config.alias("config")))

    def stored(self, **kw) -> tuple[DataFrame, DataFrame]:
        """The logs and runs, written to a store and read again."""
        path = folder(self.spark)
        runlog.write_store(self.runlog(), self.runs(), path)
        return runlog.read_store(self.spark, path, **kw)


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Context(spark, sf_dir))

    ALL[f.__name__] = run
    return run


def heavy(f):
    """A query that reads the edges many times: they are derived and written once."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Context(spark, sf_dir)
        c.edges = cut(c.edges)
        c.g = replace(c.g, edges=c.edges)
        return f(c)

    ALL[f.__name__] = run
    return run


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def _r9(c: str, step: float = 1e9):
    """A column in steps of 1e-13 and these in steps of 1e-9: what the order of sums changes does not reach a tie."""
    return (F.floor(F.floor(F.col(c) * 1e13 + 0.5) / 1e13 * step + 0.5) / step).alias(c)


# Sources


@query
def graph_nodes(c):
    return c.nodes.select("id", "kind", "label", "split")


@query
def graph_edges_symmetric(c):
    return c.edges.select("src", "dst")


@query
def graph_edges_selfloop(c):
    return graphs.add_self_loops(c.edges, c.nodes)


@query
def graph_edges_multiset(c):
    return graphs.symmetrise(graphs.star_pairs(c.spark, c.dir), dedup=False)


@query
def hetero_homogenize(c):
    """Three relations over four node types in one id space: suppliers, nations, parts, customers."""
    s, n, p, u = (c.table(t) for t in ("supplier", "nation", "part", "customer"))
    sizes = [("supplier", s.count()), ("nation", n.count()), ("part", p.count()), ("customer", u.count())]
    sells = c.table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    at = s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    lives = u.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    return graphs.homogenise(sizes, [("supplier", "part", sells), ("supplier", "nation", at), ("customer", "nation", lives)])


@query
def split_counts(c):
    return _long(c.nodes.where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n")), "n")


@query
def split_ids_train(c):
    return c.train


@query
def split_resampled(c):
    return graphs.split_by_hash(c.nodes, 20, 40).select("id", "split")


@query
def split_sequential(c):
    return graphs.split_by_range(c.nodes, c.table("customer").count()).select("id", "split")


@query
def features_lookup(c):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return c.g.features.select("id", (F.round(F.get("x", F.lit(0)).cast("double"), 6) + 0.0).alias("x0"), (F.round(total, 6) + 0.0).alias("total"))


# Layout


@query
def degree(c):
    return _long(layout.degree(c.nodes, c.edges), "deg")


@query
def degree_histogram(c):
    return _long(layout.degree(c.nodes, c.edges).groupBy("deg").agg(F.count(F.lit(1)).alias("n")), "deg", "n")


@query
def degree_order(c):
    """Position of each node by descending degree, ties by id: the stream order of the partitioner."""
    return _long(batching.degree_order(layout.degree(c.nodes, c.edges)), "deg")


@query
def csc_rowptr(c):
    return _long(layout.row_pointers(c.nodes, c.edges, "dst"), "start", "len")


@query
def csr_rowptr(c):
    return _long(layout.row_pointers(c.nodes, c.edges, "src"), "start", "len")


@query
def csc_neighbors_str(c):
    return layout.adjacency(c.edges).select("dst", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query
def degree_ratio_export(c):
    e = c.edges
    out_, in_ = (e.groupBy(F.col(x).alias("id")).agg(F.count(F.lit(1)).alias(n)) for x, n in (("src", "o"), ("dst", "i")))
    d = out_.join(in_, "id", "full").select("id", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    return d.select("id", F.round((F.col("o") + F.lit(1e-8)) / (F.col("i") + F.lit(1e-8)), 9).alias("score"))


@query
def split_masks_export(c):
    return c.nodes.select("id", *(F.coalesce(F.col("split") == s, F.lit(False)).alias(f"{s}_mask") for s in ("train", "valid", "test")))


@query
def index_mask(c):
    return layout.index_to_mask(c.nodes.select("id"), c.train)


@query
def mask_index(c):
    return layout.mask_to_index(layout.index_to_mask(c.nodes.select("id"), c.train))


@query
def part_hash(c):
    return c.assign


@query
def part_sizes(c):
    return _long(layout.histogram(c.assign, "part", K), "n")


@query
def part_size_stats(c):
    return layout.histogram(c.assign, "part", K).agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"))


@query
def train_per_part(c):
    return _long(layout.histogram(c.assign.join(c.train, "id"), "part", K), "n")


@query
def part_offsets(c):
    return _long(layout.offsets(c.assign, "part", K), "start", "end")


@query
def scatter_positions(c):
    placed, _ = layout.scatter_append(c.assign, "part", "id", K, "new_id", 1024)
    return placed.select("id", "part", F.col("new_id").cast("bigint").alias("new_id"))


@query
def node_map_inverse(c):
    return _long(c.parted.nodes.select("new_id", "old_id", "part"), "new_id")


@query
def relabelled_edges(c):
    return _long(c.parted.edges.select("src", "dst", "sp", "dp", "block"), "src", "dst")


@query
def edge_blocks(c):
    return _long(layout.histogram(c.parted.edges, "block", K * K), "n")


@query
def block_offsets(c):
    return _long(layout.offsets(c.parted.edges, "block", K * K), "start", "end")


@query
def intervals(c):
    off = layout.offsets(c.assign, "part", K)
    ends = off.select("part", "start").union(off.where(F.col("part") == K - 1).select((F.col("part") + 1).alias("part"), F.col("end").alias("start")))
    return _long(layout.intervalize(ends), "lo", "hi")


def _largest(c, n: int) -> list[int]:
    """The n parts with the most nodes, ties to the smaller number."""
    return [r["part"] for r in layout.histogram(c.assign, "part", K).orderBy(F.desc("n"), "part").limit(n).collect()]


@query
def complement_runs(c):
    """The runs of parts between the six largest ones."""
    parts = c.spark.createDataFrame([(p,) for p in _largest(c, 6)], "part int")
    return layout.complement_runs(parts, "part", K)


@query
def block_pairs(c):
    """The blocks between the three largest parts, largest first."""
    return c.spark.createDataFrame([(i, b) for i, b in enumerate(layout.block_ids(_largest(c, 3), K))], "pos int, block int")


@query
def composite_keys(c):
    return c.edges.select("src", "dst", layout.composite_key(F.col("src"), F.col("dst"), c.nodes.count()).cast("bigint").alias("key"))


@query
def ranges_gather_nodes(c):
    off = layout.offsets(c.assign, "part", K)
    r = c.batch.join(off, "part").select("seq", F.col("start"), (F.col("end") - F.col("start")).alias("len"))
    return _long(layout.ranges_gather(c.parted.nodes.select("new_id", "old_id"), "new_id", r).select("out_pos", "new_id", "old_id"), "out_pos", "new_id")


@query
def ranges_add_shift(c):
    off = layout.offsets(c.assign, "part", K)
    r = c.batch.join(off, "part").select("start", (F.col("end") - F.col("start")).alias("len"), ((F.col("seq") + 1) * 1000).alias("value"))
    n = c.parted.nodes.select("new_id", F.col("new_id").alias("v"))
    return _long(layout.ranges_add(n, "new_id", "v", r), "new_id", "v")


@query
def coo_merge_degree(c):
    """Three fragments of the edges, one of them twice, merged: duplicates stay."""
    e = c.edges
    parts = [e.where(F.col("src") % 3 == i) for i in (0, 1, 2, 0)]
    m = layout.merge_fragments(parts)
    return m.select("dst", F.size("nbrs").cast("bigint").alias("n"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query
def row_slice_edges(c):
    inter, _ = scoring.pivot_edges(c.edges, c.train)
    return inter


@heavy
def edges_sorted(c):
    """Rank of each edge in (dst, src) order."""
    return batching.edge_order(c.edges).select("src", "dst", "pos")


@heavy
def ranges_merge_degree(c):
    """Slices of two fragments of the edges by position, one of them twice, merged."""
    e = cut(batching.edge_order(c.edges))
    n = e.count()
    fragments = [e.where(F.col("src") % 2 == i).withColumn("pos", F.floor(F.col("pos") / 2)) for i in (0, 1)]
    r = c.spark.createDataFrame([(0, 0, n // 8), (1, n // 8, n // 4), (0, 0, n // 16)], "fragment int, start bigint, len bigint")
    m = layout.merge_ranges(fragments, "pos", r)
    return m.select("dst", F.size("nbrs").cast("bigint").alias("n"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query
def row_col_slice(c):
    """Edges from training nodes into nodes of the second kind, turned round."""
    into = c.nodes.where("kind = 1").select(F.col("id").alias("dst"))
    e = c.edges.join(c.train.select(F.col("id").alias("src")), "src", "left_semi").join(into, "dst", "left_semi")
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query
def split_first(c):
    """The first 100 training ids."""
    return c.train.orderBy("id").limit(100)


@query
def split_test_is_valid(c):
    return replace(c.g, attrs=c.g.attrs | {"test_is_valid": True}).split("test")


@query
def largest_parts(c):
    return _long(collate.largest_parts(layout.offsets(c.assign, "part", K), 3), "size")


# Partition quality


def _cut_cols(df):
    return df.select(F.col("cuts").cast("bigint").alias("cuts"), F.col("edges").cast("bigint").alias("edges"))


@query
def edge_cuts(c):
    return _cut_cols(metrics.edge_cuts(c.edges, c.assign))


@query
def weighted_edge_cuts(c):
    e = c.edges.withColumn("w", (1 + (F.col("src") + F.col("dst")) % 5).cast("double"))
    return metrics.edge_cuts(e, c.assign, "w").select(F.round("cuts", 6).alias("cuts"), F.round("edges", 6).alias("edges"))


@query
def cut_matrix(c):
    return _long(metrics.cut_matrix(c.edges, c.assign), "n")


@query
def train_cut_matrix(c):
    return _long(metrics.cut_matrix(c.edges, c.assign, c.train), "n")


@query
def cut_flags(c):
    return metrics.cut_flags(c.edges, c.assign, collate.popular_nodes(c.nodes, c.edges, 0.1))


@query
def moved_nodes(c):
    """Nodes that change their part when the graph is split by ranges of ids in place of a hash."""
    n = c.nodes.count()
    other = c.nodes.select("id", F.least(F.floor(F.col("id") * K / n), F.lit(K - 1)).cast("int").alias("part"))
    return _long(metrics.moved(c.assign, other), "moved", "nodes")


@query
def load_ratio(c):
    return metrics.load_ratio(c.assign, K)


@query
def label_load_ratio(c):
    return metrics.label_load_ratio(c.nodes.where("label is not null").join(c.assign, "id").select("label", "part"), K)


@query
def label_hist(c):
    return metrics.label_masses(c.nodes, "label", 5).select("class", F.round("mass", 9).alias("mass"))


def _batched(c):
    return batching.global_batches(c.train, 100, 0, 3).join(c.nodes.select("id", "label"), "id")


@query
def label_emd_per_batch(c):
    b = metrics.label_masses(_batched(c), "label", 5, "batch")
    t = metrics.label_masses(c.nodes.where("split = 'train'"), "label", 5)
    return metrics.mass_distance(b, t, "batch").select("batch", F.round("distance", 9).alias("distance"))


@query
def label_kl_per_batch(c):
    b = metrics.label_masses(_batched(c), "label", 5, "batch", 1e-9)
    t = metrics.label_masses(c.nodes.where("split = 'train'"), "label", 5, None, 1e-9)
    return metrics.divergence(b, t, "batch").select("batch", F.round("kl", 9).alias("kl"))


@query
def distance_summary(c):
    """Mean and deviation of the batches' label distances over an epoch."""
    b = metrics.label_masses(_batched(c), "label", 5, "batch")
    t = metrics.label_masses(c.nodes.where("split = 'train'"), "label", 5)
    return metrics.mass_distance(b, t, "batch").agg(F.round(F.avg("distance"), 9).alias("mean"), F.round(F.stddev_samp("distance"), 9).alias("std"))


@query
def simulated_distance(c):
    """Mean and deviation of the label distances of drawn batches, as many labels as there are training nodes times 10."""
    t = metrics.label_masses(c.nodes.where("split = 'train'"), "label", 5)
    drawn = metrics.simulated_batches(t, c.train.count() * 10, 100)
    return metrics.mass_distance(metrics.label_masses(drawn, "label", 5, "batch"), t, "batch").agg(F.round(F.avg("distance"), 9).alias("mean"), F.round(F.stddev_samp("distance"), 9).alias("std"))


@query
def distinct_ends(c):
    return c.edges.agg(F.count_distinct("src").cast("bigint").alias("src"), F.count_distinct("dst").cast("bigint").alias("dst"), F.count(F.lit(1)).cast("bigint").alias("nnz"))


# Scores


def _score(df):
    return df.select("id", _r9("s"))


@query
def lazy_rw_k1(c):
    return _score(scoring.lazy_walk(c.nodes, c.edges, scoring.seeds(c.nodes, c.train, 1.0), 1)[-1])


@heavy
def lazy_rw_k3(c):
    return _score(scoring.lazy_walk(c.nodes, c.edges, scoring.seeds(c.nodes, c.train, 1.0), 3)[-1])


@query
def node_importance_k0(c):
    return _score(scoring.node_importance(c.nodes, c.edges, c.train, 0))


@query
def node_importance_k1(c):
    return _score(scoring.node_importance(c.nodes, c.edges, c.train, 1))


@heavy
def node_importance_k2(c):
    return _score(scoring.node_importance(c.nodes, c.edges, c.train, 2))


@heavy
def edge_importance_k3(c):
    return scoring.edge_importance(c.nodes, c.edges, c.train, 3).select("src", "dst", _r9("w"))


@heavy
def walk_sum_influence(c):
    """Scores of all steps of a walk, added."""
    steps = scoring.lazy_walk(c.nodes, c.edges, scoring.seeds(c.nodes, c.train, 1.0), 2)
    return _score(scoring._add([(s, 1.0) for s in steps[1:]]))


@heavy
def pivots_topk(c):
    return c.pivot_ids.select("id", _r9("s"))


@query
def popular_nodes(c):
    return collate.popular_nodes(c.nodes, c.edges, 0.1)


@heavy
def pivot_inter_edges(c):
    return scoring.pivot_edges(c.edges, c.pivot_ids)[0]


@heavy
def pivot_intra_edges(c):
    return scoring.pivot_edges(c.edges, c.pivot_ids)[1]


def _influence(c):
    return scoring.seed_influence(c.edges, c.nodes, c.train, 2, 100)


@heavy
def seed_topk_influence(c):
    return _influence(c).select("seed", "id", _r9("s", 1e11), "rank")


@heavy
def coverage(c):
    out = scoring.coverage(_influence(c), c.assign, c.train, c.pivot_ids)
    return out.select("part", _r9("covered"), _r9("best"))


@heavy
def revisit_probability(c):
    deg = layout.degree(c.nodes, c.edges).where("deg > 0")
    back = scoring.spmv(c.edges, deg.select("id", (1 / F.col("deg")).alias("s")))
    return back.join(deg, "id").select("id", (F.col("s") / F.col("deg")).alias("r")).select("id", _r9("r"))


# Collation


@query
def collate_nodes(c):
    return _long(collate.batch_nodes(c.parted, c.batch).select("batch", "local_id", "new_id", "old_id", "label"), "local_id", "new_id")


@query
def collate_targets(c):
    return _long(collate.batch_nodes(c.parted, c.batch).where("is_target").select("batch", "local_id"), "local_id")


@query
def collate_edges(c):
    return _long(collate.batch_edges(c.parted, c.batch), "src", "dst")


def _pivots(c):
    g = c.parted
    return g, collate.build_pivots(g, c.pivot_ids, c.edges, c.assign)


@heavy
def pivot_tables(c):
    _, p = _pivots(c)
    return p.pivots.select(F.col("pvt").cast("bigint").alias("pvt"), "old_id", "part")


@heavy
def collate_pivot_nodes(c):
    nodes, _ = collate.collate_with_pivots(*_pivots(c), c.batch)
    return _long(nodes.select("batch", "local_id", "old_id", "label", "is_target"), "local_id")


@heavy
def collate_pivot_edges(c):
    _, edges = collate.collate_with_pivots(*_pivots(c), c.batch)
    return _long(edges, "src", "dst")


@heavy
def pivot_store_edges(c):
    """Pivots written beside their partition, read again for the parts of the batch, and collated."""
    g, p = _pivots(c)
    path = graphs.partition_path(folder(c.spark), "rand", K, pivots=True)
    graphs.write_pivots(p, path)
    _, edges = collate.collate_with_pivots(g, graphs.read_pivots(c.spark, path, BATCH), c.batch)
    return _long(edges, "src", "dst")


@heavy
def pivot_layout_check(c):
    """Violations by stored pivots: sources outside their part, and in-degrees that differ from the whole graph's."""
    g, p = _pivots(c)
    path = graphs.partition_path(folder(c.spark), "rand", K, pivots=True)
    graphs.write_pivots(p, path)
    return _long(collate.check_pivots(g, graphs.read_pivots(c.spark, path), layout.degree(c.nodes, c.edges)), "bad")


@heavy
def popular_pivots(c):
    """Pivots that are popular nodes as well."""
    return c.pivot_ids.select("id").intersect(collate.popular_nodes(c.nodes, c.edges, 0.1).select("id"))


@heavy
def partition_store_blocks(c):
    """A partitioned graph written, and the blocks between the batch's parts read again: only these parts' directories are planned."""
    path = graphs.partition_path(folder(c.spark), "rand", K)
    graphs.write_partitioned(c.parted, path)
    e = graphs.read_partitioned(c.spark, path, BATCH).edges
    return _long(e.groupBy("sp", "dp").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst")), "n", "src", "dst")


@heavy
def layout_check(c):
    return _long(collate.check_layout(c.parted, c.edges, c.assign), "bad")


@query
def cluster_batch_nodes(c):
    return collate.cluster_batch(c.nodes, c.edges, c.assign, BATCH, 0.05)[0]


@heavy
def cluster_batch_edges(c):
    return collate.cluster_batch(c.nodes, c.edges, c.assign, BATCH, 0.05)[1]


@heavy
def cached_batch_edges(c):
    g = c.parted
    cache = collate.popular_nodes(c.nodes, c.edges, 0.05).join(g.nodes.select(F.col("old_id").alias("id"), "new_id"), "id").select("new_id")
    return _long(collate.cached_batch(g, cache, BATCH)[1], "src", "dst")


@query
def epoch_part_batches(c):
    """Batches of parts with the training nodes that each part brings."""
    batches = batching.part_batches(K, 5, c.spark, 1, 9).join(layout.histogram(c.assign.join(c.train, "id"), "part", K), "part")
    return _long(batches.select("batch", "part", "seq", "n"), "batch", "seq", "n")


@query
def epoch_collate_edges(c):
    """Edges of every macro-batch of an epoch, by one plan."""
    e = collate.batch_edges(c.parted, batching.part_batches(K, 5, c.spark, 1, 9))
    return _long(e.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst")), "batch", "n", "src", "dst")


# Batching


def _positions(c):
    return batching.shuffle(c.train, "id", 2, 5)


@query
def shuffled_seeds(c):
    return _positions(c).select("id", "pos")


@query
def split_chunks(c):
    n = c.train.count()
    return _positions(c).select("id", "pos", batching.split_chunk(F.col("pos"), n, 64, 0.5).alias("chunk"))


@query
def even_split_chunks(c):
    n = c.train.count()
    return _positions(c).select("id", "pos", batching.even_chunk(F.col("pos"), n, 64).alias("chunk"))


@query
def chained_chunks(c):
    """Training ids shuffled, split without a short tail, zipped with shuffled validation ids and repeated, as one chain."""
    valid = chain.chain(c.g.split("valid")).shuffle("id", 2, 5).select("pos", F.col("id").alias("other"))
    made = chain.chain(c.train).shuffle("id", epoch=2, seed=5).split(64, keep=0.5).where("chunk is not null").zip(valid).repeats(2)
    return made.select("id", "other", "pos", "chunk", "repeat").table


@query
def tensor_batch_chunks(c):
    n = c.train.count()
    p = F.col("pos")
    return _positions(c).select("id", "pos", batching.tensor_chunk(p, n, 50).alias("chunk"), batching.tensor_chunk(p, n, 50, True).alias("dropped"), batching.tensor_chunk(p, n, 50, True, True).alias("quirk"))


@query
def repeat_targets(c):
    return batching.repeats(c.train, 3)


@query
def zip_positions(c):
    """Training and validation ids paired by position; the shorter list ends it."""
    a = batching.shuffle(c.train, "id", 0, 1).select("pos", F.col("id").alias("a"))
    b = batching.shuffle(c.g.split("valid"), "id", 0, 1).select("pos", F.col("id").alias("b"))
    return batching.zip_rows(a, b)


@query
def batch_unbatch(c):
    lists = batching.batch_rows(_positions(c), "pos", "id", 32, True)
    return lists.select("batch", F.posexplode("items").alias("at", "id"))


@query
def flatmap_copies(c):
    rows = c.nodes.where("kind = 0").select("id", "label", (F.col("id") % 3).alias("m"))
    return batching.flat_map(rows, "m", lambda m: F.sequence(F.lit(0).cast("bigint"), m))


@query
def global_batches(c):
    return batching.global_batches(c.train, 100, 0, 3).select("batch", "pos", "id")


def _members(c):
    return c.train.join(c.assign, "id").select("id", F.col("part").alias("block"))


@query
def hier_batches(c):
    return _long(batching.hier_batches(_members(c), 4, 50, 1, 2), "superblock")


@query
def hier_subgraph(c):
    m = c.assign.select("id", F.col("part").alias("block"))
    e = batching.hier_subgraph(c.edges, m, 4, 1, 2)
    return _long(e.groupBy("superblock").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst")), "superblock", "n", "src", "dst")


@query
def training_blocks(c):
    """Training nodes bucketed by part, with their positions."""
    placed, _ = layout.scatter_append(_members(c), "block", "id", K, "pos")
    return _long(placed.select("id", "block", "pos"), "pos")


# Sampling


def _sampled(c, fanouts):
    seeds = batching.global_batches(c.train, 100, 0, 3).select("batch", "id")
    return sampling.sample(c.edges, seeds, fanouts, 17)


@heavy
def sample_hop1(c):
    return _sampled(c, [5])[1]


@heavy
def sample_hop2(c):
    return _sampled(c, [5, 3])[1]


@heavy
def sample_nodes(c):
    return _sampled(c, [5, 3])[0]


@heavy
def mfg_hop_counts(c):
    return _long(sampling.hop_counts(*_sampled(c, [5, 3])), "nodes", "edges")


@heavy
def mfg_trimmed(c):
    _, edges = sampling.trim(*_sampled(c, [5, 3]), 1, 2)
    return _long(edges.groupBy("batch", "hop").agg(F.count(F.lit(1)).alias("n")), "n")


@heavy
def mfg_features_sum(c):
    nodes, _ = _sampled(c, [5, 3])
    rows = sampling.gather(nodes, c.g.features).withColumn("x0", F.get("x", F.lit(0)).cast("double"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).cast("bigint").alias("n"), (F.round(F.sum("x0"), 6) + 0.0).alias("total"))


@heavy
def sample_replace_edges(c):
    """Positions drawn with replacement, more of them than most lists are long, with the ids of their edges and how often each was drawn."""
    seeds = batching.global_batches(c.train, 100, 0, 3).select("batch", "id")
    placed, lists = sampling.positioned(c.edges)
    _, edges = sampling.sample(placed, seeds, [40, 3], 17, replace=True, lists=lists)
    return _long(edges.groupBy("batch", "hop", "src", "dst", "eid").agg(F.count(F.lit(1)).alias("n")), "n")


@heavy
def sample_edge_ids(c):
    """What is taken without replacement, with the ids of its edges."""
    seeds = batching.global_batches(c.train, 100, 0, 3).select("batch", "id")
    return sampling.sample(sampling.positioned(c.edges)[0], seeds, [5, 3], 17)[1].select("batch", "hop", "src", "dst", "eid")


@heavy
def sample_undirected(c):
    """All edges between a batch's sampled nodes."""
    e = sampling.induced_batches(_sampled(c, [5, 3])[0], c.edges)
    return _long(e.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst")), "n", "src", "dst")


@heavy
def drop_random_alive(c):
    return sampling.drop_random(_sampled(c, [5, 3])[0], 0.3, 4)


def _deg_scores(c, nodes):
    d = layout.degree(c.nodes, c.edges).select("id", F.col("deg").cast("double").alias("s"))
    return nodes.select("batch", "id").join(d, "id")


@heavy
def drop_influence_alive(c):
    nodes, _ = _sampled(c, [5, 3])
    return sampling.drop_weak(nodes, _deg_scores(c, nodes), 0.3)


def _walk_scores(c, nodes):
    s = scoring.lazy_walk(c.nodes, c.edges, scoring.seeds(c.nodes, c.train, 1.0), 1)[-1].select("id", F.round("s", 9).alias("s"))
    return nodes.select("batch", "id").join(s, "id")


@heavy
def drop_walk_alive(c):
    """Without the nodes that a walk from the training nodes reaches least."""
    nodes, _ = _sampled(c, [5, 3])
    return sampling.drop_weak(nodes, _walk_scores(c, nodes), 0.3)


@heavy
def retained_score(c):
    """What is left of each batch's walk scores when half of the nodes beyond the first hop go."""
    nodes, _ = _sampled(c, [5, 3])
    kept = sampling.retained(nodes, sampling.drop_far(nodes, 1, 0.5, 6), _walk_scores(c, nodes))
    return _long(kept.withColumn("score", F.round("score", 6)), "nodes", "alive")


@heavy
def drop_far_share_alive(c):
    return sampling.drop_far(_sampled(c, [5, 3])[0], 1, 0.5, 6)


@heavy
def drop_hop_share_alive(c):
    """Half of all nodes but the seeds go, the far ones first."""
    return sampling.drop_hop(_sampled(c, [5, 3])[0], 1, 0.5, 6)


@heavy
def drop_hop_near_alive(c):
    """Nine tenths go: all far ones, and of the near ones as many as it takes."""
    return sampling.drop_hop(_sampled(c, [5, 3])[0], 1, 0.9, 6)


@heavy
def drop_seed_influence_alive(c):
    """What the seeds of a batch influence least goes."""
    nodes = cut(_sampled(c, [5, 3])[0])
    return sampling.drop_by_influence(nodes, sampling.seed_scores(nodes, _influence(c)), 0.3)


@heavy
def drop_hop_alive(c):
    return sampling.drop_far(_sampled(c, [5, 3])[0], 1)


@heavy
def lossy_edges(c):
    nodes, edges = _sampled(c, [5, 3])
    return sampling.alive_edges(edges, sampling.drop_far(nodes, 1)).select("batch", "hop", "src", "dst")


@heavy
def batch_influence(c):
    _, edges = _sampled(c, [5, 3])
    return _score(sampling.batch_influence(edges, c.train, 2))


@heavy
def influence_by_layers(c):
    """How much of each batch's influence lies near, by the number of layers."""
    nodes, edges = _sampled(c, [5, 3])
    out = sampling.influence_by_layers(cut(nodes), cut(edges), 4)
    return _long(out.select("batch", "layers", "top", "near", _r9("top_sum"), _r9("all_sum")), "top", "near")


# Aggregation


@heavy
def block_neighbor_mean(c):
    """Neighbour means as a product of blocks of the partitioned graph."""
    g = c.parted
    s = aggregate.block_sums(g).join(g.nodes.select(F.col("new_id").alias("id"), "old_id"), "id")
    s = s.select(F.col("old_id").alias("id"), F.posexplode(F.transform("sums", lambda x: x / F.col("total"))).alias("pos", "v"))
    return s.select("id", "pos", (F.round("v", 6) + 0.0).alias("v"))


@heavy
def neighbor_sum(c):
    s = aggregate.neighbour_sums(c.edges, c.g.features)
    return s.select("id", F.posexplode("sums").alias("pos", "v")).select("id", "pos", (F.round("v", 6) + 0.0).alias("v"))


@heavy
def neighbor_mean(c):
    s = aggregate.neighbour_mean(c.edges, c.g.features)
    return s.select("id", F.posexplode("x").alias("pos", "v")).select("id", "pos", (F.round("v", 6) + 0.0).alias("v"))


def _flagged(c):
    return metrics.cut_flags(c.edges, c.assign, c.train.limit(0))


@query
def edge_norm_weight(c):
    return aggregate.edge_norm(_flagged(c), "cut", 2.0).select("src", "dst", F.round("w", 9).alias("w"))


@query
def attention_softmax(c):
    e = c.edges.withColumn("e", ((F.col("src") * 7 + F.col("dst") * 3) % 11) / F.lit(5.0))
    return aggregate.attention(e).select("src", "dst", _r9("a"))


@query
def scatter_add_labels(c):
    e = c.edges.join(c.nodes.select(F.col("id").alias("src"), F.coalesce("label", F.lit(0)).alias("label")), "src")
    return _long(e.groupBy(F.col("dst").alias("id")).agg(F.sum("label").alias("total")), "total")


def _rule(rows, cols, shift=0):
    """Weights by a rule that any engine can follow: ((7 (i + shift) + 3 j) mod 5 - 2) / 8."""
    i, j = np.arange(rows)[:, None] + shift, np.arange(cols)
    return ((7 * i + 3 * j) % 5 - 2) / 8


def _sums(df):
    return df.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


def _sage_layers():
    return [(_rule(64, 8), _rule(64, 8, 1), np.zeros(8)), (_rule(8, 4), _rule(8, 4, 1), np.zeros(4))]


def _head(inputs, shift):
    """Weight, left and right of an attention head."""
    j = np.arange(8) + shift
    return _rule(inputs, 8, shift), list((j % 3 - 1) / 4), list((j % 4 - 1) / 4)


@heavy
def sage_forward(c):
    return _sums(aggregate.sage(c.edges, c.g.features, _sage_layers()))


@heavy
def jk_forward(c):
    return _sums(aggregate.jumping(c.edges, c.g.features, _sage_layers()))


@heavy
def weighted_sage_forward(c):
    """Neighbour means over edges that weigh more where the partition cuts them."""
    return _sums(aggregate.weighted_sage(aggregate.edge_norm(_flagged(c), "cut", 2.0), c.g.features, _sage_layers()[:1]))


@heavy
def gcn_forward(c):
    return _sums(aggregate.gcn(c.edges, c.g.features, [(_rule(64, 8), np.zeros(8)), (_rule(8, 4), np.zeros(4))]))


@heavy
def gin_forward(c):
    return _sums(aggregate.gin(c.edges, c.g.features, [(0.125, _rule(64, 8), np.zeros(8))]))


@heavy
def gat_forward(c):
    """Two heads, averaged."""
    return _sums(aggregate.gat(c.edges, c.g.features, [[_head(64, 0), _head(64, 1)]]))


@heavy
def rgat_forward(c):
    """Two relations: from customers to parts, and back."""
    e = c.edges.withColumn("rel", (F.col("src") > F.col("dst")).cast("int"))
    return _sums(aggregate.rgat(e, c.g.features, [({0: _head(64, 0), 1: _head(64, 1)}, _rule(64, 8, 2), np.zeros(8))]))


@heavy
def sage_ri_forward(c):
    w = _rule(64, 8)
    layers = [(w, _rule(64, 8, 1), np.zeros(8), (w, np.zeros(8))), (_rule(8, 8), _rule(8, 8, 1), np.zeros(8), None)]
    return _sums(aggregate.sage_ri(c.edges, c.g.features, layers, [(_rule(80, 8), None), (_rule(8, 4), np.zeros(4))]))


# Loaders


@heavy
def node_loader_edges(c):
    return loaders.node_loader(c.g, [5, 3], 100, epoch=0, seed=3).edges


@heavy
def seed_loader_edges(c):
    """Validation seeds in the order of their ids."""
    return loaders.seed_loader(c.g, [5, 3], 100, "valid", seed=17).edges


@heavy
def hier_loader_edges(c):
    e = loaders.hierarchical_loader(c.g, c.assign, 4, [5, 3], 50, epoch=1, seed=2).edges
    return e.select(F.shiftright("batch", 32).alias("superblock"), F.col("batch").bitwiseAND(F.lit((1 << 32) - 1)).alias("batch"), "hop", "src", "dst")


@query
def partition_loader_nodes(c):
    nodes = loaders.partition_loader(c.parted, 5, epoch=1, seed=9).nodes
    return _long(nodes.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_target").cast("int")).alias("targets"), F.max("local_id").alias("last")), "batch", "n", "targets", "last")


# Run logs


def _iterations(c):
    o = c.table("orders")
    return o.select((F.col("o_orderkey") % 10).cast("int").alias("epoch"), (F.col("o_totalprice") / 1000).alias("loss"), (F.col("o_orderkey") % 32).alias("correct"), F.lit(32).alias("bsize"), (F.col("o_custkey") % 500).alias("nodes"), (F.col("o_custkey") % 2000).alias("edges"))


@query
def acc_per_epoch(c):
    m = metrics.epoch_metrics(_iterations(c))
    return m.select("epoch", *(F.round(x, 6).alias(x) for x in ("loss", "acc", "nodes", "edges")))


@query
def epoch_plateaus(c):
    """By a user's table function: each run's epochs at which validation accuracy rises over all before, and for how many epochs it had not."""
    log = c.runlog().where("label = 'val/acc'").select("run", "iter", "value")

    def step(state, row):
        if row["value"] > state.get("best", -1.0):
            yield row["run"], row["iter"], row["value"], row["iter"] - state.get("at", row["iter"])
            state.update(best=row["value"], at=row["iter"])

    out = user.table_function(log, dict, step, lambda _: iter(()), "run int, iter int, best double, waited int", ["run"], ["iter"])
    return out.select("run", "iter", _r9("best"), "waited")


@query
def epoch_spread(c):
    """By a user's aggregate with partial states: count, mean and deviation of the nodes of an epoch's iterations, from exact sums."""
    rows = _iterations(c).select("epoch", F.col("nodes").cast("bigint").alias("nodes"))

    def update(s, b):
        x = b.column("nodes").to_pylist()
        return s[0] + len(x), s[1] + sum(x), s[2] + sum(v * v for v in x)

    def finish(s):
        n, total, squares = s
        return n, total / n, ((n * squares - total * total) / (n * (n - 1))) ** 0.5 if n > 1 else None

    out = user.aggregate_function(rows, ["epoch"], ["nodes"], lambda: (0, 0, 0), update, lambda a, b: tuple(x + y for x, y in zip(a, b)), finish, "n bigint, mean double, std double")
    return out.select("epoch", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def eval_full(c):
    scores = c.nodes.select("split", "label", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: -((F.col("id") * 13 + k * 7) % 17) / F.lit(4.0)).alias("logp"))
    m = metrics.evaluate(scores)
    return m.select("split", F.col("n").cast("bigint").alias("n"), F.round("acc", 9).alias("acc"), F.round("nll", 9).alias("nll"))


@query
def best_epoch(c):
    return runlog.best_epoch(c.stored()[0]).select("run", "iter", F.round("val", 9).alias("val"), F.round("test", 9).alias("test"))


@query
def best_epoch_upto(c):
    return runlog.best_epoch(c.stored()[0], 19).select("run", "iter", F.round("val", 9).alias("val"), F.round("test", 9).alias("test"))


@query
def run_stdmean(c):
    m = runlog.mean_and_std(runlog.best_epoch(c.stored()[0]))
    return m.select(*(F.round(x, 6).alias(x) for x in m.columns))


@query
def acc_curve(c):
    m = runlog.curves(c.stored()[0], "val/acc")
    return m.select("iter", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.col("runs").cast("bigint").alias("runs"))


@query
def log_select(c):
    """Runs by nested values, from configurations of unlike shape: a list that begins as asked for, numbers by value, texts not as numbers."""
    _, runs = c.stored(filters={"sample": {"P": 1, "fanout": [2, 10]}, "model": "sage"}, until="2001-07-30")
    return runs.select("run", F.to_date("at").cast("string").alias("day"))


# Partitioners


@query
def fennel_alpha_table(c):
    top = c.nodes.agg(F.max("label")).first()[0] + 1
    s = F.when(F.col("split") == "train", F.coalesce("label", F.lit(top))).otherwise(top)
    counts = c.nodes.select(s.cast("int").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a = parting.strata_alphas(counts, c.edges.count(), K)
    return a.select("label", F.round("alpha", 9).alias("alpha"))


@query
def weight_rescale(c):
    d = layout.degree(c.nodes, c.edges).select("id", (F.col("deg") * 0.5).alias("w"))
    return layout.weight_rescale(d).select("id", "rescaled")


def _fennel(c, **kw):
    return parting.streaming_partition(c.nodes, c.edges, parting.Fennel(k=K, **kw))


@heavy
def fennel_stream(c):
    return _fennel(c, scan=0.0)


@heavy
def fennel_pruned(c):
    return _fennel(c)


@heavy
def fennel_restream(c):
    return _fennel(c, runs=3)


@heavy
def fennel_weighted(c):
    e = scoring.edge_importance(c.nodes, c.edges, c.train, 2)
    return parting.streaming_partition(c.nodes, e, parting.Fennel(k=K))


@heavy
def fennel_strata_balance(c):
    return methods.partition(c.nodes, c.edges, "fennel-wlb", K, 2, streams="one")


@heavy
def bsp_partition(c):
    return parting.superstep_partition(c.nodes, c.edges, parting.Fennel(k=K))


def _unit(c):
    return c.nodes.select("id", F.lit(1.0).alias("w")), c.edges.select("src", "dst", F.lit(1.0).alias("w"))


@heavy
def edge_matching(c):
    """Nodes that three rounds of handshakes join."""
    return multilevel.matching(*_unit(c))


@heavy
def contracted_edges(c):
    """The graph one level up: joined nodes as one, with the sums of parallel edges."""
    v, e = _unit(c)
    return multilevel.contract(v, e, multilevel.matching(v, e))[1].select("src", "dst", F.col("w").cast("bigint").alias("w"))


@heavy
def multilevel_invariants(c):
    return _sound(c, multilevel.multilevel_partition(c.nodes, c.edges, parting.Fennel(k=K)))


@heavy
def concurrent_invariants(c):
    return _sound(c, concurrent.concurrent_partition(c.nodes, c.edges, parting.Fennel(k=K), rounds=4))


@heavy
def block_streaming(c):
    return parting.block_streaming_partition(c.nodes, c.edges, parting.Fennel(k=K), blocks=4)


def _sound(c, assign):
    """Counts that show an assignment to be one, its capacity and how many parts exceed it, its cuts and a hash partition's."""
    a = cut(assign)
    n = c.nodes.count()
    cap = max(int(n / K * 1.1), -(-n // K))
    over = layout.histogram(a, "part", K).where(F.col("n") > cap).count()
    mine, other = (metrics.edge_cuts(c.edges, x).first()["cuts"] for x in (a, c.assign))
    wide = lambda x: F.lit(x).cast("bigint")
    known = a.join(c.nodes.select("id"), "id")
    return known.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.count_distinct("id").cast("bigint").alias("nodes"), F.min("part").cast("int").alias("first"), F.max("part").cast("int").alias("last"),
        wide(cap).alias("cap"), wide(over).alias("over"), wide(other).alias("hash_cuts"), F.lit(mine < other).alias("fewer_cuts"),
    )


@heavy
def fennel_invariants(c):
    return _sound(c, _fennel(c))


@heavy
def restream_invariants(c):
    return _sound(c, _fennel(c, runs=3))


@heavy
def bsp_invariants(c):
    return _sound(c, parting.superstep_partition(c.nodes, c.edges, parting.Fennel(k=K)))


@heavy
def block_stream_invariants(c):
    return _sound(c, parting.block_streaming_partition(c.nodes, c.edges, parting.Fennel(k=K), blocks=4))


def _balanced(c, assign):
    """For training nodes and others: how many there are, the most that a part may hold, and the parts that hold more."""
    train = F.coalesce(F.col("split") == "train", F.lit(False)).cast("int").alias("train")
    held = cut(assign).join(c.nodes.select("id", train), "id").groupBy("train", "part").agg(F.count(F.lit(1)).alias("n"))
    sums = held.groupBy("train").agg(F.sum("n").alias("n"))
    cap = F.greatest(F.floor(F.col("n") / K * 1.1), F.ceil(F.col("n") / K))
    out = held.withColumnRenamed("n", "here").join(sums, "train").withColumn("cap", cap)
    return out.groupBy("train", F.col("n").cast("bigint").alias("n"), F.col("cap").cast("bigint").alias("cap")).agg(F.sum((F.col("here") > F.col("cap")).cast("bigint")).alias("over"))


@heavy
def metis_tb_balance(c):
    return _balanced(c, methods.partition(c.nodes, c.edges, "metis-tb", K))


@heavy
def fennel_lb_balance(c):
    """The stratified and balanced stream, in blocks."""
    return _balanced(c, methods.partition(c.nodes, c.edges, "fennel-lb", K, 1, blocks=4))


@heavy
def ppr_push(c):
    return scoring.ppr(c.nodes, c.edges, c.train, 0.25, 1e-4).select("seed", "id", _r9("p"))


@heavy
def ppr_mass(c):
    """Of each seed, what was kept and what is left, which add up to the start, and the residuals that are still due."""
    r = scoring.ppr_sums(c.nodes, c.edges, c.train, 0.25, 1e-4)
    kept = F.col("p") * 0.25 + F.col("off")  # a node without neighbours hands nothing on
    return r.select("seed", F.round(kept + F.col("r"), 9).alias("mass"), F.col("due").cast("bigint").alias("due"))


# Streams


@query
def stream_event_counts(c):
    """The same plan as a stream's, over the events at rest."""
    out = streams.windowed_counts(c.table("events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.col("n").cast("bigint").alias("n"), F.round("total", 6).alias("total"))


@query
def stream_assign(c):
    """Runs a stream over all events to its end and returns what it wrote."""
    src = c.spark.readStream.schema(c.table("events").schema).parquet(f"{c.dir}/events.parquet*")
    return streams.run_to_end(c.spark, streams.assign_online(src.select("event_id", "user_id"), K), uuid.uuid4().hex)
