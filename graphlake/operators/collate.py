"""Macro-batches: subgraphs of chosen parts, with local ids, optionally with pivots.

A batch is a small table of parts, (batch, part, seq); all batches of an epoch are collated by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.store import cut
from graphlake.model import PartitionedGraph, Pivots
from graphlake.operators.layout import induced, scatter_append
from graphlake.operators.scoring import pivot_edges
from graphlake.operators.select import first_rows


def bases(batches: DataFrame, parts: DataFrame) -> DataFrame:
    """(batch, part, seq, start, size, base): where a part's nodes go in the batch; one row for each part of a batch."""
    sized = batches.join(parts.select("part", "start", (F.col("end") - F.col("start")).alias("size")), "part")
    before = F.sum("size").over(Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return sized.withColumn("base", F.coalesce(before, F.lit(0)))


def batch_nodes(g: PartitionedGraph, batches: DataFrame, split: str = "train") -> DataFrame:
    """(batch, local_id, new_id, old_id, label, is_target), parts in batch order."""
    b = bases(batches, g.parts).select("batch", "part", "start", "base")
    target = F.coalesce(F.col("split") == split, F.lit(False)).alias("is_target")
    return g.nodes.join(b, "part").select("batch", (F.col("base") + F.col("new_id") - F.col("start")).alias("local_id"), "new_id", "old_id", "label", target)


def batch_edges(g: PartitionedGraph, batches: DataFrame) -> DataFrame:
    """(batch, src, dst) in local ids: the edge blocks between every two parts of a batch.

    The parts' places are written first: a row for each part of a batch, whose size is then known, so edges meet them where they lie and are not shuffled.
    """
    b = cut(bases(batches, g.parts))
    side = lambda c, p: b.select("batch", F.col("part").alias(p), (F.col("base") - F.col("start")).alias(f"_{c}"))
    e = g.edges.select("src", "dst", "sp", "dp").join(side("src", "sp"), "sp").join(side("dst", "dp"), ["batch", "dp"])
    return e.select("batch", (F.col("src") + F.col("_src")).alias("src"), (F.col("dst") + F.col("_dst")).alias("dst"))


def build_pivots(g: PartitionedGraph, ids: DataFrame, edges: DataFrame, assign: DataFrame) -> Pivots:
    """The pivot tables of ids(id) in old ids, edges(src, dst) in old ids.  Pivots are numbered by old id."""
    placed, _ = scatter_append(ids.select("id").withColumn("_all", F.lit(0)), "_all", "id", 1, "pvt")
    numbered = cut(placed.select("pvt", F.col("id").alias("old_id")).join(assign.select(F.col("id").alias("old_id"), "part"), "old_id"))
    ids = numbered.select(F.col("old_id").alias("id"))
    inter, intra = pivot_edges(edges, ids)
    new = g.nodes.select(F.col("old_id").alias("src"), "new_id", F.col("part").alias("sp"))
    to = numbered.select(F.col("old_id").alias("dst"), F.col("pvt").alias("to"))
    frm = numbered.select(F.col("old_id").alias("src"), F.col("pvt").alias("frm"), F.col("part").alias("sp"))
    return Pivots(
        numbered.select("pvt", "old_id", "part"),
        inter.join(new, "src").join(to, "dst").select(F.col("new_id").alias("src"), F.col("to").alias("pvt"), "sp"),
        intra.join(frm, "src").join(to, "dst").select(F.col("frm").alias("src"), F.col("to").alias("dst"), "sp"),
    )


def largest_parts(parts: DataFrame, batch: int) -> DataFrame:
    """(part, size) of the 2 * batch largest parts, ties to the smaller number: what two buffers of a batch must hold at most."""
    return parts.select("part", (F.col("end") - F.col("start")).alias("size")).orderBy(F.desc("size"), "part").limit(2 * batch)


def batch_pivots(p: Pivots, batches: DataFrame) -> DataFrame:
    """(batch, pvt) of pivots whose part is in the batch: these are main nodes already."""
    return p.pivots.join(batches.select("batch", "part"), "part").select("batch", "pvt")


def collate_with_pivots(g: PartitionedGraph, p: Pivots, batches: DataFrame, split: str = "train") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of batches with parts in ascending order.

    nodes(batch, local_id, new_id, old_id, label, is_target): main nodes, then all pivots, whose label is 0.  edges(batch, src, dst): the
    main blocks, edges between main nodes and pivots of other parts both ways, and edges that leave such pivots for any pivot.
    """
    order = batches.withColumn("seq", F.col("part"))
    main = batch_nodes(g, order, split)
    n_main = bases(order, g.parts).groupBy("batch").agg(F.sum("size").alias("n_main"))
    # Every batch gets every pivot; batches are at most as many as parts, so their sizes go into the plan.
    sizes = F.array(*(F.struct(F.lit(r["batch"]).cast(batches.schema["batch"].dataType).alias("batch"), F.lit(r["n_main"]).cast("bigint").alias("n_main")) for r in n_main.collect())).cast(f"array<struct<batch: {batches.schema['batch'].dataType.simpleString()}, n_main: bigint>>")
    each = lambda df: df.withColumn("_b", F.explode(sizes)).select(*df.columns, "_b.batch", "_b.n_main")
    extra = each(p.pivots.join(g.nodes.select("old_id", "new_id"), "old_id"))
    nodes = main.unionByName(extra.select("batch", (F.col("n_main") + F.col("pvt")).alias("local_id"), "new_id", "old_id", F.lit(0).alias("label"), F.lit(False).alias("is_target")))
    redundant = batch_pivots(p, order)
    b = bases(order, g.parts).join(n_main, "batch")
    inter = p.inter.join(b.select("batch", F.col("part").alias("sp"), (F.col("base") - F.col("start")).alias("d"), "n_main"), "sp").join(redundant, ["batch", "pvt"], "left_anti")
    inter = inter.select("batch", (F.col("src") + F.col("d")).alias("src"), (F.col("pvt") + F.col("n_main")).alias("dst"))
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    inter = inter.select("batch", both.alias("e")).select("batch", "e.src", "e.dst")
    intra = each(p.intra).join(order.select("batch", F.col("part").alias("sp")), ["batch", "sp"], "left_anti")
    intra = intra.select("batch", (F.col("src") + F.col("n_main")).alias("src"), (F.col("dst") + F.col("n_main")).alias("dst"))
    return nodes, batch_edges(g, order).union(inter).union(intra)


def check_layout(g: PartitionedGraph, edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(check, bad): violations of the layout's properties; all are 0 for a sound layout.  edges and assign are in old ids."""
    n, k = g.nodes.count(), g.k
    out = []
    add = lambda name, df: out.append(df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("bad")))
    add("new id outside its part", g.nodes.join(g.parts, "part").where("new_id < start or new_id >= end"))
    add("new id used twice", g.nodes.groupBy("new_id").count().where("count > 1"))
    add("id out of range", g.nodes.where((F.col("new_id") < 0) | (F.col("new_id") >= n)))
    add("part differs from the assignment", g.nodes.join(assign.select(F.col("id").alias("old_id"), F.col("part").alias("p")), "old_id").where("part <> p"))
    add("block differs from its parts", g.edges.where((F.floor(F.col("block") / k) != F.col("sp")) | (F.col("block") % k != F.col("dp"))))
    to_old = lambda c: g.nodes.select(F.col("new_id").alias(c), F.col("old_id").alias(f"o_{c}"))
    back = g.edges.select("src", "dst").join(to_old("src"), "src").join(to_old("dst"), "dst").select(F.col("o_src").alias("src"), F.col("o_dst").alias("dst"))
    add("edge lost or changed", edges.select("src", "dst").exceptAll(back).union(back.exceptAll(edges.select("src", "dst"))))
    total = out[0]
    for x in out[1:]:
        total = total.union(x)
    return total


def check_pivots(g: PartitionedGraph, p: Pivots, degrees: DataFrame) -> DataFrame:
    """(check, bad): violations of a pivot layout; degrees(id, deg) are the in-degrees in the whole graph, by old id."""
    part_of = g.nodes.select(F.col("new_id").alias("src"), "part")
    got = p.inter.groupBy("pvt").agg(F.count(F.lit(1)).alias("got"))
    want = p.pivots.join(degrees.select(F.col("id").alias("old_id"), "deg"), "old_id").join(got, "pvt", "left")
    checks = [
        ("edge into a pivot is in another part than its source", p.inter.join(part_of, "src").where("part <> sp")),
        ("edge between pivots is in another part than its source", p.intra.join(p.pivots.select(F.col("pvt").alias("src"), "part"), "src").where("part <> sp")),
        ("in-degree of a pivot differs from the graph's", want.where("deg <> coalesce(got, 0)")),
        ("pivot number used twice", p.pivots.groupBy("pvt").count().where("count > 1")),
    ]
    out = None
    for name, df in checks:
        row = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("bad"))
        out = row if out is None else out.union(row)
    return out


def popular_nodes(nodes: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """(id): the given share of all nodes, by in-degree, ties to the smaller id."""
    deg = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    full = cut(nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")))
    return first_rows(full, F.col("deg"), int(full.count() * share)).select("id")


def cluster_batch(nodes: DataFrame, edges: DataFrame, assign: DataFrame, parts: list[int], share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, role), edges) of some clusters: their train nodes, their other nodes as helpers, and popular nodes of
    other clusters as cache; edges are those among all of these."""
    n = nodes.join(assign.select("id", "part"), "id")
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    mine = n.where(F.col("part").isin(parts)).select("id", F.when(train, "train").otherwise("helper").alias("role"))
    cache = popular_nodes(nodes, edges, share).join(mine, "id", "left_anti").select("id", F.lit("cache").alias("role"))
    both = mine.union(cache)
    return both, induced(edges.select("src", "dst"), both)


def cached_batch(g: PartitionedGraph, cache: DataFrame, parts: list[int]) -> tuple[DataFrame, DataFrame]:
    """(nodes(local_id, new_id), edges) with a static cache(new_id) first, then the parts' other nodes; a cached node of a part
    appears once, and edges to nodes that are neither cached nor in the parts are dropped."""
    part_nodes = g.nodes.where(F.col("part").isin(parts)).select("new_id").join(cache, "new_id", "left_anti")
    all_ = cache.select("new_id", F.lit(0).alias("side")).union(part_nodes.select("new_id", F.lit(1)))
    placed, _ = scatter_append(all_, "side", "new_id", 2, "local_id")
    ids = placed.select("local_id", "new_id")
    e = g.edges.select("src", "dst").join(ids.select(F.col("new_id").alias("src"), F.col("local_id").alias("a")), "src").join(ids.select(F.col("new_id").alias("dst"), F.col("local_id").alias("b")), "dst")
    return ids, e.select(F.col("a").alias("src"), F.col("b").alias("dst"))
