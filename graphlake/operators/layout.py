"""Positions, offsets, re-layout and format conversion.

Running sums go in two levels: sums of chunks of the id space first, then rows within a chunk.  So no part,
however large, is ordered in one task; only tables with a row for each part or chunk pass through one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.store import cut
from graphlake.model import Graph, PartitionedGraph

CHUNK = 65_536


def prefix_sum(df: DataFrame, key: str, value: str, out: str, by: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """df with ``out``: the sum of ``value`` over rows of smaller ``key`` (unique within ``by``)."""
    by = by or []
    parts = df.withColumn("_chunk", F.floor(F.col(key) / chunk))
    sums = parts.groupBy(*by, "_chunk").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over((Window.partitionBy(*by) if by else Window).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*by, "_chunk"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_chunk", "_inside", "_before")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(column, n) of the bins 0 to bins - 1; empty ones have 0."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias(column))
    return all_.join(counts.withColumn(column, F.col(column).cast("int")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def offsets(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(column, start, end): bin b holds positions start to end - 1; empty bins have start = end."""
    return prefix_sum(histogram(df, column, bins), column, "n", "start").select(column, "start", (F.col("start") + F.col("n")).alias("end"))


def scatter_append(df: DataFrame, part: str, pos: str, bins: int, out: str = "new_pos", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(df with ``out``, offsets): a stable bucket sort; rows of a part keep the order of ``pos``, which is unique."""
    off = offsets(df, part, bins)
    within = prefix_sum(df.withColumn("_one", F.lit(1)), pos, "_one", "_within", [part], chunk)
    return within.join(off.select(part, "start"), part).withColumn(out, F.col("start") + F.col("_within")).drop("start", "_within", "_one"), off


def relabel(df: DataFrame, column: str, mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """df with the ids of a column replaced."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(m, F.col(column) == F.col("_old")).withColumn(column, F.col("_new")).drop("_old", "_new")


def gather(df: DataFrame, index: str, table: DataFrame, key: str = "id") -> DataFrame:
    """df with the columns of the table's row that ``index`` names."""
    return df.join(table.withColumnRenamed(key, "_key"), F.col(index) == F.col("_key")).drop("_key")


def partition_graph(g: Graph, assign: DataFrame, k: int) -> PartitionedGraph:
    """Relabels nodes so that each part's ids are contiguous, and sorts edges into k * k blocks, source part first.  Further columns of nodes and edges come along."""
    placed, off = scatter_append(assign.select("id", "part"), "part", "id", k, "new_id")
    node_map = cut(placed.select(F.col("id").alias("old_id"), "new_id", "part"))  # both ends of the edges, nodes and features read it
    more = [c for c in g.nodes.columns if c not in ("id", "kind", "label", "split", "new_id", "old_id", "part")]
    nodes = g.nodes.join(node_map, F.col("id") == F.col("old_id")).select("new_id", "old_id", "part", "label", "split", *more)
    at = lambda c, p: node_map.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}"), F.col("part").alias(p))
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    edges = g.edges.join(at("src", "sp"), "src").join(at("dst", "dp"), "dst")
    edges = edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "sp", "dp", (F.col("sp") * k + F.col("dp")).alias("block"), *rest)
    features = None if g.features is None else relabel(g.features.withColumnRenamed("id", "new_id"), "new_id", node_map)
    return PartitionedGraph(nodes, edges, off, k, features, dict(g.attrs) | {"N_P": k, "E_P": k * k})


def degree(nodes: DataFrame, edges: DataFrame, by: str = "dst") -> DataFrame:
    """(id, deg); nodes without edges have 0."""
    d = edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def adjacency(edges: DataFrame, by: str = "dst") -> DataFrame:
    """(by, nbrs): each node's neighbours, ascending, duplicates kept."""
    other = "src" if by == "dst" else "dst"
    return edges.groupBy(by).agg(F.array_sort(F.collect_list(other)).alias("nbrs"))


#: Neighbours in a piece of a list, about.
PIECE = 256


def neighbour_lists(edges: DataFrame, by: str = "src", items: list[str] | None = None) -> DataFrame:
    """(by, near): each node's neighbours, or structs of ``items``, in no order; a long list comes in pieces, by hashes of its neighbours, so no row is large."""
    other = "dst" if by == "src" else "src"
    n = edges.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("_n"))
    e = edges.join(n, by).withColumn("_piece", F.pmod(F.xxhash64(other), F.col("_n")))
    return e.groupBy(by, "_piece").agg(F.collect_list(F.struct(*items) if items else F.col(other)).alias("near")).select(by, "near")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of batches sorted by ``key``, a table for each of its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = pc.run_end_encode(b.column(key)).run_ends.to_pylist()
        if held and held[-1].column(key)[0] != b.column(key)[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in ends[:-1]:
            yield pa.Table.from_batches([*held, b.slice(start, end - start)])
            held, start = [], end
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def row_pointers(nodes: DataFrame, edges: DataFrame, by: str = "dst") -> DataFrame:
    """(id, start, len) of each node's slice of the sorted edges; empty slices are kept."""
    return prefix_sum(degree(nodes, edges, by), "id", "deg", "start").select("id", "start", F.col("deg").alias("len"))


def in_ranges(df: DataFrame, pos: str, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with the ranges(start, len, ...) that hold its ``pos``: both meet over the chunk of the position, so it is an equality join."""
    last = F.floor((F.col("start") + F.col("len") - 1) / CHUNK)
    r = ranges.where("len > 0").withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), last)))
    d = df.withColumn("_chunk", F.floor(F.col(pos) / CHUNK)).alias("d")
    r = r.alias("r")
    on = (F.col("d._chunk") == F.col("r._chunk")) & (F.col(f"d.{pos}") >= F.col("r.start")) & (F.col(f"d.{pos}") < F.col("r.start") + F.col("r.len"))
    return d.join(r, on, how).select(*(F.col(f"d.`{c}`") for c in df.columns), *(F.col(f"r.`{c}`") for c in ranges.columns))


def ranges_gather(df: DataFrame, pos: str, ranges: DataFrame) -> DataFrame:
    """Rows of df whose ``pos`` lies in ranges(seq, start, len), with ``out_pos``: slices follow each other by seq."""
    r = prefix_sum(ranges.select("seq", "start", "len"), "seq", "len", "base")
    return in_ranges(df, pos, r).withColumn("out_pos", F.col("base") + F.col(pos) - F.col("start")).drop("start", "len", "base")


def ranges_add(df: DataFrame, pos: str, column: str, ranges: DataFrame) -> DataFrame:
    """df with value added to ``column`` where ``pos`` lies in one of ranges(start, len, value); others are unchanged."""
    got = in_ranges(df, pos, ranges.select("start", "len", "value"), "left")
    return got.withColumn(column, F.col(column) + F.coalesce("value", F.lit(0))).drop("start", "len", "value")


def merge_ranges(fragments: list[DataFrame], pos: str, ranges: DataFrame) -> DataFrame:
    """Grouped adjacency of slices of edge lists with positions: ranges(fragment, start, len) are cut from the fragment of that number; overlapping slices repeat their edges."""
    cut_out = [in_ranges(f.select("src", "dst", pos), pos, ranges.where(F.col("fragment") == i).select("start", "len")) for i, f in enumerate(fragments)]
    return merge_fragments(cut_out)


def merge_fragments(fragments: list[DataFrame]) -> DataFrame:
    """Grouped adjacency of the multiset union of edge lists; sources ascend within a row."""
    out = fragments[0].select("src", "dst")
    for f in fragments[1:]:
        out = out.union(f.select("src", "dst"))
    return adjacency(out)


def complement_runs(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(lo, hi): the maximal closed runs of 0 to bins - 1 that the column does not hold."""
    free = df.sparkSession.range(bins).select(F.col("id").alias("p")).join(df.select(F.col(column).cast("bigint").alias("p")).distinct(), "p", "left_anti")
    runs = free.withColumn("g", F.col("p") - F.row_number().over(Window.orderBy("p")))  # at most one row a part
    return runs.groupBy("g").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).select("lo", "hi")


def index_to_mask(nodes: DataFrame, ids: DataFrame, out: str = "mask") -> DataFrame:
    return nodes.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_in")


def mask_to_index(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.where(F.col(mask)).select("id")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def intervalize(off: DataFrame, column: str = "part", at: str = "start") -> DataFrame:
    """(column, lo, hi) from a table of offsets with one row more than there are parts."""
    w = Window.orderBy(column)  # one row a part
    return off.select(column, F.col(at).alias("lo"), F.lead(at).over(w).alias("hi")).where("hi is not null")


def block_ids(parts: list[int], k: int) -> list[int]:
    """All blocks between some parts, by source part and then target part."""
    return [p * k + q for p in parts for q in parts]


def weight_rescale(weights: DataFrame, column: str = "w") -> DataFrame:
    """Integer weights: shifted so that the least becomes the least step above it, divided by that step and rounded.

    All equal: no rows, as there is nothing to weigh.
    """
    lo = weights.agg(F.min(column)).first()[0]
    step = weights.where(F.col(column) > F.lit(lo)).agg(F.min(F.col(column) - F.lit(lo))).first()[0] if lo is not None else None
    if step is None:
        return weights.limit(0).withColumn("rescaled", F.lit(0).cast("bigint"))
    return weights.withColumn("rescaled", F.round((F.col(column) - F.lit(lo) + F.lit(step)) / F.lit(step)).cast("bigint"))


def normalise_weights(edges: DataFrame, column: str = "w") -> DataFrame:
    """Edge weights scaled to sum to the number of edges."""
    total = edges.agg(F.sum(column).alias("s"), F.count(F.lit(1)).alias("m")).first()
    return edges.withColumn(column, F.col(column) * F.lit(float(total["m"]) / float(total["s"])))


def composite_key(src: Column, dst: Column, n: int) -> Column:
    return src * n + dst
