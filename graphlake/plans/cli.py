"""Command lines for what is done once for each graph: ``python -m graphlake.plans.cli ingest | partition | check | evaluate``.

Each reads and writes directories of graphs (graphlake.sources.graphs) and prints one line of JSON.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphlake.functions.store import cut
from graphlake.operators import collate, layout, methods, metrics, scoring
from graphlake.session import session
from graphlake.sources import graphs


def ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A named graph's files become a directory with edges in order and, on request, grouped adjacency."""
    g = graphs.load(spark, a.name, a.source)
    graphs.write_graph(g, a.path, tuple(a.formats.split(",")))
    back = graphs.read_graph(spark, a.path)
    return {"nodes": back.nodes.count(), "edges": back.edges.count()}


def partition(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Partitions a directory's graph and chooses its pivots; both are written beside it."""
    g = graphs.read_graph(spark, a.path)
    where = graphs.partition_path(a.path, a.method, a.parts)
    out = {}
    if not a.pivots_only:
        assign = cut(methods.partition(g.nodes, g.edges, a.method, a.parts, a.runs, streams=a.streams, blocks=a.blocks))
        pg = layout.partition_graph(g, assign, a.parts)
        graphs.write_partitioned(pg, where)
        sizes = layout.histogram(assign, "part", a.parts).agg(F.avg("n"), F.min("n"), F.max("n")).first()
        cuts = metrics.edge_cuts(g.edges, assign).first()
        out = {"cuts": cuts["cuts"], "edges": cuts["edges"], "mean": sizes[0], "least": sizes[1], "most": sizes[2]}
    if a.pivots != "none" and (a.pivots == "train" or a.share > 0):
        pg = graphs.read_partitioned(spark, where)
        assign = pg.nodes.select(F.col("old_id").alias("id"), "part")
        ids = g.split("train") if a.pivots == "train" else scoring.pivots(g.nodes, g.edges, g.split("train"), a.share, a.steps)
        p = collate.build_pivots(pg, ids, g.edges, assign)
        graphs.write_pivots(p, graphs.partition_path(a.path, a.method, a.parts, pivots=True))
        out |= {"pivots": p.pivots.count(), "inter": p.inter.count(), "intra": p.intra.count()}
    return out


def check(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Violations of a partitioned directory's layout and of its pivots', if there are any; exit code 1 if one is found."""
    g = graphs.read_graph(spark, a.path)
    pg = graphs.read_partitioned(spark, graphs.partition_path(a.path, a.method, a.parts))
    rows = collate.check_layout(pg, g.edges, pg.nodes.select(F.col("old_id").alias("id"), "part")).collect()
    stored = graphs.partition_path(a.path, a.method, a.parts, pivots=True)
    if graphs.exists(spark, f"{stored}/pivots.parquet"):
        rows += collate.check_pivots(pg, graphs.read_pivots(spark, stored), layout.degree(g.nodes, g.edges)).collect()
    return {r["check"]: r["bad"] for r in rows}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Accuracy and loss of each split from a table of log probabilities (id, logp)."""
    g = graphs.read_graph(spark, a.path)
    scored = g.nodes.join(spark.read.parquet(a.scores).select("id", "logp"), "id").select("split", "label", "logp")
    return {r["split"]: {"n": r["n"], "acc": r["acc"], "nll": r["nll"]} for r in metrics.evaluate(scored).collect()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="graphlake", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    x = sub.add_parser("ingest", help=ingest.__doc__)
    x.add_argument("name", choices=sorted(graphs.LOADERS))
    x.add_argument("source")
    x.add_argument("path")
    x.add_argument("--formats", default="coo,csc")
    for f in (partition, check):
        x = sub.add_parser(f.__name__, help=f.__doc__)
        x.add_argument("path")
        x.add_argument("--method", default="fennel-lb", choices=methods.METHODS)
        x.add_argument("--parts", type=int, default=1024)
        if f is partition:
            x.add_argument("--runs", type=int, default=3)
            x.add_argument("--streams", default="blocks", choices=methods.STREAMS)
            x.add_argument("--blocks", type=int, default=16)
            x.add_argument("--pivots", default="topk", choices=("topk", "train", "none"))
            x.add_argument("--pivots-only", action="store_true")
            x.add_argument("--share", type=float, default=0.01)
            x.add_argument("--steps", type=int, default=3)
    x = sub.add_parser("evaluate", help=evaluate.__doc__)
    x.add_argument("path")
    x.add_argument("scores")
    a = top.parse_args(argv)
    out = {"ingest": ingest, "partition": partition, "check": check, "evaluate": evaluate}[a.what](spark or session("graphlake"), a)
    print(json.dumps(out))
    return int(a.what == "check" and any(out.values()))


if __name__ == "__main__":
    sys.exit(main())
