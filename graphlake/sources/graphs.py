"""Graphs by name, the star-schema graph, and directories of graphs.

Each named loader normalises one public layout (node and edge files in Parquet or CSV) to Graph: which way it is
symmetrised, whether it gets self-loops and how it is split are what tells them apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.hashing import spread
from graphlake.model import Graph, PartitionedGraph, Pivots
from graphlake.operators.batching import edge_order
from graphlake.operators.layout import adjacency, degree, row_pointers


#: Pairs that a task tells apart, about.
TASK_PAIRS = 500_000


def symmetrise(edges: DataFrame, dedup: bool = True) -> DataFrame:
    """Both directions of every edge; without dedup a multiset, as concatenation gives."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct() if dedup else both


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(nodes.select("id", "id")).distinct()


def split_by_hash(nodes: DataFrame, train: int, valid: int) -> DataFrame:
    """Random splits in percent by the hash of the id: the same on every run, without a global order."""
    h = spread(F.col("id")) / 65536
    at = F.floor(h) % 100
    return nodes.withColumn("split", F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test"))


def split_by_range(nodes: DataFrame, labelled: int, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """Sequential splits over ids 0 to labelled - 1; the rest have none."""
    a, b = int(labelled * train), int(labelled * (train + valid))
    return nodes.withColumn("split", F.when(F.col("id") < a, "train").when(F.col("id") < b, "valid").when(F.col("id") < labelled, "test"))


def homogenise(sizes: list[tuple[str, int]], relations: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Edges over one id space of several node types: each type is shifted by the sizes before it, each relation(src, dst) with it; both directions, as a multiset."""
    shift, at = {}, 0
    for kind, n in sizes:
        shift[kind], at = at, at + n
    out = None
    for a, b, r in relations:
        e = r.select((F.col("src") + shift[a]).alias("src"), (F.col("dst") + shift[b]).alias("dst"))
        out = e if out is None else out.union(e)
    return symmetrise(out, dedup=False)


def star_schema(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the parts that they ordered: part ids come after all customers'.

    Labels are customers' market segments in order; customers are split 60 / 20 / 20 by the last digit.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer = read("customer")
    nc = customer.count()  # from the files' footers
    names = customer.select("c_mktsegment").distinct()
    ranks = names.withColumn("label", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("int"))  # a handful of segments
    digit = F.col("c_custkey") % 10
    split = F.when(digit <= 5, "train").when(digit <= 7, "valid").otherwise("test")
    customers = customer.join(ranks, "c_mktsegment", "left").select(F.col("c_custkey").alias("id"), F.lit(0).alias("kind"), "label", split.alias("split"))
    parts = read("part").select((F.col("p_partkey") + nc).alias("id"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("split"))
    # So many parts that a task's share of the pairs does not grow with the tables.
    tasks = max(spark.sparkContext.defaultParallelism, -(-read("lineitem").count() // TASK_PAIRS))
    und = star_pairs(spark, sf_dir).repartition(tasks, "src", "dst").distinct()
    vectors = read("embeddings")
    n_vec = vectors.count()
    nodes = customers.union(parts)
    features = nodes.select("id", F.pmod("id", F.lit(max(n_vec, 1))).alias("vec_id")).join(vectors.select("vec_id", F.col("embedding").alias("x")), "vec_id").select("id", "x")
    return Graph(nodes, symmetrise(und, dedup=False), features, {"is_directed": False, "num_classes": 5, "task_type": "classification"})


def star_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src customer, dst part) of every order line; pairs repeat."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nc = read("customer").count()
    lines = read("lineitem").select("l_orderkey", "l_partkey").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + nc).alias("dst"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """root/name.parquet, or root/name.csv with a header if there is no such."""
    if not exists(spark, f"{root}/{name}.parquet") and exists(spark, f"{root}/{name}.csv"):
        return spark.read.csv(f"{root}/{name}.csv", header=True, inferSchema=True)
    return spark.read.parquet(f"{root}/{name}.parquet")


def _features(spark: SparkSession, root: str) -> DataFrame | None:
    """root/features (id, x), if there: arrays, or in CSV numbers between blanks."""
    if not any(exists(spark, f"{root}/features.{kind}") for kind in ("parquet", "csv")):
        return None
    f = _read(spark, root, "features")
    x = F.split(F.trim("x"), r"\s+") if f.schema["x"].dataType.typeName() == "string" else F.col("x")
    return f.select(F.col("id").cast("bigint").alias("id"), x.cast("array<float>").alias("x"))


def _files(spark: SparkSession, root: str, directed: bool = False, dedup: bool = True, loops: bool = False, **attrs) -> Graph:
    """root/nodes (id[, label, split]), root/edges (src, dst) and, if there, root/features (id, x), each .parquet or .csv."""
    nodes, edges = _read(spark, root, "nodes"), _read(spark, root, "edges")
    for c, kind in (("kind", "int"), ("label", "int"), ("split", "string")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    nodes = nodes.select(F.col("id").cast("bigint").alias("id"), "kind", F.when(F.isnan(F.col("label").cast("double")), None).otherwise(F.col("label")).cast("int").alias("label"), "split")
    edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    edges = edges if directed else symmetrise(edges, dedup)
    if loops:
        edges = add_self_loops(edges, nodes)
    return Graph(nodes, edges, _features(spark, root), {"is_directed": directed} | attrs)


def _resplit(split: Callable[[DataFrame], DataFrame]):
    def load(spark: SparkSession, root: str) -> Graph:
        g = _files(spark, root)
        return Graph(split(g.nodes), g.edges, g.features, g.attrs)

    return load


def _multiset_with_test(spark: SparkSession, root: str) -> Graph:
    """Citations both ways without dedup; validation doubles as test where there is none."""
    return _files(spark, root, dedup=False, test_is_valid=True)


def _range_split(spark: SparkSession, root: str) -> Graph:
    g = _files(spark, root)
    labelled = g.nodes.where("label is not null").agg(F.max("id")).first()[0]
    return Graph(split_by_range(g.nodes, 0 if labelled is None else labelled + 1), g.edges, g.features, g.attrs)


def _hetero(spark: SparkSession, root: str) -> Graph:
    """One id space from several node types.

    root/types.parquet (type, n, seq): the types' sizes in the order of their ids; root/relations.parquet (a, b, src, dst): edges
    between ids within types a and b; root/nodes.parquet (id, label, split): the last type's nodes, the only labelled ones;
    root/features.parquet ([type,] id, x), if there: with a type its ids are shifted like the edges', without one they are of the whole space.
    Its test nodes are not published: validation doubles as test.
    """
    types = spark.read.parquet(f"{root}/types.parquet")
    rows = types.orderBy("seq").collect()  # a handful
    shift, at = {}, 0
    for t in rows:
        shift[t["type"]], at = at, at + t["n"]
    last = rows[-1]["type"]
    shifts = F.create_map(*(x for k, v in shift.items() for x in (F.lit(k), F.lit(v))))
    rel = spark.read.parquet(f"{root}/relations.parquet")
    edges = rel.select((F.col("src") + F.element_at(shifts, F.col("a"))).alias("src"), (F.col("dst") + F.element_at(shifts, F.col("b"))).alias("dst"))
    labels = spark.read.parquet(f"{root}/nodes.parquet").select((F.col("id") + shift[last]).alias("id"), F.when(F.isnan(F.col("label").cast("double")), None).otherwise(F.col("label")).cast("int").alias("label"), "split")
    kind = sum(((F.col("id") >= v).cast("int") for v in list(shift.values())[1:]), F.lit(0))
    nodes = spark.range(at).join(labels, "id", "left").select("id", kind.cast("int").alias("kind"), "label", "split")
    features = _features(spark, root)
    if features is not None and "type" in (raw := _read(spark, root, "features")).columns:
        features = raw.select((F.col("id") + F.element_at(shifts, F.col("type"))).alias("id"), F.col("x").cast("array<float>").alias("x"))
    return Graph(nodes, symmetrise(edges, dedup=False), features, {"is_directed": False, "is_hetero": False, "test_is_valid": True})


#: Loader of each dataset name; each takes (spark, root).
LOADERS: dict[str, Callable[[SparkSession, str], Graph]] = {
    "arxiv": _files,
    "arxiv-r": _resplit(lambda n: split_by_hash(n, 20, 40)),
    "products": lambda s, r: _files(s, r, directed=True, is_directed=False),
    "papers100m": _files,
    "papers100m-directed": lambda s, r: _files(s, r, directed=True),
    "reddit": lambda s, r: _files(s, r, directed=True, loops=True, is_directed=False),
    "flickr": _files,
    "mag240m": _hetero,
    "mag240m-f": _hetero,
    "mag240m-c": _multiset_with_test,
    "igb-large": _range_split,
    "igb260m": _range_split,
    "star": star_schema,
}


def load(spark: SparkSession, name: str, root: str) -> Graph:
    if name not in LOADERS:
        raise ValueError(f"unknown graph {name!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, root)


def write_graph(g: Graph, path: str, formats: tuple[str, ...] = ("coo",)) -> None:
    """nodes, edges sorted by (dst, src) within ranges of dst, features if any, and the attributes; 'csc' and 'csr' store grouped adjacency, too."""
    spark = g.nodes.sparkSession
    g.nodes.write.parquet(f"{path}/nodes.parquet")
    g.edges.repartitionByRange("dst").sortWithinPartitions("dst", "src").write.parquet(f"{path}/edges.parquet")
    for f in formats:
        if f in GROUPED:
            adjacency(g.edges, GROUPED[f]).repartitionByRange(GROUPED[f]).sortWithinPartitions(GROUPED[f]).write.parquet(f"{path}/{f}.parquet")
    if g.features is not None:
        g.features.write.parquet(f"{path}/features.parquet")
    spark.createDataFrame([(json.dumps(g.attrs),)], "value string").coalesce(1).write.text(f"{path}/_attrs")


#: Formats of grouped adjacency and the end by which they group.
GROUPED = {"csc": "dst", "csr": "src"}


def read_graph(spark: SparkSession, path: str, formats: tuple[str, ...] = ("coo",)) -> Graph:
    """The graph of a directory; formats 'csc' and 'csr' add grouped adjacency in attrs: as stored, or made on demand.

    An undirected graph's csr is its csc."""
    g = _files(spark, path, directed=True)
    attrs = json.loads(spark.read.text(f"{path}/_attrs").first()[0])
    for f in formats:
        if f in GROUPED:
            if exists(spark, f"{path}/{f}.parquet"):
                attrs[f] = spark.read.parquet(f"{path}/{f}.parquet")
            elif f == "csr" and attrs.get("is_directed") is False and exists(spark, f"{path}/csc.parquet"):
                attrs[f] = spark.read.parquet(f"{path}/csc.parquet").withColumnRenamed("dst", "src")
            else:
                attrs[f] = adjacency(g.edges, by=GROUPED[f])
        elif f != "coo":
            raise ValueError(f"unknown format {f!r}")
    return Graph(g.nodes, g.edges, g.features, attrs)


def partition_path(root: str, method: str, k: int, pivots: bool = False) -> str:
    return f"{root}/{method}-P{k}" + "-pivots" * pivots


def write_partitioned(g: PartitionedGraph, path: str) -> None:
    """A directory for each part of nodes and for each source part of edges, so a batch's parts are planned from their directories alone.

    Within, edges cluster by target part, so row-group statistics skip the blocks that a batch does not need; a directory for each block
    would be k**2 of them.  Further node columns are stored with the nodes.
    """
    g.nodes.repartitionByRange("part", "new_id").sortWithinPartitions("part", "new_id").write.partitionBy("part").parquet(f"{path}/nodes.parquet")
    g.edges.repartitionByRange("sp", "dp", "dst").sortWithinPartitions("sp", "dp", "dst", "src").write.partitionBy("sp").parquet(f"{path}/edges.parquet")
    g.parts.write.parquet(f"{path}/parts.parquet")
    if g.features is not None:
        g.features.write.parquet(f"{path}/features.parquet")
    spark = g.nodes.sparkSession
    spark.createDataFrame([(json.dumps(g.attrs | {"k": g.k}),)], "value string").coalesce(1).write.text(f"{path}/_attrs")


def read_partitioned(spark: SparkSession, path: str, parts: list[int] | None = None) -> PartitionedGraph:
    """The partitioned graph, or just the nodes of some parts and the edge blocks between these; the filter reaches the scan."""
    attrs = json.loads(spark.read.text(f"{path}/_attrs").first()[0])
    nodes, edges = spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")
    if parts is not None:
        nodes = nodes.where(F.col("part").isin(parts))
        edges = edges.where(F.col("sp").isin(parts) & F.col("dp").isin(parts))
    k = attrs.pop("k")
    features = spark.read.parquet(f"{path}/features.parquet") if exists(spark, f"{path}/features.parquet") else None
    return PartitionedGraph(nodes, edges, spark.read.parquet(f"{path}/parts.parquet"), k, features, attrs)


def write_pivots(p: Pivots, path: str) -> None:
    """The pivot tables; both kinds of edges cluster by the part of their source, as a batch wants those of its parts or of all others."""
    p.pivots.repartitionByRange("part", "pvt").sortWithinPartitions("part", "pvt").write.parquet(f"{path}/pivots.parquet")
    p.inter.repartitionByRange("sp", "pvt").sortWithinPartitions("sp", "pvt", "src").write.parquet(f"{path}/inter.parquet")
    p.intra.repartitionByRange("sp", "dst").sortWithinPartitions("sp", "dst", "src").write.parquet(f"{path}/intra.parquet")


def read_pivots(spark: SparkSession, path: str, parts: list[int] | None = None) -> Pivots:
    """The pivot tables, or of the edges into pivots just those from some parts; the filter reaches the scan."""
    inter = spark.read.parquet(f"{path}/inter.parquet")
    return Pivots(spark.read.parquet(f"{path}/pivots.parquet"), inter if parts is None else inter.where(F.col("sp").isin(parts)), spark.read.parquet(f"{path}/intra.parquet"))


def export_foreign(g: Graph, path: str) -> None:
    """The layout of another system: indptr, indices (sorted by target and source), features, labels, split and conf, and each node's cache score.

    score: out-degree over in-degree, both plus 1e-8.  Tables carry positions, so each can be dumped in order."""
    pos = edge_order(g.edges.select("src", "dst"))
    row_pointers(g.nodes, g.edges).select(F.col("id").alias("pos"), F.col("start").alias("indptr")).write.parquet(f"{path}/indptr.parquet")
    pos.select("pos", F.col("src").alias("index")).write.parquet(f"{path}/indices.parquet")
    g.nodes.select("id", "label").write.parquet(f"{path}/labels.parquet")
    g.nodes.where("split is not null").select("id", "split").write.parquet(f"{path}/split.parquet")
    d = degree(g.nodes, g.edges, "src").withColumnRenamed("deg", "o").join(degree(g.nodes, g.edges, "dst"), "id")
    d.select("id", ((F.col("o") + 1e-8) / (F.col("deg") + 1e-8)).alias("score")).write.parquet(f"{path}/score.parquet")
    if g.features is not None:
        g.features.write.parquet(f"{path}/features.parquet")
    conf = {"num_nodes": g.nodes.count(), "num_edges": g.edges.count()} | {k: v for k, v in g.attrs.items() if isinstance(v, (int, float, str, bool))}
    spark = g.nodes.sparkSession
    spark.createDataFrame([(json.dumps(conf),)], "value string").coalesce(1).write.text(f"{path}/conf")
