"""Tiny goldens and invariants of the graph operators."""

import inspect
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.functions import config, user
from graphlake.model import Graph
from graphlake.operators import aggregate, batching, chain, collate, concurrent, layout, methods, metrics, multilevel, runlog, sampling, scoring, select
from graphlake.operators import partition as parting
from graphlake.plans import loaders, queries
from graphlake.sources import graphs

UND = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5)]
ASSIGN = [1, 0, 1, 0, 2, 2]


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.createDataFrame(UND + [(b, a) for a, b in UND], "src bigint, dst bigint")
    rows = [(i, 0, i % 3 if i < 5 else None, "train" if i in (0, 5) else "test") for i in range(6)]
    feats = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id bigint, x array<float>")
    return Graph(spark.createDataFrame(rows, "id bigint, kind int, label int, split string"), edges, feats, {"is_directed": False})


@pytest.fixture(scope="module")
def assign(spark):
    return spark.createDataFrame(list(enumerate(ASSIGN)), "id bigint, part int")


def col(df, c, by="id"):
    return [r[0] for r in df.orderBy(by).select(c).collect()]


def near(got, want):
    assert np.allclose(got, want, atol=1e-6), got


def test_degree_and_adjacency(g):
    assert col(layout.degree(g.nodes, g.edges), "deg") == [2, 2, 3, 2, 2, 1]
    assert [tuple(r) for r in layout.row_pointers(g.nodes, g.edges).orderBy("id").collect()] == [(0, 0, 2), (1, 2, 2), (2, 4, 3), (3, 7, 2), (4, 9, 2), (5, 11, 1)]
    assert col(layout.adjacency(g.edges), "nbrs", "dst") == [[1, 2], [0, 2], [0, 1, 3], [2, 4], [3, 5], [4]]


def test_lazy_walk(g, spark):
    start = scoring.seeds(g.nodes, spark.createDataFrame([(0,)], "id bigint"), 1.0)
    walk = scoring.lazy_walk(g.nodes, g.edges, start, 3)
    near(col(walk[1], "s"), [0.5, 0.25, 0.25, 0, 0, 0])
    near(col(walk[2], "s"), [0.354167, 0.291667, 0.3125, 0.041667, 0, 0])
    near(col(walk[3], "s"), [0.302083, 0.286458, 0.328125, 0.072917, 0.010417, 0])
    assert abs(sum(col(walk[3], "s")) - 1) < 1e-9


def test_importance(g):
    t = g.split("train")
    near(col(scoring.node_importance(g.nodes, g.edges, t, 1), "s"), [0.5, 0.125, 0.125, 0, 0.25, 0.5])
    near(col(scoring.node_importance(g.nodes, g.edges, t, 2), "s"), [0.5, 0.208333, 0.21875, 0.083333, 0.375, 0.5])
    w = {(r.src, r.dst): r.w for r in scoring.edge_importance(g.nodes, g.edges, t, 3).collect()}
    near([w[e] for e in UND], [0.177083, 0.161458, 0.088542, 0.057292, 0.114583, 0.34375])
    with pytest.raises(ValueError):
        scoring.node_importance(g.nodes, g.edges, t, 3)


def test_push(g, spark):
    """Nothing is lost, nothing is left to push, and scores come within eps * degree of exact ones."""
    alpha, eps = 0.25, 0.01
    adj = np.zeros((6, 6))
    for a, b in UND:
        adj[a, b] = adj[b, a] = 1
    deg = adj.sum(1)
    exact = np.linalg.solve(np.eye(6) - (1 - alpha) * adj / deg[None, :], alpha * np.eye(6))
    for eps in (0.01, 1e-5):
        rows = scoring.ppr(g.nodes, g.edges, g.nodes.select("id"), alpha, eps, left=True).collect()
        p, r = np.zeros((6, 6)), np.zeros((6, 6))
        for x in rows:
            p[x.seed, x.id], r[x.seed, x.id] = x.p, x.r
        assert np.allclose(alpha * p.sum(1) + r.sum(1), alpha) and (r < alpha * eps * deg).all()
        assert (p <= exact.T + 1e-9).all() and (exact.T - p <= eps * deg[None, :] + 1e-9).all()
    golden = [0.38446, 0.200642, 0.245817, 0.07041, 0.02984, 0.01119]  # pushed one at a time, eps 0.01
    assert np.allclose(p[0], golden, atol=0.02)


def test_partitioned_layout(g, assign):
    p = layout.partition_graph(g, assign, 3)
    assert col(p.nodes, "old_id", "new_id") == [1, 3, 0, 2, 4, 5]
    assert [tuple(r) for r in p.parts.orderBy("part").collect()] == [(0, 0, 2), (1, 2, 4), (2, 4, 6)]
    assert col(layout.offsets(p.edges, "block", 9), "start", "block") == [0, 0, 3, 4, 7, 9, 9, 10, 10]
    blocks = {}
    for r in p.edges.collect():
        blocks.setdefault(r.block, set()).add((r.src, r.dst))
    assert blocks == {1: {(0, 2), (0, 3), (1, 3)}, 2: {(1, 4)}, 3: {(2, 0), (3, 0), (3, 1)}, 4: {(3, 2), (2, 3)}, 6: {(4, 1)}, 8: {(5, 4), (4, 5)}}
    assert all(r.bad == 0 for r in collate.check_layout(p, g.edges, assign).collect())


def test_layout_check_finds_damage(g, assign):
    p = layout.partition_graph(g, assign, 3)
    bad = type(p)(p.nodes, p.edges.where("src <> 0"), p.parts, 3)
    assert {r.check for r in collate.check_layout(bad, g.edges, assign).where("bad > 0").collect()} == {"edge lost or changed"}


def test_cuts(g, assign):
    assert metrics.edge_cuts(g.edges, assign).first() == (8, 12)


def test_collate(g, assign, spark):
    p = layout.partition_graph(g, assign, 3)
    b = spark.createDataFrame([(0, 0, 0), (0, 2, 1)], "batch int, part int, seq int")
    assert col(collate.batch_nodes(p, b), "old_id", "local_id") == [1, 3, 4, 5]
    assert {(r.src, r.dst) for r in collate.batch_edges(p, b).collect()} == {(2, 1), (1, 2), (3, 2), (2, 3)}


def test_pivot_batches_keep_degrees(g, assign, spark):
    """In-degrees of main nodes equal those in the subgraph induced on main nodes and pivots."""
    p = layout.partition_graph(g, assign, 3)
    ids = spark.createDataFrame([(2,), (3,)], "id bigint")
    b = spark.createDataFrame([(0, 0, 0), (0, 2, 1)], "batch int, part int, seq int")
    nodes, edges = collate.collate_with_pivots(p, collate.build_pivots(p, ids, g.edges, assign), b)
    old = {r.local_id: r.old_id for r in nodes.collect()}
    main = {1, 3, 4, 5}
    got = {}
    for r in edges.collect():
        if r.dst < 4:
            got[old[r.dst]] = got.get(old[r.dst], 0) + 1
    keep = main | {2, 3}
    want = {v: sum(1 for a, c in UND + [(y, x) for x, y in UND] if c == v and a in keep) for v in main}
    assert got == want


@pytest.mark.parametrize(
    ("n", "size", "even", "split", "half", "tensor", "quirk"),
    [
        (3, 4, [3], [3], [3], [3], []),
        (8, 4, [4, 4], [4, 4], [4, 4], [4, 4], [4]),
        (10, 4, [5, 5], [4, 4, 2], [4, 4, 2], [4, 4, 2], [4, 4]),
        (11, 4, [6, 5], [4, 4, 3], [4, 4, 3], [4, 4, 3], [4, 4]),
        (17, 5, [6, 6, 5], [5, 5, 5, 2], [5, 5, 5], [5, 5, 5, 2], [5, 5, 5]),
    ],
)
def test_chunks(spark, n, size, even, split, half, tensor, quirk):
    p = F.col("id")
    df = spark.range(n).select(
        batching.even_chunk(p, n, size).alias("even"),
        batching.split_chunk(p, n, size).alias("split"),
        batching.split_chunk(p, n, size, 0.5).alias("half"),
        batching.tensor_chunk(p, n, size).alias("tensor"),
        batching.tensor_chunk(p, n, size, True, True).alias("quirk"),
    ).toPandas()
    for name, want in (("even", even), ("split", split), ("half", half), ("tensor", tensor), ("quirk", quirk)):
        assert df[name].dropna().value_counts().sort_index().tolist() == want, name


def test_even_chunks_closed_form(spark):
    def listed(n, size):
        """As many chunks as whole ones fit; chunk c gets its share of the remainder, share after share from the front."""
        k = max(n // size, 1)
        rest = n - k * size if n >= size else 0
        share = -(-rest // k)
        return [(size if n >= size else n) + max(0, min(share, rest - c * share)) for c in range(k)]

    rows = [(n, z) for n in range(1, 90, 7) for z in range(1, 30, 3)]
    df = spark.createDataFrame(rows, "n bigint, z bigint").withColumn("pos", F.explode(F.expr("sequence(0L, n - 1)")))
    for z in sorted({z for _, z in rows}):
        got = df.where(F.col("z") == z).withColumn("c", batching.even_chunk(F.col("pos"), F.col("n"), z)).groupBy("n", "c").count().toPandas()
        for n in {n for n, _ in rows}:
            assert got[got.n == n].sort_values("c")["count"].tolist() == listed(n, z), (n, z)


def test_complement_runs(spark):
    run = lambda parts, k: sorted((r.lo, r.hi) for r in layout.complement_runs(spark.createDataFrame([(p,) for p in parts], "p int"), "p", k).collect())
    assert run([0, 3, 4, 7], 8) == [(1, 2), (5, 6)]
    assert run([1], 4) == [(0, 0), (2, 3)]


def test_scatter_append_keeps_empty_bins(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 == 1, 0).when(F.col("id") % 5 == 3, 4).otherwise(F.col("id") % 5).cast("int").alias("part"))
    placed, off = layout.scatter_append(df, "part", "id", 5, "pos", chunk=64)
    rows = sorted((r.part, r.id, r.pos) for r in placed.collect())
    assert [p for *_, p in rows] == list(range(1000))
    assert [r.end - r.start for r in off.orderBy("part").collect()] == [400, 0, 200, 0, 400]


def test_weight_rescale(spark):
    run = lambda w: [r.rescaled for r in layout.weight_rescale(spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "id int, w double")).orderBy("id").collect()]
    assert run([1, 2, 4, 8]) == [1, 2, 4, 8]
    assert run([3, 3]) == []


def test_mass_distance(spark):
    df = spark.createDataFrame([(0, x) for x in (0, 0, 1, 2)], "b int, y int")
    a = metrics.label_masses(df, "y", 4, "b")
    b = metrics.label_masses(spark.createDataFrame([(x,) for x in range(4)], "y int"), "y", 4)
    assert metrics.mass_distance(a, b, "b").first().distance == 0.125


def test_stream_golden(g):
    p = parting.Fennel(k=2)
    for runs in (1, 2, 3):
        out = parting.streaming_partition(g.nodes, g.edges, type(p)(k=2, runs=runs))
        assert col(out, "part") == [0, 0, 1, 1, 1, 0]


def test_partition_methods(g):
    for m in methods.METHODS:
        parts = col(methods.partition(g.nodes, g.edges, m, 2, 1, blocks=2), "part")
        assert len(parts) == 6 and set(parts) <= {0, 1}, m
    with pytest.raises(ValueError):
        methods.partition(g.nodes, g.edges, "other", 2)


def test_stream_respects_caps():
    r = np.random.default_rng(0)
    n, m, k = 300, 2000, 8
    a, b = r.integers(0, n, m), r.integers(0, n, m)
    src, dst = np.r_[a, b], np.r_[b, a]
    o = np.argsort(dst, kind="stable")
    ptr = np.r_[0, np.cumsum(np.bincount(dst, minlength=n))]
    balance = (np.arange(n) % 3 == 0).astype(int)
    part = parting.stream(ptr, src[o], np.arange(n), parting.Fennel(k=k), balance=balance)
    assert part.min() >= 0 and part.max() < k
    assert np.bincount(part, minlength=k).max() <= int(n / k * 1.1) + 1
    cut = lambda x: int((x[src] != x[dst]).sum())
    assert cut(part) < cut(r.integers(0, k, n))


def test_training_nodes_are_balanced(spark):
    """All training nodes are one clique of two, which a partitioner of few cuts puts into one part."""
    nodes = spark.createDataFrame([(i, 0, "train" if i < 40 else None) for i in range(120)], "id bigint, label int, split string")
    pairs = [(i, j) for i in range(120) for j in range(120) if i != j and (i < 40) == (j < 40)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")

    def most(parts):
        return parts.join(nodes.where("split = 'train'"), "id").groupBy("part").count().agg(F.max("count")).first()[0]

    for m in ("metis-tb", "metis-wtb"):
        out = methods.partition(nodes, edges, m, 4)
        assert out.count() == 120 and most(out) <= 11, m
    skew = nodes.select("id", F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 4).cast("int").alias("part"))
    marked = nodes.withColumn("b", F.coalesce(F.col("split") == "train", F.lit(False)).cast("int"))
    out = parting.superstep_partition(marked, edges, parting.Fennel(k=4), 2, skew, balance="b")
    assert most(out) <= 11 and out.groupBy("part").count().agg(F.max("count")).first()[0] <= 34


def clustered(spark, n=400, groups=4):
    """A graph of dense groups whose ids are mixed."""
    r = np.random.default_rng(1)
    home = r.integers(0, groups, n)
    a, b = r.integers(0, n, (2, 30_000))
    keep = (a != b) & ((home[a] == home[b]) | (r.random(30_000) < 0.05))
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a[keep], b[keep], strict=True)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i, int(home[i] % 3), "train" if i % 4 == 0 else None) for i in range(n)], "id bigint, label int, split string")
    return nodes, graphs.symmetrise(edges)


def test_superstep_improves_and_keeps_room(spark):
    nodes, edges = clustered(spark)
    first = parting.hash_partition(nodes, 4)
    out = parting.superstep_partition(nodes, edges, parting.Fennel(k=4), 4)
    assert metrics.edge_cuts(edges, out).first().cuts < 0.9 * metrics.edge_cuts(edges, first).first().cuts
    assert out.count() == 400 and out.groupBy("part").count().agg(F.max("count")).first()[0] <= 110


def test_block_streaming(spark):
    """Blocks of the stream: every node once, no part over its capacity, nor over any class's, and fewer cuts than by hash."""
    nodes, edges = clustered(spark)
    first = metrics.edge_cuts(edges, parting.hash_partition(nodes, 4)).first().cuts
    out = parting.block_streaming_partition(nodes, edges, parting.Fennel(k=4, runs=2), blocks=5)
    parts = col(out, "part")
    assert col(out, "id") == list(range(400)) and max(parts.count(p) for p in range(4)) <= 110 and set(parts) == set(range(4))
    cuts = metrics.edge_cuts(edges, out).first().cuts
    assert cuts < 0.8 * first
    again = parting.block_streaming_partition(nodes, edges, parting.Fennel(k=4), blocks=3, order="id", start=out)
    assert metrics.edge_cuts(edges, again).first().cuts <= 1.1 * cuts
    lb = methods.partition(nodes, edges, "fennel-lb", 4, 1, blocks=3).join(nodes, "id")
    assert lb.count() == 400 and lb.where("split = 'train'").groupBy("part").count().agg(F.max("count")).first()[0] <= 27


def grid(spark, side):
    """A square grid, ids mixed."""
    mix = lambda i: (i * 7919) % 10_007
    pairs = [(mix(x * side + y), mix(x * side + y + d)) for x in range(side) for y in range(side) for d in (1, side) if (y + 1 < side if d == 1 else x + 1 < side)]
    nodes = spark.createDataFrame([(mix(i),) for i in range(side * side)], "id bigint")
    return nodes, graphs.symmetrise(spark.createDataFrame(pairs, "src bigint, dst bigint"))


def test_matching_and_contraction(spark):
    """Handshakes join disjoint pairs along edges, heavy ones first, within the weight allowed; contraction keeps all weight but that within."""
    edges = graphs.symmetrise(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (5, 5)], "src bigint, dst bigint"))
    edges = edges.withColumn("w", F.when(F.least("src", "dst") == 1, 5.0).otherwise(1.0))
    nodes = spark.createDataFrame([(i, 1.0 + (i == 4) * 9) for i in range(7)], "id bigint, w double")
    mates = multilevel.matching(nodes, edges, 3.0)
    assert dict(map(tuple, mates.collect())) == {1: 2, 2: 1}  # 0, 3: no free neighbour or one too heavy
    v, e, up = multilevel.contract(nodes, edges, mates)
    assert sorted(map(tuple, v.collect())) == [(0, 1.0), (1, 2.0), (3, 1.0), (4, 10.0), (5, 1.0), (6, 1.0)]
    assert sorted(map(tuple, e.collect())) == [(0, 1, 1.0), (1, 0, 1.0), (1, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)]
    nodes, edges = grid(spark, 20)
    pairs = dict(map(tuple, multilevel.matching(nodes.withColumn("w", F.lit(1.0)), edges.withColumn("w", F.lit(1.0))).collect()))
    near = {tuple(x) for x in edges.select("src", "dst").collect()}
    assert all(pairs[b] == a and (a, b) in near for a, b in pairs.items()) and len(pairs) > 300


def test_multilevel_cuts_fewer_edges_than_supersteps(spark):
    nodes, edges = grid(spark, 32)
    flat = metrics.edge_cuts(edges, parting.superstep_partition(nodes, edges, parting.Fennel(k=4))).first().cuts
    out = multilevel.multilevel_partition(nodes, edges, parting.Fennel(k=4), coarsest=100)
    assert metrics.edge_cuts(edges, out).first().cuts < 0.5 * flat
    assert sorted(col(out, "id")) == sorted(col(nodes, "id")) and out.groupBy("part").count().agg(F.max("count")).first()[0] <= 281
    alone = multilevel.multilevel_partition(nodes, edges.limit(0), parting.Fennel(k=4), coarsest=100)  # nothing to match, and no start in one task
    assert alone.count() == 1024 and alone.groupBy("part").count().agg(F.max("count")).first()[0] <= 281


@pytest.mark.parametrize(("shards", "rounds", "slack"), [(8, 8, 1.1), (3, 2, 1.0), (16, 1, 1.1)])
def test_concurrent_streams(spark, shards, rounds, slack):
    """Stale sizes cost little: cuts within a tenth of one stream's, every node placed, no part overfilled."""
    nodes, edges = clustered(spark)
    p = parting.Fennel(k=4, slack=slack)
    one = metrics.edge_cuts(edges, parting.streaming_partition(nodes, edges, p)).first().cuts
    out = concurrent.concurrent_partition(nodes, edges, type(p)(k=4, slack=slack, runs=2), shards, rounds)
    assert col(out, "id") == list(range(400)) and out.groupBy("part").count().agg(F.max("count")).first()[0] <= int(100 * slack)
    if rounds == 8:
        assert metrics.edge_cuts(edges, out).first().cuts <= 1.1 * one
    again = concurrent.concurrent_partition(nodes, edges, p, shards, rounds, "id", out)
    assert again.count() == 400


def test_chain(spark, monkeypatch):
    """A chain gives what its functions give, steps and DataFrame's own methods mixed; taken and private names are refused."""
    monkeypatch.setattr(chain, "STEPS", dict(chain.STEPS))
    df = spark.range(150)

    @chain.step("doubled")
    def doubled(rows, column, times=2):
        return rows.withColumn(column, F.col(column) * times)

    c = chain.chain(df).doubled("id", times=3).shuffle(seed=4)
    plain = batching.shuffle(doubled(df, "id", 3), "id", 0, 4)
    lists = c.batch("pos", "id", 40, drop_last=True)
    assert sorted(lists.collect()) == sorted(batching.batch_rows(plain, "pos", "id", 40, True).collect())
    assert lists.unbatch().count() == 120 and lists.columns == ["batch", "items"]
    assert [r["count"] for r in c.split_evenly(70).groupBy("chunk").count().orderBy("chunk").collect()] == [75, 75]
    assert c.zip(chain.chain(df).shuffle().select("pos", F.col("id").alias("b"))).repeats(2).count() == 300
    assert chain.chain(df.limit(0)).shuffle().split(8).count() == 0
    assert "pos: bigint" in repr(c) and {"doubled", "where"} <= set(dir(c))
    for name in ("doubled", "where", "table", "_own", "no name"):
        with pytest.raises(ValueError, match="cannot name a step"):
            chain.step(name)(doubled)
    chain.step("doubled", replace=True)(lambda rows: rows)
    assert chain.chain(df).doubled().table is not None
    with pytest.raises(AttributeError):
        chain.chain(df).unknown_step()


def test_first_rows(spark):
    """Against sorting: ties, groups, extremes of 64 bits, more rows asked for than there are."""
    r = np.random.default_rng(4)
    rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(r.integers(0, 3, 3000), r.integers(0, 40, 3000) ** 3, strict=True))]
    rows += [(1, 5000, 2**63 - 1), (1, 5001, -(2**63) + 1), (2, 5002, None), (None, 5003, 1), (7, 5004, 0)]
    df = spark.createDataFrame(rows, "g int, id bigint, v bigint")
    for few in (select.FEW, 10):
        for k in (0, 1, 137, 2999, 4000):
            want = sorted((x for x in rows if x[2] is not None), key=lambda x: (-x[2], x[1]))[:k]
            assert sorted(map(repr, map(tuple, select.first_rows(df, F.col("v"), k, few=few).collect()))) == sorted(map(repr, want))
        each = {0: 5, 1: 800, 2: 10_000, 7: 1}
        want = [x for g, k in each.items() for x in sorted((x for x in rows if x[0] == g and x[2] is not None), key=lambda x: (-x[2], x[1]))[:k]]
        got = select.first_rows(df, F.col("v"), spark.createDataFrame([*each.items(), (9, 3)], "g int, k int"), by="g", few=few)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert select.first_rows(df.limit(0), F.col("v"), 3).count() == 0


def test_limits_name_the_way_out(g, monkeypatch):
    monkeypatch.setattr(parting, "EDGE_LIMIT", 5)
    with pytest.raises(ValueError, match="block_streaming"):
        parting.streaming_partition(g.nodes, g.edges)
    with pytest.raises(ValueError, match="stream"):
        methods.partition(g.nodes, g.edges, "fennel-lb", 2, streams="concurrent")
    assert methods.partition(g.nodes, g.edges, "fennel", 2, 1, blocks=2).count() == 6


def test_number_in_ranges(spark):
    """Positions follow the key whatever the prefixes are, within groups and in all."""
    df = spark.range(500).select("id", (F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g"))
    for levels in ((2, 4), (16,), (13, 14, 15)):
        out = batching.number(df, batching.hex_id(F.col("k")), "pos", levels=levels).collect()
        assert all(r.pos == r.k for r in out)
        by = {}
        for r in batching.number(df, batching.hex_id(F.col("k")), "pos", ["g"], levels).collect():
            by.setdefault(r.g, []).append((r.k, r.pos))
        assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in by.values())


def test_repeats(spark):
    df = spark.range(3)
    assert batching.repeats(df, 0).count() == 0 and batching.repeats(df, 2).count() == 6


def test_ranges_without_loops(spark):
    df = spark.range(300_000).select(F.col("id").alias("pos"))
    r = spark.createDataFrame([(0, 10, 3), (1, 65_530, 20), (2, 5, 0), (3, 11, 1)], "seq int, start bigint, len bigint")
    out = layout.ranges_gather(df, "pos", r)
    assert [r.pos for r in out.orderBy("out_pos").collect()] == [10, 11, 12, *range(65_530, 65_550), 11]
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_lossy_batches(spark):
    nodes = spark.createDataFrame([(0, min(i // 10, 2), i) for i in range(60)], "batch int, hop int, id bigint")
    kept = sampling.drop_far(nodes, 1, 0.25)
    assert kept.count() == 50 and kept.where("hop < 2").count() == 20 and sampling.drop_far(nodes, 1).count() == 20
    scores = spark.createDataFrame([(0, i, float(i < 20)) for i in range(60)], "batch int, id bigint, s double")
    assert tuple(sampling.retained(nodes, sampling.drop_far(nodes, 1), scores).first()) == (0, 60, 20, 1.0)
    assert tuple(sampling.retained(nodes, nodes.where("hop = 0"), scores).first()) == (0, 60, 10, 0.5)


def test_sampling(g, spark):
    seeds = spark.createDataFrame([(0, 2), (1, 5)], "batch bigint, id bigint")
    nodes, edges = sampling.sample(g.edges, seeds, [2, -1], 3)
    rows = edges.collect()
    assert max(edges.where("hop = 0").groupBy("batch", "dst").count().toPandas()["count"]) <= 2
    real = {(a, b) for a, b in UND} | {(b, a) for a, b in UND}
    assert {(r.src, r.dst) for r in rows} <= real
    assert nodes.count() == nodes.select("batch", "id").distinct().count()
    assert sampling.sample(g.edges, seeds, [2, -1], 3)[1].exceptAll(edges).count() == 0


def test_aggregation_and_models(g):
    x = np.array([[i, 1.0] for i in range(6)])
    adj = np.zeros((6, 6))
    for a, b in UND:
        adj[a, b] = adj[b, a] = 1
    deg = adj.sum(1)
    near(np.array(col(aggregate.neighbour_mean(g.edges, g.features), "x")), adj @ x / deg[:, None])
    w1, w2, b = np.random.default_rng(0).standard_normal((2, 3)), np.random.default_rng(1).standard_normal((2, 3)), np.arange(3.0)
    near(np.array(col(aggregate.sage(g.edges, g.features, [(w1, w2, b)]), "x")), x @ w1 + adj @ x / deg[:, None] @ w2 + b)
    near(np.array(col(aggregate.gin(g.edges, g.features, [(0.5, w1, b)]), "x")), (1.5 * x + adj @ x) @ w1 + b)
    hat = adj + np.eye(6)
    norm = hat / np.sqrt(np.outer(hat.sum(1), hat.sum(1)))
    near(np.array(col(aggregate.gcn(g.edges, g.features, [(w1, b)]), "x")), norm @ x @ w1 + b)
    h = x @ w1
    e = (h @ [1, 0, 0.5])[None, :] + (h @ [0.2, 1, 0])[:, None]
    e = np.where(hat > 0, np.where(e > 0, e, 0.2 * e), -np.inf)
    a = np.exp(e - e.max(1, keepdims=True))
    one = a / a.sum(1, keepdims=True) @ h
    near(np.array(col(aggregate.gat(g.edges, g.features, [(w1, [1, 0, 0.5], [0.2, 1, 0])]), "x")), one)
    head = (w1, [1, 0, 0.5], [0.2, 1, 0])
    near(np.array(col(aggregate.gat(g.edges, g.features, [[head, head]]), "x")), one)
    wide = aggregate.gat(g.edges, g.features, [[head, head], (np.vstack((np.eye(3), np.zeros((3, 3)))), [0] * 3, [0] * 3)])
    elu = np.where(one > 0, one, np.expm1(one))
    near(np.array(col(wide, "x")), hat / hat.sum(1, keepdims=True) @ elu)
    # Two relations; one target has no edge of the second.
    rel = g.edges.withColumn("rel", (F.col("src") > F.col("dst")).cast("int"))
    own, bias = w2, np.ones(3)
    want = x @ own + bias
    for k in (0, 1):
        mask = np.array([[adj[v, u] * ((u > v) == bool(k)) for u in range(6)] for v in range(6)])
        s = (h @ [1, 0, 0.5])[None, :] + (h @ [0.2, 1, 0])[:, None]
        s = np.where(mask > 0, np.exp(np.where(s > 0, s, 0.2 * s)), 0)
        want = want + np.divide(s, s.sum(1, keepdims=True), out=np.zeros_like(s), where=s.sum(1, keepdims=True) > 0) @ h
    near(np.array(col(aggregate.rgat(rel, g.features, [({0: head, 1: head}, own, bias)]), "x")), want)
    even = aggregate.edge_norm(g.edges.withColumn("cut", F.lit(False)))
    near(np.array(col(aggregate.weighted_sage(even, g.features, [(w1, w2, b)]), "x")), x @ w1 + adj @ x / deg[:, None] @ w2 + b)


def test_residual_inception(g):
    x = np.array([[i, 1.0] for i in range(6)])
    adj = np.zeros((6, 6))
    for a, b in UND:
        adj[a, b] = adj[b, a] = 1
    mean = adj / adj.sum(1)[:, None]
    r = np.random.default_rng(3)
    w = lambda *shape: r.standard_normal(shape) / 4
    one, skip = (w(2, 3), w(2, 3), w(3)), (w(2, 3), w(3))
    stats = (w(3), np.abs(w(3)) + 0.5, w(3), w(3))
    two = (w(3, 3), w(3, 3), np.zeros(3))
    (own, near_w), bias = aggregate.fold_norm([two[0], two[1]], two[2], *stats)
    head = [(w(8, 4), None), (w(4, 2), w(2))]
    leaky = lambda v: np.where(v > 0, v, 0.01 * v)
    y1 = leaky(x @ one[0] + mean @ x @ one[1] + one[2])
    x1 = y1 + x @ skip[0] + skip[1]
    raw = x1 @ two[0] + mean @ x1 @ two[1]
    y2 = leaky((raw - stats[0]) / np.sqrt(stats[1] + 1e-5) * stats[2] + stats[3])
    z = np.hstack((x, y1, y2)) @ head[0][0] @ head[1][0] + head[1][1]
    got = aggregate.sage_ri(g.edges, g.features, [(*one, skip), (own, near_w, bias, None)], head)
    near(np.array(col(got, "x")), z - np.log(np.exp(z).sum(1, keepdims=True)))


def test_loaders(g, assign):
    e = loaders.node_loader(g, [-1, -1], 1)
    assert {(r["id"], r["hop"]) for r in e.nodes.where("hop < 2").collect()} >= {(0, 0), (5, 0), (1, 1), (2, 1), (4, 1)}
    assert e.features.count() == e.nodes.count()
    h = loaders.hierarchical_loader(g, assign, 1, [-1], 1)
    home = dict(enumerate(ASSIGN))
    took = [(r["src"], r["dst"]) for r in h.edges.collect()]
    assert sorted(took) == [(2, 0), (4, 5)] and all(home[a] == home[b] for a, b in took)
    pg = layout.partition_graph(g, assign, 3)
    p = loaders.partition_loader(pg, 3)
    assert p.nodes.count() == 6 and p.edges.count() == 12 and p.features.count() == 6


def test_command_line(g, spark, tmp_path, capsys):
    from graphlake.plans import cli

    graphs.write_graph(g, f"{tmp_path}/raw")
    path = f"{tmp_path}/g"
    run = lambda *a: (cli.main(list(a), spark), __import__("json").loads(capsys.readouterr().out))
    assert run("ingest", "arxiv", f"{tmp_path}/raw", path) == (0, {"nodes": 6, "edges": 12})
    code, out = run("partition", path, "--method", "fennel", "--blocks", "2", "--parts", "2", "--share", "0.4", "--steps", "1")
    assert code == 0 and out["edges"] == 12 and out["pivots"] == 2 and out["most"] == 3
    code, out = run("check", path, "--method", "fennel", "--parts", "2")
    assert code == 0 and len(out) == 10
    spark.createDataFrame([(i, [0.0, -9.0, -9.0]) for i in range(6)], "id bigint, logp array<double>").write.parquet(f"{tmp_path}/scores")
    code, out = run("evaluate", path, f"{tmp_path}/scores")
    assert out["train"] == {"n": 1, "acc": 1.0, "nll": 0.0} and out["test"]["n"] == 4


def test_pivot_store(g, assign, spark, tmp_path):
    p = layout.partition_graph(g, assign, 3)
    pivots = collate.build_pivots(p, spark.createDataFrame([(2,), (3,)], "id bigint"), g.edges, assign)
    path = graphs.partition_path(str(tmp_path), "rand", 3, pivots=True)
    graphs.write_pivots(pivots, path)
    back = graphs.read_pivots(spark, path)
    for a, b in ((pivots.pivots, back.pivots), (pivots.inter, back.inter), (pivots.intra, back.intra)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    some = graphs.read_pivots(spark, path, [0])
    assert {r.sp for r in some.inter.collect()} == {0}
    assert "EqualTo(sp,0)" in some.inter._jdf.queryExecution().executedPlan().toString()
    degrees = layout.degree(g.nodes, g.edges)
    assert all(r.bad == 0 for r in collate.check_pivots(p, back, degrees).collect())
    worse = type(back)(back.pivots, back.inter.where("src <> 0"), back.intra)
    assert {r.check for r in collate.check_pivots(p, worse, degrees).where("bad > 0").collect()} == {"in-degree of a pivot differs from the graph's"}


def test_csv_and_stored_adjacency(g, spark, tmp_path):
    g.nodes.select("id", "label", "split").coalesce(1).write.csv(f"{tmp_path}/c/nodes.csv", header=True)
    g.edges.coalesce(1).write.csv(f"{tmp_path}/c/edges.csv", header=True)
    g.features.select("id", F.array_join("x", " ").alias("x")).coalesce(1).write.csv(f"{tmp_path}/c/features.csv", header=True)
    c = graphs.load(spark, "products", f"{tmp_path}/c")
    assert c.edges.exceptAll(g.edges).count() == 0 and c.features.exceptAll(g.features).count() == 0 and c.nodes.where("label is null").count() == 1
    graphs.write_graph(g, f"{tmp_path}/g", ("coo", "csc"))
    back = graphs.read_graph(spark, f"{tmp_path}/g", ("csc", "csr"))
    want = layout.adjacency(g.edges)
    assert back.attrs["csc"].exceptAll(want).count() == 0 and back.attrs["csr"].columns == ["src", "nbrs"]
    assert "csc.parquet" in back.attrs["csr"].inputFiles()[0]  # undirected: the stored one serves for both
    graphs.export_foreign(g, f"{tmp_path}/x")
    ptr, idx = ([r[1] for r in spark.read.parquet(f"{tmp_path}/x/{n}.parquet").orderBy("pos").select("pos", v).collect()] for n, v in (("indptr", "indptr"), ("indices", "index")))
    assert ptr == [0, 2, 4, 7, 9, 11] and idx == [1, 2, 0, 2, 0, 1, 3, 2, 4, 3, 5, 4]


def test_scratch_is_shared(spark):
    from types import SimpleNamespace

    from graphlake.functions import store

    conf = SimpleNamespace(get=lambda *a: None)
    ctx = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(SimpleNamespace(conf=conf, sparkContext=ctx))
    ctx.master = "local[4]"
    assert store.shared_folder(SimpleNamespace(conf=conf, sparkContext=ctx)) == store.DEFAULT


def test_graph_round_trip(g, assign, spark, tmp_path):
    graphs.write_graph(g, f"{tmp_path}/g")
    back = graphs.read_graph(spark, f"{tmp_path}/g", ("coo", "csc"))
    assert back.edges.exceptAll(g.edges).count() == 0 and back.edges.count() == 12
    assert back.attrs["csc"].count() == 6 and back.features.count() == 6
    p = layout.partition_graph(g, assign, 3)
    graphs.write_partitioned(p, f"{tmp_path}/p")
    some = graphs.read_partitioned(spark, f"{tmp_path}/p", [0, 2])
    assert {r.block for r in some.edges.collect()} == {2, 6, 8} and some.k == 3
    plan = some.edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [sp" in plan.replace("(sp", "sp") and "PushedFilters: [In(dp" in plan
    assert graphs.load(spark, "arxiv", f"{tmp_path}/g").edges.count() == 12
    with pytest.raises(ValueError):
        graphs.load(spark, "other", "")


def test_typed_graph(spark, tmp_path):
    spark.createDataFrame([("author", 3, 0), ("place", 2, 1), ("paper", 4, 2)], "type string, n bigint, seq int").write.parquet(f"{tmp_path}/types.parquet")
    spark.createDataFrame([("author", "place", 2, 1), ("author", "paper", 0, 3), ("paper", "paper", 1, 2)], "a string, b string, src bigint, dst bigint").write.parquet(f"{tmp_path}/relations.parquet")
    spark.createDataFrame([(0, 7.0, "train"), (1, float("nan"), "test")], "id bigint, label double, split string").write.parquet(f"{tmp_path}/nodes.parquet")
    t = graphs.load(spark, "mag240m", str(tmp_path))
    assert sorted(map(tuple, t.edges.collect())) == [(0, 8), (2, 4), (4, 2), (6, 7), (7, 6), (8, 0)]
    assert [tuple(r) for r in t.nodes.orderBy("id").collect()][4:7] == [(4, 1, None, None), (5, 2, 7, "train"), (6, 2, None, "test")]
    assert t.nodes.count() == 9 and t.features is None
    spark.createDataFrame([("author", 2, [1.0]), ("paper", 1, [2.0])], "type string, id bigint, x array<float>").write.parquet(f"{tmp_path}/features.parquet")
    assert sorted((r.id, r.x) for r in graphs.load(spark, "mag240m-f", str(tmp_path)).features.collect()) == [(2, [1.0]), (6, [2.0])]


def test_validation_doubles_as_test(g):
    
    assert col(g.split("test"), "id") == [1, 2, 3, 4]
    assert g.split("valid").count() == 0 == replace(g, attrs={"test_is_valid": True}).split("test").count()


def test_run_log(spark, tmp_path):
    rows = [(0, "val/acc", 0, 0.5), (0, "val/acc", 1, 0.7), (0, "val/acc", 2, 0.7), (0, "test/acc", 1, 0.6), (1, "val/acc", 0, 0.9), (1, "test/acc", 0, 0.8)]
    log = spark.createDataFrame(rows, "run int, label string, iter int, value double")
    best = runlog.best_epoch(log)
    assert sorted(map(tuple, best.collect())) == [(0, 1, 0.7, 0.6), (1, 0, 0.9, 0.8)]
    assert runlog.best_epoch(log, 1).where("run = 0").first().iter == 1 and runlog.best_epoch(log, 0).where("run = 0").first().iter == 0
    m = runlog.mean_and_std(best).first()
    assert abs(m.val_mean - 80) < 1e-9 and abs(m.test_std - 14.142136) < 1e-6
    key = runlog.append(log, f"{tmp_path}/log", {"P": 4})
    assert spark.read.parquet(f"{tmp_path}/log").where(F.col("config") == key).count() == 6


def test_config():
    text = """{a: "x,]", 'b': "x, b: c", "c//d": 'it"s \\'q\\' /* no */', /* yes */ d: [+1, .5, 5., 0x1F, -0xa, 1e3, Infinity,], $e: true, f: 'a\\\nb\\u00e9\\x41'}"""
    assert config.parse(text) == {"a": "x,]", "b": "x, b: c", "c//d": "it\"s 'q' /* no */", "d": [1, 0.5, 5.0, 31, -10, 1000.0, float("inf")], "$e": True, "f": "abéA"}
    for bad in ("{a: 1,,}", "[,]", "{a: b}", '{"a" 1}', "{a: 'x}"):
        with pytest.raises(ValueError):
            config.parse(bad)
    c = config.parse("{a: 1, // one\n 'b': [1, 2,], \"u\": \"http://x\", }")
    assert c == {"a": 1, "b": [1, 2], "u": "http://x"}
    assert config.merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3, "x": None}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert [x["k"] for x in config.expand({"k": [1, 2], "m": [5]}, ("k", "m"))] == [1, 2]
    with pytest.raises(ValueError):
        config.expand({"k": [1, 2], "m": [1, 2, 3]}, ("k", "m"))
    assert config.flatten({"a": {"b": 1}, "c": 2}) == {"a/b": 1, "c": 2}


def test_sampling_with_replacement(spark):
    """Draws are positions of the target's list: as many as asked for, whatever the degree, and edge ids name the edges."""
    pairs = [(s, d) for d, n in ((0, 1), (1, 3), (2, 50)) for s in range(100, 100 + n)] + [(0, 100), (1, 101)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    placed, lists = sampling.positioned(edges)
    order = sorted(pairs, key=lambda e: (e[1], e[0]))
    assert [(r.src, r.dst) for r in placed.orderBy("eid").collect()] == order
    seeds = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2), (1, 77)], "batch int, id bigint")
    nodes, got = sampling.sample(placed, seeds, [20, -1], 5, replace=True, lists=lists)
    rows = got.collect()
    assert all(order[r.eid] == (r.src, r.dst) for r in rows)
    first = [r for r in rows if r.hop == 0]
    count = lambda b, d: sum(r.batch == b and r.dst == d for r in first)
    assert (count(0, 0), count(0, 1), count(0, 2), count(1, 2), count(1, 77)) == (20, 20, 20, 20, 0)
    assert len({r.src for r in first if r.dst == 2}) > 8 and {r.src for r in first if r.dst == 1} == {100, 101, 102}
    assert sorted((r.batch, r.src) for r in first if r.dst == 2 and r.batch == 0) == sorted((0, r.src) for r in first if r.dst == 2 and r.batch == 1)  # as in any batch
    assert {(r.src, r.dst) for r in rows if r.hop == 1} <= {(0, 100), (1, 101)}
    both = {(r.batch, r.src, r.dst) for r in sampling.induced_batches(nodes, edges).collect()}
    inside = {b: {r.id for r in nodes.where(F.col("batch") == b).collect()} for b in (0, 1)}
    assert both == {(b, s, d) for b in (0, 1) for s, d in pairs if s in inside[b] and d in inside[b]}
    with pytest.raises(ValueError):
        sampling.sample(edges, seeds, [1], replace=True)


def test_drop_hop_takes_near_nodes_last(spark):
    nodes = spark.createDataFrame([(0, h, h * 100 + i) for h, n in ((0, 5), (1, 10), (2, 20)) for i in range(n)], "batch int, hop int, id bigint")
    for share, left in ((0.0, (5, 10, 20)), (0.5, (5, 10, 5)), (0.8, (5, 6, 0)), (1.0, (5, 0, 0))):
        hops = [r.hop for r in sampling.drop_hop(nodes, 1, share).collect()]
        assert tuple(hops.count(h) for h in range(3)) == left
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 203, 5.0), (0, 100, 2.0), (9, 1, 3.0)], "batch int, id bigint, s double")
    assert sorted(r.id for r in sampling.drop_by_influence(nodes, scores, 32 / 30 * 0.9).collect())[:1] == [0]
    kept = sampling.drop_by_influence(nodes, scores, 1.0).collect()  # five are left: the three with scores, then the least ids
    assert sorted(r.id for r in kept) == [0, 1, 2, 100, 203]


def test_influence_of_each_batch_is_its_own(spark):
    """A batch's walk uses its own edges only, from targets to sources."""
    nodes = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 2, 4), (1, 0, 1), (1, 1, 2)], "batch int, hop int, id bigint")
    edges = spark.createDataFrame([(0, 2, 1), (0, 3, 1), (0, 4, 2), (0, 1, 2), (1, 2, 1)], "batch int, src bigint, dst bigint")
    got = {(r.batch, r.layers): (r.top, r.near, r.top_sum, r.all_sum) for r in sampling.influence_by_layers(nodes, edges, 3, times=2).collect()}
    # Batch 0: 2 and 3 get 1/2; from 2 go 1/4 to 4 and to 1; then 1/8 to 2 and 3.  The two greatest are 2 and 3.
    assert got == {(0, 2): (2, 2, 1.0, 1.25), (0, 3): (2, 2, 1.25, 1.5), (1, 2): (1, 1, 1.0, 1.0), (1, 3): (1, 1, 1.0, 1.0)}


def test_block_sums(spark):
    """Sums by blocks equal sums by edges, also where a block is dealt to several tasks."""
    nodes, edges = clustered(spark)
    edges = edges.withColumn("w", (F.col("src") % 3 + 1).cast("double"))
    x = nodes.where("id <> 5").select("id", F.array(*((F.col("id") * (i + 1) % 7).cast("double") for i in range(3))).alias("x"))
    g = layout.partition_graph(Graph(nodes.withColumn("kind", F.lit(0)), edges, x), parting.hash_partition(nodes, 4), 4)
    want = {r.id: (r.n, r.total, r.sums) for r in aggregate.neighbour_sums(edges, x, "w").collect()}
    for most in (10**6, 100):
        got = aggregate.block_sums(g, "w", most).join(g.nodes.select(F.col("new_id").alias("id"), "old_id"), "id")
        assert {r.old_id: (r.n, r.total, r.sums) for r in got.collect()} == want


def test_run_store(spark, tmp_path):
    """Configurations of unlike shape in one table; filters are paths, by value and by type."""
    configs = ['{"a": {"b": 1, "c": [2, 3]}, "m": "x"}', '{"a": {"b": "1", "c": [2, 3]}, "m": "x"}', '{"a": {"b": 1.0, "c": [2, 3, 4]}, "m": "x", "z": null}', '{"a": 5, "m": "x"}', '{"m": "it\\"s"}']
    runs = runlog.with_configs(spark.createDataFrame([(i, i, c) for i, c in enumerate(configs)], "run int, at int, config string"))
    log = spark.createDataFrame([(i, l, e, i + e / 10) for i in range(5) for l in ("val/acc", "test/acc") for e in range(3)], "run int, label string, iter int, value double")
    runlog.write_store(log, runs, f"{tmp_path}/s")
    take = lambda f, *at: sorted(r.run for r in runlog.read_store(spark, f"{tmp_path}/s", f, *at)[1].collect())
    assert take({"a": {"b": 1}}) == [0, 2] and take({"a": {"b": "1"}}) == [1] and take({"a": {"c": [2, 3]}}) == [0, 1, 2] and take({"a": {"c": [2, 3, 4]}}) == [2]
    assert take({"m": 'it"s'}) == [4] and take({"a": 5}) == [3] and take({"q": 1}) == [] and take({}, 1, 3) == [1, 2] and take({"m": "x"}, 3) == [3]
    assert runlog.read_store(spark, f"{tmp_path}/s", {"a": 5})[0].count() == 6
    assert [r.iter for r in runlog.best_epoch(runlog.read_store(spark, f"{tmp_path}/s")[0]).collect()] == [2] * 5


def test_user_functions(spark):
    """A table function sees a group's rows in order, an aggregate's states merge from many batches; nulls are groups like others."""
    rows = [(k, i, (i * 7) % 11) for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)

    def step(s, r):
        s.append(r["v"])
        if len(s) % 25 == 0:
            yield r["k"], len(s), sum(s)

    out = user.table_function(df, list, step, lambda s: iter([(None, -1, len(s))]), "k string, n int, total int", ["k"], ["i"])
    v = [(i * 7) % 11 for i in range(50)]
    want = [(k, n, sum(v[:n])) for k in ("a", "b", None) for n in (25, 50)] + [(None, -1, 50)] * 3
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spread = lambda by: user.aggregate_function(df, by, ["v", "i"], set, lambda s, b: s | {(x, y) for x, y in zip(b.column("v").to_pylist(), b.column("i").to_pylist())}, lambda a, b: a | b, lambda s: (len(s), max(s)[0]), "n bigint, most bigint").collect()
        assert sorted(map(repr, map(tuple, spread(["k"])))) == sorted(repr((k, 50, 10)) for k in ("a", "b", None))
        assert [tuple(r) for r in spread([])] == [(50, 10)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_partitioned_store_plans_its_parts_only(spark, tmp_path):
    """Reading some parts plans their directories only, collation from a store moves no edges, and further columns come back."""
    nodes, edges = clustered(spark)
    g = layout.partition_graph(Graph(nodes.withColumn("kind", F.lit(0)).withColumn("age", F.col("id") * 2), edges, None), parting.hash_partition(nodes, 8), 8)
    graphs.write_partitioned(g, f"{tmp_path}/g")
    some = graphs.read_partitioned(spark, f"{tmp_path}/g", [1, 5, 6])
    assert {f.split("/sp=")[1].split("/")[0] for f in some.edges.inputFiles()} >= {"1", "5", "6"}
    plan = some.edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "sp#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = sorted(map(tuple, g.edges.where("sp in (1, 5, 6) and dp in (1, 5, 6)").select("src", "dst", "sp", "dp", "block").collect()))
    assert sorted(map(tuple, some.edges.select("src", "dst", "sp", "dp", "block").collect())) == want
    assert sorted(map(tuple, some.nodes.select("old_id", "age").collect())) == sorted((r.old_id, r.old_id * 2) for r in g.nodes.where("part in (1, 5, 6)").collect())
    batch = spark.createDataFrame([(0, 1, 0), (0, 5, 1)], "batch int, part int, seq int")
    e = collate.batch_edges(some, batch)
    e.count()
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(sp" not in plan


def test_layers_send_the_narrower_side(spark, monkeypatch):
    """A layer from 64 to 8 numbers sends 8 along the edges, one that widens what it has; the results are those of sums and products by hand."""
    edges = spark.createDataFrame([(0, 1), (2, 1), (1, 0), (1, 2), (3, 2)], "src bigint, dst bigint")
    r = np.random.default_rng(0)
    x = r.normal(size=(4, 64))
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    widths, sums = [], aggregate.neighbour_sums

    def seen(e, f, weight=None):
        widths.append(len(f.first().x))
        return sums(e, f, weight)

    monkeypatch.setattr(aggregate, "neighbour_sums", seen)
    adj = np.zeros((4, 4))
    for s, d in edges.collect():
        adj[d, s] = 1
    mean = adj / np.maximum(adj.sum(1, keepdims=True), 1)
    w = [r.normal(size=s) for s in ((64, 8), (64, 8), (8, 16), (8, 16))]
    got = lambda df: np.array([v.x for v in sorted(df.collect())])
    h = np.maximum(x @ w[0] + mean @ x @ w[1], 0)
    want = h @ w[2] + mean @ h @ w[3]
    assert np.allclose(got(aggregate.sage(edges, feats, [(w[0], w[1], np.zeros(8)), (w[2], w[3], np.zeros(16))])), want)
    assert np.allclose(got(aggregate.gin(edges, feats, [(0.5, w[0], np.ones(8)), (0.5, w[2], np.ones(16))])), (1.5 * np.eye(4) + adj) @ np.maximum((1.5 * np.eye(4) + adj) @ x @ w[0] + 1, 0) @ w[2] + 1)
    loops = adj + np.eye(4)
    norm = loops / np.sqrt(np.outer(loops.sum(1), loops.sum(1)))
    assert np.allclose(got(aggregate.gcn(edges, feats, [(w[0], np.ones(8)), (w[2], np.ones(16))])), norm @ np.maximum(norm @ x @ w[0] + 1, 0) @ w[2] + 1)
    assert widths == [8] * 6


def test_neighbour_sums_send_lists(spark, monkeypatch):
    """A source goes to a block of targets as one row, whatever its edges; small steps, hubs, sparse ids and sources without features make no difference."""
    rows = [(s, d) for s in range(40) for d in range(100, 160) if (s * d) % 3 or d == 101] + [(7, 8), (9, 8)]
    monkeypatch.setattr(aggregate, "HELD", 64)
    for scale in (1, 10**12):
        edges = spark.createDataFrame([(s * scale, d * scale, float(s % 4)) for s, d in rows], "src bigint, dst bigint, w double")
        feats = spark.createDataFrame([(i * scale, [float(i), 1.0]) for i in [*range(39), *range(100, 160)]], "id bigint, x array<float>")
        want = {}
        for s, d in rows:
            if s < 39:
                n, t, a, b = want.get(d * scale, (0, 0, 0, 0))
                want[d * scale] = n + 1, t + s % 4, a + s * (s % 4), b + s % 4
        assert {r.id: (r.n, r.total, *r.sums) for r in aggregate.neighbour_sums(edges, feats, "w").collect()} == want
        plan = aggregate.neighbour_sums(edges, feats)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Repartition") and "Aggregate" not in plan[: plan.index("MapInArrow")]


def test_pushed_mass_of_seeds_without_edges(spark):
    """A seed without neighbours keeps all of its mass."""
    nodes = spark.createDataFrame([(0, None), (1, "train"), (2, None)], "id bigint, split string")
    c = SimpleNamespace(nodes=nodes, edges=spark.createDataFrame([(0, 2), (2, 0)], "src bigint, dst bigint"), train=nodes.where("split = 'train'").select("id"))
    assert sorted(map(tuple, inspect.unwrap(queries.ppr_mass)(c).collect())) == [(1, 0.25, 0)]


def test_edge_order_cuts_what_is_long(spark, monkeypatch):
    """Positions follow (dst, src) across ranges, hubs and repeated edges; keys are whole numbers, not texts."""
    r = np.random.default_rng(1)
    rows = [(int(s), int(d)) for s, d in zip(r.integers(0, 200_000, 500), r.integers(0, 3_000_000, 500), strict=True)] + [(i * 700, 5000) for i in range(200)] + [(3, 5000)] * 3
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    want = sorted(rows, key=lambda e: (e[1], e[0]))
    for most in (batching.EDGE_ROWS, 50):
        monkeypatch.setattr(batching, "EDGE_ROWS", most)
        out = batching.edge_order(edges)
        got = sorted(out.collect(), key=lambda e: e.pos)
        assert [(e.src, e.dst) for e in got] == want and [e.pos for e in got] == list(range(len(want)))
        assert "hex(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sampling_reads_written_edges():
    """Queries that read the edges at every hop write them first."""
    for name in ("sample_nodes", "mfg_hop_counts", "mfg_trimmed", "mfg_features_sum", "drop_random_alive", "drop_hop_share_alive", "drop_hop_alive"):
        assert "cut" in queries.ALL[name].__code__.co_names, name


def test_stream_goes_through_a_task_in_batches(spark):
    """The stream's task gets nodes, then lists, in batches, and does as the kernel over the whole graph does; the limit admits 72 million edges."""
    r = np.random.default_rng(2)
    n, k = 60, 4
    both = {(int(a), int(b)) for a, b in r.integers(0, n - 2, (300, 2)) if a != b}
    pairs = sorted(both | {(b, a) for a, b in both})
    edges, nodes = spark.createDataFrame([(a * 10, b * 10) for a, b in pairs], "src bigint, dst bigint"), spark.range(0, n * 10, 10)
    src, dst = np.array(sorted(pairs, key=lambda e: (e[1], e[0]))).T
    ptr = np.r_[0, np.cumsum(np.bincount(dst, minlength=n))]
    p, want = parting.Fennel(k=k, runs=2), None
    for _ in range(2):
        want = parting.stream(ptr, src, np.lexsort((np.arange(n), -np.diff(ptr))), p, start=want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert col(parting.streaming_partition(nodes, edges, p), "part") == want.tolist()
        plan = parting.streaming_partition(nodes, edges, p)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan and parting.EDGE_LIMIT > 72_000_000


def _random_graph(spark, n=60, m=240, hub=0):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b} | {(hub, i) for i in range(n) if i != hub}
    pairs |= {(b, a) for a, b in pairs}
    return spark.range(n), spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), pairs


def test_influence_of_a_step_is_not_shuffled_by_node(spark, monkeypatch):
    """Top lists equal a dense walk's, hubs' lists coming in pieces; the last step's sums are not an aggregate of (seed, node)."""
    monkeypatch.setattr(layout, "PIECE", 7)
    nodes, edges, pairs = _random_graph(spark)
    a = np.zeros((60, 60))
    for s, d in pairs:
        a[s, d] = 1
    walk = 0.5 * np.eye(60) + 0.5 * a / a.sum(1)[:, None]
    want = {}
    for k in (1, 2, 3):
        df = scoring.seed_influence(edges, nodes, nodes.where("id % 3 = 0"), k, 10)
        rows = {(r.seed, r["rank"]): (r.id, r.s) for r in df.collect()}
        p = np.linalg.matrix_power(walk, k)
        want = {}
        for s in range(0, 60, 3):
            best = sorted((i for i in range(60) if p[s, i] > 0), key=lambda i: (-np.floor(p[s, i] * 1e12 + 0.5), i))[:10]
            want |= {(s, r + 1): (i, p[s, i]) for r, i in enumerate(best)}
        assert {x: v[0] for x, v in rows.items()} == {x: v[0] for x, v in want.items()}
        assert all(abs(rows[x][1] - want[x][1]) < 1e-12 for x in want)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Aggregate" not in plan


def test_push_writes_no_residuals(spark, monkeypatch):
    """Scores equal the supersteps', and rows that are written do not count the nodes that a seed reaches without pushing."""
    monkeypatch.setattr(layout, "PIECE", 7)
    nodes, edges, pairs = _random_graph(spark)
    near = {i: [d for s, d in pairs if s == i] for i in range(60)}
    written, cut_ = [], scoring.cut
    monkeypatch.setattr(scoring, "cut", lambda df: written.append(cut_(df)) or written[-1])
    eps, unit = 0.02, scoring.UNIT
    got = {(r.seed, r.id): r.p for r in scoring.ppr(nodes, edges, nodes, 0.25, eps).collect()}
    want = {}
    for seed in range(60):
        p, r, due = dict.fromkeys(range(60), 0), {seed: round(0.25 * unit)}, {seed}
        while due:
            sent = {u: r[u] for u in due}
            for u in due:
                p[u], r[u] = p[u] + r[u], 0
            for u, x in sent.items():
                for v in near[u]:
                    r[v] = r.get(v, 0) + int(np.floor(0.75 * x / len(near[u])))
            due = {v for v, x in r.items() if x > 0 and x >= 0.25 * eps * unit * len(near[v])}
        want |= {(seed, v): x / unit for v, x in p.items() if x}
    assert got == want
    rounds = [t for t in written if "seed" in t.columns]
    assert sum(t.where("not ask").count() for t in rounds) == len(want) and sum(t.where("ask").count() for t in rounds) <= len(rounds) * len(want)


def test_small_graphs_take_no_jobs_for_their_levels(spark, monkeypatch):
    """Once contracted and small, a graph goes through its levels in one task: few tables are written, and the parts are as good as those of levels by tables."""
    n = 32
    at = lambda i, j: i * n + j
    pairs = [(at(i, j), at(i + 1, j)) for i in range(n - 1) for j in range(n)] + [(at(i, j), at(i, j + 1)) for i in range(n) for j in range(n - 1)]
    nodes, edges = spark.range(n * n), spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint")
    written, cut_ = [], multilevel.cut
    monkeypatch.setattr(multilevel, "cut", lambda df: written.append(1) or cut_(df))
    parts = {r.id: r.part for r in multilevel.multilevel_partition(nodes, edges, parting.Fennel(k=4), coarsest=32).collect()}
    sizes = np.bincount(list(parts.values()), minlength=4)
    assert len(parts) == n * n and sizes.max() <= 1.1 * n * n / 4
    assert sum(parts[a] != parts[b] for a, b in pairs) < 250 and len(written) < 40


def test_sampling_tasks_do_not_grow(spark, monkeypatch):
    """Edges are ranked in parts of a set size; the edges within a batch equal the joins', none other is shuffled by batch."""
    monkeypatch.setattr(sampling, "TASK_EDGES", 20)
    monkeypatch.setattr(layout, "PIECE", 7)
    nodes, edges, pairs = _random_graph(spark)
    seeds = spark.createDataFrame([(i % 3, i) for i in range(12)], "batch bigint, id bigint")
    got, took = sampling.sample(edges, seeds, [2, 2], 1)
    held = {}
    for r in got.collect():
        held.setdefault(r.batch, set()).add(r.id)
    plans, cut_ = [], sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut_(df))
    sampling.sample(edges, seeds, [2, 2], 1)
    tasks = -(-len(pairs) // 20)
    assert any(f", {tasks}" in line for p in plans for line in p.splitlines() if "RepartitionByExpression" in line)
    df = sampling.induced_batches(got, edges)
    assert sorted((r.batch, r.src, r.dst) for r in df.collect()) == sorted((b, s, d) for b, ids in held.items() for s, d in pairs if s in ids and d in ids)
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_is_written_once(spark, monkeypatch):
    """What a stream returns is a table: to read it again does not run the one task again.  Tables of earlier turns and the lists go."""
    nodes, edges, _ = _random_graph(spark)
    written, gone = [], []
    cut_, drop_ = parting.cut, parting.drop
    monkeypatch.setattr(parting, "cut", lambda df: written.append(cut_(df)) or written[-1])
    monkeypatch.setattr(parting, "drop", lambda df: gone.append(df) or drop_(df))
    out = parting.streaming_partition(nodes, edges, parting.Fennel(k=4, runs=3))
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out is written[-1]
    assert [any(x is y for y in gone) for x in written] == [True, True, True, False] and out.count() == 60


def test_stream_with_full_parts_as_by_the_rule(spark):
    """Parts open and close as nodes leave and come: each node's part is the best one with room, also in restreams with classes."""
    r = np.random.default_rng(3)
    n, k = 90, 3
    dst = np.sort(r.integers(0, n, 900))
    ptr, idx = np.r_[0, np.cumsum(np.bincount(dst, minlength=n))], r.integers(0, n, 900)
    balance, part = r.integers(0, 2, n), None
    p = parting.Fennel(k=k, slack=1.0, scan=0.0, alpha=0.5)
    cap, caps = -(-n // k), np.ceil(np.bincount(balance) / k)
    for _ in range(3):
        want = np.full(n, k) if part is None else part.copy()
        for v in range(n):
            want[v] = k
            size = np.bincount(want, minlength=k + 1)[:k]
            held = np.bincount(want[balance == balance[v]], minlength=k + 1)[:k]
            total = np.bincount(want[idx[ptr[v] : ptr[v + 1]]], minlength=k + 1)[:k] - 0.75 * size**0.5
            ok = (size < cap) & (held < caps[balance[v]])
            want[v] = np.argmax(np.where(ok, total, -np.inf)) if ok.any() else np.argmin(size)
        part = parting.stream(ptr, idx, np.arange(n), p, balance=balance, start=part)
        assert part.tolist() == want.tolist()


def test_equal_features_are_sent_once(spark, monkeypatch):
    """Sources with equal features go to a task together, by edges and by blocks, with weights and without, in small steps; sources without features count for nothing."""
    monkeypatch.setattr(aggregate, "PACKED", 50)
    monkeypatch.setattr(aggregate, "HELD", 256)
    nodes, edges, pairs = _random_graph(spark, 120, 500)
    for kinds in (1, 2):
        x = nodes.where("id <> 5").select("id", F.array(*((F.col("id") % kinds + i).cast("float") for i in range(3))).alias("x"))
        weights = edges.withColumn("w", (F.col("src") % 3).cast("double"))
        for e, weight, w in ((edges, None, lambda s: 1), (weights, "w", lambda s: s % 3)):
            want = {}
            for s, d in pairs:
                if s != 5:
                    n, t, *v = want.get(d, (0, 0, 0, 0, 0))
                    want[d] = (n + 1, t + w(s), *(v[i] + (s % kinds + i) * w(s) for i in range(3)))
            g = layout.partition_graph(Graph(nodes.select("id", F.lit(0).alias("kind"), F.lit(0).alias("label"), F.lit(None).cast("string").alias("split")), e, x), parting.hash_partition(nodes, 4), 4)
            a, b = aggregate.neighbour_sums(e, x, weight), aggregate.block_sums(g, weight)
            assert {r.id: (r.n, r.total, *r.sums) for r in a.collect()} == want
            assert {r.old_id: (r.n, r.total, *r.sums) for r in b.join(g.nodes.select(F.col("new_id").alias("id"), "old_id"), "id").collect()} == want
            plans = [y._jdf.queryExecution().optimizedPlan().toString() for y in (a, b)]
            assert (kinds > 1 or plans[0].count("MapInArrow") == 2) and plans[1].count("MapInArrow") == 2 and "Aggregate" not in plans[1]


def test_stream_goes_on_in_other_tasks(spark, monkeypatch):
    """A long stream is cut into pieces of a set number of edges, each placed by a task of its own, and comes out as in one; ids need not be
    dense, and an edge from no node counts for nothing.  Its tasks are sent small batches, and the session's setting stays."""
    nodes, edges, _ = _random_graph(spark, 90, 700, 40)
    wide = lambda c: (F.col(c) * F.col(c) * 7 + 3).alias(c)
    kinds = nodes.select(wide("id"), (F.col("id") % 4 - 1).cast("int").alias("s"), (F.col("id") % 2).cast("int").alias("b"))
    lost = edges.select(wide("src"), wide("dst")).union(spark.createDataFrame([(-5, 3), (10**6, 3), (10**6, 10)], "src bigint, dst bigint"))
    p, by = parting.Fennel(k=4, runs=2, beta=0.7, strict=False), {"order": "id", "strata": "s", "balance": "b"}
    weighted = lost.withColumn("w", F.lit(1.0) + F.col("src") % 7 / 3)
    steps, cut_ = [], parting.cut
    for e, kw in ((lost, {}), (weighted, by)):
        monkeypatch.undo()
        whole = dict(parting.streaming_partition(kinds, e, p, **kw).collect())
        steps.clear()
        monkeypatch.setattr(parting, "cut", lambda df: steps.append((df.columns, spark.conf.get(parting.BATCH))) or cut_(df))
        monkeypatch.setattr(parting, "PIECE_EDGES", 600)
        monkeypatch.setattr(parting, "STEP", 3)
        assert dict(parting.streaming_partition(kinds, e, p, **kw).collect()) == whole and set(whole.values()) <= {0, 1, 2, 3} and len(whole) == 90
        state = [rows for names, rows in steps if "ids" in names]
        assert len(state) >= 3 and set(state) == {str(parting.BATCH_ROWS)} and steps[-1][0] == ["id", "part"]
        assert spark.conf.get(parting.BATCH, None) != str(parting.BATCH_ROWS)


def test_sampling_sends_nothing_through_the_driver(spark, monkeypatch):
    """What a hop finds is longer than its files tell: its joins are merges, though all of it is small here."""
    edges = spark.createDataFrame([(s, d) for s in range(12) for d in range(12) if s != d], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "batch int, id bigint")
    placed, lists = sampling.positioned(edges)
    plans, cut_ = [], sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_(df))
    for replace in (False, True):
        nodes, got = sampling.sample(placed, seeds, [4, 2], 5, replace=replace, lists=lists)
        assert got.where("hop = 0").count() == 12 and nodes.where("hop = 0").count() == 3
    assert len(plans) == 8 and sum("SortMergeJoin" in x for x in plans) == 6 and not any("Broadcast" in x for x in plans)


def test_stream_is_sent_short_rows_of_state_and_packed_lists(spark, monkeypatch):
    """A batch is cleared to the length that its longest list ever had, so no row of nodes is long; lists are sorted once, for all runs."""
    nodes, edges, _ = _random_graph(spark, 400, 3000, 41)
    kept, cut_ = {}, parting.cut
    monkeypatch.setattr(parting, "drop", lambda df: None)
    monkeypatch.setattr(parting, "PIECE_EDGES", 2500)
    monkeypatch.setattr(parting, "cut", lambda df: _keep(kept, cut_(df)))
    out = parting.streaming_partition(nodes, edges, parting.Fennel(k=4, runs=2))
    assert out.count() == 400
    lists = kept["src"]
    assert len(lists) == 1 and lists[0].agg(F.sum(F.size("ids"))).first()[0] == 400 and lists[0].count() < 40
    assert kept["part"] and all(x.agg(F.max(F.size("ids"))).first()[0] <= 128 for x in kept["part"])


def _keep(kept, df):
    for c in ("src", "part"):
        if "ids" in df.columns and c in df.columns:
            kept.setdefault(c, []).append(df)
    return df


def test_push_sums_in_its_task(spark, monkeypatch):
    """A seed's sums are those of all its rows, of which none is written; lists go as plain arrays."""
    nodes, edges, _ = _random_graph(spark, 60, 300, 42)
    nodes = nodes.select("id").union(spark.createDataFrame([(999,)], "id bigint"))
    edges = edges.union(spark.createDataFrame([(3, 999)], "src bigint, dst bigint"))
    want = {}
    for r in scoring.ppr(nodes, edges, nodes, 0.25, 1e-3, left=True).collect():
        x = want.setdefault(r.seed, [0.0, 0.0, 0.0, 0])
        x[0 if r.d else 1] += r.p
        x[2] += r.r
        x[3] += r.r > 0 and r.r >= 0.25 * 1e-3 * r.d
    written, cut_ = [], scoring.cut
    monkeypatch.setattr(scoring, "cut", lambda df: written.append(cut_(df)) or written[-1])
    got = {r.seed: [r.p, r.off, r.r, r.due] for r in scoring.ppr_sums(nodes, edges, nodes, 0.25, 1e-3).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True)) and got[999][1] > 0
    assert sum(x.where("not ask").count() for x in written if "ask" in x.columns) == len(got)
    assert [x.schema["dst"].dataType.simpleString() for x in written if "dst" in x.columns] == ["array<bigint>"]


def test_vectors_are_sent_once_to_a_block(spark, monkeypatch):
    """However many lists name a vector, its block is sent it once: rows with a vector are its blocks times the vectors, not the lists."""
    monkeypatch.setattr(aggregate, "PACKED", 20)
    monkeypatch.setattr(aggregate, "HELD", 256)
    nodes, edges, _ = _random_graph(spark, 120, 500)
    x = nodes.select("id", F.array(*((F.lit(1.0) + i).cast("float") for i in range(3))).alias("x"))
    run_ = aggregate._named_sums
    both = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(width, weighted):
        inner = run_(width, weighted)

        def run(batches):
            def count():
                for b in batches:
                    both[0].add(b.num_rows - b.column("x").null_count)
                    both[1].add(b.column("x").null_count)
                    yield b

            return inner(count())

        return run

    monkeypatch.setattr(aggregate, "_named_sums", counted)
    got = aggregate.neighbour_sums(edges, x).collect()
    assert sum(r.n for r in got) == edges.count() and all(r.sums == [r.n * (1.0 + i) for i in range(3)] for r in got)
    blocks = max(spark.sparkContext.defaultParallelism, -(-120 * 5 // 256))
    assert both[0].value == blocks and both[1].value > 2 * blocks


def test_large_graphs_are_joined_in_stars(spark, monkeypatch):
    """All who name a leader join it along an edge, as far as it has room, so a graph of many edges takes few levels."""
    nodes, edges, _ = _random_graph(spark, 600, 9000, 43)
    v, e = nodes.select("id", F.lit(1.0).alias("w")), edges.select("src", "dst", F.lit(1.0).alias("w"))
    mates = {r.id: r.mate for r in multilevel.stars(v, e, 12.0, 0.15).collect()}
    near = {tuple(x) for x in edges.select("src", "dst").collect()}
    assert len(mates) > 400 and not set(mates) & set(mates.values()) and all((a, b) in near for a, b in mates.items())
    assert max(np.unique(list(mates.values()), return_counts=True)[1]) <= 11
    calls, contract = [], multilevel.contract
    monkeypatch.setattr(multilevel, "SMALL_EDGES", 2500)
    monkeypatch.setattr(multilevel, "contract", lambda *a: calls.append(1) or contract(*a))
    out = multilevel.multilevel_partition(nodes, edges, parting.Fennel(k=4), coarsest=16)
    assert sorted(col(out, "id")) == sorted(col(nodes, "id")) and out.groupBy("part").count().agg(F.max("count")).first()[0] <= 165
    assert len(calls) <= 3
