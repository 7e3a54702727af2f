"""Partitioning in levels: heavy-edge matching, contraction, a partition of the small graph, and refinement on the way back.

A matching is found by handshakes: every free node names its heaviest free neighbour, equal ones by a hash of the pair, and two that name each
other are joined; one order of all edges is common to both ends, so each round joins at least the first free edge.  Joined nodes
become one, with summed weights, until ``coarsest`` nodes are left.  Large graphs of many edges are joined in stars first, each a leader and all who name
it, so that a level has a fraction of the nodes of the one before and the edges are read for a few levels only.  On the way back only nodes with an edge to another part are looked
at; all propose at once the part that holds most of their edges, and parts admit the greatest gains as far as they have room.  All of it
is joins and partial sums over written tables, until a contracted graph has SMALL_NODES and SMALL_EDGES at most: its own levels are
arrays of one task, as jobs over small tables would only cost their starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.functions.hashing import bucket, rank_key
from graphlake.functions.store import cut, drop
from graphlake.operators.partition import Fennel, _caps, _even, admit, hash_partition

#: Edges that the start on the coarsest graph, which holds them all, takes.
EDGE_LIMIT = 50_000_000

#: Nodes and edges of a graph, already contracted once, whose other levels one task takes.
SMALL_NODES, SMALL_EDGES = 1 << 17, 8_000_000

#: Leaders that a node has an edge to, about, where a large graph is joined in stars.
LEADERS = 4


def matching(nodes: DataFrame, edges: DataFrame, most: float | None = None, rounds: int = 3, seed: int = 0) -> DataFrame:
    """(id, mate) of nodes(id, w) that handshakes over edges(src, dst, w), both directions stored, join two by two; most: the greatest weight of two together."""
    free, out = nodes.select("id", "w"), None
    for r in range(rounds):
        side = lambda c: free.select(F.col("id").alias(c), F.col("w").alias(f"_{c}"))
        e = edges.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst")
        e = e if most is None else e.where(F.col("_src") + F.col("_dst") <= most)
        order = F.struct("w", rank_key(F.least("src", "dst"), F.greatest("src", "dst"), r, seed))
        named = cut(e.groupBy(F.col("src").alias("id")).agg(F.max_by("dst", order).alias("to")))
        both = named.join(named.select(F.col("id").alias("to"), F.col("to").alias("back")), "to").where("back = id")
        pairs = cut(both.select("id", F.col("to").alias("mate")))
        drop(named)
        out = pairs if out is None else out.union(pairs)
        if r + 1 < rounds:
            free = free.join(pairs, "id", "left_anti")
    return out


def stars(nodes: DataFrame, edges: DataFrame, most: float, share: float, seed: int = 0) -> DataFrame:
    """(id, mate): a share of nodes(id, w), by a hash, leads, and each of the others joins the leader of its heaviest edge(src, dst, w), equal ones by a hash of the pair,
    as far as all of a leader's have a weight of ``most`` at most, the heaviest edges first."""
    leads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    order = F.struct("w", rank_key(F.least("src", "dst"), F.greatest("src", "dst"), seed))
    named = edges.where(leads("src") & ~leads("dst")).groupBy(F.col("dst").alias("id")).agg(F.max_by("src", order).alias("to"), F.max("w").alias("gain"))
    moves = cut(named.join(nodes.select("id", "w"), "id"))
    room = nodes.where(leads("id")).select(F.col("id").alias("to"), (F.lit(float(most)) - F.col("w")).alias("w"))
    return admit(moves, room, ["w"], ["to"]).select("id", F.col("to").alias("mate"))


def contract(nodes: DataFrame, edges: DataFrame, mates: DataFrame, lead: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, (id, up)): matched nodes as one, of the smaller id or, with ``lead``, of the mate's; the weights of nodes and of parallel edges are summed, edges within go."""
    up = nodes.select("id").join(mates, "id", "left").select("id", (F.coalesce("mate", "id") if lead else F.least("id", F.coalesce("mate", "id"))).alias("up"))
    sums = [F.sum(c).alias(c) for c in nodes.columns if c != "id"]
    fewer = nodes.join(up, "id").groupBy(F.col("up").alias("id")).agg(*sums)
    ends = edges.join(up.select(F.col("id").alias("src"), F.col("up").alias("a")), "src").join(up.select(F.col("id").alias("dst"), F.col("up").alias("b")), "dst")
    return fewer, ends.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), up


def _start(ids: np.ndarray, weights: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, caps: np.ndarray, k: int, passes: int = 8) -> np.ndarray:
    """Parts of a small graph: the heaviest node first, each to the part that holds most of its edges less a penalty of size; then passes that move nodes for gains only."""
    n = len(ids)
    at = np.argsort(dst, kind="stable")
    near, w, ptr = np.searchsorted(ids, src[at]), w[at], np.searchsorted(dst[at], np.r_[ids, np.iinfo(np.int64).max])
    total = weights.sum(1)
    part, held = np.full(n, k), np.zeros((k, weights.shape[1]))
    alpha = np.sqrt(k) * w.sum() / max(total.sum(), 1) ** 1.5
    for turn in range(passes):
        moved = 0
        for v in np.lexsort((ids, -total)):
            old = part[v]
            if old < k:
                held[old] -= weights[v]
            pull = np.bincount(part[near[ptr[v] : ptr[v + 1]]], w[ptr[v] : ptr[v + 1]], minlength=k + 1)[:k]
            score = pull - (0 if turn else 1.5 * alpha * total[v] * np.sqrt(held.sum(1)))
            fits = (held + weights[v] <= caps).all(1)
            best = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int((held / np.maximum(caps, 1)).max(1).argmin())
            if old < k and fits[old] and score[old] >= score[best]:
                best = old
            moved += best != old
            part[v] = best
            held[best] += weights[v]
        if not moved:
            break
    return part


def _hash(a: np.ndarray, turn: int) -> np.ndarray:
    x = (a.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _mates(total: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, most: float, rounds: int, level: int) -> np.ndarray:
    """matching() of nodes 0 to n - 1 over edges sorted by src: each node's mate, or itself."""
    n = len(total)
    mate, ids = np.arange(n), np.arange(n)
    fits = (src != dst) & (total[src] + total[dst] <= most)
    for r in range(rounds):
        on = fits & (mate[src] == src) & (mate[dst] == dst)
        s, d, x = src[on], dst[on], w[on]
        if not len(s):
            break
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)]))
        top = x == np.maximum.reduceat(x, first)[of]
        key = np.where(top, _hash(np.minimum(s, d) * n + np.maximum(s, d), level * 31 + r) | np.uint64(1), np.uint64(0))
        at = np.flatnonzero(key == np.maximum.reduceat(key, first)[of])
        named = np.full(n, -1)
        named[s[at]] = d[at]
        both = (named >= 0) & (named[named] == ids)
        mate[both] = named[both]
    return mate


def _settled(weights: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, part: np.ndarray, caps: np.ndarray, k: int, steps: int, level: int) -> np.ndarray:
    """refine() of the parts of nodes 0 to n - 1."""
    n = len(part)
    ids = np.arange(n)
    for step in range(steps):
        room = caps - np.stack([np.bincount(part, weights[:, c], k) for c in range(weights.shape[1])], 1)
        votes = np.bincount(dst * k + part[src], w, n * k).reshape(n, k)
        mine = votes[ids, part].copy()
        votes[:, (room <= 0).any(1)] = -1
        votes[ids, part] = -1
        to = votes.argmax(1)
        gain = votes[ids, to] - mine
        go = np.flatnonzero((gain > 0) & (_hash(ids, level * 31 + step + 997) % np.uint64(2) == 0))
        go = go[np.lexsort((go, -gain[go], to[go]))]
        if len(go):
            first = np.flatnonzero(np.r_[True, to[go][1:] != to[go][:-1]])
            upto = np.cumsum(weights[go], 0)
            upto -= np.repeat(upto[first] - weights[go][first], np.diff(np.r_[first, len(go)]), axis=0)
            go = go[(upto <= room[to[go]]).all(1)]
            part[go] = to[go]
    return part


def _levels(weights: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, caps: np.ndarray, k: int, least: int, most: float, rounds: int, steps: int, level: int = 0) -> np.ndarray:
    """The parts of nodes 0 to n - 1 in levels, over edges sorted by src, as multilevel_partition does it with tables."""
    n = len(weights)
    if n > least:
        mate = _mates(weights.sum(1), src, dst, w, most, rounds, level)
        kept, up = np.unique(np.minimum(np.arange(n), mate), return_inverse=True)
        if len(kept) <= 0.95 * n:
            a, b = up[src], up[dst]
            on = a != b
            key, x = a[on] * len(kept) + b[on], w[on]
            by = np.argsort(key, kind="stable")
            key, x = key[by], x[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            fewer = np.stack([np.bincount(up, weights[:, c], len(kept)) for c in range(weights.shape[1])], 1)
            sums = np.add.reduceat(x, first) if len(first) else x
            part = _levels(fewer, key[first] // len(kept), key[first] % len(kept), sums, caps, k, least, most, rounds, steps, level + 1)[up]
            return _settled(weights, src, dst, w, part, caps, k, steps, level)
    return _settled(weights, src, dst, w, _start(np.arange(n), weights, src, dst, w, caps, k), caps, k, steps, level)


def _small(nodes: DataFrame, edges: DataFrame, caps: list[float], k: int, names: list[str], least: int, most: float, rounds: int, steps: int) -> DataFrame:
    """(id, part) of a graph that one task holds."""
    side = lambda c: F.lit(None).cast("bigint").alias(c)
    rows = nodes.select("id", *names, side("src"), side("dst"), F.lit(0.0).alias("w")).union(edges.select(side("id"), *(F.lit(0.0) for _ in names), "src", "dst", F.col("w").cast("double")))

    def run(t: pa.Table) -> pa.Table:
        v, e = t.filter(t.column("id").is_valid()).sort_by("id"), t.filter(t.column("src").is_valid()).select(["src", "dst", "w"])
        ids = v.column("id").to_numpy()
        weights = np.stack([v.column(c).to_numpy() for c in names], 1)
        src, dst = (np.searchsorted(ids, e.column(c).to_numpy()) for c in ("src", "dst"))
        by = np.lexsort((dst, src))
        part = _levels(weights, src[by], dst[by], e.column("w").to_numpy()[by], np.array(caps), k, least, most, rounds, steps)
        return pa.table({"id": ids, "part": pa.array(part, pa.int32())})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "id bigint, part int")


def refine(nodes: DataFrame, edges: DataFrame, parts: DataFrame, caps: list[float], k: int, names: list[str], steps: int, seed: int = 0) -> DataFrame:
    """parts(id, part) after steps in which boundary nodes move where they gain; half of them, by a hash, may move in a step, so that neighbours do not swap for ever."""
    now = parts
    for step in range(steps):
        at = lambda c, p: now.select(F.col("id").alias(c), F.col("part").alias(p))
        e = edges.join(at("src", "sp"), "src").join(at("dst", "dp"), "dst")
        votes = e.groupBy(F.col("dst").alias("id"), F.col("dp").alias("own"), "sp").agg(F.sum("w").alias("w"))
        mine = F.sum(F.when(F.col("sp") == F.col("own"), F.col("w")).otherwise(0.0)).alias("mine")
        held = now.join(nodes, "id").groupBy("part").agg(*(F.sum(c).alias(c) for c in names))
        full = nodes.sparkSession.range(k).select(F.col("id").cast("int").alias("part")).join(held, "part", "left")
        room = cut(full.select(F.col("part").alias("to"), *((F.lit(float(m)) - F.coalesce(c, F.lit(0.0))).alias(c) for c, m in zip(names, caps, strict=True))))
        other = F.when(F.col("sp") != F.col("own"), F.struct("w", F.negative("sp").alias("less")))
        best = votes.join(room.where(" and ".join(f"{c} > 0" for c in names[:1])).select(F.col("to").alias("sp"), F.lit(True).alias("open")), "sp", "left")
        best = best.groupBy("id", "own").agg(mine, F.max(F.when(F.col("open"), other)).alias("b"), F.max(other).isNotNull().alias("boundary")).where("boundary and b is not null")
        moves = best.select("id", F.negative("b.less").alias("to"), (F.col("b.w") - F.col("mine")).alias("gain")).where((F.col("gain") > 0) & (bucket(F.col("id") * 31 + step * 7 + seed, 2) == 0))
        moves = cut(moves.join(nodes.select("id", *names), "id"))
        took = admit(moves, room, names, ["to"]).select("id", "to")
        after = cut(now.join(took, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part")))
        for x in (now, moves, room):
            drop(x)
        now = after
    return now


def multilevel_partition(nodes: DataFrame, edges: DataFrame, p: Fennel = Fennel(), balance: str | None = None, coarsest: int | None = None, rounds: int = 3, steps: int = 4) -> DataFrame:
    """(id, part) in levels.  edges may carry ``w``; balance: a 0/1 column of nodes, each value of which is capped at p.slack times its share of a part.

    coarsest: nodes (64 for each part, unless given) below which matching ends; it ends as well when a level joins less than a twentieth of
    the nodes.  Graphs beyond SMALL_NODES or SMALL_EDGES of more than eight edge rows to a node are joined in stars.  A graph that was contracted to SMALL_NODES and SMALL_EDGES goes through its other levels in one task.  If matching ended before and what is left
    has up to 64 * coarsest nodes and EDGE_LIMIT edges, that task makes the start; a graph that could not be made that small starts from a hash
    partition, and refinement does the rest.
    """
    k = p.k
    least = coarsest or 64 * k
    one = F.coalesce(F.col(balance).cast("int"), F.lit(0)) if balance else F.lit(0)
    names = ["w0", "w1"] if balance else ["w0"]
    classes = cut(nodes.select("id", one.alias("b")))
    caps_ = cut(_caps(classes, k, p.slack))
    caps = {r["b"]: float(r["cap"]) for r in caps_.collect()}  # two rows
    v = classes.select("id", F.lit(1.0).alias("w"), *(((F.col("b") == i).cast("double")).alias(c) for i, c in enumerate(names)))
    v, e = cut(v), cut(edges.select("src", "dst", (F.col("w") if "w" in edges.columns else F.lit(1.0)).cast("double").alias("w")))
    limits = [caps.get(i, 0.0) for i in range(len(names))]
    n, m, levels = v.count(), e.count(), []
    heaviest = max(2.0, 1.5 * n / least)
    small = lambda: n <= SMALL_NODES and m <= SMALL_EDGES
    while n > least and not (levels and small()):
        # About four leaders to a node: some fiftieth of the nodes has none, and comes again at the next level.
        share = max(LEADERS * n / max(m, 1), 2 * least / n)
        lead = not small() and share < 0.5
        mates = cut(stars(v, e, heaviest, share, len(levels))) if lead else matching(v, e, heaviest, rounds, len(levels))
        fewer, joined, up = (cut(x) for x in contract(v, e, mates, lead))
        n_ = fewer.count()
        if n_ > 0.95 * n:
            break
        levels.append((v, e, up))
        v, e, n, m = fewer, joined, n_, joined.count()
    if small() or n <= 64 * least and m <= EDGE_LIMIT:
        now = cut(_small(v, e, limits, k, names, least, heaviest, rounds, 2 * steps))
    else:
        now = refine(v, e, hash_partition(v, k), limits, k, names, steps, len(levels))
    for i, (finer, between, up) in reversed(list(enumerate(levels))):
        lower = cut(up.join(now.select(F.col("id").alias("up"), "part"), "up").select("id", "part"))
        drop(now)
        now = refine(finer, between, lower, limits, k, names, steps, i)
        for x in (v, e, up):
            drop(x)
        v, e = finer, between
    # Joined nodes may not have fitted: what a part holds beyond its room goes to the others.
    return cut(_even(now.join(classes, "id"), caps_, k))
