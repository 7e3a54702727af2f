"""Balanced partitioning: by hash, by one-pass streaming with restreaming, in blocks of the stream, and by supersteps.

Streaming assigns one node at a time and is sequential by definition: the adjacency flows through one task after another, each of which is sent
a few numbers for each node and the lists of a piece of the stream, for graphs of up to ``EDGE_LIMIT`` edges.  The other two have no such bound.  Block streaming assigns a block of the
stream at a time, all its nodes at once from what earlier blocks left; in a superstep every node proposes a
move at once from stale part sizes.  In both, parts admit what they have room for, the greatest gains first.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.hashing import bucket, rank_key
from graphlake.functions.store import cut, drop
from graphlake.operators.batching import degree_order, hex_id, number
from graphlake.operators.layout import degree, normalise_weights

EDGE_LIMIT = 1_000_000_000

#: Edges of a piece of a stream, about: what one task is sent, sorts and places.
PIECE_EDGES = 32_000_000

#: Nodes whose neighbours' parts are counted at once.
STEP = 1024

#: Rows of a batch that a stream's task is sent, at most: Spark sizes up the batch after each row, which takes the longer the more lists it holds.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500

#: Stands before all degrees in the order of a stream's rows.
HEAD = -(2**62)

#: Nodes in the order of their ids, ``HELD`` in a row, and the parts that they have: what one task of a stream leaves to the next.  Rows are short: a batch of
#: lists keeps the room that the longest one before it took, and all of that is cleared for every batch.
STATE, HELD = "k bigint, id bigint, ids array<bigint>, s array<int>, b array<int>, part array<int>", 128

#: The lists of some nodes that follow each other in a stream, ``LISTS`` of them at most: the nodes, how long their lists are, and what these hold.
STREAM, LISTS = "piece int, k bigint, id bigint, ids array<bigint>, n array<int>, src array<bigint>, w array<double>", 64


@dataclass(frozen=True)
class Fennel:
    """gamma: power of the size penalty; slack: part capacity over n / k; scan: share of parts touched from which all are scored; runs, beta: restreams and the factor on alpha after each; strict: full parts are never fallen back to."""

    k: int = 16
    gamma: float = 1.5
    slack: float = 1.1
    scan: float = 1 / 8
    runs: int = 1
    beta: float = 1.0
    alpha: float | None = None
    strict: bool = True


def hash_partition(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("id", bucket(F.col("id"), k).alias("part"))


def default_alpha(n: int, m: float, k: int, gamma: float = 1.5) -> float:
    return k ** (gamma - 1) * m / n**gamma


def strata_alphas(counts: DataFrame, m: int, k: int, gamma: float = 1.5) -> DataFrame:
    """(label, alpha) from (label, n) of all labels; a label without nodes has 0."""
    labels = counts.count()
    a = F.lit(m / max(labels, 1) * k ** (gamma - 1)) / F.pow(F.col("n").cast("double"), F.lit(gamma))
    return counts.select("label", F.when(F.col("n") > 0, a).otherwise(0.0).alias("alpha"))


def _placer(p: Fennel, strata: np.ndarray, alphas: np.ndarray, balance: np.ndarray | None, start: np.ndarray | None):
    """(part, place, place_all): the parts of all nodes, k for none; what gives node v one of them, by its neighbours idx and their weights (see stream); and
    what does so for one node after another, whose lists are cut by ptr.  Neighbour n stands for one that is no node: it never has a part."""
    n, k = len(strata), p.k
    cap = max(int(n / k * p.slack), -(-n // k)) if p.strict else int(n / k * p.slack)
    part = np.full(n + 1, k, np.int64)
    if start is not None:
        part[:n] = start
    sizes = np.bincount(part, minlength=k + 1)[:k].tolist()
    levels = int(strata.max(initial=0)) + 1
    by = np.zeros((levels, k), np.int64)
    placed = np.flatnonzero(part < k)
    counted = placed[strata[placed] >= 0]
    np.add.at(by, (strata[counted], part[counted]), 1)
    counts, known = by.tolist(), [{} for _ in alphas]

    def penalty(s: int, size: int) -> float:
        # By single numbers: powers of arrays differ from these in the last bit, and a stream that goes on in another task must not.
        x = known[s].get(size)
        if x is None:
            x = known[s][size] = float(-alphas[s] * p.gamma * np.float64(size) ** (p.gamma - 1))
        return x

    score = [[penalty(s, c) for c in row] for s, row in enumerate(counts[: len(alphas)])]
    caps, room = [], None
    if balance is not None:
        caps = np.ceil(np.bincount(balance) / k * p.slack).astype(np.int64).tolist()
        held = np.zeros((len(caps), k), np.int64)
        np.add.at(held, (balance[placed], part[placed]), 1)
        room = held.tolist()

    # What one node costs is a few passes over k numbers in lists: for each class, the scores of parts that have room for it, and -inf for the others.
    closed, enough = -np.inf, k * p.scan
    has_room = lambda b, q: sizes[q] < cap and (room is None or room[b][q] < caps[b])
    ok = [[has_room(b, q) for q in range(k)] for b in range(len(caps) or 1)]
    flat = [[0.0 if o else closed for o in row] for row in ok]
    fit = [[[x if o else closed for x, o in zip(of, row, strict=True)] for of in score] for row in ok]

    def judge(q: int) -> None:
        for b, row in enumerate(ok):
            o = row[q] = has_room(b, q)
            flat[b][q] = 0.0 if o else closed
            for s, of in enumerate(score):
                fit[b][s][q] = of[q] if o else closed

    def count(s: int, b: int, q: int, step: int) -> None:
        size = sizes[q] = sizes[q] + step
        edge = 0 if step > 0 else 1  # what has room changes at its cap only
        turned = size == cap - edge
        if s >= 0:
            c = counts[s][q] = counts[s][q] + step
            x = score[s][q] = penalty(s, c)
            for of, row in zip(fit, ok, strict=True):
                if row[q]:
                    of[s][q] = x
        if room is not None:
            here = room[b][q] = room[b][q] + step
            turned |= here == caps[b] - edge
        if turned:
            judge(q)

    def place(v: int, idx: np.ndarray, w: np.ndarray | None, pull: list | None = None, touched: int = 0, s: int | None = None, b: int = 0) -> None:
        if s is None:
            s, b = int(strata[v]), int(balance[v]) if room is not None else 0
        if pull is None:
            near = np.bincount(part[idx], w, k + 1)[:k]
            pull, touched = near.tolist(), int(np.count_nonzero(near))
        old, best = int(part[v]), -1
        if s < 0 or touched >= enough:
            total = list(map(add, pull, fit[b][s] if s >= 0 else flat[b]))
            if old < k:  # as if it had left its part; most stay where they are, and nothing changes
                fits = sizes[old] <= cap and (room is None or room[b][old] <= caps[b])
                total[old] = pull[old] + (penalty(s, counts[s][old] - 1) if s >= 0 else 0.0) if fits else closed
            top = max(total)
            best = total.index(top) if top > closed else -1
            if best == old:
                return
            if old < k:
                count(s, b, old, -1)
        else:
            if old < k:
                count(s, b, old, -1)
            top, near = closed, part[idx]
            some = near < k if w is None else (near < k) & (w != 0)
            seen, first = np.unique(near[some], return_index=True)
            for q in seen[np.argsort(first)].tolist():
                total = pull[q] + fit[b][s][q]
                if total > top:
                    best, top = q, total
            fair = fit[b][s] if p.strict else score[s]
            most = max(fair)
            if most > top:
                best = k - 1 - fair[::-1].index(most)
        if best < 0:  # no part has room: the smallest takes it
            best = sizes.index(min(sizes))
        part[v] = best
        count(s, b, best, 1)

    mark, none = np.zeros(n + 1, bool), np.empty(0, np.int64)

    def place_all(vs: np.ndarray, ptr: np.ndarray, idx: np.ndarray, w: np.ndarray | None) -> None:
        for a in range(0, len(vs), STEP):
            v, ends = vs[a : a + STEP], ptr[a : a + STEP + 1]
            all_ = slice(ends[0], ends[-1])
            near, row = idx[all_], np.repeat(np.arange(len(v)), np.diff(ends))
            # A node with a neighbour in this step is counted when its turn comes, the others all at once, in the order of their lists.
            mark[v] = True
            live = np.bincount(row[mark[near]], minlength=len(v)).tolist()
            mark[v] = False
            pulls = np.bincount(row * (k + 1) + part[near], None if w is None else w[all_], len(v) * (k + 1)).reshape(len(v), k + 1)[:, :k]
            touched, pulls, ends = np.count_nonzero(pulls, 1).tolist(), pulls.tolist(), ends.tolist()
            classes = balance[v].tolist() if room is not None else [0] * len(v)
            for i, (u, s, b) in enumerate(zip(v.tolist(), strata[v].tolist(), classes, strict=True)):
                if live[i] or s >= 0 and touched[i] < enough:
                    at = slice(ends[i], ends[i + 1])
                    place(u, idx[at], None if w is None else w[at], None if live[i] else pulls[i], touched[i], s, b)
                else:
                    place(u, none, None, pulls[i], touched[i], s, b)

    return part, place, place_all


def _finder(ids: np.ndarray):
    """What gives nodes their first places in the ordered ids, len(ids) to what is no node."""
    n = len(ids)
    low, span = int(ids[0]), int(ids[-1]) - int(ids[0]) + 1
    if span <= 4 * n:  # a table is a step, a search some twenty
        table = np.full(span + 1, n, np.int64)
        table[ids[::-1] - low] = np.arange(n - 1, -1, -1)
        return lambda x: table[np.where((x >= low) & (x < low + span), x - low, span)]

    def find(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ids, x)
        return np.where(ids[np.minimum(at, n - 1)] == x, at, n)

    return find


def stream(ptr: np.ndarray, idx: np.ndarray, order: np.ndarray, p: Fennel, weights: np.ndarray | None = None, strata: np.ndarray | None = None, alphas: np.ndarray | None = None, balance: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Assigns nodes 0 to n - 1 in ``order``; idx[ptr[v] : ptr[v + 1]] are v's neighbours.

    A node takes the part of the greatest (weight of neighbours there) - alpha * gamma * size ** (gamma - 1) among parts
    with room.  If few parts are touched, only these and the least penalised part compete: touched ones in
    first-seen order, the fallback on a strictly greater score, of equal ones the highest number.
    strata: sizes and alphas count for each stratum (negative: not balanced); balance: a cap for each of these classes too.
    A strict cap leaves room for every node: it is at least n / k, rounded up.
    """
    n = len(ptr) - 1
    strata = np.zeros(n, np.int64) if strata is None else strata
    if alphas is None:
        m = weights.sum() if weights is not None else len(idx)
        alphas = np.array([p.alpha if p.alpha is not None else default_alpha(n, float(m), p.k, p.gamma)])
    part, place, _ = _placer(p, strata, alphas, balance, start)
    for v in order:
        at = slice(ptr[v], ptr[v + 1])
        place(v, idx[at], None if weights is None else weights[at])
    return part[:n]


def _state(ids: np.ndarray, s: np.ndarray, b: np.ndarray, part: np.ndarray):
    """Batches of STATE."""
    rows = HELD << 9
    for i in range(0, len(ids), rows):
        at = slice(i, i + rows)
        x = ids[at]
        first = np.arange(0, len(x), HELD)
        ends = pa.array(np.r_[first, len(x)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(y, kind)) for y, kind in ((x, pa.int64()), *((y[at], pa.int32()) for y in (s, b, part)))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), HEAD)), pa.array(x[first], pa.int64()), *lists], ["k", "id", "ids", "s", "b", "part"])


def _runs(batches):
    """Batches of STREAM from rows (piece, k, id, src, w) in that order."""
    for x in batches:
        if not x.num_rows:
            continue
        piece, at = x.column("piece").to_numpy(), np.arange(x.num_rows)
        new = np.r_[True, piece[1:] != piece[:-1]]
        first = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % LISTS == 0)
        rows = pa.array(np.r_[first, len(piece)].astype(np.int32))
        n = pc.fill_null(pc.list_value_length(x.column("src")), 0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(n)].astype(np.int32)
        src, w = (x.column(c).flatten() for c in ("src", "w"))
        held = pa.array(ends[np.r_[first, len(piece)]])
        none = lambda kind: pa.nulls(len(first), pa.list_(kind))
        lists = [pa.ListArray.from_arrays(rows, x.column("id")), pa.ListArray.from_arrays(rows, pa.array(n.astype(np.int32))), pa.ListArray.from_arrays(held, src), pa.ListArray.from_arrays(held, w) if len(w) else none(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(piece[first]), *(x.column(c).take(pa.array(first)) for c in ("k", "id")), *lists], ["piece", "k", "id", "ids", "n", "src", "w"])


def _pack(batches):
    for x in batches:
        if x.num_rows:
            yield from _state(*(x.column(c).to_numpy() for c in ("id", "s", "b", "start")))


@contextmanager
def _small_batches(spark: SparkSession):
    """BATCH_ROWS for what is run within, and what was set before after it."""
    was = spark.conf.get(BATCH, None)
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if was is None else spark.conf.set(BATCH, was)


def _cuts(rows: DataFrame, edges: int) -> list:
    """Where pieces of about PIECE_EDGES edges begin in the order of rows(k, id, m), m edges each: (k, id) of all but the first."""
    ranges = rows.repartitionByRange(4 * -(-edges // PIECE_EDGES), "k", "id").withColumn("p", F.spark_partition_id())
    ranges = ranges.groupBy("p").agg(F.min(F.struct("k", "id")).alias("low"), F.sum("m").alias("m")).orderBy("p").collect()  # four for a piece
    out, held = [], 0
    for r in ranges:
        if held and held + r["m"] > PIECE_EDGES:
            out.append(r["low"])
            held = 0
        held += r["m"]
    return out


def streaming_partition(nodes: DataFrame, edges: DataFrame, p: Fennel = Fennel(), order: str = "degree", strata: str | None = None, balance: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """(id, part) by streaming.  order: 'degree' (descending, ties by id) or 'id'; edges may carry ``w``; strata and balance name
    integer columns of nodes (balance from 0, strata negative for none); start(id, part) is an assignment to begin from."""
    m = edges.count()
    if m > EDGE_LIMIT:
        raise ValueError(f"more than {EDGE_LIMIT} edges in one task: use concurrent_partition, block_streaming_partition or superstep_partition")
    weighted = "w" in edges.columns
    if weighted:
        edges = normalise_weights(edges)
    item = F.struct("src", "w") if weighted else F.struct("src")
    adj = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("near"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    lists = nodes.select("id").join(adj, "id", "left").select("id", F.coalesce(F.col("near.src"), F.array().cast("array<bigint>")).alias("src"), F.col("near.w").alias("w") if weighted else none("w", "array<double>"))
    rank = lambda n: (F.negative(n) if order == "degree" else F.lit(0)).cast("bigint").alias("k")
    lists = lists.select(rank(F.size("src")), "id", "src", "w", F.lit(0).alias("piece"))
    pieces = 1
    if m > PIECE_EDGES:
        n = F.coalesce("m", F.lit(0))
        degrees = cut(nodes.select("id").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("m")), "id", "left").select(rank(n), "id", n.alias("m")))
        lows = _cuts(degrees, m)
        drop(degrees)
        pieces += len(lows)
        piece = sum((((F.col("k") > x["k"]) | ((F.col("k") == x["k"]) & (F.col("id") >= x["id"]))).cast("int") for x in lows), F.lit(0))
        lists = lists.withColumn("piece", piece)
    # Sorted and packed once, all pieces at a time: what the stream's tasks, one after another, are sent is few rows.
    with _small_batches(nodes.sparkSession):
        lists = cut(lists.select("piece", "k", "id", "src", "w").repartition(pieces, "piece").sortWithinPartitions("piece", "k", "id").mapInArrow(_runs, STREAM))
    m = float(m)

    def kernel(turn: int, last: bool):
        def run(batches):
            heads, ids = [], None

            def begin():  # all nodes are known
                nonlocal ids, s, b, find, part, place_all
                ids, s, b, first = (np.concatenate([x.column(c).flatten().to_numpy() for x in heads]) for c in ("ids", "s", "b", "part"))
                heads.clear()
                if strata:
                    n = np.bincount(s[s >= 0])
                    alphas = np.divide(m / max(len(n), 1) * p.k ** (p.gamma - 1), n**p.gamma, out=np.zeros(len(n)), where=n > 0)
                else:
                    alphas = np.array([p.alpha if p.alpha is not None else default_alpha(len(ids), m, p.k, p.gamma)])
                for _ in range(turn):
                    alphas = alphas * p.beta
                find = _finder(ids)
                part, _, place_all = _placer(p, s, alphas, b if balance else None, first)

            s = b = find = part = place_all = None
            for batch in batches:
                head = pc.equal(batch.column("k"), HEAD)
                if ids is None:
                    heads.append(batch.filter(head).select(["ids", "s", "b", "part"]))
                rows = batch.filter(pc.invert(head))
                if not rows.num_rows:
                    continue
                if ids is None:
                    begin()
                of = lambda c: rows.column(c).flatten()
                ptr = np.concatenate(([0], np.cumsum(of("n").to_numpy())))
                place_all(find(of("ids").to_numpy()), ptr, find(of("src").fill_null(HEAD).to_numpy()), of("w").to_numpy() if weighted else None)
            if ids is None and sum(x.num_rows for x in heads):
                begin()
            if ids is not None and not last:
                yield from _state(ids, s, b, part[:-1])
            elif ids is not None:
                for i in range(0, len(ids), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 20)], pa.int64()), pa.array(part[:-1][i : i + (1 << 20)], pa.int32())], ["id", "part"])

        return run

    cols = nodes.select("id", (F.col(strata) if strata else F.lit(0)).cast("int").alias("s"), (F.col(balance) if balance else F.lit(0)).cast("int").alias("b"))
    known = cols.join(start.select("id", F.coalesce(F.col("part").cast("int"), F.lit(p.k)).alias("start")), "id", "left") if start is not None else cols.withColumn("start", F.lit(p.k))
    out = known.select("id", "s", "b", F.coalesce("start", F.lit(p.k)).alias("start")).repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_pack, STATE)
    for step in range(p.runs * pieces):
        turn, at = divmod(step, pieces)
        last = step + 1 == p.runs * pieces
        heads = out.select(*out.columns, none("n", "array<int>"), none("src", "array<bigint>"), none("w", "array<double>"))
        rows = lists.where(F.col("piece") == at) if pieces > 1 else lists
        rows = rows.select("k", "id", "ids", *(none(c, "array<int>") for c in ("s", "b", "part")), "n", "src", "w")
        # The order of a stream is one order: nodes first, then their lists.
        # Written, the last step too: whoever reads the result twice, or sorts it, does not run its task again.
        with _small_batches(nodes.sparkSession):
            before, out = out, cut(heads.union(rows).repartition(1).sortWithinPartitions("k", "id").mapInArrow(kernel(turn, last), "id bigint, part int" if last else STATE))
        drop(before)
    drop(lists)
    return out


def admit(moves: DataFrame, room: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """The moves(id, <by>, gain, <weights>) that room(<by>, <weights>) admits: the greatest gains first, in bins of a logarithm, and within a bin by a hash.

    Sums of bins, at most 65,536 for a group, say which of them fit; no group's moves are ordered in one task, and none is overfilled.
    """
    cell = moves.withColumn("_bin", F.least(F.floor(F.log2(1 + F.greatest("gain", F.lit(0.0))) * 32), F.lit(1023)).cast("int")).withColumn("_sub", bucket(F.col("id"), 64))
    sums = cell.groupBy(*by, "_bin", "_sub").agg(*(F.sum(c).alias(c) for c in names))
    w = Window.partitionBy(*by).orderBy(F.desc("_bin"), "_sub")
    upto = sums.select(*by, "_bin", "_sub", *(F.sum(c).over(w).alias(c) for c in names))
    fits = upto.join(room.select(*by, *(F.col(c).alias(f"_r_{c}") for c in names)), by)
    for c in names:
        fits = fits.where(F.col(c) <= F.col(f"_r_{c}"))
    return cell.join(fits.select(*by, "_bin", "_sub"), [*by, "_bin", "_sub"]).select(*moves.columns)


def _fill(rows: DataFrame, room: DataFrame) -> DataFrame:
    """(id, part) of rows(id, b), dealt in the order of a hash and evenly over the room(b, part, room) of their class."""
    w = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each part
    slots = room.where("room > 0").withColumn("hi", F.sum("room").over(w))
    slots = slots.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("hi", "part"))).alias("slots"), F.sum("room").alias("total"))
    n = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    placed = number(rows, rank_key(F.col("id")), "r", ["b"]).join(n, "b").join(slots, "b")
    placed = placed.withColumn("slot", F.expr("cast(cast(r as decimal(19, 0)) * cast(total as decimal(18, 0)) div cast(n as decimal(18, 0)) as bigint)"))
    index = F.size(F.filter("slots", lambda x: x["hi"] <= F.col("slot")))
    return placed.select("id", F.element_at("slots", F.least(index + 1, F.size("slots")))["part"].cast("int").alias("part"))


def _room(held: DataFrame, caps: DataFrame, k: int) -> DataFrame:
    """(b, part, room): what caps(b, cap) leave beside the rows held(b, part); less than 0 where a part holds more."""
    grid = caps.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    n = held.groupBy("b", "part").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["b", "part"], "left").select("b", "part", (F.col("cap") - F.coalesce("n", F.lit(0))).alias("room"))


def _even(now: DataFrame, caps: DataFrame, k: int) -> DataFrame:
    """now(id, part, b) with what a part holds of a class beyond caps(b, cap) moved to the parts with room for it."""
    room = cut(_room(now, caps, k))
    over = number(now, rank_key(F.col("id")), "rank", ["b", "part"]).join(caps, "b").where("rank >= cap").select("id", "b")
    moved = _fill(over, room).withColumnRenamed("part", "to")
    return now.join(moved, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part"))


def _caps(classes: DataFrame, k: int, slack: float) -> DataFrame:
    """(b, cap): the room of a part for each class of classes(id, b), enough for all of it."""
    n = F.count(F.lit(1))
    return classes.groupBy("b").agg(F.greatest(F.floor(n / k * slack), F.ceil(n / k)).alias("cap"))


def superstep_partition(nodes: DataFrame, edges: DataFrame, p: Fennel = Fennel(), steps: int = 4, start: DataFrame | None = None, balance: str | None = None) -> DataFrame:
    """(id, part) by supersteps from a hash partition: votes of neighbours plus the size penalty propose a move, the largest gains
    are admitted as far as the target has room.  All steps are joins and aggregates; each is written and read back.
    No part holds more than its share of the nodes times the slack, or with ``balance``, an integer column of nodes, of any of its classes."""
    n, m, k = nodes.count(), edges.count(), p.k
    alpha = p.alpha if p.alpha is not None else default_alpha(max(n, 1), m, k, p.gamma)
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    kinds = cut(nodes.select("id", (F.coalesce(F.col(balance).cast("int"), F.lit(0)) if balance else F.lit(0)).alias("b")))
    caps = cut(_caps(kinds, k, p.slack))
    now = (start if start is not None else hash_partition(nodes, k)).select("id", "part")
    now = cut(_even(now.join(kinds, "id"), caps, k))
    for step in range(steps):
        sizes = now.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        sizes = sizes.withColumn("score", -alpha * p.gamma * F.pow(F.col("size").cast("double"), F.lit(p.gamma - 1)))
        votes = edges.withColumn("_w", w).join(now.select(F.col("id").alias("src"), "part"), "src").groupBy(F.col("dst").alias("id"), "part").agg(F.sum("_w").alias("votes"))
        total = votes.join(sizes, "part").select("id", "part", (F.col("votes") + F.col("score")).alias("total"))
        best = total.groupBy("id").agg(F.max_by(F.struct("part", "total"), F.struct(F.col("total"), -F.col("part"))).alias("b")).select("id", F.col("b.part").alias("to"), F.col("b.total").alias("total"))
        stay = now.join(total, ["id", "part"], "left").join(sizes.select("part", "score"), "part").select("id", "part", F.coalesce("total", "score").alias("held"))
        # Half of the nodes may move in a step, by a hash, so that neighbours do not swap for ever.
        moves = stay.join(best, "id").where((F.col("to") != F.col("part")) & (F.col("total") > F.col("held"))).where(bucket(F.col("id") * 31 + step, 2) == 0)
        moves = cut(moves.join(kinds, "id").select("id", "b", "to", (F.col("total") - F.col("held")).alias("gain"), F.lit(1).alias("n")))
        room = _room(now.join(kinds, "id"), caps, k).select("b", F.col("part").alias("to"), F.col("room").alias("n"))
        took = admit(moves, room, ["n"], ["b", "to"]).select("id", "to")
        after = cut(now.join(took, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part")))
        drop(moves)
        drop(now)
        now = after
    return now


def block_streaming_partition(nodes: DataFrame, edges: DataFrame, p: Fennel = Fennel(), blocks: int = 16, order: str = "degree", strata: str | None = None, balance: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """(id, part) by streaming blocks of nodes, for graphs of any size; parameters are those of streaming_partition.

    The stream is cut into ``blocks`` of equal length.  All nodes of a block choose at once, each the part of the greatest (weight of
    neighbours there) - penalty, from the assignments of all other blocks.  A part admits the greatest gains over the best penalty
    alone, twice its fair share of the block at most and never beyond its capacity; the others fill what room is left.
    More blocks come closer to one node at a time and take more passes; each pass reads the edges of its own block only.
    """
    n, k = nodes.count(), p.k
    if "w" in edges.columns:
        edges = normalise_weights(edges)
    m = edges.count()
    cols = nodes.select("id", (F.col(strata) if strata else F.lit(0)).cast("bigint").alias("s"), (F.col(balance) if balance else F.lit(0)).cast("bigint").alias("b"))
    pos = degree_order(degree(nodes, edges)) if order == "degree" else number(nodes.select("id"), hex_id(F.col("id")), "pos", levels=(8, 12))
    stream_ = cut(cols.join(pos.select("id", "pos"), "id").select("id", "s", "b", F.least(F.floor(F.col("pos") / max(n, 1) * blocks), F.lit(blocks - 1)).cast("int").alias("block")))
    weighted = edges.select("src", "dst", (F.col("w") if "w" in edges.columns else F.lit(1.0)).alias("w"))
    e = cut(weighted.join(stream_.select(F.col("id").alias("dst"), "block"), "dst").repartitionByRange("block", "dst").sortWithinPartitions("block"))
    caps = cut(_caps(stream_, k, p.slack))
    if strata:
        alphas = strata_alphas(stream_.groupBy(F.col("s").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("label >= 0"), m, k, p.gamma).withColumnRenamed("label", "s")
        alphas = stream_.select("s").distinct().join(alphas, "s", "left").select("s", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
    else:
        alphas = stream_.select("s").distinct().withColumn("alpha", F.lit(float(p.alpha if p.alpha is not None else default_alpha(max(n, 1), m, k, p.gamma))))
    alphas = cut(alphas)
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    pieces: list[DataFrame] = []
    for j in range(blocks):
        mine = stream_.where(F.col("block") == j)
        known = start.select("id", F.col("part").cast("int").alias("part")) if start is not None else mine.select("id").limit(0).withColumn("part", F.lit(0))
        pieces.append(mine.join(known, "id").select("id", "s", "b", "part"))
    for run in range(p.runs):
        for j in range(blocks):
            mine = stream_.where(F.col("block") == j)
            rest = pieces[j].limit(0)
            for i, x in enumerate(pieces):
                rest = rest if i == j else rest.union(x)
            size = rest.groupBy("s", "part").agg(F.count(F.lit(1)).cast("double").alias("size"))
            score = alphas.withColumn("part", all_parts).join(size, ["s", "part"], "left")
            score = cut(score.select("s", "part", (-F.col("alpha") * (p.beta**run * p.gamma) * F.pow(F.coalesce("size", F.lit(0.0)), F.lit(p.gamma - 1))).alias("score")))
            room = cut(_room(rest, caps, k))
            votes = e.where(F.col("block") == j).join(rest.select(F.col("id").alias("src"), "part"), "src").groupBy(F.col("dst").alias("id"), "part").agg(F.sum("w").alias("votes"))
            total = votes.join(mine.select("id", "s", "b"), "id").join(score, ["s", "part"]).join(room.where("room > 0").select("b", "part"), ["b", "part"]).select("id", "s", "b", "part", (F.col("votes") + F.col("score")).alias("total"))
            best = total.groupBy("id", "s", "b").agg(F.max_by(F.struct("part", "total"), F.struct(F.col("total"), -F.col("part"))).alias("x")).select("id", "s", "b", "x.part", "x.total")
            fair = score.groupBy("s").agg(F.max("score").alias("fair"))
            wish = cut(best.join(fair, "s").where("total >= fair").select("id", "b", "part", (F.col("total") - F.col("fair")).alias("gain")))
            quota = mine.groupBy("b").agg(F.ceil(2 * F.count(F.lit(1)) / k).alias("quota"))
            most = room.join(quota, "b").select("b", "part", F.least("room", "quota").alias("n"))
            took = cut(admit(wish.withColumn("n", F.lit(1)), most, ["n"], ["b", "part"]).select("id", "b", "part"))
            free = room.join(took.groupBy("b", "part").agg(F.count(F.lit(1)).alias("n")), ["b", "part"], "left").select("b", "part", (F.col("room") - F.coalesce("n", F.lit(0))).alias("room"))
            others = _fill(mine.select("id", "b").join(took.select("id"), "id", "left_anti"), free)
            before, pieces[j] = pieces[j], cut(mine.select("id", "s", "b").join(took.select("id", "part").union(others), "id"))
            for x in (before, score, room, wish, took):
                drop(x)
    out = pieces[0]
    for x in pieces[1:]:
        out = out.union(x)
    return out.select("id", "part")
