"""Quality of partitions and batches, and training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.hashing import spread
from graphlake.operators.layout import histogram


def with_parts(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """edges with the parts of both ends, sp and dp."""
    return edges.join(assign.select(F.col("id").alias("src"), F.col("part").alias("sp")), "src").join(assign.select(F.col("id").alias("dst"), F.col("part").alias("dp")), "dst")


def edge_cuts(edges: DataFrame, assign: DataFrame, weight: str | None = None) -> DataFrame:
    """(cuts, edges): stored edges between parts, so both directions of a symmetric graph; with a weight, its sums."""
    w = F.col(weight) if weight else F.lit(1)
    return with_parts(edges, assign).agg(F.sum(F.when(F.col("sp") != F.col("dp"), w).otherwise(0)).alias("cuts"), F.sum(w).alias("edges"))


def cut_matrix(edges: DataFrame, assign: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(dp, sp, n): edges for each pair of parts; sources: only edges that start there."""
    if sources is not None:
        edges = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return with_parts(edges, assign).groupBy("dp", "sp").agg(F.count(F.lit(1)).alias("n"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(moved, nodes): how many nodes of two assignments (id, part) changed their part, nodes of only one of them included."""
    both = before.select("id", F.col("part").alias("a")).join(after.select("id", F.col("part").alias("b")), "id", "full")
    return both.agg(F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")), F.lit(0)).alias("moved"), F.count(F.lit(1)).alias("nodes"))


def cut_flags(edges: DataFrame, assign: DataFrame, cached: DataFrame) -> DataFrame:
    """(src, dst, cut): whether an edge is cut, edges that leave the cached set never being so."""
    e = with_parts(edges, assign).join(cached.select(F.col("id").alias("src")).distinct().withColumn("_c", F.lit(True)), "src", "left")
    return e.select("src", "dst", ((F.col("sp") != F.col("dp")) & F.col("_c").isNull()).alias("cut"))


def load_ratio(assign: DataFrame, k: int) -> DataFrame:
    """(most, spread): the greatest load over the mean and the loads' sample deviation over it, cut to 3 places; no rows: NaN and 0."""
    h = histogram(assign, "part", k)
    r = F.col("n") * k / F.sum("n").over(Window.partitionBy())
    cut = lambda c: F.floor(c * 1000) / 1000
    return h.select(r.alias("r")).agg(F.coalesce(cut(F.max("r")), F.lit(float("nan"))).alias("most"), F.coalesce(cut(F.stddev_samp("r")), F.lit(0.0)).alias("spread"))


def label_load_ratio(labelled: DataFrame, k: int) -> DataFrame:
    """(label, most, spread) over labelled(label, part)."""
    counts = labelled.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("label").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = grid.join(counts, ["label", "part"], "left").fillna(0, ["n"])
    r = full.withColumn("r", F.col("n") * k / F.sum("n").over(Window.partitionBy("label")))
    return r.groupBy("label").agg((F.floor(F.max("r") * 1000) / 1000).alias("most"), (F.floor(F.stddev_samp("r") * 1000) / 1000).alias("spread"))


def label_masses(df: DataFrame, label: str, classes: int, by: str | None = None, least: float = 0.0) -> DataFrame:
    """([by,] class, mass): shares of the classes 0 to classes - 1, plus ``least``; empty classes are kept."""
    keys = [by] if by else []
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    grid = (counts.select(by).distinct() if by else df.sparkSession.range(1).select(F.lit(0).alias("_"))).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = grid.join(counts, [*keys, "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.select(*keys, "class", (F.when(total > 0, F.col("n") / total).otherwise(0.0) + least).alias("mass"))


def mass_distance(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, distance): mean difference of the sorted masses; a permutation of the classes does not matter."""
    x = a.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("mass")))
    y = b.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mass"))).select("r", F.col("mass").alias("other"))  # one row a class
    return x.join(y, "r").groupBy(by).agg(F.avg(F.abs(F.col("mass") - F.col("other"))).alias("distance"))


def simulated_batches(masses: DataFrame, n: int, size: int) -> DataFrame:
    """(batch, label) of n labels drawn from masses(class, mass) by a hash of their number, ``size`` to a batch: what batches look like that are drawn, not dealt."""
    ends = F.sum("mass").over(Window.orderBy("class"))  # one row a class
    steps = [(r["class"], r["hi"]) for r in masses.select("class", ends.alias("hi")).orderBy("class").collect()]
    u = spread(F.col("id")) / F.lit(4294967296.0)
    label = F.lit(steps[-1][0])
    for c, hi in reversed(steps[:-1]):
        label = F.when(u < hi, F.lit(c)).otherwise(label)
    return masses.sparkSession.range(n).select(F.floor(F.col("id") / size).alias("batch"), label.alias("label"))


def divergence(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, kl): sum of b * (ln b - ln a) over the classes, by their number; masses must be positive."""
    j = a.join(b.select("class", F.col("mass").alias("t")), "class")
    return j.groupBy(by).agg((F.sum(F.col("t") * (F.log("t") - F.log("mass"))) / F.count(F.lit(1))).alias("kl"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """(epoch, loss, acc, nodes, edges) from batches(epoch, loss, correct, bsize, nodes, edges): loss and accuracy by seeds, sizes by iteration."""
    return batches.groupBy("epoch").agg(
        (F.sum(F.col("loss") * F.col("bsize")) / F.sum("bsize")).alias("loss"),
        (F.sum("correct") / F.sum("bsize")).alias("acc"),
        F.avg("nodes").alias("nodes"),
        F.avg("edges").alias("edges"),
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """(split, n, acc, nll) from scored(split, label, logp ARRAY): the first largest wins; unlabelled rows do not count."""
    guess = F.array_position("logp", F.array_max("logp")) - 1
    rows = scored.where("label is not null and split is not null")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((guess == F.col("label")).cast("double")).alias("acc"), F.avg(-F.element_at("logp", F.col("label") + 1)).alias("nll"))
