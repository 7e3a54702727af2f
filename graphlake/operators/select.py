"""Selection of the first rows of an order, by distributed order statistics.

Which rows are the first k is found by histograms: the values between the least and the greatest one fall into bins, the counts tell in which
bin the k-th row lies, and that bin is cut again while it holds too many rows; a single value that too many rows share is cut by id in the
same way.  Rows above the last bin are taken by a filter, and only the few within it are ranked.  Each pass aggregates before it
shuffles and a window sees the bins of one group only, so no task orders the rows, whatever share of them is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.store import cut

#: Bins of a pass, and rows of a bin that are ranked by one task.
BINS, FEW = 1 << 14, 1 << 16

#: Scores are compared in whole steps of 1e-12, so that the order of sums does not matter.
STEPS = 1e12


def in_steps(score: Column) -> Column:
    return F.floor(score * STEPS + 0.5)


def _narrow(rows: DataFrame, bounds: DataFrame, value: str) -> DataFrame:
    """(g, lo, hi, k, n): one bin of bounds(g, lo, hi, k), that of the k-th greatest value of rows(g, value) within these, its n rows, and how many of these are wanted."""
    wide = lambda c: F.col(c).cast("decimal(38, 0)")  # noqa: E731  values may span 64 bits
    b = bounds.withColumn("width", F.expr(f"(cast(hi as decimal(38, 0)) - cast(lo as decimal(38, 0)) + {BINS}) div {BINS}"))
    inside = rows.join(b, "g").where(F.col(value).between(F.col("lo"), F.col("hi")))
    counts = inside.groupBy("g", "lo", "hi", "k", "width", F.expr(f"(cast({value} as decimal(38, 0)) - cast(lo as decimal(38, 0))) div cast(width as decimal(38, 0))").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")  # BINS rows at most
    counts = counts.withColumn("upto", F.sum("n").over(group.orderBy(F.desc("bin")))).withColumn("last", F.min("bin").over(group))
    # The first bin that has enough; if all have too few, the last.
    hit = counts.where((F.col("upto") >= F.col("k")) | (F.col("bin") == F.col("last"))).withColumn("r", F.row_number().over(group.orderBy(F.desc("bin")))).where("r = 1")
    lo = wide("lo") + wide("bin") * wide("width")
    return hit.select("g", lo.cast("bigint").alias("lo"), F.least(wide("hi"), lo + F.col("width") - 1).cast("bigint").alias("hi"), (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n")


def _settle(rows: DataFrame, wanted: DataFrame, value: str, few: int) -> DataFrame:
    """_narrow, from wanted(g, k) to a bin that is wanted whole, has few rows or is one value."""
    ends = rows.groupBy("g").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    bounds = cut(ends.join(wanted, "g").where("k > 0").select("g", "lo", "hi", "k"))
    more = (F.col("lo") < F.col("hi")) & (F.col("k") < F.col("n")) & (F.col("n") > few)
    done = None
    while True:
        found = cut(_narrow(rows, bounds, value))
        settled = found.where(~more)
        done = settled if done is None else done.union(settled)
        if not found.where(more).limit(1).count():
            return done
        bounds = found.where(more).drop("n")


def _narrow_one(rows: DataFrame, value: str, k: int, few: int) -> tuple[int, int, int, int] | None:
    """(lo, hi, k, n) of _settle for one group, None where no row is wanted.

    The bounds are numbers of the plan, so a pass is one job without a join, and its filter reaches the scan of a written table; the driver gets
    the counts of BINS bins at most.
    """
    lo, hi, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n or k <= 0:
        return None
    while lo < hi and few < n and k < n:
        width = -(-(hi - lo + 1) // BINS)
        # The distance of two values may span 64 bits.
        kind = "bigint" if hi - lo < 1 << 62 else "decimal(38, 0)"
        at = F.expr(f"cast((cast({value} as {kind}) - cast({lo} as {kind})) div cast({width} as {kind}) as int)")
        counts = rows.where(F.col(value).between(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect(), reverse=True):
            if k <= r["n"]:
                break
            k -= r["n"]
        lo, n = lo + r["bin"] * width, r["n"]
        hi = min(hi, lo + width - 1)
    return lo, hi, k, n


def _first_of_all(rows: DataFrame, value: Column, k: int, id_: str, few: int) -> DataFrame:
    """first_rows of one group."""
    marked = rows.withColumns({"_v": value.cast("bigint"), "_i": -F.col(id_).cast("bigint")}).where("_v is not null and _i is not null")
    found = _narrow_one(marked, "_v", k, few)
    if found is None:
        return rows.limit(0)
    lo, hi = (F.lit(x).cast("bigint") for x in found[:2])
    above, inside = F.col("_v") > hi, F.col("_v").between(lo, hi)
    if found[2] < found[3] and found[3] > few:  # one value of too many rows: these are cut by id
        found = _narrow_one(marked.where(inside), "_i", found[2], few)
        ilo, ihi = (F.lit(x).cast("bigint") for x in found[:2])
        above, inside = above | (inside & (F.col("_i") > ihi)), inside & F.col("_i").between(ilo, ihi)
    if found[2] >= found[3]:
        return marked.where(above | inside).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_v"), F.desc("_i")))  # ``few`` rows at most
    edge = marked.where(inside).withColumn("_r", rank).where(F.col("_r") <= found[2])
    return marked.where(above).select(*rows.columns).union(edge.select(*rows.columns))


def first_rows(rows: DataFrame, value: Column, k: int | DataFrame, id_: str = "id", by: str | None = None, few: int = FEW) -> DataFrame:
    """The k rows of greatest ``value`` (a bigint), ties to the smaller ``id_`` (a bigint, unique within its group).

    by: the column of groups, in each of which k rows are taken; k: a number, or a table (by, k) with one for each group.  Rows with a
    null value, id or group are not taken; where there are fewer than k, all are.  rows should be a written table: each pass reads it.
    """
    if by is None:
        return _first_of_all(rows, value, k, id_, few)
    marked = rows.withColumns({"_v": value.cast("bigint"), "_i": -F.col(id_).cast("bigint"), "_g": F.col(by)}).where("_v is not null and _i is not null and _g is not null")
    flat = marked.select(F.col("_g").alias("g"), "_v", "_i")
    if isinstance(k, DataFrame):
        wanted = k.select(F.col(by).alias("g"), F.col("k").cast("bigint").alias("k"))
    else:
        wanted = flat.select("g").distinct().withColumn("k", F.lit(k).cast("bigint"))
    top = cut(_settle(flat, wanted, "_v", few))
    # One value of too many rows: these are cut by id.
    heavy = top.where((F.col("k") < F.col("n")) & (F.col("n") > few)).select("g", F.col("lo").alias("at"), "k")
    tied = flat.join(heavy.select("g", "at"), "g").where("_v = at").select("g", "_i")
    ids = _settle(tied, heavy.select("g", "k"), "_i", few) if heavy.limit(1).count() else top.limit(0)
    ids = ids.select("g", F.col("lo").alias("ilo"), F.col("hi").alias("ihi"), F.col("k").alias("ik"), F.col("n").alias("i_n"))
    bound = cut(top.join(ids, "g", "left").withColumnRenamed("g", "_g").select("_g", "lo", "hi", "ilo", "ihi", F.coalesce("ik", "k").alias("_k"), F.coalesce("i_n", "n").alias("_n")))
    met = marked.join(bound, "_g").where(F.col("_v") >= F.col("lo"))
    inside = (F.col("_v") <= F.col("hi")) & (F.col("ilo").isNull() | F.col("_i").between(F.col("ilo"), F.col("ihi")))
    above = (F.col("_v") > F.col("hi")) | (F.col("_i") > F.col("ihi"))
    sure = met.where(F.coalesce(above, F.lit(False)) | (inside & (F.col("_k") >= F.col("_n")))).select(*rows.columns)
    edge = met.where(inside & ~F.coalesce(above, F.lit(False)) & (F.col("_k") < F.col("_n")))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_v"), F.desc("_i")))  # ``few`` rows of a group at most
    return sure.union(edge.withColumn("_r", rank).where(F.col("_r") <= F.col("_k")).select(*rows.columns))
