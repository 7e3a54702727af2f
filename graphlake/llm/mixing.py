"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its token share to the power of an exponent.  The exponent is bisected until the
mixture has a target entropy or no source repeats more than a limit; the weights are then realised as
blocks of a token budget.  A source's stream is its documents in one random order after another, a new
one each epoch; every block takes its share of each stream and is permuted in itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm.common import Scratch, table


@dataclass(frozen=True)
class Mixture:
    """entropy: target as a share of the entropy of equal weights, or None; repeats: most epochs of one source for each of another (with budget None) or in all (with a budget); budget: tokens, or None for the least that sees every source whole; block: tokens of a block; grid, rounds: the bisection evaluates grid exponents in one pass, rounds times; bucket_docs: documents that are ordered together; copies: equal rows that are numbered together."""

    entropy: float | None = 0.9
    repeats: float = 4.0
    budget: float | None = None
    block: int = 1 << 20
    seed: int = 7
    grid: int = 16
    rounds: int = 6
    bucket_docs: int = 512
    copies: int = 4096


def count_tokens(text: Column) -> Column:
    """Runs of characters other than white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _measures(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, most repeats) of each exponent in one pass over the sources' totals."""
    p, lnp = F.col("p"), F.log("p")
    cols = []
    for i, a in enumerate(exponents):
        w = F.exp(lnp * a)
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * lnp).alias(f"e{i}"), F.max(F.exp(lnp * (a - 1))).alias(f"m{i}"), F.min(F.exp(lnp * (a - 1))).alias(f"n{i}")]
    row = totals.agg(F.sum("tokens").alias("all"), *cols).first()
    out = []
    for i, a in enumerate(exponents):
        z, m, n = row[f"z{i}"], row[f"m{i}"], row[f"n{i}"]
        out.append((math.log(z) - a * row[f"e{i}"] / z, m / n if budget is None else m / z * budget / row["all"]))
    return out


def find_exponent(totals: DataFrame, n_sources: int, m: Mixture) -> float:
    """The largest exponent of 0 to 1 that reaches the target entropy, or more if the repetition limit asks for it.

    Entropy and repetition both fall as the exponent grows, so each is bisected; 1 if nothing is to
    be flattened (natural shares), also where even that breaks the repetition limit.
    """

    def bisect(fine) -> float:
        """fine(measure) holds from some exponent on; the smallest such, or 1."""
        lo, hi = 0.0, 1.0
        if fine(_measures(totals, [0.0], m.budget)[0]):
            return 0.0
        for _ in range(m.rounds):
            at = [lo + (hi - lo) * k / m.grid for k in range(1, m.grid)]
            ok = [fine(x) for x in _measures(totals, at, m.budget)]
            first = ok.index(True) if True in ok else len(at)
            lo, hi = ([lo, *at][first], [*at, hi][first])
        return hi

    by_repeats = bisect(lambda x: x[1] <= m.repeats * (1 + 1e-12))
    if m.entropy is None or n_sources < 2:
        return by_repeats
    target = m.entropy * math.log(n_sources)
    by_entropy = bisect(lambda x: x[0] <= target)
    return max(by_entropy, by_repeats)


def mix(docs: DataFrame, m: Mixture = Mixture(), tokens: Column | None = None, texts: bool = False) -> DataFrame:
    """The mixture: doc_id, source, tokens, epoch, block, slot and, if asked for, text; a document appears once in each epoch that reaches it.

    Null source: a source of its own, named null.  Null or empty text: the row counts as one token
    in positions, so that no block gathers such rows without end, and its ``tokens`` is 0.  Repeated rows and null doc_ids
    are rows like others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), (count_tokens(F.col("text")) if tokens is None else tokens.cast("bigint")).alias("tokens"), F.xxhash64("text").alias("body"))
    # Equal rows are counted before the shuffle; each is told apart by its number.
    base = base.groupBy("doc_id", "source", "tokens", "body").agg(F.count(F.lit(1)).alias("m")).withColumn("size", F.greatest("tokens", F.lit(1)))
    base = scratch.write(base, "base")
    totals = base.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("tokens"), F.sum("m").alias("docs"))
    totals = scratch.write(totals, "totals")
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("docs").alias("docs")).first()
    if not whole["t"]:
        none = base.select("doc_id", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("slot"))
        return none.withColumn("text", F.lit(None).cast("string")) if texts else none
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(whole["t"])))
    a = find_exponent(shares, whole["n"], m)
    z = shares.agg(F.sum(F.exp(F.log("p") * a)).alias("z"), F.min(F.exp(F.log("p") * (a - 1))).alias("least")).first()
    budget = m.budget if m.budget is not None else whole["t"] * z["z"] / z["least"]
    weights = shares.select("source", F.col("tokens").alias("total"), (F.exp(F.log("p") * a) / z["z"]).alias("weight"))
    weights = weights.withColumn("share", F.col("weight") * budget)
    # The source that needs the budget whole has just its own tokens; rounding must not cut its last document.
    weights = weights.withColumn("share", F.when(F.abs(F.col("share") / F.col("total") - F.round(F.col("share") / F.col("total"))) < 1e-9, F.round(F.col("share") / F.col("total")) * F.col("total")).otherwise(F.col("share")))
    # Many copies of one row are numbered in several tasks.
    last = lambda n: F.floor((n - 1) / m.copies)
    many = base.where(F.col("m") > m.copies).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last(F.col("m"))))).repartition("doc_id", "body", "chunk")
    rows = base.where(F.col("m") <= m.copies).withColumn("chunk", F.lit(0).cast("bigint")).unionByName(many)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("chunk") * m.copies, F.least("m", (F.col("chunk") + 1) * m.copies) - 1))).drop("chunk", "m")
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    weights = weights.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), "total", "weight", "share")
    rows = rows.join(weights, "skey").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("share") / F.col("total")).cast("int") - 1, F.lit(0)))))
    # Running sums in three levels, so that no source, however large, is ordered in one task, nor are its buckets.
    bits = max(0, math.ceil(math.log2(max(1, whole["docs"] / m.bucket_docs))))
    rows = rows.withColumn("h", F.xxhash64(F.lit(m.seed), "epoch", "doc_id", "body", "copy"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    buckets = rows.groupBy("skey", "epoch", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("range", F.shiftright("bucket", bits - bits // 2))
    ranges = buckets.groupBy("skey", "epoch", "range").agg(F.sum("in_bucket").alias("in_range"))
    sum_before = lambda c, over, by: F.coalesce(F.sum(c).over(Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("far", sum_before("in_range", ["skey", "epoch"], "range")).drop("in_range")
    buckets = buckets.withColumn("near", sum_before("in_bucket", ["skey", "epoch", "range"], "bucket")).join(ranges, ["skey", "epoch", "range"])
    buckets = buckets.select("skey", "epoch", "bucket", (F.col("far") + F.col("near")).alias("before"))
    inside = Window.partitionBy("skey", "epoch", "bucket").orderBy("h", "doc_id", "body", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(buckets, ["skey", "epoch", "bucket"]).withColumn("at", F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.where("at < share").withColumn("block", F.floor(F.col("at") / (F.col("weight") * m.block)).cast("bigint"))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(m.seed + 1), "block", "epoch", "doc_id", "body", "copy"), "doc_id", "epoch", "body", "copy")
    out = ["doc_id", "source", "tokens", "epoch", "block", "slot"]
    placed = placed.withColumn("slot", F.row_number().over(order) - 1)
    if not texts:
        return placed.select(*out)
    placed = scratch.write(placed.select(*out, "body"), "placed")
    held = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_body"), "text")
    if base.groupBy("doc_id", "body").agg(F.sum("m").alias("m")).where("m > 1").limit(1).count():  # of equal rows one text is enough
        held = held.groupBy("_id", "_body").agg(F.first("text").alias("text"))
    return placed.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).select(*out, "text")


def op8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixture of documents; see mix for the columns and odd rows."""
    return mix(table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))
