"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are bags of hashed unigrams and bigrams.  A text's log weight is the sum of the log ratios of
its n-grams under the target (texts labelled good) and the raw corpus (all texts).  Adding Gumbel noise and taking
the k largest draws k texts without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, table

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Resampling:
    """log2_buckets: of the n-gram hash; smoothing: added to each bucket's count; target_rows: bound on the labelled texts that the target model takes; share: of the corpus to draw, or None for the share of good texts among the labelled; seed of the noise."""

    log2_buckets: int = 14
    smoothing: float = 1.0
    target_rows: int = 50_000
    share: float | None = None
    seed: int = 5


def ngram_counts(text: str | None, log2_buckets: int) -> np.ndarray:
    """Buckets of the whole text's unigrams and bigrams, one entry for each occurrence; lower-cased words and runs of signs are tokens."""
    words = TOKEN.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate((h, two)) >> np.uint64(64 - log2_buckets)).astype(np.int64)


def good_ids(labels: DataFrame, p: Resampling) -> tuple[list[int], float]:
    """(ids of at most about target_rows good texts, share of good quality among the labelled).

    Good for the target: quality 1 and not toxic, in all rows of a doc_id; null quality or doc_id: not labelled.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    n = one.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("q") == 1).cast("int")).alias("q"), F.sum(((F.col("q") == 1) & (F.col("t") == 0)).cast("int")).alias("good")).first()
    good = one.where("q = 1 and t = 0")
    if (n["good"] or 0) > p.target_rows:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(p.target_rows / n["good"] * (1 << 20)))
    return [r[0] for r in good.select(F.col("doc_id").cast("bigint")).toLocalIterator()], (n["q"] or 0) / n["n"] if n["n"] else 1.0


def fit(docs: DataFrame, ids: list[int], p: Resampling) -> np.ndarray:
    """The log ratio of each bucket.  Raw counts are over all of docs(doc_id, text); each task sends one sum a bucket."""
    held, size = docs.sparkSession.sparkContext.broadcast(np.array(sorted(ids), np.int64)), 1 << p.log2_buckets  # at most about target_rows ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            doc_ids = b.column("doc_id")
            known = np.isin(doc_ids.fill_null(0).to_numpy(), held.value) & doc_ids.is_valid().to_numpy(zero_copy_only=False)
            for text, good in zip(b.column("text").to_pylist(), known, strict=True):
                n = np.bincount(ngram_counts(text, p.log2_buckets), minlength=size)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = docs.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(size, p.smoothing), np.full(size, p.smoothing)
    at = sums.column("bucket").to_numpy()
    raw[at] += sums.column("raw").to_numpy()
    target[at] += sums.column("target").to_numpy()
    if not sums.num_rows or target.sum() == size * p.smoothing:
        return np.zeros(size)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value of a column without nulls, by counting in ever narrower bins; None if k is less than 1.

    The driver gets ``bins`` counts a pass and, at the end, at most ``few`` values.
    """
    c = F.col(column)
    ends = scores.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if k < 1 or not ends["n"]:
        return None
    lo, hi, k = ends["lo"], ends["hi"], min(k, ends["n"])
    inside = scores
    while lo < hi:
        n = inside.count()
        if n <= few:
            return sorted((r[0] for r in inside.select(c).collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        at = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        for row in inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy(F.desc("bin")).collect():
            if k <= row["n"]:
                break
            k -= row["n"]
        lo, hi = row["lo"], row["hi"]
        inside = scores.where(c.between(F.lit(lo), F.lit(hi)))
    return lo


def resample(docs: DataFrame, labels: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_grams, log_weight, key, kept, under labels(doc_id, quality, toxic).

    kept marks the sample; rows whose key ties with the last of it are all kept.  Null or empty text and text of
    white space only: no n-grams, null weight and key, not kept.  Null doc_id and repeated rows are
    rows like others, and equal rows have equal keys.  Without a good label every weight is 0 and, with
    no labels at all, every text that has n-grams is kept.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids, share = good_ids(labels, p)
    ratio = spark.sparkContext.broadcast(fit(docs, ids, p))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [ngram_counts(t, p.log2_buckets) for t in b.column("text").to_pylist()]
            weight = [float(ratio.value[g].sum()) if g.size else None for g in grams]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g.size for g in grams], pa.int64()), pa.array(weight, pa.float64()), b.column("u")], ["doc_id", "n_grams", "log_weight", "u"])

    # Uniform in (0, 1), the same on every run.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    scored = docs.withColumn("u", u).mapInArrow(score, "doc_id bigint, n_grams bigint, log_weight double, u double")
    scored = scratch.write(scored.withColumn("key", F.col("log_weight") - F.log(-F.log("u"))).drop("u"), "scored")
    k = round((p.share if p.share is not None else share) * scored.count())
    last = kth_largest(scored.where("key is not null"), "key", k)
    kept = F.coalesce(F.col("key") >= F.lit(last), F.lit(False)) if last is not None else F.lit(False)
    return scored.withColumn("kept", kept)


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the sample marked: doc_id, n_grams, log_weight, key, kept; see resample for odd rows."""
    return resample(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))
