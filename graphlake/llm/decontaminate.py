"""Benchmark decontamination by greedy string tiling.

Documents meet benchmark items over shared seeds of a few tokens, those of an item that most documents hold
left out as far as the others must then tell: a passage that covers enough of the item holds more seeds than were left out.
A pair whose seeds could cover enough of the item is tiled: the longest match between unmarked tokens is marked again and again,
found by a running Karp-Rabin hash, until no match of the least length is left.  Tiles may come in any
order, so a passage whose sentences were moved is still found.
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
from pyspark.sql.window import Window

from graphlake.llm.common import Scratch, if_small, release_memory, table

#: Scripts written without blanks (kana, Han, Thai, Lao, Burmese, Khmer): each of their characters is a token.
SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
SOME_SOLID, MIXED, WORD = re.compile(f"[{SOLID}]"), re.compile(rf"[{SOLID}]|[^\W_{SOLID}]+"), re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Tiling:
    """least: tokens of a seed and of the shortest tile; coverage: share of an item's tokens in tiles from which a document is contaminated; log2_bits: size of the seed filter, whatever the benchmark's."""

    least: int = 5
    coverage: float = 0.5
    first: int = 20
    log2_bits: int = 26


def tokens(text: str | None) -> np.ndarray:
    """uint64 hashes of the lower-cased runs of letters and digits of the whole text, and of the single characters of scripts without blanks."""
    low = (text or "").lower()
    words = (WORD if low.isascii() or not SOME_SOLID.search(low) else MIXED).findall(low)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def window_hashes(t: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n tokens, from one running sum of powers (modulo 2**64)."""
    if t.size < n:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(t.size - 1, BASE))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(t.size - n, BASE_INVERSE))), dtype=np.uint64)
    run = np.concatenate(([np.uint64(0)], np.cumsum(t * powers, dtype=np.uint64)))
    h = (run[n:] - run[:-n]) * back
    return h ^ (h >> np.uint64(29))


def _extent(p: np.ndarray, t: np.ndarray, pm: np.ndarray, tm: np.ndarray, i: int, j: int) -> int:
    """Length of the match of unmarked tokens from p[i] and t[j]."""
    n, k, step = min(p.size - i, t.size - j), 0, 64
    while k < n:
        e = min(n, k + step)
        bad = (p[i + k : i + e] != t[j + k : j + e]) | pm[i + k : i + e] | tm[j + k : j + e]
        if bad.any():
            return k + int(np.argmax(bad))
        k, step = e, step * 4
    return n


def tile(p: np.ndarray, t: np.ndarray, least: int = 5, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of pattern p with text t: (start in p, start in t, length), longest first; ties by place."""
    pm, tm, out = np.zeros(p.size, bool), np.zeros(t.size, bool), []
    s = max(least, min(first, p.size))
    while True:
        found: dict[int, list[tuple[int, int]]] = {}
        longest = 0
        ph, th = window_hashes(p, s), window_hashes(t, s)
        if ph.size and th.size:
            free = lambda m: np.flatnonzero(np.convolve(m, np.ones(s, np.int64), "valid") == 0)
            ps, ts = free(pm), free(tm)
            ts = ts[np.isin(th[ts], ph[ps])]
            ts = ts[np.argsort(th[ts], kind="stable")]
            keys = th[ts]
            for i in ps:
                js = ts[np.searchsorted(keys, ph[i], "left") : np.searchsorted(keys, ph[i], "right")]
                if i and js.size and not pm[i - 1]:  # without what is part of a match that starts before
                    js = js[(js == 0) | (p[i - 1] != t[js - 1]) | tm[js - 1]]
                for j in js:
                    k = _extent(p, t, pm, tm, int(i), int(j))
                    if k >= s:
                        found.setdefault(k, []).append((int(i), int(j)))
                        longest = max(longest, k)
                    if k > 2 * s:
                        break
                if longest > 2 * s:
                    break
        if longest > 2 * s:
            s = longest  # such long matches first
            continue
        while found:
            k = max(found)
            for i, j in sorted(found.pop(k)):
                taken = pm[i : i + k] | tm[j : j + k]
                if not taken.any():
                    pm[i : i + k] = tm[j : j + k] = True
                    out.append((i, j, k))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2], strict=True):  # what is left of an occluded match
                    if b - a >= s:
                        found.setdefault(int(b - a), []).append((i + int(a), j + int(a)))
        if s <= least:
            return out
        s = max(least, s // 2)


def _items(p: Tiling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [tokens(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), b.column("iid"), pa.array([x.size for x in t], pa.int64()), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([window_hashes(x, p.least).view(np.int64) for x in t], pa.list_(pa.int64()))],
                ["item_id", "iid", "n", "tokens", "seeds"],
            )

    return run


def _bits(h: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = h * np.uint64(0xD6E8FEB86659FD93)
    y = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - log2_bits)).astype(np.int64), (y >> np.uint64(64 - log2_bits)).astype(np.int64)


def seed_filter(seeds: DataFrame, log2_bits: int) -> np.ndarray:
    """A two-hash bit filter of seeds(h), built by tasks; the driver gets its words, at most 2**log2_bits bits."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), log2_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = seeds.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _hits(p: Tiling, held):
    """Of rows (rid, text), those with seeds in the filter: (rid, hits, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            rows: list[int] = []
            hits: list[np.ndarray] = []
            toks: list[bytes] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                t = tokens(text)
                h = window_hashes(t, p.least)
                if not h.size:
                    continue
                x, y = _bits(h, p.log2_bits)
                h = h[(bits[x >> 3] >> (x & 7) & 1 & (bits[y >> 3] >> (y & 7))).astype(bool)]
                if h.size:
                    rows.append(i)
                    hits.append(np.unique(h).view(np.int64))
                    toks.append(t.tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(rows)), pa.array(hits, pa.list_(pa.int64())), pa.array(toks, pa.binary())], ["rid", "hits", "tokens"])
        release_memory()

    return run


def coverable(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """Tokens of the item that lie in a seed which the document holds: no tiles cover more."""
    at = np.flatnonzero(np.isin(window_hashes(item, least), window_hashes(doc, least)))
    return int(np.minimum(np.diff(at), least).sum()) + least if at.size else 0


def _tile(p: Tiling):
    def tiles(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        return tile(item, doc, p.least, p.first) if coverable(item, doc, p.least) >= p.coverage * item.size else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [tiles(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("item"), b.column("doc"), strict=True)]
            matched = [sum(k for *_, k in g) for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("item_id"), b.column("n"), pa.array(matched, pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array([max((k for *_, k in g), default=0) for g in got], pa.int64())],
                ["rid", "item_id", "item_tokens", "matched_tokens", "tiles", "longest_tile"],
            )
        release_memory()

    return run


RID = "struct<doc_id: bigint, body: bigint>"


def matches(docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling()) -> DataFrame:
    """One row per contaminated text and item: rid (doc_id and a hash of the text), item_id, item_tokens, matched_tokens, tiles, longest_tile, coverage."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tiling")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("iid", F.xxhash64("item_id", "text")).mapInArrow(_items(p), "item_id bigint, iid bigint, n bigint, tokens binary, seeds array<bigint>")
    items = scratch.write(items.where(f"n >= {p.least}"), "items")
    seeds = scratch.write(items.select("iid", "n", F.posexplode("seeds").alias("pos", "h")), "seeds")
    held = spark.sparkContext.broadcast(seed_filter(seeds.select("h"), p.log2_bits))
    rows = docs.where("text is not null").select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("body")).alias("rid"), F.col("text").cast("string").alias("text"))
    hit = rows.mapInArrow(_hits(p, held), f"rid {RID}, hits array<bigint>, tokens binary").dropDuplicates(["rid"])
    hit = scratch.write(hit, "hit")
    held.destroy()
    # A tile of k tokens holds a seed for each ``least`` of them, so a pair that covers enough shares as many of the item's seeds,
    # and one of them at least among the rarest.
    held_by = hit.select(F.explode("hits").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    shared = F.ceil(F.ceil(F.col("n") * F.lit(p.coverage) - 1e-9) / p.least)
    common = Window.partitionBy("iid").orderBy(F.desc("f"), "pos")  # the seeds of one item
    telling = seeds.join(held_by, "h", "left").fillna(0, ["f"]).withColumn("k", F.row_number().over(common)).where((F.col("k") >= shared) & (F.col("f") > 0))
    pairs = hit.select("rid", F.explode("hits").alias("h")).join(telling.select("h", "iid").distinct(), "h").select("rid", "iid").distinct()
    both = pairs.join(hit.select("rid", F.col("tokens").alias("doc")), "rid").join(items.select("iid", "item_id", "n", F.col("tokens").alias("item")), "iid")
    tiled = both.select("rid", "item_id", "n", "doc", "item").mapInArrow(_tile(p), f"rid {RID}, item_id bigint, item_tokens bigint, matched_tokens bigint, tiles bigint, longest_tile bigint")
    return tiled.withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens")).where(F.col("coverage") >= p.coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling()) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, item_tokens, matched_tokens, tiles, longest_tile, coverage.

    Null or empty texts and items of fewer than ``least`` tokens match nothing; a null item_id takes no part.
    Texts with a null doc_id are judged like others, as texts of one id.  Repeated rows count once; where an id repeats with several texts its best pair
    counts.  An empty table on either side gives no rows.  Other columns are not read.
    """
    best = F.max(F.struct("coverage", "longest_tile", "matched_tokens", "item_tokens", F.negative("tiles").alias("less"))).alias("b")
    tiled = matches(docs, benchmark, p).groupBy(F.col("rid.doc_id").alias("doc_id"), "item_id").agg(best)
    return tiled.select("doc_id", "item_id", "b.item_tokens", "b.matched_tokens", F.negative("b.less").alias("tiles"), "b.longest_tile", "b.coverage")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling()) -> DataFrame:
    """docs without the rows whose own text is contaminated; other texts of the same id, null or not, stay."""
    gone = matches(docs, benchmark, p).select(F.col("rid.doc_id").alias("_gl_i"), F.col("rid.body").alias("_gl_b")).distinct()
    gone = if_small(Scratch(docs.sparkSession, "contaminated").write(gone, "gone"))
    keyed = docs.withColumn("_gl_id", F.col("doc_id").cast("bigint")).withColumn("_gl_body", F.xxhash64(F.col("text").cast("string")))
    return keyed.join(gone, F.col("_gl_id").eqNullSafe(F.col("_gl_i")) & (F.col("_gl_body") == F.col("_gl_b")), "left_anti").select(*docs.columns)


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of documents and benchmark that is contaminated; see contaminated for the columns and odd rows."""
    return contaminated(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))
