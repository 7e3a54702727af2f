"""URL rules by a sort-merge range join.

A host is keyed by its labels from the last to the first, each ended by a comma, so a host and all its
subdomains are one interval of keys and intervals either nest or lie apart.  URLs and rule intervals are
cut at the same split points; each task sweeps its URLs in key order and keeps a stack of the rules whose
interval is open.  The rules of the stack that fit the URL's path compete, and the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import Scratch, table

#: (host, path, verdict) of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@dataclass(frozen=True)
class Sweep:
    """rows: URLs a task is to sweep; sampled: keys that place the split points, a bound on what reaches the driver; parts: most tasks; otherwise: verdict without a rule."""

    rows: int = 50_000
    least_parts: int = 16
    parts: int = 10_000
    sampled: int = 50_000
    otherwise: str = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """``a.b.c`` as ``c,b,a,``; the empty host has the empty key, which no rule's interval holds."""
    # A comma within a label must not look like the end of one.
    host = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01e")), F.lit(","), F.lit("\x01c"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def _after(prefix: bytes) -> bytes:
    """The least key above all that start with prefix, which ends in a comma."""
    return prefix[:-1] + b"-"


def _assign(splits: list[bytes]):
    """Adds ``part`` to URL rows: the piece of the key space, by key and then salt, in which the row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for b in batches:
            keys = [k.encode("utf-8", "surrogatepass") + b"\0" + s.to_bytes(4, "big") for k, s in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            part = np.fromiter((bisect_right(splits, k) for k in keys), np.int32, len(keys))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return run


def _spread(splits: list[bytes]):
    """Copies a rule to each piece of the key space that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for b in batches:
            at, part = [], []
            for i, k in enumerate(b.column("key").to_pylist()):
                lo = k.encode("utf-8", "surrogatepass")
                for j in range(bisect_right(splits, lo), bisect_right(splits, _after(lo)) + 1):
                    at.append(i)
                    part.append(j)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    return run


def _sweep(otherwise: str):
    """Rows of one piece after the other, each sorted by key with rules before the URLs of the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # open intervals, outermost first: rules by path, and the paths' lengths, longest first
        piece = None
        for b in batches:
            at, rules, verdicts = [], [], []
            cols = (b.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "rule", "verdict"))
            for i, (part, key, is_url, path, rule, verdict) in enumerate(zip(*cols, strict=True)):
                if part != piece:
                    piece = part
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()  # the sweep has left this interval
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, held, lengths = stack[-1]
                    if held.get(path, ("", ""))[1] != "block":  # block before allow
                        held[path] = rule, verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, held, lengths in stack:
                    own = next((held[path[:n]] for n in lengths if n <= len(path) and path[:n] in held), None)
                    # The longest rule; of equally long ones the inner host's.
                    if own and (best is None or len(own[0]) >= len(best[0])):
                        best = own
                at.append(i)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else otherwise)
            if at:
                out = b.select(["id", "host", "path"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, p: Sweep = Sweep()) -> DataFrame:
    """One row per row of pages(id, url): id, host, path, rule, verdict, under rules(host, path, verdict).

    Null url or none with ``://``: empty host and path, no rule, the default verdict.  Null ids and
    repeated rows are rows like others.  Rules with a null or empty host take no part, a null rule path
    counts as empty, and equal rules count once (block before allow).  Without rules all get the default;
    without pages there are no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col("url").cast("string")
    urls = pages.select("id", host_of(url).alias("host"), path_of(url).alias("path"), F.hash(F.monotonically_increasing_id()).alias("salt"))
    urls = urls.withColumn("key", reversed_key(F.col("host"))).withColumn("salt", F.col("salt").cast("bigint") + 2**31)
    urls = scratch.write(urls, "urls")
    n = urls.count()
    rate = min(1.0, p.sampled / max(n, 1))
    # The split points only balance the tasks.  With the salt behind the key, a host of any size is cut too, and so are equal rows.
    picked = urls.where(F.pmod(F.xxhash64("key", "salt"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("key", "salt").limit(2 * p.sampled).toArrow()
    sample = sorted(k.encode("utf-8", "surrogatepass") + b"\0" + s.to_bytes(4, "big") for k, s in zip(picked.column("key").to_pylist(), picked.column("salt").to_pylist(), strict=True))
    parts = max(1, min(p.parts, max(p.least_parts, -(-n // p.rows)), len(sample)))
    splits = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    schema = "id {0}, host string, path string, salt bigint, key string, part int".format(urls.schema["id"].dataType.simpleString())
    left = urls.mapInArrow(_assign(splits), schema).select("part", "key", F.lit(1).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "salt")
    right = rules.where("host is not null and host <> ''").select(reversed_key(F.lower("host")).alias("key"), F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    right = right.mapInArrow(_spread(splits), "key string, host string, path string, verdict string, part int")
    right = right.select("part", "key", F.lit(0).alias("is_url"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), "path", F.concat("host", "path").alias("rule"), "verdict", F.lit(0).cast("bigint").alias("salt"))
    both = left.union(right).repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("part", "key", "is_url", "salt")
    out = "id {0}, host string, path string, rule string, verdict string".format(urls.schema["id"].dataType.simpleString())
    return both.drop("salt").mapInArrow(_sweep(p.otherwise), out)


def op4_range_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages under RULES: page_id, host, path, rule, verdict; see judge for odd rows."""
    pages = table(spark, sf_dir, "pages", ["page_id", "url"]).withColumnRenamed("page_id", "id")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).withColumnRenamed("id", "page_id")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages
), r AS (
  SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT page_id, max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) AS best
  FROM h JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM h LEFT JOIN m USING (page_id)
"""
