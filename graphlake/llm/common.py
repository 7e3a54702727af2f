"""Shared plumbing: tables, scratch storage that every executor can read, size-checked helpers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions.store import delete, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class Scratch:
    """A folder of written tables that cut lineage.

    A lost executor costs nothing that was written: later stages read the files again.
    ``drop`` removes a table that later steps no longer read; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/graphlake/{what}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def _close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; only clean-up is lost
            pass


#: Bytes up to which a written table is sent to every executor; a larger one meets the other side in a shuffle.
SMALL = 16 << 20


def if_small(written: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows' sizes (16 bytes each, unless given) add up to SMALL at most."""
    got = written.agg(F.sum(F.lit(16) if size is None else size)).first()[0] or 0
    return F.broadcast(written) if got <= SMALL else written


def release_memory() -> None:
    """Gives a Python worker's freed memory back: it idles beside the executor until its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label): label is the smallest node reachable over links(a, b).

    Every round hands each node the smallest label among itself and its neighbours and then follows
    labels of labels (pointer jumping), so chains shrink geometrically.  Messages are pre-aggregated
    before the shuffle, and a hub is split by the adaptive skew join.  Each round is a written table;
    nothing but the count of changes comes to the driver.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct()
    edges = scratch.write(both, f"{tag}-edges")
    labels = scratch.write(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("label")), f"{tag}-0")
    k = 0
    while True:
        k += 1
        offered = (
            edges.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        lower = scratch.write(lower, f"{tag}-l{k}")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        now = scratch.write(now, f"{tag}-{k}")
        changed = now.where("old <> label").limit(1).count()
        labels = now.select("node", "label")
        scratch.drop(f"{tag}-l{k}")
        scratch.drop(f"{tag}-{k - 1}")
        if not changed:
            scratch.drop(f"{tag}-edges")
            return labels
