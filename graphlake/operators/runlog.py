"""Run logs: runlog(run, label, iter, value), and runs(run, at, config) with configurations as VARIANT."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series(log: DataFrame, run: int, label: str) -> DataFrame:
    return log.where((F.col("run") == run) & (F.col("label") == label)).select("iter", "value").orderBy("iter")


def best_epoch(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(run, iter, val, test): the first greatest validation accuracy of each run, of the epochs to ``upto`` and with it, and the test accuracy at that epoch."""
    rows = log if upto is None else log.where(F.col("iter") <= upto)
    first = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("value"), "iter"))
    val = rows.where("label = 'val/acc'").withColumn("_k", first).where("_k = 1").select("run", "iter", F.col("value").alias("val"))
    return val.join(rows.where("label = 'test/acc'").select("run", "iter", F.col("value").alias("test")), ["run", "iter"], "left")


def mean_and_std(best: DataFrame) -> DataFrame:
    """One row, in percent: mean and sample deviation of validation and test accuracy over the runs."""
    return best.agg(*(f((F.col(c) * 100)).alias(f"{c}_{n}") for c in ("val", "test") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def curves(log: DataFrame, label: str) -> DataFrame:
    return log.where(F.col("label") == label).groupBy("iter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("runs"))


def with_configs(runs: DataFrame, column: str = "config") -> DataFrame:
    """runs with a column of JSON text as VARIANT: configurations of any shape in one table."""
    return runs.withColumn(column, F.parse_json(column))


def select_runs(runs: DataFrame, filters: dict, since=None, until=None) -> DataFrame:
    """Rows of runs(..., config, at) whose configuration has the given values; at in [since, until).

    config is a VARIANT or a struct.  Nested filters are paths; lists are compared item by item, so a longer list with the same beginning
    matches; a configuration without the path does not match, nor does a text that only looks like the number asked for.
    """
    is_variant = runs.schema["config"].dataType.typeName() == "variant"

    def value(steps: list) -> Column:
        if is_variant:
            path = "$" + "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in steps)
            return F.to_json(F.try_variant_get("config", path, "variant"))
        c = F.col("config")
        for x in steps:
            c = F.get(c, F.lit(x)) if isinstance(x, int) else c[x]
        return c

    def conditions(steps: list, want):
        if isinstance(want, dict):
            for k, v in want.items():
                yield from conditions([*steps, k], v)
        elif isinstance(want, (list, tuple)):
            for i, x in enumerate(want):
                yield from conditions([*steps, i], x)
        elif is_variant and isinstance(want, (int, float)) and not isinstance(want, bool):
            # Whole numbers and others are equal by value; quoted ones are texts.
            yield ~value(steps).startswith('"') & (value(steps).try_cast("double") == float(want))
        else:
            yield value(steps) == (F.lit(json.dumps(want, ensure_ascii=False)) if is_variant else F.lit(want))

    for c in conditions([], filters):
        runs = runs.where(F.coalesce(c, F.lit(False)))
    runs = runs if since is None else runs.where(F.col("at") >= since)
    return runs if until is None else runs.where(F.col("at") < until)


def append(log: DataFrame, path: str, config: dict) -> str:
    """Adds a log under the digest of its configuration and returns that; earlier logs of it stay."""
    key = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    log.withColumn("config", F.lit(key)).write.mode("append").partitionBy("config").parquet(path)
    return key


def write_store(log: DataFrame, runs: DataFrame, path: str) -> None:
    """Adds runs(run, at, config VARIANT) and their log(run, label, iter, value) to a store; logs of all configurations lie in one table, by label."""
    log.write.mode("append").partitionBy("label").parquet(f"{path}/log")
    runs.write.mode("append").parquet(f"{path}/runs")


def read_store(spark: SparkSession, path: str, filters: dict | None = None, since=None, until=None) -> tuple[DataFrame, DataFrame]:
    """(log, runs) of the store's runs that select_runs takes."""
    runs = select_runs(spark.read.parquet(f"{path}/runs"), filters or {}, since, until)
    return spark.read.parquet(f"{path}/log").join(runs.select("run"), "run", "left_semi"), runs
