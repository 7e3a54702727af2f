"""Written tables that cut the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions on one machine (tests, a laptop).
DEFAULT = "/tmp/graphlake-scratch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Without one a local session gets a default; on a cluster, where executors do not see each other's folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] not in ("local", "local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or DEFAULT).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session is gone, and its folder with it or left to the cluster
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written once and read back; a lost executor loses nothing of it.  The table goes when the process ends."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the table behind a df that cut() returned, once nothing reads it any more; what cut() did not return stays as it is."""
    path = vars(df).pop("_gl_path", None)
    if path:
        delete(df.sparkSession, path)


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_folder(spark)}/graphlake/{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path
