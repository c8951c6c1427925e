"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none, a local session (driver and executors in one place) gets a temporary folder; on a cluster
    that is an error, as executors would write to disks that nobody else sees.
    """
    sc = spark.sparkContext
    held = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.scratch.dir", None)
    if not held:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.scratch.dir", held)
    return held.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Remove tables made by ``scratch`` that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_quern_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
