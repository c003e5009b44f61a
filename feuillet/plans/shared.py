"""Intermediate tables in the folder that all executors share.

A table written here replaces `checkpoint()` where a result is read more than once: it cuts the lineage, survives the
loss of executors and stays columnar. The folder is `spark.checkpoint.dir`. Only a local session without it (tests, a
laptop) gets a temporary one. Each application writes below a folder of its own, which goes when it ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application, as a URI or path. Raises RuntimeError on a cluster without a shared folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.gettempdir()
    folder = f"{configured.rstrip('/')}/feuillet-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Remove a table of `write_shared` before the application ends, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/feuillet-" in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
