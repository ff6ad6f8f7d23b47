"""Small helpers that the operators share on the Spark side."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names in
    spark.checkpoint.dir or by setCheckpointDir. Where none is set, a session in
    one process (local mode, as in tests) gets a folder of its own; on a cluster
    that is an error, as one machine's folder isn't seen by the others."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = "file://" + tempfile.mkdtemp(prefix="searchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage
    and survives lost executors. options are those of the writer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `written`, once all that was made of
    them is written itself. Spark deletes shuffle files when the driver collects
    its garbage, so it is told to: a job of many tables would hold them all."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def with_rest(df: DataFrame, **kinds: str):
    """The schema of df's column rest, whatever its fields' names, and of kinds."""
    from pyspark.sql.types import StructType

    return StructType([df.schema["rest"], *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])


def blocks_of(n_rows: int, size: int) -> int:
    return max(1, math.ceil(n_rows / size))


def spread(n: int):
    """A block number below n for each row, even over any keys and the same when
    a task runs again over the same split."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
