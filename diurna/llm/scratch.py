"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of one Arrow batch, so that long texts don't fill a worker.
ARROW_BATCH_BYTES = 4 << 20
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on one machine a temporary folder where unset.

    On a cluster it must be set, to a folder that all machines share: a folder
    of each machine's own would lose what other machines wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="diurna-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive executors.  All tables of an
    application lie in one folder, ``diurna-<application>``, which ``clean``
    removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/diurna-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove this application's tables, once no result is read from them any more."""
    from py4j.java_gateway import java_import

    java_import(spark._jvm, "org.apache.hadoop.fs.Path")
    path = spark._jvm.Path(f"{shared_dir(spark)}/diurna-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes unless the session has set its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)  # such as 16777216 or 16777216b
    if int("".join(c for c in now if c.isdigit())) >= 2**31 - 1:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))
