"""Tables that cut a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="diurna-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder: a lost executor costs a file read, not the plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Spark's setting for an action to remove its shuffles' files at its end.
REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffles' files at their end: for plans made and run once, inside.

    Else the files stay until the driver's garbage is collected.
    """
    before = spark.conf.get(REMOVAL, None)
    spark.conf.set(REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVAL)
        else:
            spark.conf.set(REMOVAL, before)
