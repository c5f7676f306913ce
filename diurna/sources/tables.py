"""CSV files read by the names in their own headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that holds a line with too few or too many values.
_ODD = "_odd_line"


def files_of(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that ``paths`` name: files, folders or patterns.  Contents aren't read; empty files are left out."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(list(paths)).select("path").collect())


def headers(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their headers: the first line of each, without a byte-order mark."""
    out: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        out.setdefault(tuple(spark.read.option("header", True).csv(f).columns), []).append(f)
    return out


def refused_files(spark: SparkSession, paths: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Files that lack columns: ``file, missing`` (a list of names)."""
    rows = [(f, [n for n in names if n not in header]) for header, files in headers(spark, files_of(spark, paths)).items() for f in files]
    return spark.createDataFrame([r for r in rows if r[1]], "file string, missing array<string>")


def _scans(spark: SparkSession, paths: Sequence[str], names: Sequence[str]) -> list[tuple[tuple[str, ...], DataFrame]]:
    """One scan for each header, its columns as texts; a file that lacks a name is an error."""
    found = headers(spark, files_of(spark, paths))
    lacking = [f"{f}: {sorted(missing)}" for header, files in found.items() if (missing := set(names) - set(header)) for f in files]
    if lacking:
        raise ValueError(f"missing columns: {'; '.join(lacking[:5])}" + (f" and {len(lacking) - 5} more files" if len(lacking) > 5 else ""))
    if not found:
        raise ValueError(f"no lines in {list(paths)}")
    out = []
    for header, files in sorted(found.items()):
        schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField(_ODD, T.StringType())])
        out.append((header, spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", _ODD).csv(files)))
    return out


def read_by_name(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """``names`` as texts from all files, whatever order each has its columns in.

    Files of one header are one scan, which reads the named columns only.  A
    file without a named column is refused, by its name.  A line that ends
    early lacks its last values; ``odd_lines`` lists these.
    """
    parts = [scan.select(*[F.col(f"`{n}`") for n in names]) for _, scan in _scans(spark, [paths] if isinstance(paths, str) else paths, names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def odd_lines(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Lines with fewer or more values than their header: ``file, line``."""
    parts = []
    for header, scan in _scans(spark, [paths] if isinstance(paths, str) else paths, names):
        # every column is asked for: a pruned parser doesn't count values
        whole = scan.withColumn("_all", F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in header])))
        parts.append(whole.filter((F.col("_all") >= 0) & F.col(_ODD).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(_ODD).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
