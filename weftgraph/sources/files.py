"""Snapshots of files: what a build tool would ask the disk for."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, mtime long"


def mtime_of(path: str) -> int:
    """Nanoseconds, 0 for a missing file; links are followed, and a time of 0 counts as 1."""
    try:
        return os.stat(path).st_mtime_ns or 1
    except (FileNotFoundError, NotADirectoryError):
        return 0


def snapshot(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, mtime) of the paths that exist, by the driver's disk."""
    return spark.createDataFrame([(p, m) for p in paths if (m := mtime_of(p))], FILES)


def literal(spark: SparkSession, mtimes: dict[str, int]) -> DataFrame:
    """A snapshot written by hand."""
    return spark.createDataFrame([(p, m) for p, m in mtimes.items() if m], FILES)


def actions(removed: DataFrame) -> DataFrame:
    """What a runner should do: one ``remove`` per path that exists; nothing here touches a disk."""
    return removed.select(F.lit("remove").alias("action"), "path").distinct()


def parent_folders(paths: DataFrame) -> DataFrame:
    """The folders that have to exist before the outputs of `paths` (path) are written, each with its parents."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(up).alias("path")).where("path <> ''").distinct()
