"""Where intermediate tables go, for every part of the library."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_SHIPPING = threading.Lock()
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run; once per session."""
    with _SHIPPING:  # tables are written side by side
        _ship(spark)


def _ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftgraph-"), "weftgraph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("weftgraph", os.path.relpath(full, here)))
    sc.addPyFile(path)
    # Texts are long: what goes to a Python worker at once is bounded by bytes, not only by rows.
    if spark.conf.get(_ARROW_BYTES, None) in (None, "", "-1", str(2**63 - 1), "67108864", "64MB", "64m"):
        spark.conf.set(_ARROW_BYTES, str(4 << 20))
    sc._weftgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder; on a
    cluster that would lose data with its machine, so it is an error there.
    """
    ship(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, int]:
    """`stage`, and the number of rows, counted while they are written."""
    seen = Observation()
    return stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name, codec), seen.get["n"]


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is never broadcast, nor is the other side.

    Left to itself the planner takes a table's compressed size on disk for its
    size, and broadcasts what is many times that in the driver's memory. Sides
    that were counted and are small have `F.broadcast` instead.
    """
    return df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a workspace path that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
