"""Session plumbing shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._session import drop_path, shared_dir, ship, stage, stage_counted, workspace

__all__ = ["drop_path", "least_hashed", "prefix_sums", "shared_dir", "ship", "stage", "stage_counted", "table", "whole_groups", "workspace"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` rows with the least hash of `keys`, or all if there are no more; for samples of a stated size.

    Rows far beyond the expected cut are left out first, so that what the
    partitions send on is about twice the sample, however many they are.
    """
    n = df.count()
    if n <= most:
        return df
    h = F.xxhash64(*keys)
    cut = int(min(1.0, 2 * most / n + 1e-6) * 2**64) - 2**63
    near = df.where(h <= F.lit(min(cut, 2**63 - 1)))
    # Many equal rows share a hash: then too few may lie below the cut.
    return (near if near.count() >= most else df).orderBy(h, *keys).limit(most)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one in the order of `order`.

    A range shuffle by the first order column makes ranges of about
    `rows_per_bucket` rows, more only where one value of it repeats; the totals
    of the ranges (one row each) give the offsets. `df` is evaluated several
    times: pass a staged table. Nulls sort first. Adds `weft_bucket` too.
    """
    first = order[0]
    n = df.count()
    n_buckets = max(1, -(-n // rows_per_bucket))
    if n_buckets > 1:
        # A range shuffle samples the cuts itself and places a row by binary search. The
        # ranges are written once, so that the numbers of the partitions stay.
        df = stage(df.repartitionByRange(n_buckets, F.col(first).asc_nulls_first()).withColumn("weft_bucket", F.spark_partition_id()), "ranges")
    else:
        df = df.withColumn("weft_bucket", F.lit(0))
    per = df.groupBy("weft_bucket").agg(F.sum(value).alias("weft_total"))
    # A row per range: the offsets are sums over those rows.
    offs = per.select("weft_bucket", F.coalesce(F.sum("weft_total").over(Window.orderBy("weft_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("weft_offset"))
    before = Window.partitionBy("weft_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
        .join(F.broadcast(offs), "weft_bucket")  # a row per range
        .withColumn(out, (F.col(out) + F.col("weft_offset")).cast("long"))
        .drop("weft_offset")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = 4096, size: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of about so many rows or bytes that hold all rows of the groups in them, from batches sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    n = n_bytes = 0
    last: tuple | None = None
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            b = batch.slice(k, 1024)
            k += 1024
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
            if n >= rows or n_bytes >= size:
                same = np.ones(b.num_rows, bool)  # as the last row
                for c in keys:
                    same &= c == c[-1]
                cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut or last != tuple(c[0] for c in keys):
                    yield pa.Table.from_batches([*held, b.slice(0, cut)])
                    held, n, n_bytes = [], 0, 0
                    b = b.slice(cut)
            held.append(b)
            n += b.num_rows
            n_bytes += b.nbytes
            last = tuple(c[-1] for c in keys)
    if held:
        yield pa.Table.from_batches(held)
