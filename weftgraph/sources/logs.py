"""Build logs (text) and deps logs (binary): reading, last entry wins, compaction, writing.

Scans go through Spark's ``binaryFile`` reader with the path's file name made
visible: Spark's file sources pass over names that begin with a dot, so a log
is read by its parent folder's listing on the driver (`read_bytes`) or, for
many logs, from a table of (path, content).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the formats.
BUILD_LOG_HEADER = "# ninja log v"
BUILD_LOG_VERSIONS = (7, 7)  # oldest and newest that are read
DEPS_LOG_SIGNATURE = b"# ninjadeps\n"
DEPS_LOG_VERSION = 4
MAX_RECORD = (1 << 19) - 1
#: A log is rewritten when it has more entries than this, and more than three for each key.
BUILD_LOG_LEAST, DEPS_LOG_LEAST, RATIO = 100, 1000, 3

BUILD_LOG = "line_no long, output string, start_ms int, end_ms int, mtime long, hash string"
DEPS_LOG = "rec_no long, output string, mtime long, pos int, input string"


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file's bytes through Hadoop's file system, whatever its name; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


# Build logs.


def build_log_entries(lines: DataFrame) -> DataFrame:
    """Entries of a log's lines (line_no, line), header included; short lines are passed over, bad numbers are 0."""
    text = F.regexp_replace("line", r"[\r\n]+$", "")
    f = F.split(text, "\t", 5)
    number = lambda k, kind: F.coalesce(F.trim(F.get(f, F.lit(k))).try_cast(kind), F.lit(0).cast(kind))
    # A plain cast also reads "1.5" and "1e3"; a log's numbers are digits alone.
    whole = lambda k, kind: F.when(F.trim(F.get(f, F.lit(k))).rlike(r"^[+-]?\d+$"), number(k, kind)).otherwise(F.lit(0).cast(kind))
    hexed = F.lower(F.trim(F.get(f, F.lit(4))))
    hashed = F.when(hexed.rlike("^0*[0-9a-f]{1,16}$"), F.regexp_replace(hexed, "^0+(?=.)", "")).otherwise("0")
    is_entry = (F.size(f) == 5) & ~F.col("line").startswith(BUILD_LOG_HEADER)
    return lines.where(is_entry).select("line_no", F.get(f, F.lit(3)).alias("output"), whole(0, "int").alias("start_ms"), whole(1, "int").alias("end_ms"), whole(2, "bigint").alias("mtime"), hashed.alias("hash"))


def log_state(header: str | None) -> str:
    """ok, empty, old or new, by a log's first line; old and new logs are dropped and started over."""
    if header is None:
        return "empty"
    m = re.fullmatch(re.escape(BUILD_LOG_HEADER) + r"\s*(\d+)\s*", header)
    version = int(m[1]) if m else 0
    return "old" if version < BUILD_LOG_VERSIONS[0] else "new" if version > BUILD_LOG_VERSIONS[1] else "ok"


def read_build_log(spark: SparkSession, path: str) -> DataFrame:
    """A log's entries in file order; none if it is missing or of another version."""
    raw = read_bytes(spark, path)
    lines = [x for x in (raw or b"").decode(errors="replace").split("\n") if x]
    if log_state(lines[0] if lines else None) != "ok":
        lines = []
    return build_log_entries(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))


def last_entries(log: DataFrame, key: str = "output", order: str = "line_no") -> DataFrame:
    """The last entry of each key. An aggregate, not a window: partial sums on the map side, and no key is gathered whole."""
    others = [c for c in log.columns if c not in (key, order)]
    best = F.max_by(F.struct(*others), order).alias("e")
    return log.groupBy(key).agg(F.max(order).alias(order), best).select(order, key, *[F.col(f"e.{c}").alias(c) for c in others]).select(*log.columns)


def needs_compaction(log: DataFrame, key: str = "output", least: int = BUILD_LOG_LEAST, unit: str | None = None) -> DataFrame:
    """One row: total, kept and whether the log should be rewritten."""
    total = F.count("*") if unit is None else F.countDistinct(unit)
    return log.agg(total.alias("total"), F.countDistinct(key).alias("kept")).withColumn("compact", (F.col("total") > least) & (F.col("total") > RATIO * F.col("kept")))


def format_entry() -> Column:
    """A log line of an entry."""
    return F.concat_ws("\t", "start_ms", "end_ms", "mtime", "output", "hash")


def record_command(log: DataFrame, finished: DataFrame) -> DataFrame:
    """The log with entries for every output of finished commands (output, start_ms, end_ms, mtime, hash, seq, pos) appended in order."""
    base = log.agg(F.coalesce(F.max("line_no"), F.lit(-1)).alias("base"))
    rows = finished.withColumn("k", F.row_number().over(Window.orderBy("seq", "pos"))).crossJoin(F.broadcast(base))
    return log.unionByName(rows.select((F.col("base") + F.col("k")).alias("line_no"), "output", "start_ms", "end_ms", "mtime", "hash"))


def restat(log: DataFrame, files: DataFrame, outputs: list[str] | None = None) -> DataFrame:
    """The last entries with modification times taken again from a snapshot, for all or some outputs; gone files have 0."""
    kept = last_entries(log).join(files.select(F.col("path").alias("output"), F.col("mtime").alias("now")), "output", "left")
    chosen = F.lit(True) if not outputs else F.col("output").isin(outputs)
    return kept.withColumn("mtime", F.when(chosen, F.coalesce("now", F.lit(0))).otherwise(F.col("mtime"))).select(*log.columns)


def build_log_text(entries: DataFrame) -> DataFrame:
    """Lines of a rewritten log, sorted by output, the header first: (line_no, line)."""
    body = entries.orderBy("output").select(format_entry().alias("line"))
    head = entries.sparkSession.createDataFrame([(f"{BUILD_LOG_HEADER}{BUILD_LOG_VERSIONS[1]}",)], "line string")
    return head.unionAll(body)


# Deps logs.


def decode_deps(content: bytes) -> tuple[list[tuple[int, int, int, list[int]]], list[str], str | None]:
    """(records (number, output id, mtime, input ids), paths by id, warning) of a deps log; reading ends at the first bad record."""
    head = len(DEPS_LOG_SIGNATURE) + 4
    if content[: len(DEPS_LOG_SIGNATURE)] != DEPS_LOG_SIGNATURE or len(content) < head or struct.unpack_from("<i", content, head - 4)[0] != DEPS_LOG_VERSION:
        return [], [], "bad deps log signature or version; starting over" if content else None
    records: list[tuple[int, int, int, list[int]]] = []
    paths: list[str] = []
    at, k = head, 0
    while at < len(content):
        if at + 4 > len(content):
            return records, paths, "premature end of file; recovering"
        size = struct.unpack_from("<I", content, at)[0]
        is_deps, size = bool(size >> 31), size & 0x7FFFFFFF
        body = content[at + 4 : at + 4 + size]
        if len(body) < size or size > MAX_RECORD or size % 4:
            return records, paths, "premature end of file; recovering"
        if is_deps:
            if size < 12:
                return records, paths, "premature end of file; recovering"
            ids = struct.unpack(f"<{size // 4}I", body)
            mtime = struct.unpack("<q", body[4:12])[0]
            if any(i >= len(paths) for i in (ids[0], *ids[3:])):
                return records, paths, "premature end of file; recovering"
            records.append((k, ids[0], mtime, list(ids[3:])))
        else:
            if size < 4 or struct.unpack("<I", body[-4:])[0] ^ 0xFFFFFFFF != len(paths):
                return records, paths, "premature end of file; recovering"
            paths.append(re.sub(rb"\0{1,3}$", b"", body[:-4]).decode(errors="replace"))
        at += 4 + size
        k += 1
    return records, paths, None


def encode_deps(records: list[tuple[str, int, list[str]]]) -> bytes:
    """A deps log of (output, mtime, inputs); ids in order of first use, a repeated record of the same content left out."""
    out = bytearray(DEPS_LOG_SIGNATURE + struct.pack("<i", DEPS_LOG_VERSION))
    ids: dict[str, int] = {}
    seen: dict[str, tuple[int, list[str]]] = {}
    for output, mtime, inputs in records:
        if seen.get(output) == (mtime, inputs):
            continue
        seen[output] = (mtime, inputs)
        for path in (output, *inputs):
            if path not in ids:
                raw = path.encode()
                raw += b"\0" * (-len(raw) % 4)
                if len(raw) + 4 > MAX_RECORD:
                    raise ValueError("a path is too long for the deps log")
                out += struct.pack("<I", len(raw) + 4) + raw + struct.pack("<I", len(ids) ^ 0xFFFFFFFF)
                ids[path] = len(ids)
        body = struct.pack("<Iq", ids[output], mtime) + struct.pack(f"<{len(inputs)}I", *[ids[x] for x in inputs])
        if len(body) > MAX_RECORD:
            raise ValueError("too many dependencies for one record")
        out += struct.pack("<I", len(body) | 1 << 31) + body
    return bytes(out)


def deps_rows(content: bytes) -> Iterator[tuple[int, str, int, int, str | None]]:
    """Rows of DEPS_LOG; a record without inputs is one row with a null input."""
    records, paths, _ = decode_deps(content)
    for k, out, mtime, ins in records:
        if not ins:
            yield k, paths[out], mtime, -1, None
        for pos, i in enumerate(ins):
            yield k, paths[out], mtime, pos, paths[i]


class DepsLogSource(DataSource):
    """``spark.read.format("deps_log").load(paths)``: one partition per file, as ids count within a file."""

    @classmethod
    def name(cls) -> str:
        return "deps_log"

    def schema(self) -> str:
        return DEPS_LOG

    def reader(self, schema) -> DataSourceReader:
        return _DepsReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DepsWriter(self.options)


class _DepsReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [x for x in options.get("path", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value)
        with where.open_input_file(path) as f:
            yield from deps_rows(f.read())


class _DepsWriter(DataSourceWriter):
    """Writes one log; the rows must come in one partition (`coalesce(1)`), sorted by rec_no and pos."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        records: dict[int, tuple[str, int, list[str]]] = {}
        for r in rows:
            records.setdefault(r.rec_no, (r.output, r.mtime, []))
            if r.input is not None:
                records[r.rec_no][2].append(r.input)
        if records:
            where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
            with where.open_output_stream(path) as f:
                f.write(encode_deps([records[k] for k in sorted(records)]))
        return WriterCommitMessage()


def read_deps_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(deps_rows(read_bytes(spark, path) or b"")), DEPS_LOG)


def scan_deps_logs(files: DataFrame) -> DataFrame:
    """Many logs at once, from a table (path, content): their rows with the path, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, *r) for path, content in zip(part["path"], part["content"], strict=True) for r in deps_rows(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "rec_no", "output", "mtime", "pos", "input"])

    return files.select("path", "content").mapInPandas(run, f"path string, {DEPS_LOG}")


def last_deps(log: DataFrame) -> DataFrame:
    """The rows of the last record of each output."""
    last = log.groupBy("output").agg(F.max("rec_no").alias("rec_no"))
    return log.join(last, ["output", "rec_no"]).select(*log.columns)


def record_deps(log: DataFrame, new: DataFrame) -> DataFrame:
    """Records of `new` (output, mtime, inputs array) that say something else than the log's last ones, as rows of the log."""
    had = last_deps(log).groupBy("output").agg(F.first("mtime").alias("old_mtime"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "input"))), lambda x: x["input"]).alias("old"))
    # A record without inputs is one row with a null, which collects as [null].
    had = had.withColumn("old", F.filter("old", lambda x: x.isNotNull()))
    changed = new.join(had, "output", "left").where(~(F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("inputs").eqNullSafe(F.col("old"))))
    base = log.agg(F.coalesce(F.max("rec_no"), F.lit(-1)).alias("base"))
    numbered = changed.withColumn("k", F.row_number().over(Window.orderBy("output"))).crossJoin(F.broadcast(base))
    return numbered.select((F.col("base") + F.col("k")).alias("rec_no"), "output", "mtime", F.posexplode_outer("inputs").alias("pos", "input")).withColumn("pos", F.coalesce("pos", F.lit(-1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DepsLogSource)
