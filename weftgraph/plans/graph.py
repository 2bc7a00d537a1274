"""A build graph as a bundle of relations."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._session import shuffled, stage
from ..sources.dyndep import DYNDEPS
from ..sources.files import FILES
from ..sources.logs import BUILD_LOG, DEPS_LOG
from ..sources.manifest import SCHEMAS, Manifest

DEPFILES = "path string, outs array<string>, ins array<string>"


@dataclass(frozen=True)
class BuildGraph:
    """The relations of one tree, each a DataFrame; see `sources.manifest.SCHEMAS` for their columns.

    edge_inputs is a bag: a statement may name an input twice. A path has at
    most one producing statement (`checks`). Absent logs are None, which
    differs from empty ones: without a build log commands are not compared.
    """

    edges: DataFrame
    edge_inputs: DataFrame
    edge_outputs: DataFrame
    edge_validations: DataFrame
    defaults: DataFrame
    pools: DataFrame | None = None
    nodes: DataFrame | None = None
    scopes: DataFrame | None = None
    scope_bindings: DataFrame | None = None
    rules: DataFrame | None = None
    rule_bindings: DataFrame | None = None
    files: DataFrame | None = None  # path, mtime: what exists
    build_log: DataFrame | None = None  # last entries
    deps_log: DataFrame | None = None  # last records
    depfiles: DataFrame | None = None  # path, outs, ins

    @staticmethod
    def from_manifest(spark: SparkSession, manifest: Manifest, **more: DataFrame) -> BuildGraph:
        rows = manifest.rows()
        return BuildGraph(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}, **more)

    @staticmethod
    def from_text(spark: SparkSession, text: str, read: Callable[[str], str | None] | None = None, **more: DataFrame) -> BuildGraph:
        return BuildGraph.from_manifest(spark, Manifest(read or (lambda _: None)).parse("build.ninja", text), **more)

    @staticmethod
    def load(spark: SparkSession, filename: str, **more: DataFrame) -> BuildGraph:
        return BuildGraph.from_manifest(spark, Manifest().load(filename), **more)

    @staticmethod
    def empty_files(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], FILES)

    @staticmethod
    def empty_log(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], BUILD_LOG)

    @staticmethod
    def empty_deps(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], DEPS_LOG)

    def with_(self, **changes) -> BuildGraph:
        return replace(self, **changes)

    def staged(self) -> BuildGraph:
        """The same graph with its large relations written out, side by side, for operators that read them many times."""
        names = [n for n in ("edges", "edge_inputs", "edge_outputs", "files", "build_log", "deps_log", "depfiles") if getattr(self, n) is not None]
        with ThreadPoolExecutor(len(names)) as pool:
            done = pool.map(lambda n: stage(getattr(self, n), f"graph-{n.replace('_', '-')}"), names)
            return self.with_(**dict(zip(names, done, strict=True)))

    def paths(self) -> DataFrame:
        """Every path that a statement names, once."""
        names = [x.select("path") for x in (self.edge_inputs, self.edge_outputs, self.edge_validations)]
        return names[0].unionByName(names[1]).unionByName(names[2]).distinct()

    def node_ids(self) -> DataFrame:
        """(node_id, path): ids by first mention, outputs of a statement before its inputs and validations."""
        at = lambda df, part: df.select("path", F.struct("edge_id", F.lit(part).alias("part"), "pos").alias("at"))
        seen = at(self.edge_outputs, 0).unionByName(at(self.edge_inputs, 1)).unionByName(at(self.edge_validations, 2)).groupBy("path").agg(F.min("at").alias("at"))
        # Ids are dense by definition, so one global order is needed; it is of distinct paths only.
        from pyspark.sql import Window

        return seen.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("node_id"), "path")

    def links(self, kinds: list[str] | None = None) -> DataFrame:
        """(src, dst): dst uses an output of src; kinds: only by such inputs."""
        ins = self.edge_inputs if kinds is None else self.edge_inputs.where(F.col("kind").isin(kinds))
        return self.edge_outputs.select("path", F.col("edge_id").alias("src")).join(shuffled(ins.select("path", F.col("edge_id").alias("dst"))), "path").select("src", "dst").distinct()

    def root_nodes(self) -> DataFrame:
        """Outputs that no statement uses."""
        return self.edge_outputs.select("path").join(self.edge_inputs.select("path"), "path", "left_anti").distinct()

    def default_nodes(self) -> DataFrame:
        """The targets of a build that names none: the defaults, or else the roots."""
        named = self.defaults.select("path")
        none = self.defaults.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("x"))
        return named.unionByName(self.root_nodes().join(F.broadcast(none), F.lit(True), "left_semi"))

    def checks(self) -> DataFrame:
        """(path, message) of paths with several producers; empty in a sound graph."""
        by = self.edge_outputs.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("edge_id").alias("e")).where("n > 1")
        own = F.concat("path", F.lit(" is defined as an output multiple times"))
        return by.select("path", F.when(F.col("e") == 1, own).otherwise(F.concat(F.lit("multiple rules generate "), "path")).alias("message"))

    def with_dyndeps(self, dyndeps: DataFrame) -> BuildGraph:
        """The graph with what dyndep files add (see `sources.dyndep.DYNDEPS`): implicit outputs and inputs, and restat."""
        extra_in = dyndeps.select("edge_id", F.posexplode("implicit_inputs").alias("k", "path"))
        extra_out = dyndeps.select("edge_id", F.posexplode("implicit_outputs").alias("k", "path"))
        last = self.edge_outputs.groupBy("edge_id").agg(F.max("pos").alias("last"))
        outs = extra_out.join(last, "edge_id").select("edge_id", (F.col("last") + 1 + F.col("k")).cast("int").alias("pos"), "path", F.lit(True).alias("implicit"))
        flags = dyndeps.select("edge_id", F.col("restat").alias("more"))
        edges = self.edges.join(flags, "edge_id", "left").withColumn("restat", F.col("restat") | F.coalesce("more", F.lit(False))).drop("more")
        return self.with_(edges=edges.select(*self.edges.columns), edge_outputs=self.edge_outputs.unionByName(outs), edge_inputs=spliced(self.edge_inputs, extra_in))

    def dyndep_errors(self, dyndeps: DataFrame, loaded: DataFrame) -> DataFrame:
        """Messages where a statement and its dyndep file (loaded: dyndep path, edge_id mentioned) don't name each other."""
        wants = self.edges.where("dyndep <> ''").select("edge_id", "dyndep").join(loaded.select("dyndep").distinct(), "dyndep")
        first = self.edge_outputs.where("pos = 0").select("edge_id", F.col("path").alias("out"))
        silent = wants.join(loaded, ["edge_id", "dyndep"], "left_anti").join(first, "edge_id")
        other = loaded.join(self.edges.select("edge_id", "dyndep"), ["edge_id", "dyndep"], "left_anti").join(first, "edge_id")
        return silent.select(F.concat(F.lit("'"), "out", F.lit("' not mentioned in its dyndep file '"), "dyndep", F.lit("'")).alias("message")).unionByName(
            other.select(F.concat(F.lit("dyndep file '"), "dyndep", F.lit("' mentions output '"), "out", F.lit("' whose build statement does not have a dyndep binding for the file")).alias("message"))
        )


def spliced(edge_inputs: DataFrame, extra: DataFrame) -> DataFrame:
    """Inputs with implicit ones (edge_id, k, path) put in before the order-only ones; places counted again."""
    from pyspark.sql import Window

    rank = F.when(F.col("kind") == "order_only", 2).otherwise(0)
    both = edge_inputs.select("edge_id", "path", "kind", rank.alias("part"), "pos").unionByName(extra.select("edge_id", "path", F.lit("implicit").alias("kind"), F.lit(1).alias("part"), F.col("k").cast("int").alias("pos")))
    place = F.row_number().over(Window.partitionBy("edge_id").orderBy("part", "pos")) - 1
    return both.select("edge_id", place.cast("int").alias("pos"), "path", "kind")


__all__ = ["DEPFILES", "DYNDEPS", "BuildGraph", "spliced"]
