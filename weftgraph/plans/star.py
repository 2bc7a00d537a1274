"""A star schema seen as a build graph, so that every operator has tables to run on and SQL to agree with.

Outputs and what they are made of: nations of their region, customers and
suppliers of their nation, orders of their customer (explicit), their parts
(implicit) and suppliers (order-only), and phony market segments of their
orders. Regions and parts are leaves. An order's priority is its pool, and
sets restat and generator rules; every fifth order records dependencies.
Events are a log: one output per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._session import shuffled
from .graph import BuildGraph

#: Statement numbers of a kind begin here.
CUSTOMER, SUPPLIER, ORDER, SEGMENT = (k * 10**12 for k in range(1, 5))
DAY_NS = 86_400 * 10**9
POOL_DEPTHS = (("", 0), ("console", 1), ("1-URGENT", 0), ("2-HIGH", 40), ("3-MEDIUM", 30), ("4-NOT SPECIFIED", 20), ("5-LOW", 10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


def day_ns(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("long") * DAY_NS


def _segments(customers: DataFrame) -> DataFrame:
    """(segment, edge_id); the names are few."""
    names = customers.select(F.col("c_mktsegment").alias("segment")).distinct()
    return names.select("segment", (F.lit(SEGMENT).cast("long") + F.row_number().over(Window.orderBy("segment")) - 1).alias("edge_id"))


def supply_graph(spark: SparkSession, sf_dir: str) -> BuildGraph:
    t = lambda name: table(spark, sf_dir, name)
    nation, customer, supplier, orders, lineitem = (t(x) for x in ("nation", "customer", "supplier", "orders", "lineitem"))
    segments = _segments(customer)
    no, text = F.lit(False), F.lit("")

    def edge(df, number, rule, key, phony=no, pool=text, restat=no, generator=no, deps=text):
        name = F.col(key).cast("string")
        return df.select(
            number.cast("long").alias("edge_id"), F.lit(rule).alias("rule"), phony.alias("is_phony"), pool.alias("pool"), F.lit(0).alias("scope_id"), restat.alias("restat"),
            generator.alias("generator"), deps.alias("deps"), text.alias("depfile"), text.alias("dyndep"), text.alias("rspfile"), text.alias("rspfile_content"),
            F.when(phony, "").otherwise(F.concat(F.lit(f"make {rule} "), name)).alias("command"), F.concat(F.lit(f"{rule.upper()} "), name).alias("description"),
            F.concat(F.lit(rule + ":"), name).alias("command_hash"), F.concat(F.lit(rule + "/"), name).alias("out"),
        )

    priority = F.col("o_orderpriority")
    edges = edge(nation, F.col("n_nationkey"), "nation", "n_nationkey")
    edges = edges.unionByName(edge(customer, F.lit(CUSTOMER) + F.col("c_custkey"), "customer", "c_custkey"))
    edges = edges.unionByName(edge(supplier, F.lit(SUPPLIER) + F.col("s_suppkey"), "supplier", "s_suppkey"))
    edges = edges.unionByName(
        edge(orders, F.lit(ORDER) + F.col("o_orderkey"), "order", "o_orderkey", pool=priority, restat=priority == "4-NOT SPECIFIED", generator=priority == "5-LOW", deps=F.when(F.col("o_orderkey") % 5 == 0, "gcc").otherwise(""))
    )
    edges = edges.unionByName(edge(segments, F.col("edge_id"), "segment", "segment", phony=F.lit(True)))

    row = lambda number, pos, path, kind: [number.cast("long").alias("edge_id"), pos.cast("int").alias("pos"), path.alias("path"), F.lit(kind).alias("kind")]
    zero = F.lit(0)
    ins = nation.select(*row(F.col("n_nationkey"), zero, _path("region", "n_regionkey"), "explicit"))
    ins = ins.unionByName(customer.select(*row(F.lit(CUSTOMER) + F.col("c_custkey"), zero, _path("nation", "c_nationkey"), "explicit")))
    ins = ins.unionByName(supplier.select(*row(F.lit(SUPPLIER) + F.col("s_suppkey"), zero, _path("nation", "s_nationkey"), "explicit")))
    ins = ins.unionByName(orders.select(*row(F.lit(ORDER) + F.col("o_orderkey"), zero, _path("customer", "o_custkey"), "explicit")))
    order = F.lit(ORDER) + F.col("l_orderkey")
    ins = ins.unionByName(lineitem.select("l_orderkey", "l_partkey").distinct().select(*row(order, 1 + F.col("l_partkey"), _path("part", "l_partkey"), "implicit")))
    ins = ins.unionByName(lineitem.select("l_orderkey", "l_suppkey").distinct().select(*row(order, 10**9 + F.col("l_suppkey"), _path("supplier", "l_suppkey"), "order_only")))
    of_segment = orders.join(shuffled(customer), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(segments), F.col("c_mktsegment") == F.col("segment"))  # a row per segment
    ins = ins.unionByName(of_segment.select(*row(F.col("edge_id"), F.col("o_orderkey"), _path("order", "o_orderkey"), "explicit")))

    outs = edges.select("edge_id", F.lit(0).alias("pos"), F.col("out").alias("path"), F.lit(False).alias("implicit"))
    file = lambda df, path, mtime: df.select(path.alias("path"), mtime.cast("long").alias("mtime"))
    files = file(t("region"), _path("region", "r_regionkey"), F.lit(1000)).unionByName(file(nation, _path("nation", "n_nationkey"), F.lit(2000)))
    files = files.unionByName(file(customer, _path("customer", "c_custkey"), F.lit(3000))).unionByName(file(supplier, _path("supplier", "s_suppkey"), F.lit(4000)))
    files = files.unionByName(lineitem.groupBy("l_partkey").agg(F.min(day_ns("l_shipdate")).alias("m")).select(_path("part", "l_partkey").alias("path"), F.col("m").alias("mtime")))
    files = files.unionByName(file(orders.where("o_orderkey % 13 <> 0"), _path("order", "o_orderkey"), day_ns("o_orderdate")))
    return BuildGraph(
        edges=edges.drop("out"), edge_inputs=ins, edge_outputs=outs,
        edge_validations=orders.where("o_orderkey % 101 = 0").select((F.lit(ORDER) + F.col("o_orderkey")).alias("edge_id"), zero.alias("pos"), _path("supplier", "o_orderkey").alias("path")).join(shuffled(supplier.select(_path("supplier", "s_suppkey").alias("path"))), "path", "left_semi").select("edge_id", "pos", "path"),
        defaults=spark.createDataFrame([], "pos int, path string"), pools=spark.createDataFrame(list(POOL_DEPTHS), "name string, depth int"),
        files=files, build_log=build_log(spark, sf_dir), deps_log=deps_log(spark, sf_dir),
    )


def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last entries: customers, suppliers and most orders, some with another command or an older time."""
    t = lambda name: table(spark, sf_dir, name)

    def entry(df, rule, key, mtime, hashed, took):
        return df.select(F.col(key).cast("long").alias("line_no"), _path(rule, key).alias("output"), F.lit(0).alias("start_ms"), took.cast("int").alias("end_ms"), mtime.cast("long").alias("mtime"), hashed.alias("hash"))

    own = lambda rule, key: F.concat(F.lit(rule + ":"), F.col(key).cast("string"))
    log = entry(t("nation"), "nation", "n_nationkey", F.lit(2000), own("nation", "n_nationkey"), F.col("n_nationkey"))
    log = log.unionByName(entry(t("customer"), "customer", "c_custkey", F.lit(3000), own("customer", "c_custkey"), F.col("c_custkey") % 50))
    log = log.unionByName(entry(t("supplier"), "supplier", "s_suppkey", F.lit(4000), own("supplier", "s_suppkey"), F.col("s_suppkey") % 50))
    key = F.col("o_orderkey")
    hashed = F.when(key % 7 == 0, "changed").otherwise(own("order", "o_orderkey"))
    return log.unionByName(entry(t("orders").where("o_orderkey % 11 <> 0"), "order", "o_orderkey", day_ns("o_orderdate") - (key % 3) * DAY_NS, hashed, key % 997))


def deps_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every fifth order: its suppliers and one more customer; every tenth record is too old, every 25th order has none."""
    orders, lineitem, customer = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    some = orders.where("o_orderkey % 5 = 0 and o_orderkey % 25 <> 0").select("o_orderkey", (day_ns("o_orderdate") - F.when(F.col("o_orderkey") % 10 == 0, DAY_NS).otherwise(0)).alias("mtime"), (F.col("o_custkey") * 7 % 100).alias("other"))
    by_line = some.join(shuffled(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()), "o_orderkey").select("o_orderkey", "mtime", F.col("l_suppkey").cast("int").alias("pos"), _path("supplier", "l_suppkey").alias("input"))
    more = some.join(shuffled(customer.select(F.col("c_custkey").alias("other"))), "other").select("o_orderkey", "mtime", F.lit(10**9).alias("pos"), _path("customer", "other").alias("input"))
    return by_line.unionByName(more).select(F.col("o_orderkey").alias("rec_no"), _path("order", "o_orderkey").alias("output"), "mtime", "pos", "input")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a build log: an output per user."""
    ms = F.floor(F.col("value") * 100).cast("int")
    start = (F.col("event_id") * 50).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), _path("user", "user_id").alias("output"), start.alias("start_ms"), (start + ms).alias("end_ms"), F.col("event_id").alias("mtime"), F.col("event_type").alias("hash"))


def event_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): each event made of the user's event before it."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), before.alias("parent"))


# The same relations for DuckDB.
SQL = """
seg AS (SELECT c_mktsegment AS segment, 4000000000000 + row_number() OVER (ORDER BY c_mktsegment) - 1 AS edge_id FROM (SELECT DISTINCT c_mktsegment FROM customer)),
edges(edge_id, rule, is_phony, pool, restat, generator, deps, command, command_hash, path) AS (
  SELECT n_nationkey::BIGINT, 'nation', false, '', false, false, '', 'make nation ' || n_nationkey, 'nation:' || n_nationkey, 'nation/' || n_nationkey FROM nation
  UNION ALL SELECT 1000000000000 + c_custkey, 'customer', false, '', false, false, '', 'make customer ' || c_custkey, 'customer:' || c_custkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 'supplier', false, '', false, false, '', 'make supplier ' || s_suppkey, 'supplier:' || s_suppkey, 'supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 3000000000000 + o_orderkey, 'order', false, o_orderpriority, o_orderpriority = '4-NOT SPECIFIED', o_orderpriority = '5-LOW', CASE WHEN o_orderkey % 5 = 0 THEN 'gcc' ELSE '' END, 'make order ' || o_orderkey, 'order:' || o_orderkey, 'order/' || o_orderkey FROM orders
  UNION ALL SELECT edge_id, 'segment', true, '', false, false, '', '', 'segment:' || segment, 'segment/' || segment FROM seg),
edge_inputs(edge_id, pos, path, kind) AS (
  SELECT n_nationkey::BIGINT, 0, 'region/' || n_regionkey, 'explicit' FROM nation
  UNION ALL SELECT 1000000000000 + c_custkey, 0, 'nation/' || c_nationkey, 'explicit' FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 0, 'nation/' || s_nationkey, 'explicit' FROM supplier
  UNION ALL SELECT 3000000000000 + o_orderkey, 0, 'customer/' || o_custkey, 'explicit' FROM orders
  UNION ALL SELECT DISTINCT 3000000000000 + l_orderkey, 1 + l_partkey, 'part/' || l_partkey, 'implicit' FROM lineitem
  UNION ALL SELECT DISTINCT 3000000000000 + l_orderkey, 1000000000 + l_suppkey, 'supplier/' || l_suppkey, 'order_only' FROM lineitem
  UNION ALL SELECT seg.edge_id, o_orderkey, 'order/' || o_orderkey, 'explicit' FROM orders JOIN customer ON o_custkey = c_custkey JOIN seg ON segment = c_mktsegment),
files(path, mtime) AS (
  SELECT 'region/' || r_regionkey, 1000::BIGINT FROM region UNION ALL SELECT 'nation/' || n_nationkey, 2000 FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 3000 FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 4000 FROM supplier
  UNION ALL SELECT 'part/' || l_partkey, min(l_shipdate::DATE - DATE '1970-01-01') * 86400000000000 FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT 'order/' || o_orderkey, (o_orderdate::DATE - DATE '1970-01-01') * 86400000000000 FROM orders WHERE o_orderkey % 13 <> 0),
build_log(output, mtime, hash, took) AS (
  SELECT 'nation/' || n_nationkey, 2000::BIGINT, 'nation:' || n_nationkey, n_nationkey::BIGINT FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 3000, 'customer:' || c_custkey, c_custkey % 50 FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 4000, 'supplier:' || s_suppkey, s_suppkey % 50 FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, (o_orderdate::DATE - DATE '1970-01-01' - o_orderkey % 3) * 86400000000000, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'order:' || o_orderkey END, o_orderkey % 997 FROM orders WHERE o_orderkey % 11 <> 0),
dep_orders AS (SELECT o_orderkey, ((o_orderdate::DATE - DATE '1970-01-01') - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) * 86400000000000 AS mtime, o_custkey * 7 % 100 AS other FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 25 <> 0),
deps_log(rec_no, output, mtime, pos, input) AS (
  SELECT DISTINCT o_orderkey, 'order/' || o_orderkey, mtime, l_suppkey, 'supplier/' || l_suppkey FROM dep_orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey, 'order/' || o_orderkey, mtime, 1000000000, 'customer/' || other FROM dep_orders JOIN customer ON c_custkey = other),
event_log(line_no, output, start_ms, end_ms, mtime, hash) AS (SELECT event_id, 'user/' || user_id, event_id * 50, event_id * 50 + floor(value * 100)::INT, event_id, event_type FROM events),
links AS (SELECT DISTINCT e.edge_id AS src, i.edge_id AS dst FROM edges e JOIN edge_inputs i USING (path))
"""


def sql(body: str) -> str:
    """A query over the relations."""
    return f"WITH RECURSIVE {SQL.strip()}{body}"


__all__ = ["SQL", "build_log", "day_ns", "deps_log", "event_log", "event_parents", "sql", "supply_graph", "table"]
