"""Queries over texts and small graphs made from the star schema: what parsers, logs, scopes, names and simulation give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import closure, planning, tools
from ..sources import depfile, logs, manifest
from . import simulate, star
from .queries import query

_SUPPLIERS = "SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier"


def _trees(spark, sf_dir) -> DataFrame:
    """(tree, text): a manifest per nation, with a statement per supplier and one for all of them."""
    line = F.concat(F.lit("build s"), "s_suppkey", F.lit(".o: cc s"), "s_suppkey", F.lit(".c | n"), "s_nationkey", F.lit(".h || dir\n"))
    last = F.concat(F.lit("build lib: ar"), F.array_join(F.transform("keys", lambda x: F.concat(F.lit(" s"), x["s_suppkey"], F.lit(".o"))), ""), F.lit("\n"))
    rules = "flags = -O2\nrule cc\n  command = cc $flags -c $in -o $out\nrule ar\n  command = ar $out $in\nbuild dir: phony\n"
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("line", line)
    each = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))).alias("keys"))
    text_ = F.concat(F.lit(rules), F.array_join(F.transform("keys", lambda x: x["line"]), ""), last)
    return each.select(F.col("s_nationkey").cast("string").alias("tree"), text_.alias("text"))


@query(
    f"""WITH s AS ({_SUPPLIERS})
    SELECT s_nationkey::VARCHAR AS tree, k + 1 AS edge_id, pos, CASE pos WHEN 0 THEN 's' || s_suppkey || '.c' WHEN 1 THEN 'n' || s_nationkey || '.h' ELSE 'dir' END AS path,
           CASE pos WHEN 0 THEN 'explicit' WHEN 1 THEN 'implicit' ELSE 'order_only' END AS kind FROM s, (VALUES (0), (1), (2)) t(pos)
    UNION ALL SELECT s_nationkey::VARCHAR, count(*) OVER (PARTITION BY s_nationkey) + 1, k, 's' || s_suppkey || '.o', 'explicit' FROM s""",
    plain=True,
)
def parsed_inputs(spark, sf_dir):
    got = manifest.relation(manifest.parse_many(_trees(spark, sf_dir)), "edge_inputs")
    return got.select("tree", "edge_id", F.col("pos").cast("long").alias("pos"), "path", "kind")


@query(
    f"""WITH s AS ({_SUPPLIERS})
    SELECT s_nationkey::VARCHAR AS tree, k + 1 AS edge_id, 'cc' AS rule, 'cc -O2 -c s' || s_suppkey || '.c -o s' || s_suppkey || '.o' AS command FROM s
    UNION ALL SELECT s_nationkey::VARCHAR, count(*) + 1, 'ar', 'ar lib ' || string_agg('s' || s_suppkey || '.o', ' ' ORDER BY s_suppkey) FROM s GROUP BY s_nationkey
    UNION ALL SELECT DISTINCT s_nationkey::VARCHAR, 0, 'phony', '' FROM s""",
    plain=True,
)
def parsed_commands(spark, sf_dir):
    return manifest.relation(manifest.parse_many(_trees(spark, sf_dir)), "edges").select("tree", "edge_id", "rule", "command")


@query(
    """SELECT n_nationkey::VARCHAR AS tree, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'build.ninja:1: expected ''='', got newline' || chr(10) || 'bad' || chr(10) || '   ^ near here'
       WHEN 2 THEN 'build.ninja:1: unknown build rule ''' || n_name || '''' || chr(10) || 'build x: ' || n_name || chr(10) || repeat(' ', 9) || '^ near here'
       ELSE 'build.ninja:1: unknown target ''' || n_name || '''' || chr(10) || 'default ' || n_name || chr(10) || repeat(' ', 8 + length(n_name)) || '^ near here' END AS error FROM nation WHERE NOT contains(n_name, ' ')""",
    plain=True,
)
def manifest_errors(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where(~F.col("n_name").contains(" "))
    kind = F.col("n_nationkey") % 4
    text_ = F.when(kind == 0, F.concat(F.lit("x = "), "n_name", F.lit("\n"))).when(kind == 1, "bad\n").when(kind == 2, F.concat(F.lit("build x: "), "n_name", F.lit("\n"))).otherwise(F.concat(F.lit("default "), "n_name", F.lit("\n")))
    return manifest.parse_many(n.select(F.col("n_nationkey").cast("string").alias("tree"), text_.alias("text"))).select("tree", "error")


@query(
    f"""WITH s AS ({_SUPPLIERS}), n AS (SELECT s_nationkey, count(*) AS c FROM s GROUP BY s_nationkey)
    SELECT s_nationkey::VARCHAR AS tree, kind, c + 1 AS n_events, ((c + 1) * (c + 2) // 2)::BIGINT AS edge_ids FROM n, (VALUES ('start'), ('finish')) t(kind)""",
    plain=True,
)
def simulated_builds(spark, sf_dir):
    events = simulate.simulate_many(_trees(spark, sf_dir), parallelism=3)
    return events.groupBy("tree", "kind").agg(F.count("*").alias("n_events"), F.sum("edge_id").alias("edge_ids"))


@query("SELECT DISTINCT 'o' || l_orderkey AS out, 'p' || l_partkey || ' x.h' AS path FROM lineitem", plain=True)
def depfile_inputs(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.concat(F.lit("p"), "l_partkey", F.lit("\\ x.h")).alias("name"))
    files = lines.groupBy("l_orderkey").agg(F.concat(F.lit("o"), "l_orderkey", F.lit(": \\\n  "), F.array_join(F.sort_array(F.collect_list("name")), " \\\n  "), F.lit("\n")).alias("content"))
    got = files.select(depfile.parse_depfile(F.col("content")).alias("d")).where("d.error is null")
    return got.select(F.get("d.outs", F.lit(0)).alias("out"), F.explode("d.ins").alias("path"))


def _deps_files(spark, sf_dir) -> DataFrame:
    """(path, content): a binary log per supplier, with a record for each part it has delivered, in order of first date; the last day's record comes twice."""

    @F.pandas_udf("binary")
    def encoded(records: pd.Series) -> pd.Series:
        return records.map(lambda rows: logs.encode_deps([(r["out"], int(r["mtime"]), list(r["ins"])) for r in rows]))

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("h"), F.col("l_orderkey") % 50))).alias("ins"), F.count("*").alias("n"))
    rec = F.struct(F.col("l_partkey").alias("k"), F.concat(F.lit("p"), "l_partkey").alias("out"), F.col("n").alias("mtime"), "ins")
    each = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(rec)).alias("r"))
    return each.select(F.concat(F.lit("s"), "l_suppkey").alias("path"), encoded(F.concat("r", F.slice("r", F.lit(1), F.lit(1)))).alias("content"))


@query(
    """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey, 'h' || (l_orderkey % 50) AS input FROM lineitem), n AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT 's' || l_suppkey AS path, 'p' || l_partkey AS output, n AS mtime, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY input) - 1 AS pos, input FROM x JOIN n USING (l_suppkey, l_partkey)""",
    plain=True,
)
def deps_logs(spark, sf_dir):
    got = logs.scan_deps_logs(_deps_files(spark, sf_dir))
    return got.select("path", "output", F.col("mtime").cast("long").alias("mtime"), F.col("pos").cast("long").alias("pos"), "input")


def _scopes(spark, sf_dir):
    """A scope per region, nation and customer below the outermost one; names are bound at each level, and by some customers anew."""
    g = star.supply_graph(spark, sf_dir)
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("region", "nation", "customer"))
    r, n, c = F.col("r_regionkey") + 1, F.col("n_nationkey") + 100, F.col("c_custkey") + 1000
    rows = lambda df, *cols: df.select(*[x.cast("int" if k < 2 else "string") for k, x in enumerate(cols)])
    scopes = spark.range(1).select(F.lit(0).alias("scope_id"), F.lit(None).cast("int").alias("parent_id"))
    for df, own, up in ((region, r, F.lit(0)), (nation, n, F.col("n_regionkey") + 1), (customer, c, F.col("c_nationkey") + 100)):
        scopes = scopes.unionByName(rows(df, own, up).toDF("scope_id", "parent_id"))
    bind = lambda df, own, key, value: df.select(own.cast("int").alias("scope_id"), F.lit(key).alias("key"), value.alias("value"))
    own = customer.where("c_custkey % 3 = 0")
    bindings = bind(region, r, "area", F.col("r_name")).unionByName(bind(nation, n, "land", F.col("n_name"))).unionByName(bind(own, c, "area", F.col("c_mktsegment")))
    return g.with_(scopes=scopes, scope_bindings=bindings)


@query(
    """SELECT r_regionkey + 1 AS scope_id, 'area' AS key, r_name AS value FROM region
    UNION ALL SELECT n_nationkey + 100, 'area', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey + 100, 'land', n_name FROM nation
    UNION ALL SELECT c_custkey + 1000, 'area', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE r_name END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_custkey + 1000, 'land', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    plain=True,
)
def scope_variables(spark, sf_dir):
    return tools.scope_values(_scopes(spark, sf_dir)).select(F.col("scope_id").cast("long").alias("scope_id"), "key", "value")


@query("SELECT seq, path FROM (VALUES (0, 'segment/BUILDING'), (1, 'segment/MACHINERY')) t(seq, path)", plain=True)
def resolved_targets(spark, sf_dir):
    return tools.resolve(star.supply_graph(spark, sf_dir), ["segment/./BUILDING", "x/../segment/MACHINERY"])


@query(
    """WITH w AS (SELECT DISTINCT c_mktsegment AS word FROM customer), a AS (SELECT n_nationkey, substr(n_name, 2) AS asked FROM nation)
    SELECT n_nationkey, asked, (SELECT n_name FROM nation b WHERE levenshtein(b.n_name, a.asked) <= 3 ORDER BY levenshtein(b.n_name, a.asked), b.n_name LIMIT 1) AS said FROM a""",
    plain=True,
)
def suggestions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    words = n.agg(F.sort_array(F.collect_list("n_name")).alias("words"))  # 25 names
    return n.select("n_nationkey", F.expr("substr(n_name, 2)").alias("asked")).crossJoin(F.broadcast(words)).select("n_nationkey", "asked", text.suggestion(F.col("asked"), F.col("words")).alias("said"))


# What the star schema as a graph has no case of.


def _rings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations of a region in a ring, customers that lead to their nation, and a region behind each nation."""
    nation, customer = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    a, b = nation.select("n_regionkey", F.col("n_nationkey").alias("a")), nation.select("n_regionkey", F.col("n_nationkey").alias("b"))
    after = a.join(b, "n_regionkey").groupBy("n_regionkey", "a").agg(F.coalesce(F.min(F.when(F.col("b") > F.col("a"), F.col("b"))), F.min("b")).alias("b"))
    links = after.select(F.concat(F.lit("n"), "a").alias("src"), F.concat(F.lit("n"), "b").alias("dst"))
    links = links.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")))
    links = links.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))
    return links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct(), links


@query("SELECT 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", plain=True)
def rings(spark, sf_dir):
    return closure.cyclic(*_rings(spark, sf_dir))


@query("SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION SELECT 'r1' UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", plain=True)
def ring_members(spark, sf_dir):
    """All that leads to region 1: closure over circles."""
    _, links = _rings(spark, sf_dir)
    return closure.closure(spark.createDataFrame([("r1",)], "node string"), closure.reverse(links))


@query("SELECT 'p' || l_partkey AS path, CASE WHEN count(DISTINCT l_orderkey) = 1 THEN 'p' || l_partkey || ' is defined as an output multiple times' ELSE 'multiple rules generate p' || l_partkey END AS message FROM lineitem GROUP BY l_partkey HAVING count(*) > 1", plain=True)
def double_producers(spark, sf_dir):
    outs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("p"), "l_partkey").alias("path"))
    return star.supply_graph(spark, sf_dir).with_(edge_outputs=outs).checks()


def _ready(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("pool"), F.floor("o_totalprice").cast("long").alias("weight"))


@query(
    """WITH r AS (SELECT o_orderkey AS edge_id, o_orderpriority AS pool, floor(o_totalprice)::BIGINT AS weight FROM orders)
    SELECT edge_id, pool, weight, pool = '5-LOW' OR row_number() OVER (PARTITION BY pool ORDER BY weight DESC, edge_id) <= 9 AS admitted FROM r""",
    plain=True,
)
def weighted_admission(spark, sf_dir):
    pools = spark.createDataFrame([(p, 0 if p == "5-LOW" else 9) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "name string, depth int")
    return planning.admitted(_ready(spark, sf_dir), pools)


@query("SELECT o_orderkey AS edge_id, floor(o_totalprice)::BIGINT AS weight FROM orders ORDER BY weight DESC, edge_id LIMIT 40", plain=True)
def heaviest_commands(spark, sf_dir):
    return planning.next_batch(_ready(spark, sf_dir), 40).select("edge_id", "weight")


@query(
    """WITH RECURSIVE w AS (SELECT o_orderkey AS n, o_custkey AS c, 1 + o_orderkey % 7 AS weight, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
    SELECT n AS node, sum(weight) OVER (PARTITION BY c ORDER BY k DESC)::BIGINT AS cost FROM w""",
    plain=True,
)
def order_chains(spark, sf_dir):
    """Each customer's orders as a chain: the weight of the way from an order to the last one."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("node"), "o_custkey", (F.col("o_orderkey") % 7 + 1).alias("weight"))
    after = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("node")).alias("x")).select(F.explode(F.arrays_zip(F.expr("slice(x, 1, size(x) - 1)").alias("src"), F.expr("slice(x, 2, size(x) - 1)").alias("dst"))).alias("l"))
    return closure.longest_paths(rows, after.select("l.src", "l.dst"))
