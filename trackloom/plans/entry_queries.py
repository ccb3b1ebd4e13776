"""Queries and updates on tables of entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import entries
from trackloom.plans.registry import query
from trackloom.sources.tracks import N_SQL, T_SQL, e_sql, observations, table, track_edges, tracks


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def find_entries(spark, sf_dir):
    wanted = entries.any_of("o_orderpriority", ["1-URGENT", "2-HIGH"], also=F.col("o_orderstatus") == "F")
    return entries.find(table(spark, sf_dir, "orders"), wanted, ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def find_one(spark, sf_dir):
    return entries.find(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", ["o_orderkey", "o_custkey"], one_by="o_orderkey")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def distinct_values(spark, sf_dir):
    found = entries.distinct_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", F.col("o_totalprice") > 1000)
    return found.select("o_custkey", F.array_join("values", ",").alias("statuses"))


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false) AND NOT coalesce(c_mktsegment = 'BUILDING', false)")
def delete_entries(spark, sf_dir):
    return entries.delete_where(table(spark, sf_dir, "customer"), [F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"]).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debtor' END AS note FROM customer")
def update_entries(spark, sf_dir):
    return entries.update_where(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "note": F.lit("debtor")}).select("c_custkey", "c_acctbal", "note")


@query("SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal < 0) THEN 'first' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_one(spark, sf_dir):
    return entries.update_where(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("first")}, only_first_by="c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def renamed_fields(spark, sf_dir):
    tables = entries.rename_everywhere({t: table(spark, sf_dir, t) for t in ("nation", "region")}, {"n_nationkey": "id", "n_name": "name", "r_regionkey": "id", "r_name": "name"})
    return tables["nation"].select("id", "name").unionByName(tables["region"].select("id", "name"))


TYPED = "CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END"


@query(f"SELECT event_id FROM events WHERE TRY_CAST({TYPED} AS BIGINT) IS NOT NULL")
def typed_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("field", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")))
    return entries.delete_untyped(rows, "field", "long").select("event_id")


@query("""SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_returnflag) = max(l_returnflag) AND min(l_linestatus) = max(l_linestatus) AS consistent,
count(DISTINCT l_linenumber) AS parts, count(l_quantity) AS n FROM lineitem GROUP BY l_orderkey""")
def combined_parts(spark, sf_dir):
    return entries.combine_parts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""SELECT s_nationkey, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM (SELECT s_nationkey, 's' || s_suppkey % 3 AS w FROM supplier UNION ALL SELECT s_nationkey, 's' || s_suppkey % 5 FROM supplier) GROUP BY s_nationkey""")
def merged_maps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sets = s.groupBy("s_nationkey").agg(*[F.collect_set(F.concat(F.lit("s"), (F.col("s_suppkey") % k).cast("string"))).alias(f"m{k}") for k in (3, 5)])
    both = sets.select("s_nationkey", entries.merge_maps(F.create_map(F.lit("w"), "m3"), F.create_map(F.lit("w"), "m5")).alias("m"))
    return both.select("s_nationkey", F.array_join(F.array_sort(F.col("m").getItem("w")), ",").alias("words"))


@query(f"WITH {N_SQL} SELECT node_id, coalesce(CASE WHEN bid % 3 > 0 THEN 'k' || bid % 3 END, 'none') AS brood FROM n")
def node_attribute(spark, sf_dir):
    nodes = tracks(spark, sf_dir).select("node_id", "bid")
    values = nodes.where("bid % 3 > 0").select("node_id", F.concat(F.lit("k"), (F.col("bid") % 3).cast("string")).alias("value"))
    return entries.add_attribute(nodes, values, "node_id", "brood", "none")[0].select("node_id", "brood")


@query(f"WITH {N_SQL} SELECT count(*) FILTER (WHERE bid % 3 > 0) AS found, count(*) FILTER (WHERE bid % 3 = 0) AS missed FROM n")
def node_attribute_counts(spark, sf_dir):
    nodes = tracks(spark, sf_dir).select("node_id", "bid")
    return entries.add_attribute(nodes, nodes.where("bid % 3 > 0").select("node_id", F.col("bid").alias("value")), "node_id", "brood", 0)[1]


@query("SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def metadata_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return entries.metadata_rows(nations, table(spark, sf_dir, "supplier").drop("s_acctbal"), "s_nationkey")


@query("SELECT c_custkey, coalesce(sum(o_totalprice), 0.0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def metric_defaults(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey"))
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return entries.with_defaults(wanted, found, ["c_custkey"], {"total": 0.0})


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def chosen_ids(spark, sf_dir):
    by_status = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return entries.choose(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_mktsegment") == "MACHINERY", [by_status("F")], [by_status("P")])


KINDS = ["click", "purchase", "view"]


@query(f"WITH {T_SQL} SELECT bid, " + ", ".join(f"min(x) FILTER (WHERE kind = '{k}') AS {k}" for k in KINDS) + " FROM t GROUP BY bid")
def wide_matrix(spark, sf_dir):
    return entries.wide_matrix(observations(spark, sf_dir), "bid", "kind", "x", KINDS)


@query(f"WITH {e_sql(800)} SELECT src, dst, a.bid AS bid_1, b.bid AS bid_2, a.tN AS end_1, b.tN AS end_2 FROM e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst")
def pair_attributes(spark, sf_dir):
    """The attributes come along with the edges, far more than the tracks, and nothing is joined with them."""
    nodes = tracks(spark, sf_dir).withColumns({"object": F.col("bid"), "end": F.col("tN")})
    edges = track_edges(nodes, 800, src=("object", "end"), dst=("object", "end"))
    return edges.select("dst", "src", F.col("src_object").alias("bid_1"), F.col("src_end").alias("end_1"), F.col("dst_object").alias("bid_2"), F.col("dst_end").alias("end_2"))


@query(f"""WITH {T_SQL}, k AS (SELECT *, CAST(round(time / 3600) AS BIGINT) AS tick FROM t),
a AS (SELECT bid, tick, x FROM k QUALIFY row_number() OVER (PARTITION BY bid, tick ORDER BY time) = 1), b AS (SELECT bid, tick, y FROM k WHERE kind = 'view' QUALIFY row_number() OVER (PARTITION BY bid, tick ORDER BY time) = 1)
SELECT bid, tick, x, y FROM a JOIN b USING (bid, tick)""")
def merged_on_ticks(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return entries.merge_on_ticks([rows.select("bid", "time", "x"), rows.where("kind = 'view'").select("bid", "time", "y")], 3600).select("bid", "tick", "x", "y")


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS number FROM part")
def padded_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", entries.padded_number(F.col("p_partkey")).alias("number"))


@query("SELECT c_custkey, coalesce(100.0 * count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 0.0) AS progress FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def user_progress(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counts = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("o_orderkey").alias("whole"))
    return counts.select("c_custkey", entries.percentage(F.col("part"), F.col("whole")).alias("progress"))


@query("SELECT l_orderkey AS bid, l_linenumber % 3 AS time, max(l_quantity) AS value FROM lineitem GROUP BY ALL")
def combined_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid"), F.create_map(F.col("l_linenumber") % 3, F.col("l_quantity")).alias("entries"))
    return entries.fields_of_parts(rows, "bid", "entries")
