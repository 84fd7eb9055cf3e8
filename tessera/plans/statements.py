"""Row-level statements, the catalog, files, statistics and routines as queries: each beside SQL for the rows that it leaves or returns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import checked
from tessera.operators import dml, policies, routines, statistics
from tessera.plans.query import Query, Tables
from tessera.sources import files
from tessera.sources.tables import TABLES
from tessera.streaming import changes

u = F.col
NEW = "s_suppkey % 40 AS n_nationkey, min(s_name) AS n_name FROM supplier GROUP BY s_suppkey % 40"


def frames(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in TABLES}


def nation(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


def new_nations(t: Tables) -> DataFrame:
    """Keys of which some are known."""
    return t.supplier.groupBy((u("s_suppkey") % 40).cast("int").alias("n_nationkey")).agg(F.min("s_name").alias("n_name")).withColumn("n_regionkey", F.lit(9))


def customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal")


def charge(t: Tables) -> DataFrame:
    f = routines.sql_function(t.spark, "tessera_charge", "price DOUBLE, discount DOUBLE", "DOUBLE", "price * (1 - discount)")
    return t.lineitem.select("l_orderkey", "l_linenumber", f(u("l_extendedprice"), u("l_discount")).alias("v"))


def registered(t: Tables) -> DataFrame:
    f = routines.register_function(t.spark, "tessera_twice", lambda x: x * 2, "long", "stable")
    return t.part.select("p_partkey", f(u("p_partkey")).alias("v"))


def geometric_mean(t: Tables) -> DataFrame:
    f = routines.create_aggregate(t.spark, "tessera_geomean", lambda x: math.exp(sum(map(math.log, x)) / len(x)), "double")
    return t.part.groupBy("p_brand").agg(F.round(f(u("p_retailprice")), 6).alias("v"))


def secured(t: Tables) -> policies.Secured:
    own = policies.Policy(u("c_nationkey") < 5, roles=("clerk",))
    rich = policies.Policy(u("c_acctbal") > 0, restrictive=True)
    return policies.Secured(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "owner", [own, rich])


def triggered(t: Tables) -> DataFrame:
    x = routines.Triggers()
    x.create("before", "insert", lambda rows: rows.withColumn("n_name", F.upper("n_name")), u("n_nationkey") > 30)
    return x.run("insert", nation(t), new_nations(t), dml.insert)


QUERIES = {
    # row-level statements
    "dml_insert_select": Query(lambda t: dml.insert(nation(t), new_nations(t).drop("n_regionkey"), {"n_regionkey": F.lit(-1)}), f"SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT *, -1 FROM (SELECT {NEW})"),
    "dml_insert_returning": Query(lambda t: dml.insert_returning(nation(t), new_nations(t), u("n_nationkey"), F.lower("n_name").alias("low")), f"SELECT n_nationkey, lower(n_name) AS low FROM (SELECT {NEW})"),
    "dml_on_conflict_nothing": Query(lambda t: dml.insert_or_nothing(nation(t), new_nations(t), ["n_nationkey"]), f"SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT *, 9 FROM (SELECT {NEW}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    "dml_on_conflict_update": Query(lambda t: dml.upsert(nation(t), new_nations(t), ["n_nationkey"], {"n_name": F.concat("t.n_name", F.lit("/"), "excluded.n_name")}, u("t.n_regionkey") < 3), f"SELECT coalesce(t.n_nationkey, e.n_nationkey) AS n_nationkey, CASE WHEN t.n_nationkey IS NULL THEN e.n_name WHEN e.n_nationkey IS NOT NULL AND t.n_regionkey < 3 THEN t.n_name || '/' || e.n_name ELSE t.n_name END AS n_name, coalesce(t.n_regionkey, 9) AS n_regionkey FROM nation t FULL JOIN (SELECT {NEW}) e ON t.n_nationkey = e.n_nationkey"),
    "dml_replace_into": Query(lambda t: dml.replace_into(nation(t), new_nations(t), ["n_nationkey"]), f"SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey % 40 FROM supplier) UNION ALL SELECT *, 9 FROM (SELECT {NEW})"),
    "dml_update": Query(lambda t: dml.update(customers(t), {"c_acctbal": F.lit(0.0)}, u("c_acctbal") < 0), "SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "dml_update_returning": Query(lambda t: dml.update_returning(customers(t), {"c_nationkey": u("c_nationkey") + 100}, u("c_acctbal") < 0, u("c_custkey"), u("c_nationkey")), "SELECT c_custkey, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_acctbal < 0"),
    "dml_update_from": Query(lambda t: dml.update_from(customers(t), t.orders, {"c_custkey": "o_custkey"}, {"c_acctbal": u("s.o_totalprice")}, [u("o_orderkey")]), "SELECT c_custkey, c_nationkey, coalesce(p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"),
    "dml_update_from_returning": Query(lambda t: dml.update_from_returning(customers(t), t.orders.where("o_orderstatus = 'P'"), {"c_custkey": "o_custkey"}, {"c_acctbal": u("s.o_totalprice")}, [u("o_orderkey")], u("c_custkey"), u("c_acctbal")), "SELECT c_custkey, p AS c_acctbal FROM customer JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey"),
    "dml_delete": Query(lambda t: dml.delete(customers(t), u("c_acctbal") < 0), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE NOT c_acctbal < 0"),
    "dml_delete_returning": Query(lambda t: dml.delete_returning(customers(t), u("c_acctbal") < 0, u("c_custkey")), "SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "dml_delete_using": Query(lambda t: dml.delete_using(customers(t), t.orders.where("o_orderstatus = 'P'"), {"c_custkey": "o_custkey"}), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "dml_delete_using_returning": Query(lambda t: dml.delete_using_returning(customers(t), t.orders.where("o_orderstatus = 'P'"), {"c_custkey": "o_custkey"}, u("c_custkey")), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "dml_merge": Query(lambda t: dml.merge(nation(t), new_nations(t), {"n_nationkey": "n_nationkey"}, {"n_regionkey": u("t.n_regionkey") + 10}, {"n_nationkey": u("s.n_nationkey"), "n_name": u("s.n_name")}), f"SELECT coalesce(t.n_nationkey, s.n_nationkey) AS n_nationkey, coalesce(t.n_name, s.n_name) AS n_name, CASE WHEN s.n_nationkey IS NULL THEN t.n_regionkey ELSE t.n_regionkey + 10 END AS n_regionkey FROM nation t FULL JOIN (SELECT {NEW}) s ON t.n_nationkey = s.n_nationkey"),
    "dml_truncate": Query(lambda t: dml.truncate(nation(t)).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM nation WHERE FALSE"),
    # files and catalog
    "copy_round_trip": Query(lambda t: files.round_trip(t.customer), "SELECT * FROM customer"),
    "copy_round_trip_delimiter": Query(lambda t: files.round_trip(t.events, "|"), "SELECT * FROM events"),
    "partition_range": Query(lambda t: files.partition_of(t.orders.select("o_orderkey", "o_totalprice"), "range", "o_totalprice", [1000, 100000, 300000]), "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE -1 END AS part FROM orders"),
    "partition_list": Query(lambda t: files.partition_of(t.customer.select("c_custkey", "c_mktsegment"), "list", "c_mktsegment", [["BUILDING"], ["MACHINERY", "FURNITURE"]]), "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 1 ELSE -1 END AS part FROM customer"),
    "inherited_scan": Query(lambda t: files.inherited(t.nation.select("n_nationkey", "n_name"), t.supplier.select(u("s_suppkey").alias("n_nationkey"), u("s_name").alias("n_name"), "s_acctbal")), "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "information_schema_columns": Query(lambda t: files.information_schema_columns(t.spark, frames(t)).select("table_name", "column_name", "ordinal_position"), f"SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in TABLES)})"),
    "information_schema_tables": Query(lambda t: files.information_schema_tables(t.spark, frames(t)).select("table_name"), f"SELECT table_name FROM information_schema.tables WHERE table_name IN ({', '.join(repr(n) for n in TABLES)})"),
    "pg_class": Query(lambda t: files.pg_class(t.spark, frames(t)).select("relname", "relnatts"), f"SELECT table_name AS relname, CAST(count(*) AS INT) AS relnatts FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in TABLES)}) GROUP BY table_name"),
    "pg_attribute": Query(lambda t: files.pg_attribute(t.spark, frames(t)).select("attname", "attnum"), f"SELECT column_name AS attname, ordinal_position AS attnum FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in TABLES)})"),
    # statistics
    "analyze_column": Query(lambda t: statistics.column_statistics(t.customer, "c_acctbal").select("n", "nulls", "ndistinct", "low", "high"), "SELECT count(*) AS n, count(*) - count(c_acctbal) AS nulls, count(DISTINCT c_acctbal) AS ndistinct, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer"),
    "analyze_most_common": Query(lambda t: statistics.most_common(t.orders, "o_orderpriority", 3).select("o_orderpriority", "n", F.round("frequency", 9).alias("frequency")), "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS frequency FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3"),
    "analyze_dependency": Query(lambda t: statistics.dependency_degree(t.part, "p_size", "p_brand").select(F.round("degree", 9).alias("degree")), "SELECT round(sum(CASE WHEN k <= 1 THEN n ELSE 0 END) / sum(n), 9) AS degree FROM (SELECT count(*) AS n, count(DISTINCT p_brand) AS k FROM part GROUP BY p_size)"),
    "analyze_groups": Query(lambda t: statistics.distinct_groups(t.orders, "o_orderstatus", "o_orderpriority"), "SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) AS combinations, count(DISTINCT o_orderstatus) AS of_o_orderstatus, count(DISTINCT o_orderpriority) AS of_o_orderpriority FROM orders"),
    # routines and policies
    "sql_function": Query(charge, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    "registered_function": Query(registered, "SELECT p_partkey, p_partkey * 2 AS v FROM part"),
    "created_aggregate": Query(geometric_mean, "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS v FROM part GROUP BY p_brand"),
    "table_function": Query(lambda t: routines.table_function(t.spark, "SELECT o_orderkey FROM {orders} WHERE o_custkey = :who", "who", orders=t.orders)(7), "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "prepared_statement": Query(lambda t: routines.Prepared(t.spark, "SELECT c_custkey FROM {customer} WHERE c_acctbal > $1 AND c_mktsegment = $2", customer=t.customer).execute(1000.0, "BUILDING"), "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'"),
    "prepared_statement_marks": Query(lambda t: routines.Prepared(t.spark, "SELECT c_custkey FROM {customer} WHERE c_nationkey = ? OR c_nationkey = ?", customer=t.customer).execute(3, 5), "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 5)"),
    "policy_read": Query(lambda t: secured(t).read("clerk"), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 5 AND c_acctbal > 0"),
    "policy_refused": Query(lambda t: secured(t).refused("clerk", t.customer.select("c_custkey", "c_nationkey", "c_acctbal")), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE NOT (c_nationkey < 5 AND c_acctbal > 0)"),
    "trigger_before_insert": Query(triggered, f"SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey > 30 THEN upper(n_name) ELSE n_name END, 9 FROM (SELECT {NEW})"),
    "domain_check": Query(lambda t: checked.outside_domain(t.part.select("p_partkey", "p_size"), "p_size", u("p_size") < 30), "SELECT p_partkey, p_size FROM part WHERE p_size >= 30"),
    # change feeds: events as changes in the order of their ids
    "publication": Query(lambda t: changes.published(t.events.select(u("event_id").alias("lsn"), (u("event_id") % 3 != 0).alias("committed"), F.lit("events").alias("table"), F.when(u("event_id") % 2 == 0, "insert").otherwise("delete").alias("op")), ["events"], ("insert",)).select("lsn", "op"), "SELECT event_id AS lsn, 'insert' AS op FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0"),
    "slot_peek": Query(lambda t: changes.peek(t.events.select(u("event_id").alias("lsn")), 100, 50), "SELECT event_id AS lsn FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50"),
}
