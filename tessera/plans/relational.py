"""Relational queries over the star schema; most texts are read alike by both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import asof, frames, quantified, rows
from tessera.plans.query import Query, same
from tessera.streaming import changes

QUERIES = {
    # scans, projections, predicates
    "scan_table": same("SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "scan_index_equality": same("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 33"),
    "scan_bitmap_and": same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 5"),
    "scan_bitmap_or": same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 1 OR l_quantity = 50 OR l_orderkey = 7"),
    "project_columns": same("SELECT c_name, c_acctbal FROM customer"),
    "project_expressions": same("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1) AS charge FROM lineitem"),
    "from_less_select": same("SELECT 1 + 2 AS three, 'a' AS letter"),
    "values_rows": same("SELECT k, v FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(k, v)"),
    "unnest_array": Query("SELECT vec_id, explode(embedding) AS e FROM embeddings", "SELECT vec_id, unnest(embedding) AS e FROM embeddings"),
    "filter_comparison": same("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <> 1000 AND NOT (p_brand = 'Brand#11')"),
    "filter_disjunction": same("SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR (s_nationkey = 3 AND s_acctbal > 1000)"),
    "filter_three_valued": same("SELECT k FROM (VALUES (1, TRUE), (2, FALSE), (3, CAST(NULL AS BOOLEAN))) AS t(k, b) WHERE NOT b"),
    "logic_null_tests": same("SELECT k, b IS NULL AS n, b IS NOT NULL AS nn, coalesce(b, FALSE) AS t, (b IS DISTINCT FROM TRUE) AS nt, (b IS NOT DISTINCT FROM FALSE) AS f, (b AND NULL) AS anda, (b OR NULL) AS ora FROM (VALUES (1, TRUE), (2, FALSE), (3, CAST(NULL AS BOOLEAN))) AS t(k, b)"),
    "logic_truth_tests": same("SELECT c_custkey, (c_acctbal > 5000) IS TRUE AS t, (CASE WHEN c_nationkey > 12 THEN c_acctbal > 0 END) IS NOT TRUE AS nt, (CASE WHEN c_nationkey > 12 THEN c_acctbal > 0 END) IS FALSE AS f, (CASE WHEN c_nationkey > 12 THEN c_acctbal > 0 END) IS UNKNOWN AS u FROM customer"),
    "predicate_between": same("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey NOT BETWEEN 10 AND 100"),
    "predicate_in_list": same("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)"),
    "predicate_like": same("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_name NOT LIKE 'b%'"),
    "predicate_like_escape": same("SELECT k FROM (VALUES (1, '10%'), (2, '100'), (3, '1_0')) AS t(k, s) WHERE s LIKE '1%#%' ESCAPE '#' OR s LIKE '1#_0' ESCAPE '#'"),
    "predicate_ilike": same("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%ing' AND c_name NOT ILIKE '%7'"),
    "case_searched": same("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part"),
    "case_simple": same("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders"),
    "cast_try": Query("SELECT k, try_cast(s AS INT) AS i, try_cast(s AS DOUBLE) AS d, try_cast(s AS DATE) AS t FROM (VALUES (1, '12'), (2, 'x'), (3, '2024-02-29'), (4, '1.5')) AS v(k, s)", "SELECT k, CASE WHEN regexp_full_match(s, '[0-9]+') THEN try_cast(s AS INT) END AS i, try_cast(s AS DOUBLE) AS d, try_cast(s AS DATE) AS t FROM (VALUES (1, '12'), (2, 'x'), (3, '2024-02-29'), (4, '1.5')) AS v(k, s)"),
    "type_of": Query("SELECT typeof(o_orderkey) IN ('bigint') AS a, typeof(o_orderstatus) IN ('string') AS b FROM orders", "SELECT typeof(o_orderkey) IN ('BIGINT') AS a, typeof(o_orderstatus) IN ('VARCHAR') AS b FROM orders"),
    "arithmetic": Query("SELECT l_orderkey, l_linenumber, l_linenumber + 7 AS a, l_linenumber - 7 AS s, l_linenumber * 3 AS m, 17 div l_linenumber AS q, 17 % l_linenumber AS r, pow(l_linenumber, 2) AS p, -l_linenumber AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber + 7 AS a, l_linenumber - 7 AS s, l_linenumber * 3 AS m, CAST(17 // l_linenumber AS BIGINT) AS q, 17 % l_linenumber AS r, pow(l_linenumber, 2) AS p, -l_linenumber AS n FROM lineitem"),
    "divide_by_zero_is_null": Query("SELECT l_orderkey, l_linenumber, try_divide(l_quantity, l_linenumber - 1) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END AS q FROM lineitem"),
    "text_concatenation": same("SELECT c_custkey, c_name || '/' || c_mktsegment AS s, c_name || NULL AS n FROM customer"),
    "row_and_array_constructors": Query("SELECT n_nationkey, named_struct('a', n_nationkey, 'b', n_name).b AS b, array(n_nationkey, n_regionkey)[1] AS second FROM nation", "SELECT n_nationkey, struct_pack(a := n_nationkey, b := n_name).b AS b, [n_nationkey, n_regionkey][2] AS second FROM nation"),
    # joins
    "join_inner": same("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_hash_hint": Query("SELECT /*+ SHUFFLE_HASH(s) */ l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "join_merge_hint": Query("SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders o ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "join_nested_loop_hint": Query("SELECT /*+ SHUFFLE_REPLICATE_NL(r) */ n_name, r_name FROM nation JOIN region r ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left": same("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "join_right": same("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "join_full": same("SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_partkey"),
    "join_cross": same("SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_comma": same("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "join_natural": same("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) y"),
    "join_using": same("SELECT k, a, b FROM (SELECT c_nationkey AS k, c_custkey AS a FROM customer) x JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation) y USING (k)"),
    "join_chain": same("SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "join_theta": same("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_range": same("SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size BETWEEN n_nationkey AND n_nationkey + 2"),
    "join_intervals": same("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey + 3 AND b.n_nationkey < a.n_nationkey + a.n_regionkey"),
    "join_asof": Query(lambda t: asof.asof_join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), "o_orderkey"), t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("open_key")), "k", "at"), "SELECT a.o_custkey AS k, a.o_orderdate AS at, a.o_orderkey, b.open_key FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') a ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS open_key FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) b ON a.o_custkey = b.o_custkey AND a.o_orderdate >= b.o_orderdate"),
    "join_many_to_many": same("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey"),
    "semi_in": same("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "anti_not_in": same("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "anti_not_in_null": Query(lambda t: quantified.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.select(F.when(F.col("o_custkey") > 50, F.col("o_custkey")).alias("k")), "k"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 50 THEN o_custkey END FROM orders)"),
    "anti_not_in_keys": Query(lambda t: quantified.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.where("o_totalprice > 300000"), "o_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "exists_uncorrelated": same("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)"),
    "not_exists_uncorrelated": same("SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 1000)"),
    "exists_correlated": same("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "not_exists_correlated": same("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "scalar_subquery": same("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)"),
    "scalar_subquery_empty": same("SELECT n_name, (SELECT max(o_totalprice) FROM orders WHERE o_orderkey < 0) AS none FROM nation"),
    "scalar_subquery_correlated": same("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer"),
    "quantified_any": Query(lambda t: quantified.compare_any(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", ">", t.part.where("p_size = 1"), "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size = 1)"),
    "quantified_all": Query(lambda t: quantified.compare_all(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", ">=", t.part.where("p_size = 1"), "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 1)"),
    "quantified_all_empty": Query(lambda t: quantified.compare_all(t.nation.select("n_nationkey"), "n_nationkey", "<", t.nation.where("n_nationkey < 0"), "n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_nationkey < ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)"),
    "quantified_any_unequal": Query(lambda t: quantified.compare_any(t.nation.select("n_nationkey"), "n_nationkey", "<>", t.nation.where("n_nationkey = 3"), "n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_nationkey <> ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = 3)"),
    # aggregates
    "aggregate_plain": same("SELECT count(*) AS n, count(o_custkey) AS k, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_orderdate) AS last FROM orders"),
    "aggregate_no_input": same("SELECT count(*) AS n, sum(o_totalprice) AS total, bool_and(o_totalprice > 0) AS b FROM orders WHERE o_orderkey < 0"),
    "group_by": same("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "group_by_rollup": same("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "group_by_cube": same("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "group_by_grouping_sets": same("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "grouping_function": same("SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "grouping_id": same("SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "aggregate_mode": Query("SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS m FROM part GROUP BY p_brand", "SELECT p_brand, min(p_size) AS m FROM (SELECT p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1 GROUP BY p_brand"),
    "aggregate_hypothetical_rank": same("SELECT p_brand, count(*) FILTER (WHERE p_size < 25) + 1 AS rank, count(DISTINCT p_size) FILTER (WHERE p_size < 25) + 1 AS dense_rank FROM part GROUP BY p_brand"),
    "having": same("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000"),
    "aggregate_filter": same("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority"),
    "count_distinct": same("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY l_returnflag"),
    "bool_aggregates": same("SELECT c_mktsegment, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS o FROM customer GROUP BY c_mktsegment"),
    "every_aggregate": Query("SELECT c_nationkey, every(c_acctbal > -500) AS e FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, bool_and(c_acctbal > -500) AS e FROM customer GROUP BY c_nationkey"),
    "percentile_cont": Query("SELECT p_brand, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY p_retailprice), 6) AS p FROM part GROUP BY p_brand", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.3), 6) AS p FROM part GROUP BY p_brand"),
    "percentile_disc": Query("SELECT p_brand, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS p FROM part GROUP BY p_brand", "SELECT p_brand, quantile_disc(p_retailprice, 0.5) AS p FROM part GROUP BY p_brand"),
    "string_agg": Query("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "array_agg": Query("SELECT n_regionkey, array_join(transform(sort_array(collect_list(n_nationkey)), x -> CAST(x AS STRING)), ',') AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS ks FROM nation GROUP BY n_regionkey"),
    "json_agg": Query("SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey"),
    "json_object_agg": Query("SELECT r_regionkey, to_json(map_from_entries(sort_array(collect_list(struct(r_name, r_regionkey))))) AS j FROM region GROUP BY r_regionkey", "SELECT r_regionkey, CAST(json_group_object(r_name, r_regionkey) AS VARCHAR) AS j FROM region GROUP BY r_regionkey"),
    "statistical_aggregates": same("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS b FROM lineitem GROUP BY l_returnflag"),
    "distinct": same("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_on": Query(lambda t: rows.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    # windows
    "window_ranking": same("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders"),
    "window_lag_lead": same("SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS p, lead(o_totalprice, 2, 0.0) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "window_ntile": same("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer"),
    "window_percent_rank": same("SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS cd FROM customer"),
    "window_values": same("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "window_aggregates": same("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS s, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS a, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders"),
    "window_bool": same("SELECT c_custkey, bool_and(c_acctbal > 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, bool_or(c_acctbal > 9000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS o FROM customer"),
    "window_every": Query("SELECT c_custkey, every(c_acctbal > -900) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS e FROM customer", "SELECT c_custkey, bool_and(c_acctbal > -900) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS e FROM customer"),
    "window_default_frame": same("SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS s FROM lineitem"),
    "window_rows_frame": same("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders"),
    "window_range_frame": same("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "window_groups_frame": Query(lambda t: frames.groups_frame(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], F.col("p_size"), -2, 0, n=F.count(F.lit(1)), s=F.sum("p_size")), "SELECT p_partkey, p_brand, p_size, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    **{
        f"window_exclude_{k}": Query(
            lambda t, e=e: frames.excluding(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "p_size", e).withColumn("mean", F.round("mean", 9)),
            f"SELECT p_partkey, p_brand, p_size, count(p_size) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS total, round(avg(p_size) OVER w, 9) AS mean FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {e})",
        )
        for k, e in (("current_row", "CURRENT ROW"), ("group", "GROUP"), ("ties", "TIES"), ("no_others", "NO OTHERS"))
    },
    **{
        f"window_exclude_bounded_{k}": Query(
            lambda t, e=e: frames.values_excluding(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "p_partkey", "p_size", e, Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 2)),
            f"SELECT p_partkey, p_brand, p_size, count(p_size) OVER w AS n, CAST(sum(p_size) OVER w AS DOUBLE) AS total, min(p_size) OVER w AS low, max(p_size) OVER w AS high, first_value(p_size) OVER w AS first, last_value(p_size) OVER w AS last FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {e})",
        )
        for k, e in (("current_row", "CURRENT ROW"), ("group", "GROUP"), ("ties", "TIES"), ("no_others", "NO OTHERS"))
    },
    "window_exclude_max": Query(lambda t: frames.extreme_excluding_current(t.part.select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice"), "SELECT p_partkey, p_brand, p_retailprice, max(p_retailprice) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS best FROM part"),
    # order and limits
    "sort_multi_key": Query(lambda t: t.customer.select("c_custkey", "c_nationkey", "c_acctbal").orderBy(F.col("c_nationkey").asc_nulls_last(), F.col("c_acctbal").desc_nulls_first()), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC NULLS LAST, c_acctbal DESC NULLS FIRST"),
    "sort_expression": same("SELECT p_partkey, rank() OVER (ORDER BY p_size % 7 DESC, length(p_name)) AS place FROM part ORDER BY p_size % 7 DESC, length(p_name)"),
    "sort_collation": Query("SELECT n_name FROM nation ORDER BY n_name COLLATE UTF8_LCASE", "SELECT n_name FROM nation ORDER BY n_name COLLATE NOCASE"),
    "limit_offset": same("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "top_k": same("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "limit_all": Query("SELECT r_name FROM region ORDER BY r_name LIMIT ALL", "SELECT r_name FROM region ORDER BY r_name"),
    "fetch_first": Query(lambda t: rows.fetch_first(t.orders.select("o_orderkey"), F.col("o_orderkey"), n=7, offset=3), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3"),
    "fetch_with_ties": Query(lambda t: rows.fetch_with_ties(t.part.select("p_partkey", "p_size"), 5, "p_size"), "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 5"),
    # set operations
    **{f"set_{k}": same(f"SELECT o_custkey % 1000 AS k FROM orders {op} SELECT l_suppkey AS k FROM lineitem") for k, op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"))},
    "set_precedence": same("SELECT n_regionkey AS k FROM nation UNION SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 15"),
    # common tables
    "cte": same("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 1000000) SELECT c_name, round(total, 2) AS total FROM top JOIN customer ON o_custkey = c_custkey"),
    "cte_column_list": same("WITH x(k, n) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT k, n FROM x"),
    "cte_recursive": same("WITH RECURSIVE c(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 15) SELECT n, f FROM c"),
    "derived_table": same("SELECT s, count(*) AS n FROM (SELECT substring(o_orderpriority, 1, 1) AS s FROM orders) AS d GROUP BY s"),
    "lateral_unnest": Query("SELECT n_nationkey, e FROM nation LATERAL VIEW explode(array(n_nationkey, n_regionkey)) x AS e", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS e FROM nation"),
    # added here: event-time windows
    "stream_tumbling": Query(lambda t: changes.windowed(t.events), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}
