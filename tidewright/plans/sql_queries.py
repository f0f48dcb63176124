"""General SQL: one query per category that users of the engine may send, over the star-schema tables, with its SQL.

Sums of prices are of decimals, so that no order of addition shows in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.plans.registry import Registry, table

R = Registry()


def both(name: str, text: str, other: str | None = None) -> None:
    """Register SQL with tables in braces; ``other`` is its wording in the other dialect where they differ."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, folder, n) for n in names})

    R.add(name, re.sub(r"\{(\w+)\}", r"\1", other or text))(run)


# scans, projections, filters
both("q_filter_project", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2)) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_quantity BETWEEN 5 AND 10 AND l_returnflag IN ('A', 'R')")
both("q_case_null", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(event_type, 'click'), 'other') AS kind, event_type IS DISTINCT FROM 'view' AS not_view FROM {events}")
both("q_like_between", "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' AND p_size NOT BETWEEN 10 AND 20")
both("q_constant_folding", "SELECT n_nationkey, 1 + 2 * 3 AS seven, 'a' || 'b' AS ab FROM {nation} WHERE 1 = 1 AND n_regionkey < 10 - 7")

# aggregation
both(
    "q_agg_pricing",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n, CAST(max(l_tax) AS DOUBLE) AS max_tax FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
both("q_agg_having", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
both("q_agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
both("q_agg_distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM {lineitem}")
both("q_agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(avg(l_quantity), 6) AS mean, round(corr(l_quantity, l_tax), 6) AS c FROM {lineitem} GROUP BY l_returnflag")
both("q_agg_quantile", "SELECT o_orderpriority, percentile(o_totalprice, 0.5) AS median FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median FROM {orders} GROUP BY o_orderpriority")
both("q_agg_arg", "SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey")
both("q_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("q_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey)")
both("q_rollup", "SELECT p_brand, p_size, count(*) AS n, min(p_retailprice) AS cheapest FROM {part} GROUP BY ROLLUP (p_brand, p_size)")
both("q_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}) PIVOT (count(l_linenumber) FOR l_linestatus IN ('O' AS open_lines, 'F' AS full_lines))", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS full_lines FROM {lineitem} GROUP BY l_returnflag")

# joins
both("q_join_inner", "SELECT n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
both("q_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
both("q_join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS k, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c ON s_nationkey = c_nationkey")
both("q_join_semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("q_join_anti", "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)")
both("q_join_cross_small", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("q_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("q_join_chain", "SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {supplier} ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY r_name")
both("q_lateral", "SELECT n.n_name, t.s_name FROM {nation} n, LATERAL (SELECT max(s.s_name) AS s_name FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey) t")

# subqueries, common table expressions
both("q_subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})")
both("q_subquery_correlated", "SELECT l_orderkey, l_linenumber FROM {lineitem} a WHERE l_quantity > (SELECT avg(l_quantity) * 1.9 FROM {lineitem} b WHERE b.l_partkey = a.l_partkey)")
both("q_subquery_in", "SELECT s_suppkey, s_name FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_discount > 0.09) AND s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0)")
both("q_cte", "WITH big AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM big) SELECT o_custkey, t FROM big, top WHERE t > m * 0.8")
both("q_recursive_cte", "WITH RECURSIVE s(k, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT k + 1, v * 2 FROM s WHERE k < 20) SELECT k, v FROM s")

# windows
both("q_window_rank", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
both("q_window_analytic", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS later, first_value(o_orderkey) OVER w AS first_key, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("q_window_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_max FROM {events}")
both("q_window_qualify", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM {lineitem}) WHERE rn = 1", "SELECT l_orderkey, l_linenumber FROM {lineitem} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
both("q_window_running_max", "SELECT node, seq, partition, max(complete_through_ms) OVER (PARTITION BY partition, node ORDER BY seq, at_ms, complete_through_ms ROWS UNBOUNDED PRECEDING) AS so_far FROM {watermark_log}")

# order, limit
both("q_topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("q_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
both("q_order_all", "SELECT n_regionkey, n_name FROM {nation} ORDER BY ALL")

# sets
both("q_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("q_union_all", "SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) GROUP BY c_nationkey")
both("q_intersect", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
both("q_except_all", "SELECT l_suppkey FROM {lineitem} WHERE l_linenumber = 1 EXCEPT ALL SELECT s_suppkey AS l_suppkey FROM {supplier}")

# scalars
both("q_string", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substring(c_name, 1, 4) AS head, replace(c_mktsegment, 'E', 'e') AS r, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS padded, trim(concat(' ', c_mktsegment, ' ')) AS t, regexp_replace(c_name, '[0-9]+', '#') AS masked FROM {customer}", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substring(c_name, 1, 4) AS head, replace(c_mktsegment, 'E', 'e') AS r, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, trim(concat(' ', c_mktsegment, ' ')) AS t, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked FROM {customer}")
both("q_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('MONTH', o_orderdate) AS first_day, o_orderdate + INTERVAL '3' DAY AS later, dayofyear(o_orderdate) AS doy FROM {orders}", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS first_day, o_orderdate + INTERVAL 3 DAY AS later, dayofyear(o_orderdate) AS doy FROM {orders}")
both("q_math", "SELECT p_partkey, abs(-p_size) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, mod(p_size, 7) AS m, round(sqrt(p_size), 9) AS s, greatest(p_size, 25) AS g, sign(p_size - 25) AS sg, p_size & 12 AS bits FROM {part}", "SELECT p_partkey, abs(-p_size) AS a, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, mod(p_size, 7) AS m, round(sqrt(p_size), 9) AS s, greatest(p_size, 25) AS g, sign(p_size - 25)::DOUBLE AS sg, p_size & 12 AS bits FROM {part}")
both("q_array", "SELECT o_custkey, size(collect_set(o_orderstatus)) AS kinds, array_join(array_sort(collect_set(o_orderpriority)), ',') AS all_priorities FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, len(list(DISTINCT o_orderstatus)) AS kinds, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS all_priorities FROM {orders} GROUP BY o_custkey")
both("q_array_lambda", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS norm2, size(filter(embedding, x -> x > 0)) AS positive FROM {embeddings}", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM {embeddings}")
both("q_map", "SELECT event_id, element_at(map('type', event_type, 'user', CAST(user_id AS STRING)), 'user') AS u FROM {events}", "SELECT event_id, user_id::VARCHAR AS u FROM {events}")
both("q_struct", "SELECT event_id, s.a AS a, s.b AS b FROM (SELECT event_id, named_struct('a', user_id, 'b', event_type) AS s FROM {events})", "SELECT event_id, s.a AS a, s.b AS b FROM (SELECT event_id, {{'a': user_id, 'b': event_type}} AS s FROM {events})")
both("q_hash", "SELECT doc_id, sha2(coalesce(text, ''), 256) AS h, md5(coalesce(text, '')) AS m FROM {documents}", "SELECT doc_id, sha256(coalesce(text, '')) AS h, md5(coalesce(text, '')) AS m FROM {documents}")
both("q_json", "SELECT partition, origin, seq, CAST(get_json_object(attrs, '$.rows') AS BIGINT) AS n_rows, get_json_object(attrs, '$.thread') AS thread FROM (SELECT DISTINCT partition, origin, seq, attrs FROM {otlp_logs})", "SELECT partition, origin, seq, CAST(attrs ->> '$.rows' AS BIGINT) AS n_rows, attrs ->> '$.thread' AS thread FROM (SELECT DISTINCT partition, origin, seq, attrs FROM {otlp_logs})")
both("q_text_lengths", "SELECT source, count(*) AS n, sum(length(text)) AS chars, max(n_chars) AS longest, count_if(length(text) = n_chars) AS exact FROM {documents} GROUP BY source", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, max(n_chars) AS longest, count(*) FILTER (WHERE length(text) = n_chars) AS exact FROM {documents} GROUP BY source")
R.sql["q_struct"] = R.sql["q_struct"].replace("{{", "{").replace("}}", "}")

# time windows
both("q_tumbling", "SELECT window(ts, '1 hour').start AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY ALL")


@R.add("q_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def q_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in windows of an hour every half hour."""
    return table(spark, folder, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@R.add(
    "q_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def q_session(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user that end after half an hour without events."""
    return table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# inexact by nature: rows only
@R.add("q_approx_distinct")
def q_approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Sketched distinct counts; tested to lie within the sketch's error of the exact ones."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"))


@R.add("q_range_function", "SELECT range AS id, range * 2 AS twice FROM range(1000)")
def q_range_function(spark: SparkSession, folder: str) -> DataFrame:
    """The range table function."""
    return spark.sql("SELECT id, id * 2 AS twice FROM range(1000)")


@R.add("q_top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def q_top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The three largest orders of each customer (ranked windows with a bound prune before the shuffle)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")
