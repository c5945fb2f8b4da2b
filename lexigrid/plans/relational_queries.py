"""Generic relational coverage over the driver's tables, as Spark SQL and as DuckDB SQL; alike unless two texts are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.plans.base import table
from lexigrid.plans.registry import query
from lexigrid.storage import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(name: str, sql: str, duck: str | None = None) -> None:
    def run(spark, d):
        used = {t: table(spark, d, t) for t in TABLES if t in sql}
        for t, df in used.items():
            df.createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(name, duck or sql)(run)


ALIKE = {
    "filter_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'",
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS kind FROM customer",
    "null_handling": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 1 ELSE 0 END AS gone FROM customer",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey",
    "join_range": "SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_acctbal BETWEEN n_nationkey * 100 AND n_nationkey * 100 + 250 GROUP BY n_nationkey",
    "join_multiway": "SELECT l_orderkey, l_linenumber, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_null_safe": "SELECT a.c_custkey AS a, b.n_nationkey AS b FROM customer a JOIN nation b ON nullif(a.c_nationkey, 3) IS NOT DISTINCT FROM nullif(b.n_nationkey, 3)",
    "join_lateral": "SELECT n_nationkey, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_stats": "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders",
    "win_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part",
    "win_dense_rank": "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part",
    "win_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "win_percent_rank": "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS q FROM customer",
    "win_cume_dist": "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS q FROM customer",
    "win_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "win_lead": "SELECT event_id, lead(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "win_first_last": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM events",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM part",
    "win_running_sum": "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem",
    "win_topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 3",
    "sort_multi": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    "sort_nulls": "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "offset_limit": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS x FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS x FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT l_partkey AS x FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25",
    "except_all": "SELECT c_nationkey AS x FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "sub_scalar": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sub_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "sub_not_exists": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)",
    "sub_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "sub_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON o_custkey = c_custkey",
    "cte_recursive": "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 20) SELECT n, s FROM t",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, length(p_name) AS n, reverse(p_name) AS r, replace(p_name, ' ', '_') AS x, lpad(p_brand, 12, '*') AS l FROM part",
    "fn_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS q, floor(l_extendedprice / 100) AS f, abs(l_discount - 0.05) < 0.011 AS near, round(ln(l_extendedprice), 6) AS e FROM lineitem",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "tpch_q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q12": "SELECT l_linestatus, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high, count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus",
    "tpch_q14": "SELECT round(100 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey",
    "tpch_q18": "SELECT c_custkey, o_orderkey, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_custkey, o_orderkey",
}
for _name, _text in ALIKE.items():
    register(_name, _text)

register(
    "join_asof",
    "SELECT e.event_id, max_by(o.o_orderkey, struct(o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY e.event_id",
    "SELECT e.event_id, arg_max(o.o_orderkey, row(o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY e.event_id",
)
register(
    "join_interval",
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
)
for _hint in ("BROADCAST", "MERGE", "SHUFFLE_HASH"):
    register(
        f"join_{_hint.lower()}",
        f"SELECT /*+ {_hint}(n) */ s_suppkey, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey",
        "SELECT s_suppkey, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey",
    )
register(
    "agg_pivot",
    "SELECT * FROM (SELECT o_orderpriority AS prio, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority AS prio, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority",
)
register(
    "agg_unpivot",
    "SELECT s_suppkey, name, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR name IN (nation, balance))",
    "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
)
register(
    "agg_percentile",
    "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
)
register(
    "agg_listagg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
register(
    "agg_argmax",
    "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey",
)
register("fn_regex", r"SELECT doc_id, regexp_extract(text, r'([A-Za-z]+)\s', 1) AS word, regexp_replace(source, '[0-9]+', '#') AS s FROM documents", r"SELECT doc_id, regexp_extract(text, '([A-Za-z]+)\s', 1) AS word, regexp_replace(source, '[0-9]+', '#', 'g') AS s FROM documents")
register("fn_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS first, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first, DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS days FROM orders")
register(
    "fn_array",
    # DuckDB rounds the scaled double and keeps the sign of what becomes zero; Spark rounds its decimal digits
    "SELECT vec_id, transform(slice(embedding, 1, 3), x -> signum(x) * round(abs(CAST(x AS DOUBLE) * 2) * 10000) / 10000) AS t, size(filter(embedding, x -> x > 0)) AS pos, array_position(transform(embedding, x -> x > 0), true) AS first FROM embeddings",
    "SELECT vec_id, list_transform(embedding[1:3], lambda x: round(CAST(x AS DOUBLE) * 2, 4)) AS t, len(list_filter(embedding, lambda x: x > 0)) AS pos, coalesce(list_position(list_transform(embedding, lambda x: x > 0), true), 0) AS first FROM embeddings",
)
register("fn_map", "SELECT n_nationkey, map('name', n_name, 'region', CAST(n_regionkey AS STRING))['name'] AS name, size(map('a', 1, 'b', 2)) AS n FROM nation", "SELECT n_nationkey, n_name AS name, 2 AS n FROM nation")
register("fn_struct", "SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a AS a FROM nation", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).a AS a FROM nation")
register("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, to_json(named_struct('e', event_type)) AS j FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"e\":\"' || event_type || '\"}' AS j FROM events")
register("fn_hash", "SELECT doc_id, md5(text) AS m, sha2(source, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(source) AS s FROM documents")


@query("agg_approx_distinct")
def agg_approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("agg_sketch")
def agg_sketch(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    return t.select("l_returnflag", F.hll_sketch_estimate("s").alias("parts"))


@query("scan_parquet", "SELECT count(*) AS n, sum(l_linenumber) AS s FROM lineitem")
def scan_parquet(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


def _folder(spark, kind):
    import uuid

    return f"{shared_dir(spark)}/tables/{kind}-{uuid.uuid4().hex}"


@query("scan_csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv_roundtrip(spark, d):
    t, to = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), _folder(spark, "csv")
    t.write.csv(to, header=True)
    return spark.read.schema(t.schema).csv(to, header=True)


@query("scan_json_roundtrip", "SELECT event_id, event_type, value FROM events")
def scan_json_roundtrip(spark, d):
    t, to = table(spark, d, "events").select("event_id", "event_type", "value"), _folder(spark, "json")
    t.write.json(to)
    return spark.read.schema(t.schema).json(to)


@query("partitioned_write", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def partitioned_write(spark, d):
    t, to = table(spark, d, "part").select("p_partkey", "p_brand"), _folder(spark, "parts")
    t.repartition("p_brand").write.partitionBy("p_brand").parquet(to)
    return spark.read.parquet(to).where(F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"))
