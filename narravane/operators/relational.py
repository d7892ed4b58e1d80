"""General relational operators on the star schema."""

from __future__ import annotations

from narravane.functions.dialect import operator

_REVENUE = "CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 5e-1) AS BIGINT)) AS BIGINT)"


@operator("lineitem", "orders", "customer", "nation", "region")
def star_join(d):
    """Revenue in cents by region and nation."""
    return f"""
    SELECT r_name AS region, n_name AS nation, count(*) AS items, {_REVENUE} AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""


@operator("lineitem")
def rollup_sales(d):
    """Totals by flag and status, with subtotals."""
    return f"SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS items, {_REVENUE} AS cents FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"


@operator("lineitem")
def cube_sales(d):
    """Totals by all subsets of flag and status."""
    return f"SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS items, {_REVENUE} AS cents FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)"


@operator("lineitem")
def grouping_sets_sales(d):
    """Totals by flag, by status, and of all."""
    return f"SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS items, {_REVENUE} AS cents FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@operator("customer", "orders")
def customers_with_orders(d):
    """Semi join: customers with a large order."""
    return f"SELECT c_custkey AS customer_id FROM customer {'LEFT SEMI' if d.name == 'spark' else 'SEMI'} JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"


@operator("customer", "orders")
def customers_without_orders(d):
    """Anti join: customers without a large order."""
    return f"SELECT c_custkey AS customer_id FROM customer {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"


@operator("customer", "supplier")
def nation_sets(d):
    """Union, intersection and difference of nations with customers and suppliers in debt."""
    a, b = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0", "SELECT s_nationkey FROM supplier WHERE s_acctbal < 0"
    return f"SELECT 'union' AS kind, k FROM ({a} UNION {b}) x UNION ALL SELECT 'intersect', k FROM ({a} INTERSECT {b}) y UNION ALL SELECT 'except', k FROM ({a} EXCEPT {b}) z"


@operator("orders")
def top_orders(d):
    """The three largest orders of each priority, with rank functions."""
    return """
    WITH r AS (SELECT o_orderpriority AS priority, o_orderkey AS order_id, row_number() OVER w AS k, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr, ntile(4) OVER w AS quarter
               FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))
    SELECT priority, order_id, CAST(k AS BIGINT) AS k, CAST(rk AS BIGINT) AS rk, CAST(dr AS BIGINT) AS dr, CAST(quarter AS BIGINT) AS quarter FROM r WHERE k <= 3"""


@operator("orders")
def running_totals(d):
    """Sum of a customer's orders so far and over the last three, in cents."""
    return """
    WITH o AS (SELECT *, CAST(floor(o_totalprice * 100 + 5e-1) AS BIGINT) AS cents FROM orders)
    SELECT o_orderkey AS order_id, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far,
           CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM o"""


@operator("orders")
def status_pivot(d):
    """Orders of a priority by status, a column each."""
    return "SELECT o_orderpriority AS priority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS f, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS o, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY o_orderpriority"


@operator("orders", "events")
def as_of_event(d):
    """For each order the last event of its user at or before it, by a window over both logs."""
    return f"""
    WITH u AS (SELECT o_custkey AS k, {d.micros("o_orderdate")} AS at_us, o_orderkey AS order_id, CAST(NULL AS BIGINT) AS event_id, 1 AS side FROM orders
               UNION ALL SELECT user_id, {d.micros("ts")}, CAST(NULL AS BIGINT), event_id, 0 FROM events),
    w AS (SELECT k, order_id, max(CASE WHEN event_id IS NOT NULL THEN at_us * 1 END) OVER (PARTITION BY k ORDER BY at_us, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_us FROM u)
    SELECT order_id, last_us FROM w WHERE order_id IS NOT NULL"""
