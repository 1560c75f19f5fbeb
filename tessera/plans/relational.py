"""Relational breadth on the star schema: what a user of SQL expects besides the retrieval operators."""

from __future__ import annotations

from tessera.plans.dialect import Book

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS


@book.both("2.21")
def pricing_summary(d):
    """Sums and means of lines by return flag and status up to a date."""
    return f"""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
    FROM {d.t('lineitem')} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@book.both("2.21")
def nation_revenue(d):
    """Revenue by the supplier's nation over five joined tables, small sides first by their statistics."""
    return f"""
    SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {d.t('lineitem')} l JOIN {d.t('supplier')} s ON l.l_suppkey = s.s_suppkey
    JOIN {d.t('nation')} x ON s.s_nationkey = x.n_nationkey JOIN {d.t('region')} r ON x.n_regionkey = r.r_regionkey GROUP BY n_name, r_name"""


@book.both("2.21")
def segment_cube(d):
    """All groupings of segment and order status."""
    return f"""
    SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(o_orderstatus, '*') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM {d.t('orders')} o JOIN {d.t('customer')} c ON o.o_custkey = c.c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)"""


@book.both("2.21")
def customers_without_orders(d):
    """An anti-join and a semi-join as set operations agree on who has never ordered."""
    return f"SELECT c_custkey FROM {d.t('customer')} c WHERE NOT EXISTS (SELECT 1 FROM {d.t('orders')} o WHERE o.o_custkey = c.c_custkey) INTERSECT (SELECT c_custkey FROM {d.t('customer')} EXCEPT SELECT o_custkey FROM {d.t('orders')})"


@book.both("2.21")
def as_of_event(d):
    """The last earlier event of the same user for each purchase-like event: an as-of join by a window, without a range join."""
    return f"""
    WITH w AS (SELECT event_id, user_id, event_type, value, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_value FROM {d.t('events')})
    SELECT event_type, count(*) AS n, count(prior) AS with_prior, round(avg(value - prior_value), 6) AS step FROM w GROUP BY event_type"""


@book.both("2.21")
def ranking_functions(d):
    """Ranks, dense ranks, quartiles and cumulative shares of suppliers by balance within their nation."""
    w = "OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)"
    return f"""
    SELECT s_suppkey, {d.i('rank() ' + w)} AS r, {d.i('dense_rank() ' + w)} AS dr, {d.i('ntile(4) ' + w)} AS quartile, round(cume_dist() {w}, 6) AS upto, round(percent_rank() {w}, 6) AS pr FROM {d.t('supplier')}"""


@book.both("2.21")
def top_customers(d):
    """Three customers with the largest orders in each nation."""
    return f"""
    WITH t AS (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS total FROM {d.t('orders')} o JOIN {d.t('customer')} c ON o.o_custkey = c.c_custkey GROUP BY c_nationkey, c_custkey)
    SELECT * FROM (SELECT *, {d.i('row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey)')} AS k FROM t) x WHERE k <= 3"""


@book.both("2.21")
def moving_average(d):
    """A seven-day moving mean of each event type's daily values."""
    return f"""
    WITH y AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM {d.t('events')} GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, CAST(day AS VARCHAR(10)) AS day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean FROM y"""
