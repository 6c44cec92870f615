"""Relational controls on the star schema: joins, grouping sets, set operations, ranking. Spark built-ins, checked all the same."""

from __future__ import annotations

from verdex.plans.dialect import Spark, both


@both("pricing_summary")
def pricing_summary(d: Spark) -> str:
    """Grouped aggregates over the largest table; the date filter and six columns reach the scan."""
    return f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM {d.t('lineitem')} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@both("revenue_by_nation")
def revenue_by_nation(d: Spark) -> str:
    """A five-table join; the dimension sides are small and Catalyst broadcasts them by their statistics."""
    return f"""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {d.t('customer')} JOIN {d.t('orders')} ON c_custkey = o_custkey JOIN {d.t('lineitem')} ON l_orderkey = o_orderkey
JOIN {d.t('nation')} ON c_nationkey = n_nationkey JOIN {d.t('region')} ON n_regionkey = r_regionkey GROUP BY n_name"""


@both("semi_anti")
def semi_anti(d: Spark) -> str:
    return f"""SELECT c_mktsegment, count(*) AS n FROM {d.t('customer')} c WHERE EXISTS (SELECT 1 FROM {d.t('orders')} o WHERE o.o_custkey = c.c_custkey)
AND NOT EXISTS (SELECT 1 FROM {d.t('orders')} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') GROUP BY c_mktsegment"""


@both("cube_counts")
def cube_counts(d: Spark) -> str:
    return f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {d.t('orders')} GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@both("rollup_counts")
def rollup_counts(d: Spark) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {d.t('lineitem')} GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@both("set_operations_all")
def set_operations_all(d: Spark) -> str:
    return f"SELECT v, count(*) AS n FROM (SELECT c_nationkey AS v FROM {d.t('customer')} EXCEPT ALL SELECT s_nationkey FROM {d.t('supplier')}) x GROUP BY v"


@both("ranking")
def ranking(d: Spark) -> str:
    """Top three parts by price per brand; the rank limit is pushed below the shuffle (WindowGroupLimit)."""
    return f"SELECT p_brand, p_partkey, rk FROM (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM {d.t('part')}) r WHERE rk <= 3"


@both("correlated_average")
def correlated_average(d: Spark) -> str:
    return f"SELECT o_custkey, count(*) AS n FROM {d.t('orders')} o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM {d.t('orders')} i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey"


@both("tumbling_windows")
def tumbling_windows(d: Spark) -> str:
    """Batch form of event-time windows of six hours."""
    since = d.seconds("TIMESTAMP '2024-01-01 00:00:00'", "ts")
    return f"""WITH e AS (SELECT event_type, value, cast(floor({since} / 21600.0) as bigint) AS w FROM {d.t('events')}) SELECT event_type, w, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY event_type, w"""


@both("session_windows")
def session_windows(d: Spark) -> str:
    """Batch form of sessions: a gap of 30 minutes ends one."""
    return f"""WITH g AS (SELECT user_id, ts, CASE WHEN {d.seconds('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)', 'ts')} < 1800 THEN 0 ELSE 1 END AS starts FROM {d.t('events')})
SELECT user_id, cast(sum(starts) as bigint) AS sessions, count(*) AS events FROM g GROUP BY user_id"""


@both("session_state")
def session_state(d: Spark) -> str:
    """The state that appending a session's texts leaves."""
    return f"SELECT conv_id, cast(sum(length(text)) as bigint) AS state_chars, count(*) AS appends FROM {d.t('conversations')} GROUP BY conv_id"
