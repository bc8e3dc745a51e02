"""Reconciliation of orders: line items are planned; fills, outcomes and comparisons follow from them with faults of known kinds."""

from __future__ import annotations

from panelmill.operators import reconcile as R
from panelmill.sources import bars as B

#: The five sets as SQL that both engines run; the rules are written apart for each.
SETS = {
    "lines": "SELECT l_orderkey AS statement, l_partkey AS code, l_linestatus AS side, l_linenumber AS position, CAST(l_quantity AS BIGINT) AS shares, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_suppkey AS BIGINT) AS supplier, CAST(o_orderdate AS DATE) AS day FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "planned": "SELECT statement, code, side, shares FROM {lines} WHERE code % 59 <> 0",
    "fills": "SELECT statement, code, side, shares - CASE WHEN code % 9 = 0 THEN 1 ELSE 0 END AS shares, price, CAST(CASE WHEN supplier % 31 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS fee, CASE WHEN supplier % 29 = 0 THEN day + INTERVAL '1' DAY ELSE day END AS trade_date FROM {lines} WHERE (statement + position) % 6 <> 0",
    "keys": "SELECT statement, code, side, min(position) AS position, sum(shares) AS planned_shares, sum(CASE WHEN (statement + position) % 6 <> 0 THEN shares - CASE WHEN code % 9 = 0 THEN 1 ELSE 0 END ELSE 0 END) AS filled_shares FROM {lines} GROUP BY statement, code, side",
    "outcomes": "SELECT statement, code, side, position + k AS position, filled_shares + k AS filled_shares, planned_shares - filled_shares AS unfilled_shares, CASE WHEN code % 13 = 0 THEN 'UNKNOWN' WHEN filled_shares = 0 THEN 'UNFILLED' WHEN filled_shares = planned_shares THEN 'FILLED' ELSE 'partially_filled' END AS status FROM (SELECT *, 0 AS k FROM {keys} UNION ALL SELECT *, 1 AS k FROM {keys} WHERE code % 19 = 0) WHERE code % 17 <> 0",
    "comparison": "SELECT statement, code, side, position, planned_shares, filled_shares AS shares, planned_shares - filled_shares + CASE WHEN code % 23 = 0 THEN 1 ELSE 0 END AS unfilled_shares, CASE WHEN filled_shares = 0 THEN 'UNFILLED' WHEN filled_shares = planned_shares THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS fill_status FROM {keys} WHERE code % 37 <> 0",
    "statements": "SELECT o_orderkey AS statement, CAST(o_orderdate AS DATE) AS execution_date, CASE WHEN o_orderkey % 7 = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS completion FROM {orders}",
}


def four_set_findings(spark, sf_dir):
    """Every rule that a statement's plans, fills, outcomes and comparisons break."""
    # Orders are hashed within the partitions of a shuffle: no task holds all of them, no line items are sorted, and all sets lie by statement.
    sets = {"lineitem": B.table(spark, sf_dir, "lineitem"), "orders": B.table(spark, sf_dir, "orders").hint("shuffle_hash")}
    for name, text in SETS.items():
        sets[name] = spark.sql(text, **{k: v for k, v in sets.items() if "{" + k + "}" in text})
    return R.findings(*[sets[k] for k in ("statements", "planned", "fills", "outcomes", "comparison")])


_NAMES = {k: k for k in ("lineitem", "orders", *SETS)}
FINDINGS_SQL = "WITH " + ",\n".join(f"{k} AS ({v.format(**_NAMES)})" for k, v in SETS.items()) + """,
pl AS (SELECT statement, code, side, sum(shares) AS p FROM planned GROUP BY ALL),
fi AS (SELECT f.statement, code, side, sum(shares) AS f, count(*) FILTER (shares <= 0 OR price <= 0 OR fee < 0 OR trade_date <> execution_date) AS bad FROM fills f JOIN statements s ON f.statement = s.statement GROUP BY ALL),
oc AS (SELECT statement, code, side, count(*) AS n, arg_min(filled_shares, position) AS d, arg_min(unfilled_shares, position) AS u, upper(arg_min(status, position)) AS st FROM outcomes GROUP BY ALL),
co AS (SELECT statement, code, side, count(*) AS m, arg_min(planned_shares, position) AS cp, arg_min(shares, position) AS cd, arg_min(unfilled_shares, position) AS cu, arg_min(fill_status, position) AS cs FROM comparison GROUP BY ALL),
j AS (SELECT *, CASE d WHEN 0 THEN 'UNFILLED' ELSE if(u = 0, 'FILLED', 'PARTIALLY_FILLED') END AS want FROM (SELECT * FROM pl FULL JOIN fi USING (statement, code, side) FULL JOIN oc USING (statement, code, side) FULL JOIN co USING (statement, code, side))),
x AS (SELECT statement, code, side, 'FILL_INVALID' AS finding FROM j WHERE bad > 0
UNION ALL SELECT statement, code, side, 'FILL_WITHOUT_PLAN' FROM fi ANTI JOIN pl USING (statement, code, side)
UNION ALL SELECT statement, code, side, 'OUTCOME_WITHOUT_PLAN' FROM oc ANTI JOIN pl USING (statement, code, side)
UNION ALL SELECT statement, code, side, 'OUTCOME_MISSING' FROM pl ANTI JOIN oc USING (statement, code, side)
UNION ALL SELECT statement, code, side, 'OUTCOME_DUPLICATE' FROM oc WHERE n > 1
UNION ALL SELECT statement, code, side, 'OUTCOME_INVALID' FROM j WHERE n > 0 AND (d < 0 OR u < 0 OR d + u <> coalesce(p, 0) OR coalesce(f, 0) <> d OR st <> want)
UNION ALL SELECT statement, code, side, 'COMPARISON_WITHOUT_PLAN' FROM co ANTI JOIN pl USING (statement, code, side)
UNION ALL SELECT statement, code, side, 'COMPARISON_MISSING' FROM pl ANTI JOIN co USING (statement, code, side)
UNION ALL SELECT statement, code, side, 'COMPARISON_DUPLICATE' FROM co WHERE m > 1
UNION ALL SELECT statement, code, side, 'COMPARISON_INVALID' FROM j WHERE m > 0 AND NOT coalesce(n > 0 AND cd = d AND cu = u AND cp = p AND cs = want, false)
UNION ALL SELECT s.statement, NULL, NULL, 'COMPLETION_MISMATCH' FROM statements s LEFT JOIN (SELECT statement, sum(p) AS p, sum(greatest(d, 0)) AS d FROM j GROUP BY 1) t ON s.statement = t.statement
  WHERE completion <> CASE WHEN coalesce(d, 0) = 0 THEN 'UNFILLED' WHEN d = p THEN 'COMPLETE' ELSE 'PARTIAL' END)
SELECT * FROM x"""

QUERIES = {"four_set_findings": four_set_findings}
ORACLES = {"four_set_findings": FINDINGS_SQL}
