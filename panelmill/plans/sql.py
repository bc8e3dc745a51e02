"""Common table expressions of the comparison SQL."""

BARS = """px AS (
  SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT code, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
    sum(l_quantity) AS volume, round(sum(l_extendedprice), 6) AS amount, count(*) AS trades
  FROM px GROUP BY code, date),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM bars)"""

BENCH = """bm AS (
  SELECT CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice) / sum(l_quantity), 6) AS bench FROM lineitem GROUP BY 1)"""

SESSIONS = """cal AS (
  SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(
    (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)::TIMESTAMP, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)::TIMESTAMP, INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6)"""

CLIP = "greatest({1}, least({2}, {0}))"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
