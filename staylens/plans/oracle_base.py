"""DuckDB text shared by the oracle queries: the fixture and its cleaned form.

The oracle engine is DuckDB; its dialect differs from Spark SQL in rtrim
argument order, the global flag of regexp_replace and sum(BIGINT) typing,
which the text below accounts for.
"""

from staylens.sources.fixtures import LISTINGS_RAW_SQL

LISTINGS_CLEAN_SQL = r"""
listings_parsed AS (
  SELECT * EXCLUDE (name, host_id, host_name, bathrooms_text,
                    host_response_rate, host_acceptance_rate, host_is_superhost, price),
    CAST(rtrim(host_response_rate, '%') AS DOUBLE) / 100.0 AS host_response_rate,
    CAST(rtrim(host_acceptance_rate, '%') AS DOUBLE) / 100.0 AS host_acceptance_rate,
    CASE host_is_superhost WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS host_is_superhost,
    CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price,
    CAST(nullif(regexp_extract(bathrooms_text, '(\d+(\.\d+)?)', 1), '') AS DOUBLE) AS bathrooms
  FROM listings_raw),
listings_positive AS (SELECT * FROM listings_parsed WHERE price > 0),
listings_cap AS (SELECT quantile_cont(price, 0.99) AS cap FROM listings_positive),
listings_capped AS (
  SELECT p.* FROM listings_positive p, listings_cap c WHERE p.price <= c.cap),
listings_clean AS (
  SELECT *, ln(1 + price) AS log_price FROM (
    SELECT DISTINCT * EXCLUDE (id) FROM listings_capped)
  WHERE price IS NOT NULL AND room_type IS NOT NULL AND neighbourhood IS NOT NULL)
"""


def with_ctes(select_sql: str, extra: str = "") -> str:
    """Prefix a SELECT with the fixture CTEs (unused CTEs cost nothing in DuckDB)."""
    from staylens.plans.frames import FRAMES_SQL
    ctes = LISTINGS_RAW_SQL.strip() + ",\n" + LISTINGS_CLEAN_SQL.strip() + ",\n" + FRAMES_SQL.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return "WITH " + ctes + "\n" + select_sql.strip()
