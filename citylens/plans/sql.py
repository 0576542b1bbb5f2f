"""The same analyses written as Spark SQL text over temp views (the SQL entry of the case studies).

Catalyst produces the same physical plan as the DataFrame form.
"""

from __future__ import annotations

from citylens.sources import views as V

TOP_CODES_PER_BIN = """
WITH hours AS (
  SELECT violation_code, hour(try_to_timestamp(concat(violation_time, 'M'), 'hhmma')) AS hour
  FROM clock_tickets
  WHERE issue_ts >= timestamp_ntz '2024-01-01' AND issue_ts < timestamp_ntz '2025-01-01'),
bins AS (
  SELECT violation_code, CAST(hour div 4 + 1 AS INT) AS bin FROM hours WHERE hour IS NOT NULL),
counts AS (SELECT bin, violation_code, count(*) AS count FROM bins GROUP BY bin, violation_code)
SELECT bin, violation_code, count, rank FROM (
  SELECT bin, violation_code, count, dense_rank() OVER (PARTITION BY bin ORDER BY count DESC) AS rank
  FROM counts) ranked
WHERE rank <= 3
"""

SEASON_SHARE = """
WITH s AS (
  SELECT element_at(array('Winter', 'Spring', 'Summer', 'Autumn'), CAST((month(issue_ts) % 12) div 3 + 1 AS INT)) AS season
  FROM tickets WHERE issue_ts >= timestamp_ntz '1997-01-01' AND issue_ts < timestamp_ntz '1998-01-01'),
c AS (SELECT season, count(*) AS count FROM s GROUP BY season)
SELECT season, count, CAST(count AS DOUBLE) * 100.0 / CAST((SELECT sum(count) FROM c) AS DOUBLE) AS share FROM c
"""


def sql_top_codes_per_bin(spark, sf):
    V.register(spark, sf)
    return spark.sql(TOP_CODES_PER_BIN)


def sql_season_share(spark, sf):
    V.register(spark, sf)
    return spark.sql(SEASON_SHARE)


QUERIES = {
    "sql_top_codes_per_bin": sql_top_codes_per_bin,
    "sql_season_share": sql_season_share,
}
