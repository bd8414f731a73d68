"""Input tables and the derived dirty views the registered queries run on.

The driver tables hold no nulls, duplicates or constants, so cleaning them as
they are would prove nothing.  Each view is one SQL text that Spark and the
checking engine both evaluate over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_DIRTY_ORDER_COLUMNS = """
  SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20
       ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN 'N/A'
       WHEN o_orderkey % 7 = 0 THEN concat('  ', lower(o_orderpriority), ' *')
       ELSE o_orderpriority END AS o_orderpriority,
  'EU' AS const_region, o_custkey AS custkey_copy, CAST(NULL AS STRING) AS empty_col,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus END AS sparse_status,
  CASE WHEN o_orderkey % 19 = 0 THEN 'bad'
       ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) END AS cents_text,
  CASE WHEN o_orderkey % 23 = 0 THEN 'unknown'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
  (o_orderkey % 2 = 0) AS is_even
  FROM orders"""

DIRTY_ORDERS = f"{_DIRTY_ORDER_COLUMNS} UNION ALL {_DIRTY_ORDER_COLUMNS} WHERE o_orderkey % 50 = 0"

DIRTY_EVENTS = """
  SELECT event_id, user_id, ts,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 31 = 0 THEN concat(' ', upper(event_type), '--')
       WHEN event_id % 37 = 0 THEN '?' ELSE event_type END AS event_type,
  CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 8 = 0 THEN NULL
       ELSE value END AS value,
  CASE WHEN event_id % 41 = 0 THEN 2.5E0 ELSE CAST(event_id % 6 AS DOUBLE) END AS visits_count,
  concat('$', CAST(event_id % 1000 AS STRING), ',000') AS price_text
  FROM events
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 500 = 1"""

SCORED_DOCS = """
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

VIEWS = {"dirty_orders": DIRTY_ORDERS, "dirty_events": DIRTY_EVENTS, "scored_docs": SCORED_DOCS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a derived view over the driver tables it names."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for t in TABLES:
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def cte(*names: str) -> str:
    """The same views as the head of a checking SQL text."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


Catalog = dict[str, Query]
