"""Article-shaped views over the driver tables (see FIXTURES.md).

The same SQL text runs in Spark (tables bound as DataFrame arguments of
``spark.sql``) and in DuckDB (tables are views of the same names), so the
Spark jobs and their oracle see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture definition (FIXTURES.md §C and §D).
ARTICLES_SQL = """
SELECT d.doc_id AS article_id,
       CAST(o.o_orderdate AS DATE) AS date,
       CAST(year(o.o_orderdate) AS BIGINT) AS year,
       CAST(month(o.o_orderdate) AS BIGINT) AS month,
       CAST(day(o.o_orderdate) AS BIGINT) AS day,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL
            WHEN d.doc_id % 17 = 0 THEN concat(d.source, ' Desk')
            WHEN d.doc_id % 19 = 0 THEN 'News Staff'
            WHEN d.doc_id % 23 = 0 THEN 'None'
            ELSE concat('Author ', CAST(o.o_custkey % 40 AS STRING)) END AS author,
       CASE WHEN d.doc_id % 29 = 0 THEN NULL
            ELSE split_part(d.text, chr(10), 1) END AS title,
       CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE d.text END AS article,
       concat('http://example.org/', CAST(d.doc_id AS STRING)) AS url,
       CASE WHEN d.doc_id % 97 = 0 THEN concat('slug-', CAST(d.doc_id AS STRING))
            ELSE CASE (d.doc_id * 7) % 16
                 WHEN 0 THEN 'tech news'      WHEN 1 THEN 'World News'
                 WHEN 2 THEN 'SPORTS'         WHEN 3 THEN 'Wall Street'
                 WHEN 4 THEN 'art & design'   WHEN 5 THEN 'U.S.'
                 WHEN 6 THEN 'business news'  WHEN 7 THEN 'politics'
                 WHEN 8 THEN 'cold weather'   WHEN 9 THEN 'opinion: guests'
                 WHEN 10 THEN 'Opinion'       WHEN 11 THEN 'health-care'
                 WHEN 12 THEN 'nan'           WHEN 13 THEN 'NATION_3'
                 WHEN 14 THEN 'book reviews'  ELSE NULL END END AS section,
       CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE d.source END AS publication,
       CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE o.o_orderpriority END AS simple_topic
FROM {documents} d JOIN {orders} o ON o.o_orderkey = d.doc_id
"""

FACTS_SQL = """
SELECT o.o_orderkey AS article_id,
       CAST(o.o_orderdate AS DATE) AS date,
       CAST(year(o.o_orderdate) AS BIGINT) AS year,
       c.c_mktsegment AS publication,
       concat('Author ', CAST(o.o_custkey AS STRING)) AS author,
       o.o_orderpriority AS simple_topic,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE 'x' END AS article,
       CASE WHEN o.o_orderkey % 43 = 0 THEN NULL
            ELSE CAST((o.o_orderkey * 37) % 201 - 100 AS DOUBLE) / 100 END AS score,
       CAST((o.o_orderkey * 11) % 101 AS DOUBLE) / 100 AS pos,
       CAST(((100 - (o.o_orderkey * 11) % 101) * ((o.o_orderkey * 3) % 5)) AS DOUBLE) / 400 AS neg,
       CAST(((100 - (o.o_orderkey * 11) % 101) * (4 - (o.o_orderkey * 3) % 5)) AS DOUBLE) / 400 AS neu
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

_TABLE_NAMES = ("documents", "orders", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-layer article table: ``article_id`` plus the 10 raw fields."""
    return spark.sql(ARTICLES_SQL, documents=table(spark, sf_dir, "documents"),
                     orders=table(spark, sf_dir, "orders"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense per-month fact table for the grouping jobs."""
    return spark.sql(FACTS_SQL, orders=table(spark, sf_dir, "orders"),
                     customer=table(spark, sf_dir, "customer"))


def sql_with(*views: str) -> str:
    """A DuckDB ``WITH`` prefix defining the named fixture views."""
    parts = []
    names = {n: n for n in _TABLE_NAMES}
    for v in views:
        body = {"articles": ARTICLES_SQL, "facts": FACTS_SQL}[v]
        parts.append(f"{v} AS ({body.format(**names)})")
    return "WITH " + ",\n".join(parts) + "\n"
