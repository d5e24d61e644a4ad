"""How the public test tables play the engine's parts. Each binding is SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ITEMS = "SELECT doc_id AS item_id, text AS description, lang AS location, source AS category, n_chars FROM {documents}"
QUERIES = "SELECT item_id AS query_id, text AS query, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS location FROM {benchmark}"
CHOICES = """SELECT o_orderkey AS query_id, c_nationkey AS search_loc, s_nationkey AS item_loc, lower(concat(c_mktsegment, ' ', o_orderpriority)) AS query,
 CASE WHEN l_linenumber <> 7 THEN p_brand END AS category, l_partkey AS item_id
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
 LEFT JOIN {supplier} ON l_suppkey = s_suppkey LEFT JOIN {part} ON l_partkey = p_partkey"""
SCORED = """SELECT user_id AS query_id, event_id AS item_id, event_type AS channel, value AS score, event_id % 13 AS shop,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 3 > 0 AS INT) END AS filter_ok, CAST(event_id % 7 = 0 AS INT) AS label FROM {events}"""
SHOPPED = "SELECT o_orderkey AS query_id, lower(concat(c_mktsegment, ' ', o_orderpriority, ' ', CAST(o_custkey % 50 AS STRING))) AS query, c_nationkey AS location, o_custkey % 25 AS n_pos, o_orderstatus AS status FROM {orders} JOIN {customer} ON o_custkey = c_custkey"
PARTS = "SELECT p_partkey AS item_id, p_name AS title, concat('Вид услуги ', p_type, ' Тип услуги ', p_brand, ' Рейтинг пользователя ', CAST(p_size % 5 AS STRING), ',5 звезды и выше') AS params, p_retailprice AS price, p_size AS size FROM {part}"
VECTORS = "SELECT vec_id, embedding, label FROM {embeddings}"

#: The candidate pool: parts with a place as items, the texts of every fiftieth part as queries, choices of parts as history.
POOL_ITEMS = """SELECT p_partkey AS item_id, concat(p_name, ' ', p_type) AS title, concat('Вид услуги ', p_type, ' Тип услуги ', p_brand) AS params, concat(p_brand, ' ', p_name, ' ', p_type) AS description,
 p_retailprice AS price, CASE WHEN p_partkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) END AS rating, CASE WHEN p_partkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS reviews,
 p_partkey % 2 = 0 AS phone_hidden, p_partkey % 3 = 0 AS message_forbidden, CASE WHEN p_partkey % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_partkey % 90 AS DOUBLE) END AS lat, CAST(p_partkey % 180 AS DOUBLE) AS lon,
 CASE WHEN p_partkey % 26 < 25 THEN CAST(p_partkey % 26 AS INT) END AS location, p_brand AS microcat FROM {part}"""
POOL_QUERIES = """SELECT p_partkey AS query_id, concat(p_type, ' ', p_name) AS query, CASE WHEN p_size % 2 = 0 THEN concat('Вид услуги ', p_type, ' Рейтинг пользователя 4 звезды и выше') END AS filters,
 CAST(p_size % 30 AS INT) AS location, CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 10 = 1 THEN NULL ELSE 114 END AS category FROM {part} WHERE p_partkey % 50 = 0"""
POOL_CHOICES = """SELECT c_nationkey AS search_loc, CASE WHEN l_linenumber = 1 THEN l_partkey % 25 ELSE c_nationkey END AS item_loc, lower(concat(p_name, ' ', p_type)) AS query,
 CASE WHEN l_linenumber <> 7 AND p_name NOT LIKE 'cold%' THEN p_brand END AS category
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE p_name NOT LIKE 'hot r%' AND c_nationkey <> 3"""


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the tables of a folder."""
    return spark.sql(sql, **tables(spark, sf_dir, sql))


def plain(sql: str) -> str:
    """The same binding over tables of these names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)")


def normalized(column: str) -> str:
    """DuckDB's form of text normalisation."""
    return f"trim(regexp_replace(translate(lower(coalesce({column}, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"
