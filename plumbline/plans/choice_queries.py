"""Queries over past choices, places and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.functions.text import query_key as key_of
from plumbline.operators import history, splits

from .bindings import CHOICES, SHOPPED, bound, plain
from .catalog import catalog

QUERIES, ORACLE_SQL, query = catalog()

_SHARES = f"""WITH choices AS ({plain(CHOICES)}), known AS (SELECT search_loc, item_loc, count(*)::DOUBLE AS c FROM choices WHERE search_loc IS NOT NULL AND item_loc IS NOT NULL GROUP BY ALL),
every AS (SELECT * FROM known UNION ALL SELECT DISTINCT search_loc, search_loc, 5.0::DOUBLE FROM known), summed AS (SELECT search_loc, item_loc, sum(c) AS c FROM every GROUP BY ALL),
shares AS (SELECT search_loc, item_loc, round(c / sum(c) OVER (PARTITION BY search_loc), 6) AS p FROM summed)
"""


@query(_SHARES + "SELECT * FROM shares")
def location_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where searchers of a place choose items, smoothed towards their own place."""
    return history.transitions(bound(spark, sf_dir, CHOICES))


@query(_SHARES + """, searched AS (SELECT DISTINCT c_nationkey AS search_loc FROM customer UNION SELECT n_nationkey + 100 FROM nation WHERE n_nationkey < 5), present AS (SELECT DISTINCT s_nationkey AS item_loc FROM supplier UNION SELECT 101)
SELECT search_loc, item_loc, p FROM shares JOIN searched USING (search_loc) JOIN present USING (item_loc) WHERE p >= 0.005 OR search_loc = item_loc
UNION ALL SELECT search_loc, search_loc, 1.0::DOUBLE FROM searched WHERE search_loc NOT IN (SELECT search_loc FROM shares) AND search_loc IN (SELECT item_loc FROM present)""")
def geo_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in each searched place's zone; places without history stand for themselves."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    searched = read("customer").select(F.col("c_nationkey").alias("search_loc")).distinct().union(read("nation").where("n_nationkey < 5").select(F.col("n_nationkey") + 100))
    present = read("supplier").select(F.col("s_nationkey").alias("item_loc")).distinct().union(spark.range(1).select(F.lit(101)))
    return history.zones(history.transitions(bound(spark, sf_dir, CHOICES)), searched, present)


@query(_SHARES + "SELECT search_loc, item_loc FROM (SELECT *, row_number() OVER (PARTITION BY search_loc ORDER BY p DESC, item_loc) AS k FROM shares WHERE item_loc IN (SELECT s_nationkey FROM supplier)) WHERE k = 1")
def geo_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most probable place with items."""
    present = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("item_loc")).distinct()
    return history.likeliest(history.transitions(bound(spark, sf_dir, CHOICES)), present)


_KEYED = f"WITH choices AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(query, ' '), lambda w: w <> ''))), ' ') AS query_key FROM ({plain(CHOICES)}))"
_TOKENS = _KEYED + """, words AS (SELECT unnest(string_split(query_key, ' ')) AS token, category FROM choices), counts AS (SELECT token, category, count(*) AS c FROM words GROUP BY ALL),
per AS (SELECT token, sum(c) AS n, sum(CASE WHEN category IS NOT NULL THEN c END) AS known FROM counts GROUP BY token HAVING sum(c) >= 2 AND sum(CASE WHEN category IS NOT NULL THEN c END) > 0),
bytoken AS (SELECT token, category, round(c::DOUBLE / known, 6) AS p FROM counts JOIN per USING (token) WHERE category IS NOT NULL)
"""


@query(_TOKENS + "SELECT * FROM bytoken")
def category_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that each word leads to."""
    return history.token_categories(bound(spark, sf_dir, CHOICES), F.col("query"))


@query(_TOKENS + """, keys AS (SELECT DISTINCT query_key FROM choices), summed AS (SELECT query_key, category, round(sum(p), 6) AS s FROM (SELECT query_key, unnest(string_split(query_key, ' ')) AS token FROM keys) JOIN bytoken USING (token) GROUP BY ALL),
shared AS (SELECT query_key, category, round(s / round(sum(s) OVER (PARTITION BY query_key), 6), 6) AS p FROM summed)
SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY p DESC, category) = 1 AS INT) AS is_top FROM shared""")
def query_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category distribution of each query text."""
    pairs = bound(spark, sf_dir, CHOICES)
    keys = pairs.select("query").distinct().select(key_of(F.col("query")).alias("query_key")).distinct()
    return history.query_categories(keys, history.token_categories(pairs, F.col("query")))


@query(_KEYED + """, t AS (SELECT query_key, count(*) AS text_chosen FROM choices GROUP BY query_key), n AS (SELECT count(*) AS n FROM choices), b AS (SELECT query_key, category, count(*) AS chosen FROM choices WHERE category IS NOT NULL GROUP BY ALL)
SELECT query_key, category, coalesce(chosen, 0) AS chosen, text_chosen, round(ln(1 + text_chosen::DOUBLE / n * 1e5), 6) AS log_count, round(coalesce(chosen, 0)::DOUBLE / text_chosen, 6) AS share FROM t LEFT JOIN b USING (query_key), n""")
def history_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a text was chosen, and the share of each category."""
    return history.choice_shares(bound(spark, sf_dir, CHOICES).withColumn("query_key", key_of(F.col("query"))))


_PLACES = "SELECT s_nationkey AS location, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier"


@query(f"SELECT location, median(lat) AS lat, median(lon) AS lon, count(*) AS n_items, round(ln(1 + count(*)::DOUBLE), 6) AS size FROM ({_PLACES}) GROUP BY location")
def location_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median position and size of each place."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    at = s.select(F.col("s_nationkey").alias("location"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"))
    return at.groupBy("location").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count(F.lit(1)).alias("n_items"), F.round(F.log1p(F.count(F.lit(1)).cast("double")), 6).alias("size"))


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey AS location, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier), c AS (SELECT location, median(lat) AS clat, median(lon) AS clon FROM s GROUP BY location)
SELECT s_suppkey, round(2 * 6371.0e0 * asin(sqrt(least(greatest(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin((radians(clon) - radians(lon)) / 2), 2), 0.0e0), 1.0e0))), 4) AS km FROM s JOIN c USING (location)""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each supplier from its place's centroid."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    at = s.select("s_suppkey", F.col("s_nationkey").alias("location"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"))
    centre = at.groupBy("location").agg(F.median("lat").alias("clat"), F.median("lon").alias("clon"))
    return at.join(centre, "location").select("s_suppkey", F.round(numbers.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 4).alias("km"))


_H = lambda c, seed: f"md5(concat({c}::VARCHAR, ':{seed}'))"


@query(f"""WITH ids AS (SELECT DISTINCT o_orderkey AS query_id FROM orders), r AS (SELECT query_id, row_number() OVER (ORDER BY {_H('query_id', 42)}, query_id) AS k, count(*) OVER () AS n FROM ids)
SELECT query_id, CAST(k <= greatest(1, floor(n * 0.03e0)) AS INT) AS in_small FROM r WHERE k <= greatest(1, floor(n * 0.1e0))""")
def heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the queries, and the 3 % inside it."""
    q = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("query_id"))
    small = splits.held_out(q, "query_id", 0.03).withColumn("_s", F.lit(1))
    return splits.held_out(q, "query_id", 0.1).join(small, "query_id", "left").select("query_id", F.coalesce("_s", F.lit(0)).alias("in_small"))


def _selected(source: str, known: str, share: float, n_valid: int, n_test: int, seed: int = 42) -> str:
    """CTEs that end in picked (query_id, seen, split): one query a text, then the limit of choices, then quotas by stratum."""
    total = n_valid + n_test
    target = round(total * (1 - share))
    return f"""first AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_H('query_id', seed)}, query_id) AS k FROM {source}),
marked AS (SELECT query_id, query IN (SELECT query FROM {known}) AS seen FROM first WHERE k = 1 AND n_pos > 0 AND n_pos <= 20), strata AS (SELECT count(*) FILTER (seen) AS ns, count(*) FILTER (NOT seen) AS nu FROM marked),
want AS (SELECT least(nu, {target}) AS wu, CASE WHEN least(nu, {target}) = 0 THEN least(ns, {total}) WHEN nu < {target} THEN least(ns, CAST(round_even(nu * {share}e0 / {1 - share}e0, 0) AS BIGINT)) ELSE least(ns, {total - target}) END AS ws FROM strata),
lots AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY {_H('query_id', seed + 1)}, query_id) AS r FROM marked), drawn AS (SELECT query_id, seen FROM lots, want WHERE r <= CASE WHEN seen THEN ws ELSE wu END),
picked AS (SELECT query_id, seen, CASE WHEN row_number() OVER (ORDER BY {_H('query_id', seed + 2)}, query_id) <= (SELECT floor((ws + wu) * {n_valid}e0 / {total}e0) FROM want) THEN 'valid' ELSE 'test' END AS split FROM drawn)"""


@query(f"WITH q AS ({plain(SHOPPED)}), known AS (SELECT DISTINCT query FROM q WHERE status = 'F'), asked AS (SELECT * FROM q WHERE status <> 'F'), {_selected('asked', 'known', 0.4, 100, 100)} SELECT * FROM picked")
def eval_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries with the wanted share of known texts."""
    q = bound(spark, sf_dir, SHOPPED)
    return splits.eval_select(q.where("status <> 'F'"), "query_id", "query", "n_pos", q.where("status = 'F'").select("query"), 0.4, 100, 100)


@query(f"WITH q AS ({plain(SHOPPED)}), known AS (SELECT DISTINCT query FROM q), asked AS (SELECT * FROM q WHERE status <> 'F'), {_selected('asked', 'known', 0.4, 70, 33)} SELECT * FROM picked")
def eval_select_all_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries where every text is known."""
    q = bound(spark, sf_dir, SHOPPED)
    return splits.eval_select(q.where("status <> 'F'"), "query_id", "query", "n_pos", q.select("query"), 0.4, 70, 33)


_HELD = lambda share: f"(SELECT query_id FROM (SELECT query_id, row_number() OVER (ORDER BY {_H('query_id', 42)}, query_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM q)) WHERE k <= greatest(1, floor(n * {share}e0)))"


@query(f"""WITH q AS ({plain(SHOPPED)}), held AS {_HELD(0.1)}, inner_ AS {_HELD(0.03)}, asked AS (SELECT * FROM q WHERE query_id IN (SELECT query_id FROM inner_)), known AS (SELECT DISTINCT query FROM q WHERE query_id NOT IN (SELECT query_id FROM inner_)),
{_selected('asked', 'known', 0.5, 40, 40)}, cand AS (SELECT * FROM q WHERE query_id IN (SELECT query_id FROM held)), barred AS (SELECT DISTINCT query FROM cand WHERE query_id IN (SELECT query_id FROM picked)),
few AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_H('query_id', 42)}, query_id) AS k FROM cand WHERE query NOT IN (SELECT query FROM barred) AND n_pos > 0 AND n_pos <= 20 AND length(trim(query)) >= 2)
SELECT query_id, 'history' AS role FROM q WHERE query_id NOT IN (SELECT query_id FROM held) UNION ALL SELECT query_id, split FROM picked UNION ALL SELECT * FROM (SELECT query_id, 'train' FROM few WHERE k <= 3 ORDER BY {_H('query_id', 43)}, query_id LIMIT 1000)""")
def split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, training and evaluation queries from one call."""
    return splits.split_roles(bound(spark, sf_dir, SHOPPED), "query_id", "query", "query", "n_pos", 0.5, 40, 40, 1000)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of two sets."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return splits.id_union([read("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")), read("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))], "id")


@query(f"SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ORDER BY {_H('p_partkey', 42)}, p_partkey LIMIT 100")
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred items that nobody chose in number."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return splits.distractors(read("part").select(F.col("p_partkey").alias("item_id")), read("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("item_id")), "item_id", 100)


@query("SELECT c_custkey, c_name, part, row_number() OVER (ORDER BY p, c_custkey) - 1 AS row FROM (SELECT *, CASE c_nationkey WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS p, CASE c_nationkey WHEN 3 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS part FROM customer WHERE c_nationkey IN (1, 2, 3))")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered part after part."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    ids = lambda n: c.where(f"c_nationkey = {n}").select("c_custkey")
    return splits.in_order(c.drop("c_nationkey"), "c_custkey", [("train", ids(3)), ("valid", ids(1)), ("test", ids(2))])


@query(f"""WITH q AS ({plain(SHOPPED)}), barred AS (SELECT DISTINCT query FROM q WHERE query_id % 50 = 0), usable AS (SELECT * FROM q WHERE query NOT IN (SELECT query FROM barred) AND n_pos > 0 AND n_pos <= 20 AND length(trim(coalesce(query, ''))) >= 2),
few AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_H('query_id', 42)}, query_id) AS k FROM usable) SELECT query_id, query, location, n_pos, status FROM few WHERE k <= 3 ORDER BY {_H('query_id', 43)}, query_id LIMIT 5000""")
def clean_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training queries without evaluation texts."""
    q = bound(spark, sf_dir, SHOPPED)
    return splits.clean_train(q, "query_id", "query", "query", "n_pos", q.where("query_id % 50 = 0").select("query_id"), 5000)


@query("SELECT p_partkey AS item_id, p_name AS title FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 3 = 0")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training items and the serving items that they lack."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return splits.corpus_union(p.where("item_id % 3 <> 0"), p.withColumn("title", F.upper("title")), "item_id")


@query("SELECT o_orderkey, l_linenumber, label FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS label, CAST('0x' || substr(md5(concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, '42')), 1, 8) AS BIGINT) / 4294967296.0e0 AS u FROM lineitem) WHERE label > 0 OR u < 0.5")
def neg_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and half of the negatives."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return splits.thin_negatives(t, ["o_orderkey", "l_linenumber"], "label")


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by an order of its own."""
    return splits.first_row(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_retailprice * 900 - 900000 IS NOT NULL THEN round(least(greatest(p_retailprice * 900 - 900000, 0), 1e6), 6) END AS price, round(ln(1 + greatest(p_size::DOUBLE - 3, 0)), 6) AS log_size FROM part")
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped prices and log counts of dirty numbers."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(numbers.price((F.col("p_retailprice") * 900 - 900000).cast("string")), 6).alias("price"), F.round(numbers.log_count(F.col("p_size") - 3), 6).alias("log_size"))
