"""Queries over ranks, fusion and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import ranking

from .bindings import SCORED, bound, plain
from .catalog import catalog

QUERIES, ORACLE_SQL, query = catalog()

_S = f"WITH s AS ({plain(SCORED)})"
_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, SCORED)


@query(_S + " SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INT) AS rank FROM s")
def rank_within_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every row within its query."""
    return ranking.rank_within(scored(spark, sf_dir), "query_id", "item_id", "score").select("query_id", "item_id", "rank")


@query(_S + " SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10 AS INT) AS in_top FROM s")
def topk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a row among its query's first ten?"""
    return ranking.topk_mask(scored(spark, sf_dir), "query_id", "item_id", "score", 10).select("query_id", "item_id", "in_top")


_RANKS = _S + """, r AS (SELECT query_id, item_id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INT) AS r1,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY shop DESC, item_id) - 1 AS INT) AS r2, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score * shop, 6) DESC, item_id) - 1 AS INT) AS r3 FROM s)"""


def three_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("both", F.round(F.col("score") * F.col("shop"), 6))
    for name, by in (("r1", "score"), ("r2", "shop"), ("r3", "both")):
        s = ranking.rank_within(s, "query_id", "item_id", by, name)
    return s.select("query_id", "item_id", "label", "r1", "r2", "r3")


@query(_RANKS + " SELECT query_id, item_id, round(1.0e0 / (r1 + 60) + 2.0e0 / (r2 + 60) + 0.5e0 / (r3 + 60), 9) AS fused FROM r")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal rank fusion of three rankings."""
    return three_ranks(spark, sf_dir).select("query_id", "item_id", ranking.rrf({"r1": 1.0, "r2": 2.0, "r3": 0.5}).alias("fused"))


@query(_RANKS + " SELECT query_id, item_id, label, r1, r2, r3 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(r1, r2) - 1e6 * label, item_id) AS k FROM r) WHERE k <= 8")
def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows of a query at most: positives, then the best channel rank."""
    return ranking.cap_groups(three_ranks(spark, sf_dir), "query_id", "item_id", "label", ["r1", "r2"], 8)


@query(_S + ", c AS (SELECT query_id, item_id, channel, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, item_id) - 1 AS rank FROM s) SELECT query_id, item_id, channel, CAST(rank AS INT) AS rank FROM c WHERE rank < 5")
def channel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five of each channel of a query, one window for all channels."""
    return ranking.first_of_channels(scored(spark, sf_dir), "query_id", "item_id", "score", "channel", 5).select("query_id", "item_id", "channel", "rank")


_POOL = _S + ", c AS (SELECT query_id, shop, channel, CAST(row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, item_id) - 1 AS INT) AS rank FROM s), top AS (SELECT * FROM c WHERE rank < 5)"
_COLS = ", ".join(f"coalesce(min(CASE WHEN channel = '{c}' THEN rank END), 9999) AS rank_{c}" for c in _CHANNELS)


@query(_POOL + f", m AS (SELECT query_id, shop, {_COLS} FROM top GROUP BY query_id, shop) SELECT *, " + " + ".join(f"CAST(rank_{c} < 9999 AS INT)" for c in _CHANNELS) + " AS n_channels FROM m")
def channel_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of channels, a rank column for each."""
    top = ranking.first_of_channels(scored(spark, sf_dir), "query_id", "item_id", "score", "channel", 5)
    return ranking.merge_channels(top, "query_id", "shop", _CHANNELS)


@query(_RANKS + ", p AS (SELECT r.query_id, r.item_id, s.score + CASE WHEN r2 < 3 THEN 1e6 ELSE 0 END AS p FROM r JOIN s USING (item_id)) SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, item_id) AS k FROM p) WHERE k <= 5")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five where the first three of another ranking have their places."""
    s = ranking.rank_within(scored(spark, sf_dir), "query_id", "item_id", "shop", "r2")
    return ranking.select_topk(s, "query_id", "item_id", "score", 5, quotas={"r2": 3}).select("query_id", "item_id")


@query(_S + " SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score - CASE WHEN coalesce(filter_ok = 0, false) THEN 1e7 ELSE 0 END DESC, item_id) AS k FROM s) WHERE k <= 5")
def hard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five with rows that break a filter last; unknown does not count as broken."""
    return ranking.select_topk(scored(spark, sf_dir), "query_id", "item_id", "score", 5, hard=["filter_ok"]).select("query_id", "item_id")


@query(_S + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s), m AS (SELECT DISTINCT query_id, shop FROM r WHERE r <= 4),
o AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS t FROM r WHERE r > 4 AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = r.query_id AND m.shop = r.shop)),
d AS (SELECT query_id, item_id FROM o WHERE t <= 2), x AS (SELECT query_id, item_id, 'main' AS chosen FROM r WHERE r <= 4 UNION ALL SELECT query_id, item_id, 'shop' FROM d),
n AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id), f AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS t FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.item_id = r.item_id))
SELECT * FROM x UNION ALL SELECT query_id, item_id, 'fill' FROM f JOIN n USING (query_id) WHERE t <= 6 - n""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows, two of them for shops that the first four lack."""
    return ranking.select_topk(scored(spark, sf_dir), "query_id", "item_id", "score", 6, diversity={"shop": 2}).select("query_id", "item_id", "chosen")


_FILL = _S + """, c AS (SELECT query_id, shop, min(r) AS r FROM (SELECT query_id, shop, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS r FROM s) WHERE r < 3 GROUP BY ALL),
q AS (SELECT DISTINCT query_id FROM s), g AS (SELECT shop, row_number() OVER (ORDER BY count(*) DESC, shop) - 1 AS r FROM s GROUP BY shop),
e AS (SELECT query_id, shop, 0 AS s, r FROM c UNION ALL SELECT query_id, shop, 1, g.r FROM q, g), f AS (SELECT query_id, shop, min(struct_pack(s := s, r := r)) AS m FROM e GROUP BY ALL),
z AS (SELECT query_id, shop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m.s, m.r, shop) - 1 AS INT) AS rank FROM f)"""


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    first = ranking.rank_within(s, "query_id", "item_id", "score").where("rank < 3").groupBy("query_id", "shop").agg(F.min("rank").alias("rank"))
    popular = ranking.rank_within(s.groupBy("shop").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1)), "all", "shop", "n").select("shop", "rank")
    everyone = s.select("query_id").distinct().crossJoin(F.broadcast(popular))  # a fill list of a dozen rows
    return ranking.fill_to_k(first, "query_id", "shop", [everyone], 10)


@query(_FILL + " SELECT * FROM z WHERE rank < 10")
def fill_to_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers filled up to ten from a list of popular shops."""
    return filled(spark, sf_dir)


@query(_FILL + " SELECT query_id, string_agg(shop::VARCHAR, ' ' ORDER BY rank) AS answer FROM z WHERE rank < 10 GROUP BY query_id")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer file's rows."""
    return ranking.answers(filled(spark, sf_dir), "query_id", "shop")


_LISTS = """WITH items AS (SELECT s_suppkey AS item, s_nationkey AS place, floor(s_acctbal / 1000) AS score FROM supplier), local AS (SELECT place, item, row_number() OVER (PARTITION BY place ORDER BY score DESC, item) - 1 AS rank FROM items), everywhere AS (SELECT item, row_number() OVER (ORDER BY score DESC, item) - 1 AS rank FROM items),
q AS (SELECT c_custkey AS query, c_nationkey AS place FROM customer), chosen AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item) - 1 AS rank FROM (SELECT DISTINCT o_custkey AS query, l_suppkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey)) """


def fill_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with place and score, queries with place, and what was chosen for them."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("place"), F.floor(F.col("s_acctbal") / 1000).alias("score"))
    queries = read("customer").select(F.col("c_custkey").alias("query"), F.col("c_nationkey").alias("place"))
    pairs = read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query"), F.col("l_suppkey").alias("item")).distinct()
    return items, queries, ranking.rank_within(pairs.withColumn("s", -F.col("item")), "query", "item", "s").select("query", "item", "rank")


@query(_LISTS + "SELECT place, item, CAST(rank AS INT) AS rank FROM local WHERE rank < 3 UNION ALL SELECT NULL, item, CAST(rank AS INT) FROM everywhere WHERE rank < 3")
def fill_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items of each place and of all."""
    local, everywhere = ranking.fill_lists(fill_sides(spark, sf_dir)[0], "item", "place", "score", 3)
    return local.unionByName(everywhere.withColumn("place", F.lit(None).cast(local.schema["place"].dataType)))


@query(_LISTS + """, every AS (SELECT query, item, 0 AS s, rank FROM chosen UNION ALL SELECT query, item, 1, rank FROM q JOIN local USING (place) WHERE rank < 20 UNION ALL SELECT query, item, 2, rank FROM q, everywhere WHERE rank < 20),
best AS (SELECT query, item, min(struct_pack(s := s, r := rank)) AS m FROM every GROUP BY ALL) SELECT query, item, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY m.s, m.r, item) - 1 AS k FROM best) WHERE k < 12""")
def filled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers filled from their place's list, then from the list of all."""
    items, queries, chosen = fill_sides(spark, sf_dir)
    return ranking.fill_answers(chosen, queries, "query", "item", "place", *ranking.fill_lists(items, "item", "place", "score", 20), 12)
