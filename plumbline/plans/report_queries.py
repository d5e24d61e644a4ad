"""Queries that measure and report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import filter_pairs
from plumbline.operators import evaluation, pool, ranking, splits
from plumbline.sources.tables import materialised

from .bindings import CHOICES, SCORED, SHOPPED, bound, plain
from .catalog import catalog
from .rank_queries import _RANKS, _S, three_ranks

QUERIES, ORACLE_SQL, query = catalog()

_REL = _RANKS + ", rel AS (SELECT query_id, sum(label) AS n_rel FROM r GROUP BY query_id)"


def relevant(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.sum("label").alias("n_rel"))


@query(_REL + ", h AS (SELECT query_id, sum(label) AS hits FROM r WHERE r1 < 20 GROUP BY query_id) SELECT round(avg(coalesce(hits, 0) / n_rel::DOUBLE), 6) AS recall, count(*) AS n_queries FROM rel LEFT JOIN h USING (query_id) WHERE n_rel > 0")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro recall of the first twenty."""
    r = three_ranks(spark, sf_dir)
    return evaluation.macro_recall(r.where("r1 < 20"), relevant(r), "query_id")


@query(_REL + ", h AS (SELECT query_id, sum(label) AS hits FROM r WHERE r1 < 20 OR r2 < 20 GROUP BY query_id) SELECT round(avg(coalesce(hits, 0) / n_rel::DOUBLE), 6) AS recall, count(*) AS n_queries FROM rel LEFT JOIN h USING (query_id) WHERE n_rel > 0")
def pool_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pool of two channels could reach."""
    r = three_ranks(spark, sf_dir)
    return evaluation.macro_recall(r.where("r1 < 20 or r2 < 20"), relevant(r), "query_id")


@query(_REL + ", h AS (SELECT query_id, sum(label) AS hits FROM r WHERE r1 < 20 GROUP BY query_id) SELECT query_id, CAST(n_rel AS BIGINT) AS n_rel, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits, 0) / n_rel::DOUBLE, 6) AS recall FROM rel LEFT JOIN h USING (query_id) WHERE n_rel > 0")
def per_query_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each query."""
    r = three_ranks(spark, sf_dir)
    return evaluation.query_recall(r.where("r1 < 20"), relevant(r), "query_id")


@query(_REL + ", p AS (SELECT query_id, c, k, sum(CASE WHEN v < k THEN label ELSE 0 END) AS hits FROM (SELECT query_id, label, unnest(['r1', 'r2', 'r3']) AS c, unnest([r1, r2, r3]) AS v FROM r), (SELECT unnest([10, 50]) AS k) GROUP BY ALL) SELECT c AS channel, CAST(k AS INT) AS k, round(avg(hits / n_rel::DOUBLE), 6) AS recall FROM p JOIN rel USING (query_id) WHERE n_rel > 0 GROUP BY ALL")
def channel_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each channel within 10 and 50."""
    r = three_ranks(spark, sf_dir)
    return evaluation.channel_recall(r, relevant(r), "query_id", ["r1", "r2", "r3"], [10, 50])


_COMBOS = "(SELECT row_number() OVER (ORDER BY i, j) - 1 AS combo, w1, w2 FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest([0.0e0, 0.5e0, 1.0e0, 2.0e0]) AS w1), (SELECT unnest([0, 1, 2, 3]) AS j, unnest([0.0e0, 0.5e0, 1.0e0, 2.0e0]) AS w2) WHERE w1 + w2 > 0)"


@query(_REL + f""", e AS (SELECT combo, w1, w2, query_id, label, row_number() OVER (PARTITION BY combo, query_id ORDER BY round(w1 / (r1 + 60) + w2 / (r2 + 60), 9) DESC, item_id) AS k FROM r, {_COMBOS}),
h AS (SELECT combo, w1, w2, query_id, sum(label) AS hits FROM e WHERE k <= 20 GROUP BY ALL) SELECT CAST(combo AS INT) AS combo, w1 AS w_r1, w2 AS w_r2, round(sum(hits / n_rel::DOUBLE) / (SELECT count(*) FROM rel WHERE n_rel > 0), 6) AS recall FROM h JOIN rel USING (query_id) WHERE n_rel > 0 GROUP BY ALL""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of every weight combination of two rankings."""
    r = three_ranks(spark, sf_dir)
    return evaluation.weight_grid(r, relevant(r), "query_id", "item_id", ["r1", "r2"], 20)


def selecting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows to select from, and what is relevant; both written, as every step of a search reads them."""
    s = materialised(ranking.rank_within(bound(spark, sf_dir, SCORED), "query_id", "item_id", "shop", "r2"), "selecting")
    return s, materialised(relevant(s), "relevant")


_QUOTA = _S + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shop DESC, item_id) - 1 AS r2 FROM s), rel AS (SELECT query_id, sum(label) AS n_rel FROM s GROUP BY query_id HAVING sum(label) > 0), e AS (SELECT q, query_id, label, row_number() OVER (PARTITION BY q, query_id ORDER BY score + CASE WHEN r2 < q THEN 1e6 ELSE 0 END DESC, item_id) AS k FROM r, (SELECT unnest([0, 3, 5, 10]) AS q))"


@query(_QUOTA + " SELECT CAST(q AS INT) AS quota, round(sum(h / n_rel::DOUBLE) / (SELECT count(*) FROM rel), 6) AS recall FROM (SELECT q, query_id, sum(label) AS h FROM e WHERE k <= 20 GROUP BY ALL) JOIN rel USING (query_id) GROUP BY q")
def quota_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the search over selection parameters: the recall of every quota of a column, in one job."""
    s, rel = selecting(spark, sf_dir)
    values = (0, 3, 5, 10)
    got = evaluation.selection_recalls(s, rel, "query_id", "item_id", "score", [evaluation.with_value(evaluation.NEUTRAL, "quotas", "r2", v) for v in values], 20)
    return spark.createDataFrame(list(zip(values, got, strict=True)), "quota int, recall double")


@query()
def greedy_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over quotas, hard columns and diversity, whole grid, and its acceptance by the other half of the queries."""
    s, rel = selecting(spark, sf_dir)
    half = lambda k: (lambda params: evaluation.selection_recalls(s.where(f"query_id % 2 = {k}"), rel.where(f"query_id % 2 = {k}"), "query_id", "item_id", "score", params, 20))
    best, recall = evaluation.tune_selection(half(0), ["filter_ok"], ["r2"], ["shop"])
    kept = evaluation.accepted(best, half(1))
    return spark.range(1).select(F.lit(json.dumps(best)).alias("params"), F.lit(float(recall)).alias("recall"), F.lit(json.dumps(kept)).alias("accepted"))


@query(_REL + ", h AS (SELECT query_id, sum(label) AS hits FROM r WHERE r1 < 20 GROUP BY query_id), q AS (SELECT query_id, n_rel, round(coalesce(hits, 0) / n_rel::DOUBLE, 6) AS recall FROM rel LEFT JOIN h USING (query_id) WHERE n_rel > 0) SELECT 'parity' AS segment, (query_id % 2)::VARCHAR AS value, round(avg(recall), 6) AS recall, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'n_rel', least(n_rel, 5)::BIGINT::VARCHAR, round(avg(recall), 6), count(*) FROM q GROUP BY ALL")
def segment_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by segments of queries."""
    r = three_ranks(spark, sf_dir)
    per = evaluation.query_recall(r.where("r1 < 20"), relevant(r), "query_id")
    return evaluation.segment_report(per, {"parity": F.col("query_id") % 2, "n_rel": F.least("n_rel", F.lit(5)).cast("long")})


@query(_REL + ", b AS (SELECT CASE WHEN r1 <= 9 THEN 'top-10' WHEN r1 <= 49 THEN '11-50' WHEN r1 <= 99 THEN '51-100' WHEN r1 <= 299 THEN '101-300' ELSE '>300' END AS bucket FROM r WHERE label = 1) SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS share FROM b GROUP BY bucket")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the relevant rows stand."""
    r = three_ranks(spark, sf_dir).where("label = 1")
    return evaluation.value_shares(r.select(evaluation.rank_bucket(F.col("r1")).alias("bucket")), "bucket")


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY event_type")
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each value."""
    return evaluation.value_shares(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


@query(f"WITH q AS ({plain(SHOPPED)}), l AS (SELECT DISTINCT query FROM q WHERE status = 'O'), r AS (SELECT DISTINCT query FROM q WHERE status = 'F') SELECT count(*) AS n, count(r.query) AS n_shared, round(count(r.query) / count(*)::DOUBLE, 6) AS share FROM l LEFT JOIN r ON l.query = r.query")
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of serving texts that training knows."""
    q = bound(spark, sf_dir, SHOPPED)
    return evaluation.overlap_share(q.where("status = 'O'"), q.where("status = 'F'"), "query")


@query("WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.99) AS q99, quantile_cont(n, 0.999) AS q999, count(*) FILTER (n > 5) AS n_many FROM p")
def pick_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of choices per query (over counts, of which there are few distinct)."""
    return evaluation.count_quantiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", {"q50": 0.5, "q90": 0.9, "q99": 0.99, "q999": 0.999}, 5)


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("WITH t AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'), s AS (SELECT * FROM lineitem WHERE l_linestatus = 'O') " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round((SELECT avg({f}) FROM t), 6) AS train_mean, round((SELECT avg({f}) FROM s), 6) AS served_mean, round((SELECT avg({f}) FROM s) / nullif((SELECT avg({f}) FROM t), 0), 6) AS ratio" for f in _FEATURES))
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of features in training and in serving."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return evaluation.drift(t.where("l_linestatus = 'F'"), t.where("l_linestatus = 'O'"), _FEATURES)


@query(_RANKS + ", t AS (SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY r1) AS top5 FROM r WHERE r1 < 5 GROUP BY query_id) SELECT query_id, item_id AS missed, r1 AS missed_rank, top5 FROM r JOIN t USING (query_id) WHERE label = 1 AND r1 >= 20")
def miss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant rows beyond the first twenty, with what stood on top."""
    r = three_ranks(spark, sf_dir)
    top = ranking.answers(r.where("r1 < 5").select("query_id", "item_id", F.col("r1").alias("rank")), "query_id", "item_id").withColumnRenamed("answer", "top5")
    missed = r.where("label = 1 and r1 >= 20").select("query_id", F.col("item_id").alias("missed"), F.col("r1").alias("missed_rank"))
    return missed.join(top, "query_id")


@query(_RANKS + ", m AS (SELECT c, v FROM (SELECT label, unnest(['r1', 'r2', 'r3']) AS c, unnest([r1, r2, r3]) AS v FROM r) WHERE label = 1) SELECT c AS channel, round(avg(CASE WHEN v < 50 THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_share, median(CASE WHEN v < 50 THEN v END) AS median_rank FROM m GROUP BY c")
def missed_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the relevant that each channel has, and their median rank."""
    return evaluation.channel_hits(three_ranks(spark, sf_dir).where("label = 1"), ["r1", "r2", "r3"], 50)


@query("WITH c AS (SELECT o_custkey % 100 AS q, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT q, i, count(*) AS n FROM c GROUP BY ALL) SELECT (SELECT count(DISTINCT q) FROM c WHERE q NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 90)) AS unknown_queries, (SELECT count(DISTINCT i) FROM c WHERE i NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)) AS unknown_items, (SELECT count(*) FROM g WHERE n > 1) AS repeated, (SELECT count(*) FROM (SELECT q FROM c GROUP BY q HAVING count(*) > 50)) AS too_long, (SELECT count(*) FROM customer WHERE c_custkey < 90 AND c_custkey NOT IN (SELECT q FROM c)) AS unanswered")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what breaks the answer contract, in answers that break each of its rules."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    chosen = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 100).alias("q"), F.col("l_partkey").alias("i"))
    return evaluation.validate_answers(chosen, read("customer").where("c_custkey < 90").select(F.col("c_custkey").alias("q")), read("part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("i")), "q", "i", 50)


@query(f"WITH c AS ({plain(CHOICES)}) SELECT search_loc, item_loc, count(*) AS n FROM c WHERE search_loc <> item_loc GROUP BY ALL ORDER BY n DESC, search_loc, item_loc LIMIT 10")
def transition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent choices away from the searched place."""
    c = bound(spark, sf_dir, CHOICES).where("search_loc <> item_loc")
    return c.groupBy("search_loc", "item_loc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "search_loc", "item_loc").limit(10)


@query("""WITH p AS (SELECT p_partkey, p_type, p_brand, lower(concat('Вид услуги ', p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' Тип услуги ', p_brand) END)) AS params FROM part), k AS (SELECT 'Вид услуги' AS key, concat('вид услуги ', lower(p_type)) AS v, params FROM p UNION ALL SELECT 'Тип услуги', concat('тип услуги ', lower(p_brand)), params FROM p)
SELECT key, count(*) AS n, round(avg(CASE WHEN contains(params, v) THEN 1.0e0 ELSE 0.0e0 END), 6) AS share FROM k GROUP BY key""")
def filter_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each filter key's value stands in the chosen item's parameters."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = F.concat(F.lit("Вид услуги "), F.col("p_type"), F.lit(" Тип услуги "), F.col("p_brand"))
    held = F.lower(F.concat(F.lit("Вид услуги "), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" Тип услуги "), F.col("p_brand")))))
    return evaluation.key_matches(p.select(held.alias("params"), F.inline(filter_pairs(asked))), "params")


@query(_RANKS + " SELECT query_id, string_agg(DISTINCT item_id::VARCHAR, ' ' ORDER BY item_id::VARCHAR) AS items FROM r WHERE label = 1 GROUP BY query_id")
def positive_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of relevant items of each query."""
    r = three_ranks(spark, sf_dir).where("label = 1").withColumn("item_id", F.col("item_id").cast("string"))
    return evaluation.positive_sets(r, "query_id", "item_id").select("query_id", F.array_join("items", " ").alias("items"))


@query(_RANKS + ", a AS (SELECT query_id, count(*) AS n FROM r WHERE r1 < 5 GROUP BY query_id) SELECT count(*) AS n, round(avg(n), 6) AS mean_items FROM a")
def answer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of items of the answers."""
    r = three_ranks(spark, sf_dir).where("r1 < 5").select("query_id", "item_id", F.col("r1").alias("rank"))
    return evaluation.answer_length(ranking.answers(r, "query_id", "item_id"))


@query(_REL + ", p AS (SELECT * FROM r WHERE r1 < 20 OR r2 < 20), h AS (SELECT query_id, sum(label) AS hits FROM p GROUP BY query_id) SELECT round(avg(coalesce(hits, 0) / n_rel::DOUBLE) FILTER (n_rel > 0), 6) AS recall, round((SELECT count(*) FROM p) / count(*)::DOUBLE, 6) AS candidates FROM rel LEFT JOIN h USING (query_id)")
def pool_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pool could reach, and its candidates a query."""
    r = three_ranks(spark, sf_dir)
    return evaluation.pool_ceiling(r.where("r1 < 20 or r2 < 20"), relevant(r), "query_id")


_POSITIVES = "SELECT o_custkey % 200 AS query_id, l_partkey % 500 AS item_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"
_LOCATED = f", pos AS (SELECT DISTINCT query_id, item_id FROM ({plain(_POSITIVES)})), sc AS (SELECT query_id, item_id % 500 AS item_id, min(r1) AS rank FROM r GROUP BY ALL)"


def pool_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Positives that a pool may lack, and scored rows."""
    scored = three_ranks(spark, sf_dir).groupBy("query_id", (F.col("item_id") % 500).alias("item_id")).agg(F.min("r1").alias("rank"))
    return bound(spark, sf_dir, _POSITIVES).distinct(), scored


@query(_RANKS + _LOCATED + ", l AS (SELECT CASE WHEN rank IS NULL THEN 'out of pool' WHEN rank <= 9 THEN 'top-10' WHEN rank <= 49 THEN '11-50' WHEN rank <= 99 THEN '51-100' WHEN rank <= 299 THEN '101-300' ELSE '>300' END AS bucket FROM pos LEFT JOIN sc USING (query_id, item_id)) SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM l)::DOUBLE, 6) AS share FROM l GROUP BY bucket")
def positives_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the positives stand, those outside the pool included."""
    positives, scored = pool_sides(spark, sf_dir)
    return evaluation.value_shares(evaluation.located(positives, scored, "query_id", "item_id"), "bucket")


_MISSES = _LOCATED + """, t AS (SELECT p_partkey AS item_id, p_name AS title FROM part), top AS (SELECT query_id, max(title) FILTER (rank = 0) AS top1, max(title) FILTER (rank = 1) AS top2, max(title) FILTER (rank = 2) AS top3 FROM sc LEFT JOIN t USING (item_id) WHERE rank < 3 GROUP BY query_id),
m AS (SELECT pos.query_id, concat('query ', pos.query_id) AS query, pos.item_id AS missed, title AS missed_title, rank AS missed_rank, top1, top2, top3 FROM pos LEFT JOIN sc USING (query_id, item_id) LEFT JOIN t ON t.item_id = pos.item_id LEFT JOIN top ON top.query_id = pos.query_id WHERE rank IS NULL OR rank >= 5)"""


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives, scored = pool_sides(spark, sf_dir)
    queries = positives.select("query_id").distinct().withColumn("query", F.concat(F.lit("query "), "query_id"))
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return evaluation.miss_table(positives, scored, queries, items, "query_id", "item_id", "title", 5, 3)


@query(_RANKS + _MISSES + " SELECT * FROM m")
def miss_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missed positive with its title and the titles that stood on top, wide."""
    return misses(spark, sf_dir)


@query(_RANKS + _MISSES + " SELECT * FROM m WHERE query_id IN (SELECT query_id FROM (SELECT DISTINCT query_id FROM m) ORDER BY md5(concat(query_id::VARCHAR, ':0')), query_id LIMIT 8)")
def miss_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The misses of eight queries, drawn by a hash."""
    return evaluation.sampled_queries(misses(spark, sf_dir), "query_id")


@query(f"WITH q AS ({plain(SHOPPED)}), k AS (SELECT DISTINCT query FROM q WHERE status = 'F') SELECT count(*) AS n, round(avg(CASE WHEN query IN (SELECT query FROM k) THEN 1.0e0 ELSE 0.0e0 END), 6) AS share FROM q WHERE status = 'O'")
def seen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of served queries whose text training knows."""
    q = bound(spark, sf_dir, SHOPPED)
    return evaluation.seen_share(q.where("status = 'O'"), q.where("status = 'F'"), "query")


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 WHEN p_size - 5 <= 10 THEN 1 ELSE 2 END AS rev_bucket, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 90 >= 1 THEN 1 ELSE 0 END AS mc_plausible FROM part")
def selection_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by number of reviews, and whether the words lead to the category (unknown counts as yes)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = p.select("p_partkey", F.log1p(F.greatest(F.col("p_size") - 5, F.lit(0)).cast("double")).alias("item_reviews_count"), F.when(F.col("p_partkey") % 4 > 0, (F.col("p_partkey") % 90) / 100).alias("tok_mc_share"))
    return pool.helpers(given).select("p_partkey", "rev_bucket", "mc_plausible")


@query(_S + ", b AS (SELECT query_id, item_id, label, coalesce(filter_ok / 3.0e0, 0.0e0) + 2 * (shop % 2) + score AS by_vector, score + 40 * (shop % 2) AS by_place FROM s) SELECT query_id, item_id, round(by_vector, 6) AS by_vector, round(by_place, 6) AS by_place FROM b")
def linear_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores without training."""
    s = bound(spark, sf_dir, SCORED)
    given = s.select("query_id", "item_id", (F.col("filter_ok") / 3).alias("bm25_rel_geo"), (F.col("shop") % 2).alias("in_geo"), F.col("score").alias("cos"), F.col("score").alias("bm25"), (F.col("shop") % 2).alias("location_match"))
    return given.select("query_id", "item_id", *[F.round(c, 6).alias(n) for n, c in pool.linear_baselines().items()])


@query(_S + " SELECT query_id, item_id FROM s WHERE query_id IN (SELECT query_id FROM s GROUP BY query_id HAVING max(label) > 0)")
def with_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of queries that have something to learn from."""
    return splits.with_positive(bound(spark, sf_dir, SCORED), "query_id", "label").select("query_id", "item_id")
