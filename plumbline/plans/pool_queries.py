"""Queries over the candidate pool and the rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.functions.text import query_key as key_of
from plumbline.operators import history, pool
from plumbline.sources.tables import materialised

from .bindings import POOL_CHOICES, POOL_ITEMS, POOL_QUERIES, bound, normalized, plain, tables
from .catalog import catalog
from .text_queries import POSTINGS, bm25_scores

QUERIES, ORACLE_SQL, query = catalog()


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bindings import ITEMS, QUERIES as ASKED

    found = bm25_scores(spark, sf_dir)
    here = found.join(bound(spark, sf_dir, ITEMS).select("item_id", "location", "n_chars"), "item_id").join(bound(spark, sf_dir, ASKED).select("query_id", F.col("location").alias("search_loc")), "query_id")
    return here.select("query_id", "item_id", "bm25", (F.col("location") == F.col("search_loc")).cast("int").alias("in_geo"), (F.col("n_chars") % 2 == 0).cast("int").alias("filter_ok"))


@query(POSTINGS + """, m AS (SELECT s.query_id, bm25, i.location = a.location AS g, n_chars % 2 = 0 AS f FROM scored s JOIN items i USING (item_id) JOIN asked a USING (query_id))
SELECT query_id, max(bm25) AS best, coalesce(max(CASE WHEN g THEN bm25 END), 0.0) AS best_geo, round(ln(1 + count(*)::DOUBLE), 6) AS n_bm25_hits_log, round(ln(1 + count(*) FILTER (g)::DOUBLE), 6) AS geo_supply_bm25, round(ln(1 + count(*) FILTER (g AND f)::DOUBLE), 6) AS geo_supply_filt FROM m GROUP BY query_id""")
def supply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima and counters of each query over the whole corpus."""
    return pool.supply(marked(spark, sf_dir))


def inputs(spark: SparkSession, sf_dir: str) -> dict:
    """The pool's inputs: parts with a place as items, texts of parts as queries, embeddings by number."""
    items, asked = (bound(spark, sf_dir, x) for x in (POOL_ITEMS, POOL_QUERIES))
    # joined once for all that is counted from it; by merging, since small files may hold more rows than a driver can send
    pairs = materialised(spark.sql(POOL_CHOICES, **{t: df.hint("merge") for t, df in tables(spark, sf_dir, POOL_CHOICES).items()}), "choices")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = v.count()
    item_vectors = items.select("item_id", (F.col("item_id") % n).alias("vec_id")).join(v, "vec_id").select("item_id", "embedding")
    query_vectors = asked.select("query_id", ((F.col("query_id") * 7 + 1) % n).alias("vec_id")).join(v, "vec_id").select("query_id", "embedding")
    short = lambda df: df.withColumn("embedding", numbers.unit(F.slice("embedding", 1, 32)))
    keyed = pairs.withColumn("query_key", key_of(F.col("query")))
    return {
        "items": items, "queries": asked, "encoders": [(item_vectors, query_vectors), (short(item_vectors), short(query_vectors))], "shares": history.transitions(pairs),
        "by_token": history.token_categories(pairs, F.col("query")), "chosen": history.choice_shares(keyed),
        "positives": asked.select("query_id", (F.col("query_id") + 1).alias("item_id")).union(asked.select("query_id", F.col("query_id").alias("item_id"))),
    }


def _postings(name: str, b: float) -> str:
    """CTEs of an index over it.<name>_text; <name>_p are the postings."""
    return f"""
{name}_c AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split({name}_text, ' ')) AS term FROM it) WHERE term <> '' GROUP BY ALL),
{name}_v AS (SELECT term, count(*) AS df FROM {name}_c GROUP BY term HAVING count(*) >= 2),
{name}_k AS (SELECT * FROM {name}_c JOIN {name}_v USING (term)), {name}_l AS (SELECT item_id, sum(tf) AS dl FROM {name}_k GROUP BY item_id),
{name}_p AS (SELECT item_id, term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (1 - {b}e0 + {b}e0 * dl / avgdl)) AS weight
 FROM {name}_k JOIN {name}_l USING (item_id), (SELECT (SELECT count(*) FROM it) AS n, (SELECT sum(dl) FROM {name}_l) / (SELECT count(*) FROM it)::DOUBLE AS avgdl))"""


def _terms(name: str, column: str) -> str:
    return f"{name} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split({column}, ' ')) AS term FROM q) WHERE term <> '' GROUP BY ALL)"


def _cover(name: str, terms: str, index: str) -> str:
    """CTE of the pool's pairs with the share of the query's known terms, and the score."""
    return f"""{name} AS (SELECT query_id, item_id, round(count(t.term) FILTER (h.term IS NOT NULL) / nullif(count(t.term), 0)::DOUBLE, 6) AS cov, coalesce(round(sum(qtf * weight), 6), 0.0) AS score
 FROM pool LEFT JOIN (SELECT * FROM {terms} WHERE term IN (SELECT term FROM {index}_v)) t USING (query_id) LEFT JOIN {index}_p h USING (item_id, term) GROUP BY ALL)"""


_CHANNELS = {c: k for c, k in pool.CHANNELS.items() if not c.startswith("dense2")}
_MASK = {"global": "true", "geo": "g", "geo_filt": "g AND f AND w"}
POOL_SQL = f"""WITH items AS ({plain(POOL_ITEMS)}), asked AS ({plain(POOL_QUERIES)}), choices AS ({plain(POOL_CHOICES)}),
it AS (SELECT *, {normalized("title")} AS title_text, replace({normalized("concat_ws(' ', title, title, title, title, title, params, description)")}, 'услуги', 'услуг') AS full_text FROM items),
q AS (SELECT *, {normalized("query")} AS t, CASE WHEN filters IS NOT NULL THEN lower(split_part(filters, ' ', 3)) ELSE '' END AS ft, CASE WHEN filters IS NOT NULL THEN concat('вид услуги ', lower(split_part(filters, ' ', 3))) END AS wanted FROM asked),
{_postings("full", 0.4)}, {_postings("title", 0.3)}, {_terms("tq", "t")}, {_terms("fq", "ft")}, {_terms("aq", "concat_ws(' ', t, t, ft)")},
scored AS (SELECT query_id, item_id, round(sum(qtf * weight), 6) AS bm25 FROM full_p JOIN aq USING (term) GROUP BY ALL),
known AS (SELECT search_loc, item_loc, count(*)::DOUBLE AS c FROM choices WHERE search_loc IS NOT NULL AND item_loc IS NOT NULL GROUP BY ALL),
summed AS (SELECT search_loc, item_loc, sum(c) AS c FROM (SELECT * FROM known UNION ALL SELECT DISTINCT search_loc, search_loc, 5.0::DOUBLE FROM known) GROUP BY ALL),
shares AS (SELECT search_loc, item_loc, round(c / sum(c) OVER (PARTITION BY search_loc), 6) AS p FROM summed),
present AS (SELECT location AS item_loc, median(CASE WHEN NOT isnan(lat) THEN lat END) AS clat, median(lon) AS clon, ln(1 + count(*)::DOUBLE) AS size FROM items WHERE location IS NOT NULL GROUP BY location),
raw AS (SELECT search_loc, item_loc, p FROM shares JOIN present USING (item_loc) UNION ALL SELECT DISTINCT location, location, 1.0::DOUBLE FROM asked WHERE location NOT IN (SELECT search_loc FROM shares) AND location IN (SELECT item_loc FROM present)),
zone AS (SELECT * FROM raw WHERE p >= 0.005 OR search_loc = item_loc),
likeliest AS (SELECT search_loc, arg_min(item_loc, struct_pack(a := -p, b := item_loc)) AS item_loc FROM shares JOIN present USING (item_loc) GROUP BY search_loc),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n FROM v),
cosines AS (SELECT query_id, item_id, round(list_dot_product(a.e, b.e), 6) AS cos FROM q, n JOIN v a ON a.vec_id = (q.query_id * 7 + 1) % n.n, it JOIN v b ON b.vec_id = it.item_id % n.n),
masks AS (SELECT query_id, item_id, z.p IS NOT NULL AS g, coalesce(contains(lower(params), wanted), true) AS f, wanted IS NOT NULL AS w FROM q CROSS JOIN it LEFT JOIN zone z ON z.search_loc = q.location AND z.item_loc = it.location),
every AS (SELECT 'bm25' AS kind, query_id, item_id, bm25 AS s, g, f, w FROM scored JOIN masks USING (query_id, item_id) UNION ALL SELECT 'dense', query_id, item_id, cos, g, f, w FROM cosines JOIN masks USING (query_id, item_id)),
ranked AS ({" UNION ALL ".join(f"SELECT '{c}' AS channel, query_id, item_id, r FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) - 1 AS r FROM every WHERE kind = '{c.split('_')[0]}' AND ({_MASK[c.split('_', 1)[1]]})) WHERE r < {k}" for c, k in _CHANNELS.items())}),
pool AS (SELECT query_id, item_id, {", ".join(f"CAST(coalesce(min(r) FILTER (channel = '{c}'), 9999) AS INT) AS rank_{c}" for c in _CHANNELS)}, CAST(count(*) AS INT) AS n_channels FROM ranked GROUP BY ALL),
best AS (SELECT query_id, max(s) FILTER (kind = 'bm25') AS b, coalesce(max(s) FILTER (kind = 'bm25' AND g), 0.0) AS bg, round(ln(1 + (count(*) FILTER (kind = 'bm25'))::DOUBLE), 6) AS hits, round(ln(1 + (count(*) FILTER (kind = 'bm25' AND g))::DOUBLE), 6) AS sg,
 round(ln(1 + (count(*) FILTER (kind = 'bm25' AND g AND f))::DOUBLE), 6) AS sf, max(s) FILTER (kind = 'dense') AS c, coalesce(max(s) FILTER (kind = 'dense' AND g), -1.0) AS cg FROM every GROUP BY query_id),
{_cover("cf", "tq", "full")}, {_cover("ct", "tq", "title")}, {_cover("cx", "fq", "full")},
keyed AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(query, ' '))), ' ') AS query_key FROM choices), qk AS (SELECT query_id, array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ') AS query_key FROM q),
texts AS (SELECT query_key, round(ln(1 + count(*)::DOUBLE / (SELECT count(*) FROM choices) * 1e5), 6) AS cnt, count(*) AS k FROM keyed GROUP BY query_key),
exact AS (SELECT query_key, category AS microcat, round(count(*) / any_value(k)::DOUBLE, 6) AS share FROM keyed JOIN texts USING (query_key) WHERE category IS NOT NULL GROUP BY ALL),
counts AS (SELECT token, category, count(*) AS c FROM (SELECT unnest(string_split(query_key, ' ')) AS token, category FROM keyed) GROUP BY ALL),
per AS (SELECT token, sum(c) FILTER (category IS NOT NULL) AS known FROM counts GROUP BY token HAVING sum(c) >= 2 AND known > 0),
bytoken AS (SELECT token, category, round(c::DOUBLE / known, 6) AS p FROM counts JOIN per USING (token) WHERE category IS NOT NULL),
likely AS (SELECT query_key, category AS microcat, round(s / round(sum(s) OVER (PARTITION BY query_key), 6), 6) AS p FROM (SELECT query_key, category, round(sum(p), 6) AS s FROM (SELECT DISTINCT query_key, unnest(string_split(query_key, ' ')) AS token FROM qk) JOIN bytoken USING (token) GROUP BY ALL)),
tops AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY p DESC, microcat) = 1 AS top FROM likely),
wide AS (SELECT pool.*, it.microcat, coalesce(s.bm25, 0.0) AS bm25, best.*, cf.cov AS cf, ct.cov AS ct, ct.score AS bm25_title, cx.cov AS cx, cos, q.wanted, it.params, q.filters, q.category, q.t, it.title, it.description, it.rating, it.reviews, it.price, it.phone_hidden, it.message_forbidden,
 it.location AS item_loc, q.location AS search_loc, it.lat, it.lon, coalesce(raw.p, 0.0) AS geo_p, z.p IS NOT NULL AS g, here.size AS qsize, there.size AS isize, centre.clat, centre.clon, here.item_loc IS NOT NULL AS has, texts.cnt, exact.share, tops.p AS tp, tops.top, qk.query_key IN (SELECT query_key FROM tops) AS told,
 FROM pool JOIN it USING (item_id) JOIN q USING (query_id) JOIN qk USING (query_id) JOIN best USING (query_id) JOIN cf USING (query_id, item_id) JOIN ct USING (query_id, item_id) JOIN cx USING (query_id, item_id) JOIN cosines USING (query_id, item_id) LEFT JOIN scored s USING (query_id, item_id)
 LEFT JOIN raw ON raw.search_loc = q.location AND raw.item_loc = it.location LEFT JOIN zone z ON z.search_loc = q.location AND z.item_loc = it.location LEFT JOIN present here ON here.item_loc = q.location LEFT JOIN present there ON there.item_loc = it.location
 LEFT JOIN likeliest ON likeliest.search_loc = q.location LEFT JOIN present centre ON centre.item_loc = CASE WHEN here.item_loc IS NOT NULL THEN q.location ELSE likeliest.item_loc END
 LEFT JOIN texts ON texts.query_key = qk.query_key LEFT JOIN exact ON exact.query_key = qk.query_key AND exact.microcat = it.microcat LEFT JOIN tops ON tops.query_key = qk.query_key AND tops.microcat = it.microcat)
SELECT query_id, item_id, microcat, {", ".join(f"rank_{c}" for c in _CHANNELS)}, n_channels, bm25, round(bm25 / greatest(coalesce(b, 0.0), 1e-6), 6) AS bm25_rel, CASE WHEN bg > 0 THEN round(bm25 / bg, 6) END AS bm25_rel_geo, sg AS geo_supply_bm25, sf AS geo_supply_filt, hits AS n_bm25_hits_log,
 coalesce(cf, 0.0) AS cov_full, bm25_title, coalesce(ct, 0.0) AS cov_title, cx AS filter_cov, CASE WHEN wanted IS NOT NULL THEN CAST(contains(lower(params), wanted) AS INT) END AS filter_ok, cos, round(cos - c, 6) AS cos_minus_max, round(cos - cg, 6) AS cos_minus_max_geo,
 CAST(coalesce(item_loc = search_loc, false) AS INT) AS location_match, CAST(g AS INT) AS in_geo, geo_p, CAST(has AS INT) AS query_loc_has_items,
 CASE WHEN NOT isnan(lat) AND clat IS NOT NULL THEN round(ln(1 + 2 * 6371.0e0 * asin(sqrt(least(greatest(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin((radians(clon) - radians(lon)) / 2), 2), 0.0e0), 1.0e0)))), 6) END AS dist_km_log,
 round(coalesce(qsize, 0.0), 6) AS query_loc_size, round(coalesce(isize, 0.0), 6) AS item_loc_size, CAST(coalesce(category = 0, false) AS INT) AS search_category_is0, CAST(filters IS NOT NULL AS INT) AS has_filter, CAST(len(string_split(t, ' ')) AS INT) AS q_ntok,
 CASE WHEN NOT isnan(rating) THEN rating END AS item_rating, round(ln(1 + CASE WHEN isnan(reviews) THEN 0 ELSE greatest(reviews, 0) END), 6) AS item_reviews_count, round(ln(1 + least(greatest(price, 0), 1e6)), 6) AS item_price, CAST(phone_hidden AS INT) AS item_phone_hidden, CAST(message_forbidden AS INT) AS item_message_forbidden,
 CAST(length(title) AS INT) AS title_len, CAST(length(description) AS INT) AS desc_len, CASE WHEN filters IS NOT NULL THEN CAST(CASE WHEN rating IS NULL OR isnan(rating) THEN -1 ELSE rating END >= 4 AS INT) END AS rating_ok,
 coalesce(cnt, 0.0) AS hist_text_cnt, CASE WHEN cnt IS NOT NULL THEN coalesce(share, 0.0) END AS hist_text_mc_share, coalesce(tp, 0.0) AS tok_mc_share, CASE WHEN told THEN CAST(coalesce(top, false) AS INT) END AS tok_mc_is_top, CAST(item_id = query_id OR item_id = query_id + 1 AS INT) AS label FROM wide"""


def rounded(found: DataFrame) -> DataFrame:
    kinds = dict(found.dtypes)
    return found.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else c for c in found.columns])


@query(POOL_SQL)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of six channels with the rankers' features of one encoder and a label."""
    given = inputs(spark, sf_dir)
    return rounded(pool.build_pool(**given | {"encoders": given["encoders"][:1], "channels": _CHANNELS}))


@query()
def pair_features_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of nine channels with all fifty features: the second encoder is scored in half precision."""
    return rounded(pool.build_pool(**inputs(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small pool for the rankers: parts against the orders' texts, marked by what was chosen."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        (F.col("l_orderkey") % 500).alias("query_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), (F.col("l_quantity") > 40).cast("int").alias("label"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"),
    )


@query()
def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a pointwise and a pairwise ranker, trained here, and their fusion."""
    from plumbline.operators import rankers, ranking

    pool_ = labelled(spark, sf_dir)
    features = ["price", "discount", "tax"]
    train = pool_.where("query_id % 2 = 0")
    models = {"binary": rankers.train_one("binary", train, features, 3, depth=3), "lambdarank": rankers.train_one("lambdarank", train, features, 2, depth=3)}
    ranked = rankers.model_ranks(pool_, models)
    return ranked.select("query_id", "item_id", "label", "rank_model_binary", "rank_model_lambdarank", ranking.rrf({"rank_model_binary": 1.0, "rank_model_lambdarank": 1.0}).alias("fused"))


@query()
def head_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after a head of fixed weights."""
    from plumbline.operators import head

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return head.apply_head(v, head.new_head(64, 32)).select("vec_id", F.transform("encoded", lambda x: F.round(x, 6)).alias("encoded"))
