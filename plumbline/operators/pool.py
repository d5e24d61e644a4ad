"""Candidate pool: masked channels of BM25 and of one or two encoders, merged, with the pair features of the rankers.

Missing features are null where they do not apply and 0 where the contract says so. Maxima and supply counters are over
the whole corpus, not the pool. Pairs are scored and chosen in blocks of queries (see blocks) and never written before they
are the result; steps that are read again (items, postings, the index) are tables in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers, text
from plumbline.functions.stem import stemmed
from plumbline.sources.tables import materialised

from . import blocks, bm25, history, vectors
from .evaluation import review_bucket

#: Least share of a category that the words lead to.
PLAUSIBLE = 0.01
#: Distinct filter phrases that may travel to every item.
BROADCAST_PHRASES = 10_000
#: Items that each channel gives, at most.
CHANNELS = {f"{kind}_{mask}": k for kind in ("bm25", "dense", "dense2") for mask, k in (("global", 100), ("geo", 300), ("geo_filt", 150))}


def prepare_queries(queries: DataFrame, shares: DataFrame, items: DataFrame) -> DataFrame:
    """Texts, key, filters, threshold and zone of each query (query_id, query, filters, location, category)."""
    plain = text.query_only_text(F.col("query"))
    present = items.select(F.col("location").alias("item_loc")).where("item_loc is not null").distinct()
    searched = queries.select(F.col("location").alias("search_loc")).where("search_loc is not null").distinct()
    zone = history.zones(shares, searched, present).groupBy("search_loc").agg(F.map_from_entries(F.collect_list(F.struct("item_loc", "p"))).alias("zone"))
    likeliest = history.likeliest(shares, present).withColumnRenamed("item_loc", "likeliest")
    ready = queries.select(
        "query_id", F.col("location").alias("search_loc"), "category",
        stemmed(text.query_text(F.col("query"), F.col("filters"))).alias("full_text"), stemmed(plain).alias("title_text"), stemmed(text.filter_only_text(F.col("filters"))).alias("filter_text"),
        text.query_key(stemmed(plain)).alias("query_key"), text.checkable_filters(F.col("filters")).alias("wanted"), text.rating_threshold(F.col("filters")).alias("threshold"),
        (F.length(text.or_empty(F.col("filters"))) > 0).cast("int").alias("has_filter"),
    )
    here = present.withColumn("query_loc_has_items", F.lit(1)).withColumnRenamed("item_loc", "search_loc")
    joined = ready.join(zone, "search_loc", "left").join(likeliest, "search_loc", "left").join(here, "search_loc", "left")
    return joined.withColumns({"q_ntok": text.n_tokens(F.col("title_text")), "query_loc_has_items": F.coalesce("query_loc_has_items", F.lit(0)), "zone_places": F.coalesce(F.map_keys("zone"), F.array().cast(f"array<{items.schema['location'].dataType.simpleString()}>"))})


def held_phrases(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """items (item_id, compact) with held: the phrases (one column, distinct) that occur in compact.

    Up to BROADCAST_PHRASES, counted, all phrases travel in one broadcast row and every item tests them. Beyond, items and
    phrases are joined by the key and first character that a phrase begins with, wherever it stands in an item, and only
    what meets is tested.
    """
    if phrases.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES:
        listed = phrases.agg(F.collect_set("phrase").alias("phrases"))
        held = F.filter("phrases", lambda f: F.contains(F.col("compact"), f))
        return items.crossJoin(F.broadcast(listed)).withColumn("held", held).drop("phrases")
    begin = F.lit("(?s)(?=((?:" + "|".join(text.COMPACT_KEYS) + ") .))")
    probes = items.select("item_id", "compact", F.explode(F.array_distinct(F.regexp_extract_all("compact", begin, F.lit(1)))).alias("probe"))
    asked = phrases.select("phrase", F.get(F.regexp_extract_all("phrase", begin, F.lit(1)), F.lit(0)).alias("probe"))
    met = probes.join(asked, "probe").where(F.contains(F.col("compact"), F.col("phrase")))
    held = met.groupBy("item_id").agg(F.collect_set("phrase").alias("held"))
    return items.join(held, "item_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def prepare_items(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Texts, numbers and held filter phrases of each item."""
    phrases = queries.select(F.explode("wanted").alias("phrase")).distinct()
    ready = items.select(
        "item_id", "location", "microcat", numbers.number(F.col("lat")).alias("lat"), numbers.number(F.col("lon")).alias("lon"),
        stemmed(text.weighted(F.col("title"), F.col("params"), F.col("description"))).alias("full_text"), stemmed(text.normalize(F.col("title"))).alias("title_text"),
        text.compact_params(F.col("params")).alias("compact"), numbers.number(F.col("rating")).alias("item_rating"), numbers.log_count(F.col("reviews")).alias("item_reviews_count"),
        F.coalesce(F.log1p(numbers.price(F.col("price"))), F.lit(0.0)).alias("item_price"), F.coalesce(F.col("phone_hidden").cast("int"), F.lit(0)).alias("item_phone_hidden"),
        F.coalesce(F.col("message_forbidden").cast("int"), F.lit(0)).alias("item_message_forbidden"), F.length(text.or_empty(F.col("title"))).alias("title_len"), F.length(text.or_empty(F.col("description"))).alias("desc_len"),
    )
    return held_phrases(ready, phrases).drop("compact")


def supply(scored: DataFrame) -> DataFrame:
    """Per query over all its scored items (in_geo, filter_ok 0/1): maxima and log counters."""
    geo, both = F.col("in_geo") == 1, (F.col("in_geo") == 1) & (F.col("filter_ok") == 1)
    return scored.groupBy("query_id").agg(
        F.max("bm25").alias("best"), F.coalesce(F.max(F.when(geo, F.col("bm25"))), F.lit(0.0)).alias("best_geo"), F.round(F.log1p(F.count(F.lit(1)).cast("double")), 6).alias("n_bm25_hits_log"),
        F.round(F.log1p(F.count_if(geo).cast("double")), 6).alias("geo_supply_bm25"), F.round(F.log1p(F.count_if(both).cast("double")), 6).alias("geo_supply_filt"),
    )


def _views(kind: str, channels: dict[str, int]) -> list[vectors.View]:
    """The channels of the words (bm25) or of an encoder."""
    masks = {"global": {}, "geo": {"zone": True}, "geo_filt": {"zone": True, "tags": True}}
    return [vectors.View(f"{kind}_{mask}", channels[f"{kind}_{mask}"], **extra) for mask, extra in masks.items() if channels.get(f"{kind}_{mask}")]


def _coded(terms: DataFrame, by: str, name: str, value: str, values: str) -> DataFrame:
    """(by, <name>_terms, <name>_<values>): the hashed terms of each row and a number for each, in two lists."""
    listed = terms.groupBy(by).agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), F.col(value).cast("double").alias("v"))).alias("l"))
    return listed.select(by, F.col("l.h").alias(f"{name}_terms"), F.col("l.v").alias(f"{name}_{values}"))


def _with_terms(q: DataFrame, it: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with the terms they ask of an index, and items with the weights of those that some query asks for."""
    sides = {"full": 0.4, "title": 0.3}
    uses = {"score": ("full", "full_text"), "full": ("full", "title_text"), "title": ("title", "title_text"), "filter": ("full", "filter_text")}
    texts = ["full_text", "title_text", "filter_text"]
    asked = materialised(reduce(lambda a, b: a.unionByName(b), [bm25.term_counts(q, "query_id", F.col(c), "qtf").withColumn("of", F.lit(c)) for c in texts]), "query-terms")
    terms = asked.select("term").distinct()
    known = {}
    for side, b in sides.items():
        postings = bm25.index(it, "item_id", F.col(f"{side}_text"), b=b).join(bm25.sized(terms), "term", "left_semi")
        known[side] = materialised(postings.select("term").distinct(), "known-terms")
        it = it.join(_coded(postings, "item_id", side, "weight", "weights"), "item_id", "left")
    for use, (side, column) in uses.items():
        mine = asked.where(F.col("of") == column).join(bm25.sized(known[side]), "term", "left_semi")
        q = q.join(_coded(mine, "query_id", use, "qtf", "counts"), "query_id", "left")
    return q, it


def build_pool(items: DataFrame, queries: DataFrame, encoders: list[tuple[DataFrame, DataFrame]], shares: DataFrame, by_token: DataFrame, chosen: DataFrame, channels: dict[str, int] = CHANNELS, positives: DataFrame | None = None) -> DataFrame:
    """One row per candidate pair with all features.

    items: item_id, title, params, description, price, rating, reviews, phone_hidden, message_forbidden, lat, lon, location,
    microcat. queries: query_id, query, filters, location, category. encoders: for each (item vectors, query vectors) with
    an id and `embedding`, unit length; the second is scored in half precision. shares, by_token, chosen: see history.
    positives: (query_id, item_id), adds label.
    """
    q = materialised(prepare_queries(queries, shares, items), "queries")
    it = materialised(prepare_items(items, q), "items")
    places = materialised(it.where("location is not null").groupBy("location").agg(F.median("lat").alias("clat"), F.median("lon").alias("clon"), F.log1p(F.count(F.lit(1)).cast("double")).alias("size")), "places")
    centre = F.when(F.col("query_loc_has_items") == 1, F.col("search_loc")).otherwise(F.col("likeliest"))
    asked, held = _with_terms(q, it)
    asked = asked.withColumns({"centre": centre, "n_wanted": F.size(F.array_distinct("wanted")), "zone_codes": F.transform("zone_places", lambda x: F.xxhash64(x)), "wanted_codes": F.transform(F.array_distinct("wanted"), lambda x: F.xxhash64(x))})
    asked = asked.join(places.select(F.col("location").alias("centre"), "clat", "clon"), "centre", "left").join(places.select(F.col("location").alias("search_loc"), F.col("size").alias("query_loc_size")), "search_loc", "left")
    held = held.join(places.select("location", F.col("size").alias("item_loc_size")), "location", "left").withColumns({"place": F.when(F.col("location").isNotNull(), F.xxhash64(F.col("location").cast(q.schema["zone_places"].dataType.elementType))), "held_codes": F.transform("held", lambda x: F.xxhash64(x))})
    for k, (item_vectors, query_vectors) in enumerate(encoders):
        held = held.join(item_vectors.select("item_id", F.col("embedding").alias(f"vector_{k}")), "item_id", "left")
        asked = asked.join(query_vectors.select("query_id", F.col("embedding").alias(f"vector_{k}")), "query_id", "left")
    asked = materialised(asked.drop("full_text", "title_text", "filter_text", "zone", "zone_places", "wanted", "likeliest"), "pool-queries")
    kinds = ["bm25", "dense", "dense2"][: 1 + len(encoders)]
    names = [c for c in channels if c.split("_")[0] in kinds]
    index, files = blocks.write_index(held.drop("full_text", "title_text", "held"), "item_id")
    of_query = ["query_id", "query_key", "search_loc", "category", "threshold", "has_filter", "q_ntok", "query_loc_has_items", "query_loc_size", "clat", "clon", "n_wanted"]
    of_item = ["item_id", "location", "microcat", "lat", "lon", "item_rating", "item_reviews_count", "item_price", "item_phone_hidden", "item_message_forbidden", "title_len", "desc_len", "item_loc_size"]
    plan = blocks.Plan(files, _views("bm25", channels), [_views(kind, channels) for kind in kinds[1:]], of_query, of_item)
    pool = blocks.candidates(asked, index, plan)

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counter = lambda c: F.round(F.log1p(F.col(c).cast("double")), 6)
    pool = pool.withColumns(
        {
            "bm25_rel": F.col("bm25") / F.greatest("best_bm25", F.lit(1e-6)), "bm25_rel_geo": numbers.ratio(F.col("bm25"), F.col("best_bm25_geo")),
            "n_bm25_hits_log": counter("n_hits"), "geo_supply_bm25": counter("n_geo"), "geo_supply_filt": counter("n_geo_filt"),
            "cov_full": zero(F.col("full_cov")), "cov_title": zero(F.col("title_cov")), "bm25_title": F.col("title_bm25"),
        }
    )
    for k in range(len(encoders)):
        n = "" if k == 0 else "2"
        pool = pool.withColumns({f"cos{n}": F.col(f"cos_{k}"), f"cos{n}_minus_max": F.col(f"cos_{k}") - F.col(f"best_{k}"), f"cos{n}_minus_max_geo": F.col(f"cos_{k}") - F.col(f"best_geo_{k}")})
    if len(encoders) > 1:
        pool = pool.withColumn("cos_mean12", (F.col("cos") + F.col("cos2")) / 2)

    # what is joined to the pairs is a row per place or per text and category: broadcast where its counted size allows
    small = lambda df, name: bm25.sized(materialised(df, name))
    # the probability itself, also where it is too small for the zone
    every = history.zones(shares, q.select("search_loc").where("search_loc is not null").distinct(), places.select(F.col("location").alias("item_loc")), least=0.0)
    wide = pool.join(small(every.select("search_loc", F.col("item_loc").alias("location"), F.col("p").alias("geo_p")), "place-shares"), ["search_loc", "location"], "left")
    wide = wide.withColumns(
        {
            "filter_ok": F.when(F.col("n_wanted") > 0, (F.col("n_held") == F.col("n_wanted")).cast("int")),
            "location_match": F.coalesce(F.col("location") == F.col("search_loc"), F.lit(False)).cast("int"),
            "geo_p": zero(F.col("geo_p")),
            "dist_km_log": F.log1p(numbers.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))),
            "query_loc_size": zero(F.col("query_loc_size")),
            "item_loc_size": zero(F.col("item_loc_size")),
            "search_category_is0": F.coalesce(F.col("category") == 0, F.lit(False)).cast("int"),
            "rating_ok": F.when(F.col("threshold").isNotNull(), (F.coalesce("item_rating", F.lit(-1.0)) >= F.col("threshold")).cast("int")),
        }
    )
    keys = q.select("query_key").distinct()
    chosen = materialised(chosen.join(bm25.sized(keys), "query_key", "left_semi"), "history")
    texts = small(chosen.groupBy("query_key").agg(F.max("log_count").alias("hist_text_cnt")), "history-texts")
    exact = bm25.sized(chosen.where("category is not null").select("query_key", F.col("category").alias("microcat"), F.col("share").alias("hist_text_mc_share")))
    likely = materialised(history.query_categories(keys, by_token).withColumnRenamed("category", "microcat"), "likely")
    has = bm25.sized(likely.select("query_key").distinct().withColumn("known", F.lit(1)))
    likely = bm25.sized(likely.select("query_key", "microcat", F.col("p").alias("tok_mc_share"), F.col("is_top").alias("tok_mc_is_top")))
    wide = wide.join(texts, "query_key", "left").join(exact, ["query_key", "microcat"], "left").join(likely, ["query_key", "microcat"], "left").join(has, "query_key", "left")
    wide = wide.withColumns(
        {
            "hist_text_mc_share": F.when(F.col("hist_text_cnt").isNotNull(), zero(F.col("hist_text_mc_share"))),
            "hist_text_cnt": zero(F.col("hist_text_cnt")),
            "tok_mc_share": zero(F.col("tok_mc_share")),
            "tok_mc_is_top": F.when(F.col("known") == 1, F.coalesce("tok_mc_is_top", F.lit(0))),
        }
    )
    if positives is not None:
        wide = wide.join(small(positives.select("query_id", "item_id").distinct().withColumn("label", F.lit(1)), "positives"), ["query_id", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    columns = ["query_id", "item_id", "microcat", *feature_names(len(encoders), names), *(["label"] if positives is not None else [])]
    return wide.select(*columns)


def helpers(pool: DataFrame) -> DataFrame:
    """Columns that selection uses: rev_bucket, and mc_plausible (the words lead to the category; unknown counts as yes)."""
    plausible = F.coalesce(F.col("tok_mc_share") >= PLAUSIBLE, F.lit(True)).cast("int")
    return pool.withColumns({"rev_bucket": review_bucket(F.col("item_reviews_count")), "mc_plausible": plausible})


def linear_baselines() -> dict[str, Column]:
    """Two scores without training: by zone, text and vector, and by text and place."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return {"by_vector": zero("bm25_rel_geo") + 2 * F.col("in_geo") + F.col("cos"), "by_place": F.col("bm25") + 40 * F.col("location_match")}


def feature_names(encoders: int = 2, channels: list[str] | None = None) -> list[str]:
    """Features in the order of the rankers' contract (fixed values)."""
    names = [f"rank_{c}" for c in (channels if channels is not None else CHANNELS)]
    names += "n_channels bm25 bm25_rel bm25_rel_geo geo_supply_bm25 geo_supply_filt n_bm25_hits_log cov_full bm25_title cov_title filter_cov filter_ok".split()
    names += "cos cos_minus_max cos_minus_max_geo".split() if encoders else []
    names += "cos2 cos2_minus_max cos2_minus_max_geo cos_mean12".split() if encoders > 1 else []
    return names + "location_match in_geo geo_p query_loc_has_items dist_km_log query_loc_size item_loc_size search_category_is0 has_filter q_ntok item_rating item_reviews_count item_price item_phone_hidden item_message_forbidden title_len desc_len rating_ok hist_text_cnt hist_text_mc_share tok_mc_share tok_mc_is_top".split()
