"""Statistics of past choices: where searchers of a place choose items, and which categories words lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import tokens

#: Prior weight of a search location's own items, and least probability of a location in the zone.
PRIOR, ZONE_MIN = 5.0, 0.005


def transitions(pairs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(search_loc, item_loc, p): smoothed shares of the locations chosen by searchers of a location.

    pairs: one row per choice with search_loc and item_loc; choices of unknown location have no weight. Counts are
    combined before the shuffle, so a location with a third of the choices is one row per task.
    """
    known = pairs.where(F.col("search_loc").isNotNull() & F.col("item_loc").isNotNull())
    counts = known.groupBy("search_loc", "item_loc").agg(F.count(F.lit(1)).cast("double").alias("c"))
    own = counts.select("search_loc").distinct().select("search_loc", F.col("search_loc").alias("item_loc"), F.lit(prior).alias("c"))
    summed = counts.unionByName(own).groupBy("search_loc", "item_loc").agg(F.sum("c").alias("c"))
    totals = summed.groupBy("search_loc").agg(F.sum("c").alias("total"))
    return summed.join(totals, "search_loc").select("search_loc", "item_loc", F.round(F.col("c") / F.col("total"), 6).alias("p"))


def zones(shares: DataFrame, searched: DataFrame, present: DataFrame, least: float = ZONE_MIN) -> DataFrame:
    """(search_loc, item_loc, p): locations of the corpus in each searched location's zone.

    A location without history has its own location with probability 1, if the corpus has it. Columns: searched.search_loc,
    present.item_loc, both distinct.
    """
    seen = searched.join(shares, "search_loc").join(present, "item_loc", "left_semi").where((F.col("p") >= least) | (F.col("search_loc") == F.col("item_loc")))
    fresh = searched.join(shares.select("search_loc").distinct(), "search_loc", "left_anti").select("search_loc", F.col("search_loc").alias("item_loc")).join(present, "item_loc", "left_semi")
    return seen.select("search_loc", "item_loc", "p").unionByName(fresh.select("search_loc", "item_loc", F.lit(1.0).alias("p")))


def likeliest(shares: DataFrame, present: DataFrame) -> DataFrame:
    """(search_loc, item_loc): most probable location that the corpus has; ties to the smaller location."""
    best = W.partitionBy("search_loc").orderBy(F.desc("p"), F.asc("item_loc"))
    return shares.join(present, "item_loc", "left_semi").withColumn("k", F.row_number().over(best)).where("k = 1").select("search_loc", "item_loc")


def token_categories(pairs: DataFrame, text: Column, min_pairs: int = 2) -> DataFrame:
    """(token, category, p): of the choices whose query has the token, the shares of categories.

    A token needs min_pairs choices; choices of unknown category count for that but give no share.
    """
    # distinct (query text, category) counts first, so that words are expanded once per distinct text
    texts = pairs.select(text.alias("text"), "category").groupBy("text", "category").agg(F.count(F.lit(1)).alias("c"))
    words = texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), "category", "c")
    counts = words.groupBy("token", "category").agg(F.sum("c").alias("c"))
    per = counts.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("category").isNotNull(), F.col("c"))).alias("known")).where((F.col("all") >= min_pairs) & (F.col("known") > 0))
    return counts.where("category is not null").join(per, "token").select("token", "category", F.round(F.col("c") / F.col("known"), 6).alias("p"))


def query_categories(keys: DataFrame, by_token: DataFrame) -> DataFrame:
    """(query_key, category, p, is_top): mean of the tokens' shares, renormalised; ties to the smaller category."""
    words = keys.select("query_key", F.explode(F.array_distinct(tokens(F.col("query_key")))).alias("token"))
    summed = words.join(by_token, "token").groupBy("query_key", "category").agg(F.round(F.sum("p"), 6).alias("s"))
    whole = W.partitionBy("query_key")
    p = F.round(F.col("s") / F.round(F.sum("s").over(whole), 6), 6)
    return summed.select("query_key", "category", p.alias("p")).withColumn("is_top", (F.row_number().over(whole.orderBy(F.desc("p"), F.asc("category"))) == 1).cast("int"))


def choice_shares(pairs: DataFrame) -> DataFrame:
    """(query_key, category, chosen, text_chosen, log_count, share) from choices with query_key and category.

    share: of the text's choices those of the category; log_count: log1p of the text's choices in 100,000. A text all of
    whose choices are of unknown category has one row, with a null category and share 0.
    """
    by_text = pairs.groupBy("query_key").agg(F.count(F.lit(1)).alias("text_chosen"))
    total = pairs.agg(F.count(F.lit(1)).alias("n"))
    both = pairs.where("category is not null").groupBy("query_key", "category").agg(F.count(F.lit(1)).alias("chosen"))
    joined = by_text.join(both, "query_key", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0).cast("long"))).crossJoin(F.broadcast(total))  # one row
    return joined.select("query_key", "category", "chosen", "text_chosen", F.round(F.log1p(F.col("text_chosen") / F.col("n") * 1e5), 6).alias("log_count"), F.round(F.col("chosen") / F.col("text_chosen"), 6).alias("share"))
