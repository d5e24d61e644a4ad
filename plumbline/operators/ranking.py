"""Ranks, fusion, caps and constrained selection. Ties go to the smaller item everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
BOOST, DEMOTION = 1e6, 1e7


def by_score(query: str, item: str, score: str):
    return W.partitionBy(query).orderBy(F.desc(score), F.asc(item))


def rank_within(df: DataFrame, query: str, item: str, score: str, name: str = "rank") -> DataFrame:
    """Rank from 0 within the query."""
    return df.withColumn(name, (F.row_number().over(by_score(query, item, score)) - 1).cast("int"))


def topk_mask(df: DataFrame, query: str, item: str, score: str, k: int = 50, name: str = "in_top") -> DataFrame:
    return rank_within(df, query, item, score, "_r").withColumn(name, (F.col("_r") < k).cast("int")).drop("_r")


def first_of_channels(df: DataFrame, query: str, item: str, score: str, channel: str, k: int | dict[str, int], name: str = "rank") -> DataFrame:
    """The first k rows of each channel of a query (k: a number, or one for each channel), in one window for all channels."""
    order = W.partitionBy(query, channel).orderBy(F.desc(score), F.asc(item))
    most = F.lit(k) if isinstance(k, int) else F.element_at(F.create_map(*[F.lit(x) for pair in k.items() for x in pair]), F.col(channel))
    ranked = df.withColumn(name, (F.row_number().over(order) - 1).cast("int"))
    return ranked.where(F.col(name) < (k if isinstance(k, int) else max(k.values()))).where(F.col(name) < most)


def rrf(weights: dict[str, float], k: int = RRF_K) -> Column:
    """Weighted reciprocal rank fusion of rank columns; a weight of 0 leaves its model out."""
    parts = [F.lit(float(w)) / (F.col(c) + k) for c, w in weights.items() if w]
    return F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), 9)


def cap_groups(df: DataFrame, query: str, item: str, label: str, ranks: list[str], most: int) -> DataFrame:
    """At most `most` rows of a group: positives first, then the best channel rank."""
    best = F.least(*ranks) if len(ranks) > 1 else F.col(ranks[0])
    order = W.partitionBy(query).orderBy((best - 1e6 * F.col(label)).asc(), F.asc(item))
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def adjusted(score: str, quotas: dict[str, int] | None = None, hard: list[str] | None = None) -> Column:
    """Score lifted for ranks within a quota and lowered for hard columns equal to 0; a missing value is not lowered."""
    out = F.col(score).cast("double")
    for c, q in (quotas or {}).items():
        out = out + F.when(F.coalesce(F.col(c) < q, F.lit(False)), BOOST).otherwise(0.0)
    for c in hard or []:
        out = out - F.when(F.coalesce(F.col(c) == 0, F.lit(False)), DEMOTION).otherwise(0.0)
    return out


def select_topk(df: DataFrame, query: str, item: str, score: str, k: int = 50, quotas: dict[str, int] | None = None, hard: list[str] | None = None, diversity: dict[str, int] | None = None) -> DataFrame:
    """The k rows of each query by adjusted priority, with slots for values that the main list lacks.

    The main list has k less the slots. Each diversity column in turn takes its slots from the rest whose value the main
    list does not have (what slots have picked does not count as seen); open slots go by priority. chosen: main, the
    column, or fill.
    """
    slots = sum((diversity or {}).values())
    order = W.partitionBy(query).orderBy(F.desc("_p"), F.asc(item))
    ranked = df.withColumn("_p", adjusted(score, quotas, hard)).withColumn("_r", F.row_number().over(order))
    state = ranked.withColumn("chosen", F.when(F.col("_r") <= k - slots, F.lit("main")))
    for c, d in (diversity or {}).items():
        if d:
            seen = F.max(F.when(F.col("chosen") == "main", 1)).over(W.partitionBy(query, c))
            state = state.withColumn("_open", F.col("chosen").isNull() & seen.isNull())
            turn = F.row_number().over(W.partitionBy(query, "_open").orderBy(F.asc("_r")))
            state = state.withColumn("_t", turn).withColumn("chosen", F.when(F.col("_open") & (F.col("_t") <= d), F.lit(c)).otherwise(F.col("chosen"))).drop("_open", "_t")
    taken = F.count("chosen").over(W.partitionBy(query))
    rest = F.row_number().over(W.partitionBy(query, F.col("chosen").isNull()).orderBy(F.asc("_r")))
    state = state.withColumn("_taken", taken).withColumn("_t", rest)
    state = state.withColumn("chosen", F.coalesce("chosen", F.when(F.col("_t") <= k - F.col("_taken"), F.lit("fill"))))
    return state.where(F.col("chosen").isNotNull()).drop("_p", "_r", "_taken", "_t")


def fill_to_k(chosen: DataFrame, query: str, item: str, lists: list[DataFrame], k: int = 50) -> DataFrame:
    """(query, item, rank): chosen rows (with rank), then each list (query, item, rank) in turn, without repeats, to k."""
    parts = [chosen.select(query, item, "rank", F.lit(0).alias("_s"))]
    parts += [x.select(query, item, "rank", F.lit(i + 1).alias("_s")) for i, x in enumerate(lists)]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    first = every.groupBy(query, item).agg(F.min(F.struct("_s", "rank")).alias("_m"))
    order = W.partitionBy(query).orderBy("_m._s", "_m.rank", item)
    return first.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < k).select(query, item, "rank")


def fill_lists(items: DataFrame, item: str, place: str, score: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """((place, item, rank), (item, rank)): the `most` items of highest score of each place, and of all."""
    ranked = rank_within(items.where(F.col(place).isNotNull()), place, item, score).where(F.col("rank") < most)
    everywhere = items.select(item, score).orderBy(F.desc(score), F.asc(item)).limit(most)
    # at most `most` rows are numbered in the one window
    numbered = everywhere.withColumn("rank", (F.row_number().over(W.orderBy(F.desc(score), F.asc(item))) - 1).cast("int"))
    return ranked.select(place, item, "rank"), numbered.select(item, "rank")


def fill_answers(chosen: DataFrame, queries: DataFrame, query: str, item: str, place: str, local: DataFrame, everywhere: DataFrame, k: int = 50) -> DataFrame:
    """(query, item, rank): chosen rows, then the query's place's list, then the list of all, without repeats, to k.

    The lists have a fixed number of rows a place, so both are joined to the queries that lack items only.
    """
    short = queries.select(query, place).join(chosen.groupBy(query).agg(F.count(F.lit(1)).alias("_n")), query, "left").where(F.coalesce("_n", F.lit(0)) < k).select(query, place)
    near = short.join(local, place).select(query, item, "rank")
    return fill_to_k(chosen, query, item, [near, short.select(query).crossJoin(F.broadcast(everywhere))], k)


def answers(chosen: DataFrame, query: str, item: str) -> DataFrame:
    """(query, answer): items in order of rank, joined by spaces; a query has at most k, so the list is bounded."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i")))), lambda x: x["i"])
    return chosen.groupBy(query).agg(F.array_join(listed, " ").alias("answer"))


def merge_channels(channels: DataFrame, query: str, item: str, names: list[str], absent: int = 9999) -> DataFrame:
    """Union of channels (query, item, channel, rank): a rank column for each, `absent` where an item is missing."""
    ranks = [F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(absent)).cast("int").alias(f"rank_{c}") for c in names]
    merged = channels.groupBy(query, item).agg(*ranks)
    return merged.withColumn("n_channels", reduce(lambda a, b: a + b, [(F.col(f"rank_{c}") < absent).cast("int") for c in names]))
