"""Recall, reports and search over parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import seeded

from .ranking import RRF_K, select_topk


def query_recall(hits: DataFrame, relevant: DataFrame, query: str, label: str = "label") -> DataFrame:
    """(query, n_rel, hits, recall) for queries with something relevant; relevant: (query, n_rel). Misses count 0."""
    got = hits.groupBy(query).agg(F.sum(label).alias("hits"))
    joined = relevant.where("n_rel > 0").join(got, query, "left")
    return joined.select(query, "n_rel", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.greatest("n_rel", F.lit(1)), 6))


def macro_recall(hits: DataFrame, relevant: DataFrame, query: str, label: str = "label") -> DataFrame:
    """One row: recall (mean over queries) and n_queries."""
    return query_recall(hits, relevant, query, label).agg(F.round(F.avg(F.col("hits") / F.col("n_rel")), 6).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def channel_recall(pool: DataFrame, relevant: DataFrame, query: str, channels: list[str], within: list[int], label: str = "label") -> DataFrame:
    """(channel, k, recall): share of the relevant that a channel has within its first k, one pass over the pool."""
    sums = [F.sum(F.when(F.col(c) < k, F.col(label)).otherwise(0)).alias(f"{c}:{k}") for c in channels for k in within]
    per = relevant.where("n_rel > 0").join(pool.groupBy(query).agg(*sums), query, "left")
    means = per.agg(*[F.avg(F.coalesce(F.col(f"`{c}:{k}`"), F.lit(0)) / F.col("n_rel")).alias(f"{c}:{k}") for c in channels for k in within])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("k"), F.round(F.col(f"`{c}:{k}`"), 6).alias("recall")) for c in channels for k in within])
    return means.select(F.inline(rows))


def segment_report(per_query: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """(segment, value, recall, n) of per-query recalls, all segments in one pass."""
    kinds = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("string").alias("value")) for n, c in segments.items()])
    return per_query.select("recall", F.inline(kinds)).groupBy("segment", "value").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def weight_grid(ranked: DataFrame, relevant: DataFrame, query: str, item: str, models: list[str], k: int = 50, grid: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0), label: str = "label") -> DataFrame:
    """(combo, w_<model>..., recall) for every combination but all zeros, in order of enumeration; one job."""
    combos = [w for w in itertools.product(grid, repeat=len(models)) if any(w)]
    names = [f"w_{m}" for m in models]
    table = F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(float(v)).alias(n) for n, v in zip(names, w, strict=True)]) for i, w in enumerate(combos)])
    every = ranked.select(query, item, label, *models, F.inline(table))
    score = F.round(reduce(lambda a, b: a + b, [F.col(n) / (F.col(m) + RRF_K) for n, m in zip(names, models, strict=True)]), 9)
    order = W.partitionBy("combo", query).orderBy(F.desc("score"), F.asc(item))
    top = every.withColumn("score", score).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    hits = top.groupBy("combo", *names, query).agg(F.sum(label).alias("hits"))
    n = relevant.where("n_rel > 0").agg(F.count(F.lit(1)).alias("n"))
    shares = hits.join(relevant.where("n_rel > 0"), query).groupBy("combo", *names).agg(F.sum(F.col("hits") / F.col("n_rel")).alias("s"))
    return shares.crossJoin(F.broadcast(n)).select("combo", *names, F.round(F.col("s") / F.col("n"), 6).alias("recall"))


def best_weights(grid: DataFrame, gain: float = 1e-6) -> dict:
    """First combination that no later one beats by more than gain; the grid has a bounded number of rows."""
    best = None
    for row in grid.orderBy("combo").collect():
        if best is None or row["recall"] > best["recall"] + gain:
            best = row
    return best.asDict() if best else {}


#: No quotas, no hard columns, no slots.
NEUTRAL: dict = {"quotas": {}, "hard": [], "diversity": {}}


def selection_recalls(df: DataFrame, relevant: DataFrame, query: str, item: str, score: str, proposals: list[dict], k: int = 50, label: str = "label") -> list[float]:
    """Macro recall of each set of selection parameters, all of them in one job; the driver gets a row for each."""
    chosen = [select_topk(df, query, item, score, k, **p).groupBy(query).agg(F.sum(label).alias("hits")).withColumn("proposal", F.lit(i)) for i, p in enumerate(proposals)]
    n = relevant.where("n_rel > 0").agg(F.count(F.lit(1)).alias("n"))
    every = reduce(lambda a, b: a.unionByName(b), chosen).join(relevant.where("n_rel > 0"), query)
    shares = every.groupBy("proposal").agg(F.sum(F.col("hits") / F.col("n_rel")).alias("s")).crossJoin(F.broadcast(n))
    found = {r["proposal"]: r["recall"] for r in shares.select("proposal", F.round(F.col("s") / F.col("n"), 6).alias("recall")).collect()}
    return [found.get(i, 0.0) for i in range(len(proposals))]


def search_steps(hard: list[str], quota_columns: list[str], diversity_columns: list[str], quotas: tuple[int, ...], slots: tuple[int, ...], passes: int):
    """What a search tries, step by step: (kind of parameter, column, values)."""
    for column in hard:
        yield "hard", column, (True,)
    for _ in range(passes):
        for column in quota_columns:
            yield "quotas", column, quotas
        for column in diversity_columns:
            yield "diversity", column, slots


def with_value(params: dict, kind: str, column: str, value) -> dict:
    return {**params, kind: [*params[kind], column] if kind == "hard" else params[kind] | {column: value}}


def tune_selection(recalls: Callable[[list[dict]], list[float]], hard: list[str], quota_columns: list[str], diversity_columns: list[str], min_gain: float = 0.002, quotas: tuple[int, ...] = (0, 3, 5, 10), slots: tuple[int, ...] = (0, 1, 2, 3), passes: int = 2) -> tuple[dict, float]:
    """Search column by column: the values of a column are measured together, against what earlier columns have settled.

    In order of values, each one that gains more than min_gain on the best so far takes its place.
    """
    best, value = NEUTRAL, recalls([NEUTRAL])[0]
    for step in search_steps(hard, quota_columns, diversity_columns, quotas, slots, passes):
        tried = [with_value(best, *step[:2], v) for v in step[2]]
        for params, got in zip(tried, recalls(tried), strict=True):
            if got > value + min_gain:
                best, value = params, got
    return best, value


def accepted(params: dict, recalls: Callable[[list[dict]], list[float]]) -> dict:
    """Tuned parameters if another part's recall is no worse with them than without, else the neutral ones."""
    without, tuned = recalls([NEUTRAL, params])
    return params if tuned >= without else NEUTRAL


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "out of pool").when(rank <= 9, "top-10").when(rank <= 49, "11-50").when(rank <= 99, "51-100").when(rank <= 299, "101-300").otherwise(">300")


def review_bucket(log_reviews: Column) -> Column:
    return F.when(log_reviews <= 0, 0).when(log_reviews <= F.log1p(F.lit(10.0)), 1).otherwise(2)


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share); counts are combined before the one-row total is taken."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def overlap_share(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of left, how many right has, and their share."""
    keys = right.select(key).distinct().withColumn("_in", F.lit(1))
    joined = left.select(key).where(F.col(key).isNotNull()).distinct().join(keys, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_shared"), F.round(F.avg(F.when(F.col("_in").isNotNull(), 1.0).otherwise(0.0)), 6).alias("share"))


def count_quantiles(rows: DataFrame, key: str, quantiles: dict[str, float], many: int) -> DataFrame:
    """One row: exact quantiles of the rows a key, and n_many, how many keys have more than `many` (counts have few distinct values)."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(*[F.percentile("n", F.lit(q)).alias(name) for name, q in quantiles.items()], F.count_if(F.col("n") > many).alias("n_many"))


def channel_hits(positives: DataFrame, channels: list[str], within: int) -> DataFrame:
    """(channel, hit_share, median_rank) of the positives' channel ranks below `within`."""
    long = positives.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])))
    hit = F.col("v") < within
    return long.groupBy("channel").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("hit_share"), F.median(F.when(hit, F.col("v"))).alias("median_rank"))


def key_matches(pairs: DataFrame, params: str) -> DataFrame:
    """(key, n, share): how often a filter's 'key value' stands in the chosen item's parameters; pairs: key, value, params."""
    ok = F.contains(F.col(params), F.lower(F.concat("key", F.lit(" "), "value")))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("share"))


def seen_share(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: share of asked's rows whose key is known, repeated rows counted as often as they occur."""
    marked = asked.select(key).join(known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("_in").isNotNull(), 1.0).otherwise(0.0)), 6).alias("share"))


def positive_sets(positives: DataFrame, query: str, item: str) -> DataFrame:
    """(query, items): the distinct positives of each query, sorted."""
    return positives.groupBy(query).agg(F.sort_array(F.collect_set(item)).alias("items"))


def answer_length(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row: answers, and the mean number of items in them."""
    n = F.when(F.length(answer) > 0, F.size(F.split(answer, " "))).otherwise(0)
    return answers.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_items"))


def pool_ceiling(pool: DataFrame, relevant: DataFrame, query: str, label: str = "label") -> DataFrame:
    """One row: recall of the whole pool, and candidates a query."""
    size = pool.agg(F.count(F.lit(1)).alias("rows"))
    n = relevant.agg(F.count(F.lit(1)).alias("queries"))
    return macro_recall(pool, relevant, query, label).crossJoin(size).crossJoin(n).select("recall", F.round(F.col("rows") / F.col("queries"), 6).alias("candidates"))


def located(positives: DataFrame, scored: DataFrame, query: str, item: str, rank: str = "rank") -> DataFrame:
    """Positives with their rank among the scored rows, null outside the pool, and the rank's bucket."""
    found = positives.select(query, item).join(scored.select(query, item, rank), [query, item], "left")
    return found.withColumn("bucket", rank_bucket(F.col(rank)))


def miss_table(positives: DataFrame, scored: DataFrame, queries: DataFrame, items: DataFrame, query: str, item: str, title: str, k: int = 50, top: int = 5) -> DataFrame:
    """One row for each positive beyond k: the query's columns, the missed title and rank, and the titles on top, wide."""
    missed = located(positives, scored, query, item).where(F.col("rank").isNull() | (F.col("rank") >= k))
    first = scored.where(F.col("rank") < top).join(items.select(item, title), item, "left")
    wide = first.groupBy(query).agg(*[F.max(F.when(F.col("rank") == i, F.col(title))).alias(f"top{i + 1}") for i in range(top)])
    named = missed.join(items.select(item, F.col(title).alias("missed_title")), item, "left").join(queries, query, "left")
    return named.join(wide, query, "left").select(*queries.columns, F.col(item).alias("missed"), "missed_title", F.col("rank").alias("missed_rank"), *[f"top{i + 1}" for i in range(top)])


def sampled_queries(misses: DataFrame, query: str, n: int = 8, seed: int = 0) -> DataFrame:
    """The rows of n queries, the first in seeded order."""
    ids = misses.select(query).distinct().withColumn("_h", seeded(F.col(query), seed)).orderBy("_h", query).limit(n).select(query)
    return misses.join(F.broadcast(ids), query, "left_semi")  # n ids


def drift(train: DataFrame, served: DataFrame, features: list[str]) -> DataFrame:
    """(feature, train_mean, served_mean, ratio): one pass over each side; ratio is null for a mean of 0."""

    def means(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
        return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias(name)) for f in features])))

    joined = means(train, "train_mean").join(means(served, "served_mean"), "feature")
    return joined.select("feature", F.round("train_mean", 6).alias("train_mean"), F.round("served_mean", 6).alias("served_mean"), F.round(F.col("served_mean") / F.nullif("train_mean", F.lit(0.0)), 6).alias("ratio"))


def validate_answers(chosen: DataFrame, queries: DataFrame, items: DataFrame, query: str, item: str, k: int = 50) -> DataFrame:
    """One row of counts that must all be 0: unknown queries or items, repeats, too long, unanswered."""
    unknown_q = chosen.select(query).distinct().join(queries.select(query), query, "left_anti").agg(F.count(F.lit(1)).alias("unknown_queries"))
    unknown_i = chosen.select(item).distinct().join(items.select(item), item, "left_anti").agg(F.count(F.lit(1)).alias("unknown_items"))
    repeated = chosen.groupBy(query, item).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    long = chosen.groupBy(query).count().where(F.col("count") > k).agg(F.count(F.lit(1)).alias("too_long"))
    unanswered = queries.select(query).distinct().join(chosen.select(query), query, "left_anti").agg(F.count(F.lit(1)).alias("unanswered"))
    return reduce(lambda a, b: a.crossJoin(b), [unknown_q, unknown_i, repeated, long, unanswered])  # one row each
