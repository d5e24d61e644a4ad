"""Held-out splits and sampling by hashes that any engine can compute; the same seed gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import seeded
from plumbline.sources.tables import materialised

#: Hexadecimal digits of a hash by which ids are counted.
PREFIX = 4


def held_out(queries: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """The fraction of distinct ids (one at least) that comes first in seeded order; a smaller fraction is a subset.

    Ids are counted by the first PREFIX digits of their hash (the driver gets 16**PREFIX rows at most); all ids of smaller
    prefixes are taken, and only the one prefix that the border falls into is sorted.
    """
    ids = queries.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("_h", seeded(F.col(id_col), seed))
    prefix = F.substring("_h", 1, PREFIX)
    counts = sorted((r["p"], r["n"]) for r in ids.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = max(1, int(sum(n for _, n in counts) * fraction))
    border = None
    for p, n in counts:
        border = p
        if left <= n:
            break
        left -= n
    whole = ids.where(prefix < F.lit(border)).select(id_col)
    return whole.unionByName(ids.where(prefix == F.lit(border)).orderBy("_h", id_col).limit(left).select(id_col))


def first_of_group(df: DataFrame, group: str, id_col: str, seed: int, k: int = 1) -> DataFrame:
    """k rows of each group in seeded order."""
    order = W.partitionBy(group).orderBy(seeded(F.col(id_col), seed), F.asc(id_col))
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def quotas(n_seen: int, n_unseen: int, share_seen: float, wanted: int) -> tuple[int, int]:
    """Rows of both strata for a sample with the share of seen texts.

    Where unseen texts are short the sample shrinks with them; where there are none, seen texts alone make it up.
    """
    target = round(wanted * (1 - share_seen))
    unseen = min(n_unseen, target)
    if not unseen:
        return min(n_seen, wanted), 0
    seen = wanted - unseen if unseen == target else round(unseen * share_seen / max(1 - share_seen, 1e-6))
    return min(n_seen, seen), unseen


def eval_select(queries: DataFrame, id_col: str, key: str, n_pos: str, known_keys: DataFrame, share_seen: float, n_valid: int, n_test: int, max_pos: int = 20, seed: int = 42) -> DataFrame:
    """(id, seen, split): one query of each text, if that one has 1..max_pos choices, seen and unseen texts in the wanted
    shares.
    """
    usable = first_of_group(queries, key, id_col, seed).where((F.col(n_pos) > 0) & (F.col(n_pos) <= max_pos))
    marked = usable.join(known_keys.select(key).distinct().withColumn("_s", F.lit(1)), key, "left").withColumn("seen", F.col("_s").isNotNull())
    counts = {r["seen"]: r["count"] for r in marked.groupBy("seen").count().collect()}
    want = quotas(counts.get(True, 0), counts.get(False, 0), share_seen, n_valid + n_test)
    order = lambda df: df.withColumn("_h", seeded(F.col(id_col), seed + 1)).orderBy("_h", id_col)
    chosen = order(marked.where("seen")).limit(want[0]).unionByName(order(marked.where("not seen")).limit(want[1]))
    n = int(sum(want) * n_valid / (n_valid + n_test))
    mixed = chosen.select(id_col, "seen").withColumn("_h", seeded(F.col(id_col), seed + 2))
    # the chosen rows are at most n_valid + n_test, so one window over them is bounded
    return mixed.withColumn("_k", F.row_number().over(W.orderBy("_h", id_col))).select(id_col, "seen", F.when(F.col("_k") <= n, "valid").otherwise("test").alias("split"))


def split_roles(queries: DataFrame, id_col: str, key: str, text: str, n_pos: str, share_seen: float, n_valid: int, n_test: int, most_train: int, held: float = 0.1, evaluated: float = 0.03, seed: int = 42) -> DataFrame:
    """(id, role): history for what no ranker sees; of the held-out queries train, valid and test. Others have no row.

    Evaluation queries come from a smaller held-out share, and their texts count as seen if any query outside it has them;
    training queries come from the held-out share without the evaluation's texts.
    """
    outer, inner = held_out(queries, id_col, held, seed), held_out(queries, id_col, evaluated, seed)
    chosen = eval_select(queries.join(inner, id_col, "left_semi"), id_col, key, n_pos, queries.join(inner, id_col, "left_anti").select(key), share_seen, n_valid, n_test, seed=seed)
    chosen = materialised(chosen, "evaluation-queries")
    train = clean_train(queries.join(outer, id_col, "left_semi"), id_col, key, text, n_pos, chosen, most_train, seed=seed)
    parts = [queries.join(outer, id_col, "left_anti").select(id_col, F.lit("history").alias("role")), train.select(id_col, F.lit("train").alias("role")), chosen.select(id_col, F.col("split").alias("role"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def id_union(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Distinct ids of all parts."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(id_col) for p in parts]).where(F.col(id_col).isNotNull()).distinct()


def distractors(items: DataFrame, relevant: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n items that are no positive, the first in seeded order (a distributed top n)."""
    other = items.select(id_col).distinct().join(relevant.select(id_col), id_col, "left_anti")
    return other.withColumn("_h", seeded(F.col(id_col), seed)).orderBy("_h", id_col).limit(n).select(id_col)


def in_order(table: DataFrame, id_col: str, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of table whose ids the parts name, with `part` and `row`: places from 0 in the order of parts, then of ids."""
    named = reduce(lambda a, b: a.unionByName(b), [p.select(id_col, F.lit(i).alias("_p"), F.lit(name).alias("part")) for i, (name, p) in enumerate(parts)])
    sizes = named.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = {r["_p"]: r["_n"] for r in sizes.collect()}
    starts = [sum(before.get(j, 0) for j in range(i)) for i in range(len(parts))]
    place = F.row_number().over(W.partitionBy("_p").orderBy(id_col)) - 1 + F.element_at(F.array(*map(F.lit, starts)), F.col("_p") + 1)
    return table.join(named.withColumn("row", place.cast("long")).drop("_p"), id_col)


def with_positive(df: DataFrame, group: str, label: str) -> DataFrame:
    """The rows of groups that hold a positive; the others teach a ranker nothing."""
    return df.withColumn("_best", F.max(label).over(W.partitionBy(group))).where("_best > 0").drop("_best")


def clean_train(queries: DataFrame, id_col: str, key: str, text: str, n_pos: str, excluded: DataFrame, most: int, max_pos: int = 20, min_chars: int = 2, per_text: int = 3, seed: int = 42) -> DataFrame:
    """Training queries: no evaluation text, 1..max_pos choices, min_chars at least, per_text of a text, `most` in all."""
    barred = queries.join(excluded.select(id_col), id_col, "left_semi").select(key).distinct()
    usable = queries.join(barred, key, "left_anti").where((F.col(n_pos) > 0) & (F.col(n_pos) <= max_pos) & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= min_chars))
    few = first_of_group(usable, key, id_col, seed, per_text)
    return few.withColumn("_h", seeded(F.col(id_col), seed + 1)).orderBy("_h", id_col).limit(most).drop("_h")


def thin_negatives(df: DataFrame, id_cols: list[str], label: str, keep: float = 0.5, seed: int = 42) -> DataFrame:
    """All positives, and negatives whose seeded hash falls below the share."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where((F.col(label) > 0) | (drawn < keep))


def corpus_union(train: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """train and the rows of other whose id train lacks, on their common columns."""
    both = [c for c in train.columns if c in other.columns]
    return train.select(*both).unionByName(other.select(*both).join(train.select(id_col), id_col, "left_anti"))


def first_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
