"""BM25 over an inverted index in a table: one row per (item, term).

Terms found in fewer than min_df items leave the vocabulary before lengths are measured; the average length counts
every item, also those without a kept term. Words are split and counted once: the counts and the finished postings are
tables in the shared folder, which every later step scans. Vocabularies and query terms up to a counted size are
broadcast, so that postings are filtered where they lie; larger ones are joined by term, which adaptive execution splits
where a term is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.sources.tables import materialised

#: Rows of a vocabulary, of item lengths or of query terms that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes that a part of a scan is expected to have.
SPLIT_BYTES = 128 << 20


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted rows allow."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, if by its estimated bytes it is read in fewer parts than there are: splitting words costs more
    than sending texts. Larger tables are left where they are read.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * SPLIT_BYTES else df


def term_counts(texts: DataFrame, id_col: str, text: Column, name: str = "tf") -> DataFrame:
    """(id, term, tf) of normalised texts."""
    texts = texts if texts.isStreaming else dealt(texts)
    return texts.select(id_col, F.explode(tokens(text)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias(name))


def vocabulary(counts: DataFrame, min_df: int = 2) -> DataFrame:
    """(term, df) of the kept terms; counts: (item, term, tf)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def index(items: DataFrame, id_col: str, text: Column, k1: float = 1.2, b: float = 0.4, min_df: int = 2) -> DataFrame:
    """Postings (id, term, tf, df, weight), written once."""
    counts = materialised(term_counts(items, id_col, text), "term-counts")
    kept = counts.join(sized(materialised(vocabulary(counts, min_df), "vocabulary")), "term")
    lengths = materialised(kept.groupBy(id_col).agg(F.sum("tf").alias("dl")), "lengths")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    size = lengths.agg(F.sum("dl").alias("total"))
    stats = n.crossJoin(size).select("n", (F.coalesce("total", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"))  # one row each
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return materialised(kept.join(sized(lengths), id_col).crossJoin(F.broadcast(stats)).select(id_col, "term", "tf", "df", weight.alias("weight")), "postings")


def query_terms(queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    """(query, term, qtf), written once: few rows beside the postings."""
    return materialised(term_counts(queries, query_id, text, "qtf"), "query-terms")


def scores(postings: DataFrame, item_id: str, queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    """(query, item, bm25): query counts times weights; items without a shared term have no row."""
    asked = sized(query_terms(queries, query_id, text))
    return postings.join(asked, "term").groupBy(query_id, item_id).agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 6).alias("bm25"))


def known_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The query terms that the index has."""
    here = postings.join(sized(asked.select("term").distinct()), "term", "left_semi").select("term").distinct()
    return materialised(asked.join(sized(here), "term", "left_semi"), "known-terms")


def coverage(postings: DataFrame, item_id: str, queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    """(query, item, n_matched, n_terms, coverage): distinct query terms of the vocabulary that the item has."""
    asked = known_terms(postings, query_terms(queries, query_id, text))
    counts = asked.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_terms"))
    matched = postings.select(item_id, "term").join(sized(asked.select(query_id, "term")), "term").groupBy(query_id, item_id).agg(F.count(F.lit(1)).alias("n_matched"))
    return matched.join(sized(counts), query_id).select(query_id, item_id, "n_matched", "n_terms", F.round(F.col("n_matched") / F.col("n_terms"), 6).alias("coverage"))


def topk(scored: DataFrame, query_id: str, item_id: str, score: str, k: int, name: str = "rank") -> DataFrame:
    """The k best items of each query with their rank from 0; ties go to the smaller item."""
    best = W.partitionBy(query_id).orderBy(F.desc(score), F.asc(item_id))
    return scored.withColumn(name, F.row_number().over(best) - 1).where(F.col(name) < k)
