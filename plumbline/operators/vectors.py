"""Exact vector search in blocks.

The query set is packed into matrices, so a task multiplies one block of items, wherever they lie, with each query block
and sends on its own top k; a window makes the final choice. One pass over the items serves any number of views (channels
with their own k and masks). A task holds a bounded number of scores at a time and picks by partition, not by a full sort.
Query blocks are broadcast if their size (counted) allows, and items are then neither shuffled nor broadcast; beyond that
size blocks of queries meet blocks of items, and both are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of one block, numbers (queries times dimensions) that may be broadcast, and scores that a task holds at a time.
BLOCK, BROADCAST_NUMBERS, TILE = 4096, 8_000_000, 4_000_000


@dataclass(frozen=True)
class View:
    """A channel: its k, and whether the zone and the tags restrict it (tags leave out queries that have none)."""

    name: str
    k: int
    zone: bool = False
    tags: bool = False


def half(values: np.ndarray) -> np.ndarray:
    """Round through half precision."""
    return values.astype(np.float16).astype(np.float64)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _allowed(asked: list, here: list, every: bool) -> np.ndarray:
    """For each query and item of a block: is the item's value among the query's (every: has it all the query's)?

    Each distinct value of the items is tested once for each distinct value of the queries.
    """
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    place: dict = {}
    codes = np.fromiter((place.setdefault(plain(h), len(place)) for h in here), np.int64, len(here))
    wanted: dict = {}
    rows = np.fromiter((wanted.setdefault(plain(a), len(wanted)) for a in asked), np.int64, len(asked))
    test = np.zeros((len(wanted), len(place)), bool)
    for a, i in wanted.items():
        want = set(a) if isinstance(a, tuple) else {a}
        for h, j in place.items():
            test[i, j] = want.issubset(h or ()) if every else h is not None and h in want
    return test[:, codes][rows]


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best finite scores of each row; ties go to the smaller order."""
    if scores.shape[1] > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((scores >= cut) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    by = np.lexsort((order[cols], -scores[rows, cols], rows))
    rows, cols = rows[by], cols[by]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept]


def dense_channels(items: DataFrame, item_id: str, item_vec: str, queries: DataFrame, query_id: str, query_vec: str, views: list[View], *, item_zone: str | None = None, query_zone: str | None = None, item_tags: str | None = None, query_tags: str | None = None, fp16: bool = False) -> DataFrame:
    """(query, item, cos, channel, rank) of the best items of each query in each view, in one pass over the items.

    query_zone: a value, or a list of values, one of which an item's zone must be. query_tags: a list that an item's tags
    must contain whole. fp16 rounds vectors and scores through half precision.
    """
    keep = [query_id, query_vec, *(c for c in (query_zone, query_tags) if c)]
    asked = queries.select(*keep).where(F.col(query_vec).isNotNull())
    held = items.select(item_id, item_vec, *(c for c in (item_zone, item_tags) if c)).where(F.col(item_vec).isNotNull())
    out = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("cos", T.DoubleType()), T.StructField("channel", T.StringType())])
    said = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vec)).alias("d")).first()
    kinds = [False] * bool(query_zone) + [True] * bool(query_tags)

    def best(b: pa.RecordBatch, ids: pa.Array, q: np.ndarray, masks: list[list]):
        m, order = _matrix(b.column(1)), np.array(b.column(0).to_pylist())
        m, here = half(m) if fp16 else m, [b.column(2 + j).to_pylist() for j in range(len(kinds))]
        step = max(1, TILE // max(1, b.num_rows))
        for i in range(0, len(q), step):
            s = half(half(q[i : i + step]) @ m.T) if fp16 else np.round(q[i : i + step] @ m.T, 6)
            allowed = [_allowed(values[i : i + step], h, every) for values, h, every in zip(masks, here, kinds, strict=True)]
            for view in views:
                ok = [a for a, every in zip(allowed, kinds, strict=True) if (view.tags if every else view.zone)]
                if view.tags:
                    ok.append(np.array([bool(x) for x in masks[-1][i : i + step]])[:, None])
                seen = np.where(np.logical_and.reduce(np.broadcast_arrays(*ok)), s, -np.inf) if ok else s
                rows, cols = _best(seen, order, view.k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + i)), b.column(0).take(pa.array(cols)), pa.array(s[rows, cols]), pa.array([view.name] * len(rows), pa.string())], names=out.names)

    if (said["n"] or 0) * (said["d"] or 0) <= BROADCAST_NUMBERS:
        table = asked.toArrow().combine_chunks()
        column = lambda j: pa.concat_arrays(table.column(j).chunks)
        sent = items.sparkSession.sparkContext.broadcast((column(0), _matrix(column(1)), [column(2 + j).to_pylist() for j in range(len(kinds))]) if table.num_rows else None)

        def work(batches):
            for b in batches:
                if sent.value and b.num_rows:
                    yield from best(b, *sent.value)

        found = held.mapInArrow(work, out)
    else:
        # blocks of queries against blocks of items: rows of the product are blocks, not pairs
        blocks = asked.groupBy(F.pmod(F.xxhash64(query_id), F.lit(-(-said["n"] // BLOCK))).alias("block")).agg(F.collect_list(F.struct(*keep)).alias("asked"))
        n, names = held.count(), held.columns
        groups = held.groupBy(F.pmod(F.xxhash64(item_id), F.lit(max(1, -(-n // BLOCK)))).alias("block")).agg(F.collect_list(F.struct(*held.columns)).alias("held"))

        def work(batches):
            for b in batches:
                for row in range(b.num_rows):
                    parts = b.column(0)[row].values.flatten()
                    batch = pa.RecordBatch.from_arrays(b.column(1)[row].values.flatten(), names=names)
                    yield from best(batch, parts[0], _matrix(parts[1]), [p.to_pylist() for p in parts[2:]])

        found = blocks.select("asked").crossJoin(groups.select("held")).mapInArrow(work, out)
    order = W.partitionBy(query_id, "channel").orderBy(F.desc("cos"), F.asc(item_id))
    most = F.element_at(F.create_map(*[F.lit(x) for v in views for x in (v.name, v.k)]), F.col("channel"))
    ranked = found.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.where(F.col("rank") < max(v.k for v in views)).where(F.col("rank") < most)


def dense_topk(items: DataFrame, item_id: str, item_vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, *, item_zone: str | None = None, query_zone: str | None = None, item_tags: str | None = None, query_tags: str | None = None, fp16: bool = False) -> DataFrame:
    """(query, item, cos, rank) of the k best items of each query, within its zone and tags where they are named; an empty
    list of tags restricts nothing.
    """
    view = View("all", k, zone=bool(query_zone), tags=False)
    masks = {"item_zone": item_zone, "query_zone": query_zone}
    if not query_tags:
        return dense_channels(items, item_id, item_vec, queries, query_id, query_vec, [view], **masks, fp16=fp16).drop("channel")
    some = F.coalesce(F.size(query_tags), F.lit(0)) > 0
    run = lambda asked, v, **tags: dense_channels(items, item_id, item_vec, asked, query_id, query_vec, [v], **masks, **tags, fp16=fp16).drop("channel")
    return run(queries.where(some), View("all", k, view.zone, True), item_tags=item_tags, query_tags=query_tags).unionByName(run(queries.where(~some), view))


@F.pandas_udf(T.DoubleType())
def half_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dot product of joined vectors with vectors and score rounded through half precision, as the search rounds them."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        x, y = np.stack(a[known].to_numpy()), np.stack(b[known].to_numpy())
        out[known] = half(np.einsum("ij,ij->i", half(x.astype(np.float64)), half(y.astype(np.float64))))
    return pd.Series(out).where(known)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors inside the JVM, for joined pairs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def lookup(ids: DataFrame, id_col: str, sources: list[DataFrame], vec: str = "embedding", need_all: bool = False) -> DataFrame:
    """Vector of each id from the first source that has it, and that source's place; null if none has.

    need_all: an error at run time for an id that no source has.
    """
    out = ids
    names = []
    for k, s in enumerate(sources):
        out = out.join(s.select(id_col, F.col(vec).alias(f"vector_{k}")), id_col, "left")
        names.append(f"vector_{k}")
    found = F.coalesce(*names)
    if need_all:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no source has a vector of "), F.col(id_col).cast("string"))).cast(sources[0].schema[vec].dataType))
    return out.select(*ids.columns, found.alias(vec), F.coalesce(*[F.when(F.col(n).isNotNull(), k) for k, n in enumerate(names)]).alias("source"))
