"""Candidate pairs with their scores: blocks of queries against an index of items, exact and without a table of pairs.

The index is a table of one row per item, in order of item: weighted terms, place, held phrases and vectors, all as
numbers. A task takes a block of queries and reads the index twice, a tile of items at a time. The first reading scores
every pair of the tile and keeps the best of each channel and the counters of each query; items come in order, so a later
one has to be better than the last kept. The second reading makes the features of the chosen pairs. Nothing but these
leaves the task: disk holds the index alone, and work grows with queries times items, as any exact search's does.

Terms, phrases and places are compared by 64-bit hashes. Executors read the index through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import NO_RANK
from plumbline.sources.tables import materialised

from .vectors import View, half

#: Queries of a block, items of a tile, and items of a file of the index.
BLOCK, TILE, FILE_ROWS = 512, 4096, 50_000
#: A term is multiplied as a dense column from this share of a tile's pairs; rarer ones are expanded pair by pair.
DENSE_SHARE = 1 / 200
#: Scores are rounded to six decimals: one that is better by a step is at least this much higher before that.
HALF_STEP = 0.4e-6


def write_index(items: DataFrame, item_id: str) -> tuple[DataFrame, list[str]]:
    """The items in order, written once, and the files in that order."""
    n = max(1, -(-items.count() // FILE_ROWS))
    index = materialised(items.repartitionByRange(n, item_id).sortWithinPartitions(item_id), "pool-index")
    first = index.groupBy(F.input_file_name().alias("file")).agg(F.min(item_id).alias("first")).orderBy("first")
    return index, [r["file"] for r in first.collect()]


def _tiles(files: list[str], columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The place of the first item, and the items of each tile."""
    start = 0
    for path in files:
        system, where = fs.FileSystem.from_uri(path)
        with system.open_input_file(where) as f:
            for b in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(TILE, columns=columns, use_threads=False):
                yield start, b
                start += b.num_rows


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element of a list column, and the elements; a null has none."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.repeat(np.arange(len(column)), size), np.asarray(column.flatten())


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (zeros for a null) and which there are."""
    there = np.asarray(column.is_valid())
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), len(flat) // max(1, there.sum())))
    out[there] = flat.reshape(there.sum(), -1)
    return out, there


class Asked:
    """What each query of a block asks for: (code, count) rows, in order of code."""

    def __init__(self, codes: pa.Array, counts: pa.Array | None = None):
        query, code = _lists(codes)
        count = np.ones(len(code)) if counts is None else np.asarray(counts.flatten(), np.float64)
        self.n, self.size = len(codes), np.bincount(query, minlength=len(codes))
        self.codes, at = np.unique(code, return_inverse=True)
        by = np.argsort(at, kind="stable")
        self.query, self.count, self.at = query[by], count[by], at[by]
        self.each = np.bincount(self.at, minlength=len(self.codes))
        self.first = np.cumsum(self.each) - self.each
        self.keys = self.at * self.n + self.query  # ascending: by code, then by query

    def here(self, column: pa.Array, weights: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place among the codes, and weight of the elements of a list column that some query asks for."""
        row, code = _lists(column)
        weight = np.ones(len(code)) if weights is None else np.asarray(weights.flatten(), np.float64)
        if not len(self.codes):
            return row[:0], row[:0], weight[:0]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[place] == code
        return row[found], place[found], weight[found]

    def scores(self, rows: int, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum of weight times count over what an item and a query share, for every pair of the tile (rows, n)."""
        hits = np.bincount(place, minlength=len(self.codes)) * self.each
        hot = np.flatnonzero((hits >= DENSE_SHARE * rows * self.n) & (hits > 0))
        column = np.full(len(self.codes) + 1, -1)
        column[hot] = np.arange(len(hot))
        out = np.zeros((rows, self.n))
        if len(hot):
            left, right, c = np.zeros((rows, len(hot))), np.zeros((len(hot), self.n)), column[place]
            left[row[c >= 0], c[c >= 0]] = weight[c >= 0]
            c = column[self.at]
            right[c[c >= 0], self.query[c >= 0]] = self.count[c >= 0]
            out = left @ right
        rare = column[place] < 0
        row, place, weight = row[rare], place[rare], weight[rare]
        each = self.each[place]
        if each.sum():
            entry = np.repeat(self.first[place] - np.cumsum(each) + each, each) + np.arange(each.sum())
            cell = np.repeat(row, each) * self.n + self.query[entry]
            out += np.bincount(cell, np.repeat(weight, each) * self.count[entry], out.size).reshape(out.shape)
        return out

    def pairs(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int, item: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of given pairs (item of the tile, query): how much they share, and the sum of weight times count."""
        each = np.bincount(row, minlength=rows)
        first, mine = np.cumsum(each) - each, each[item]
        pair = np.repeat(np.arange(len(item)), mine)
        entry = np.repeat(first[item] - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())
        key = place[entry] * self.n + query[pair]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        pair, at, entry = pair[found], at[found], entry[found]
        return np.bincount(pair, minlength=len(item)), np.round(np.bincount(pair, weight[entry] * self.count[at], len(item)).astype(np.float64), 6)


class Best:
    """The k best items of each query so far; ties go to the item that came first."""

    def __init__(self, n: int, k: int, fp16: bool = False):
        self.k, self.fp16 = k, fp16
        self.last = np.full(n, -np.inf)  # the k-th score, or less than any
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self._bar()

    def _bar(self) -> None:
        """What a score that is not rounded has to exceed."""
        if self.fp16:
            with np.errstate(over="ignore"):
                above = np.nextafter(self.last.astype(np.float16), np.float16(np.inf)).astype(np.float64)
            self.least = (self.last + above) / 2 - 1e-9
        else:
            self.least = self.last + HALF_STEP

    def add(self, start: int, scores: np.ndarray, ok: np.ndarray | None) -> None:
        """Items from place start on, scores not rounded (items, queries); ok: the pairs that count."""
        step = len(scores) if np.isfinite(self.last).all() else max(256, self.k)
        for i in range(0, len(scores), step):
            s = scores[i : i + step]
            seen = s > self.least
            if ok is not None:
                seen &= ok[i : i + step]
            item, query = np.nonzero(seen)
            value = half(s[item, query]) if self.fp16 else np.round(s[item, query], 6)
            better = value > self.last[query]
            self.new.append((query[better], item[better] + (start + i), value[better]))
            self.waiting += len(self.new[-1][0])
            if self.waiting > self.k * len(self.last):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, item's place, score and rank of the best so far."""
        query, item, value = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        by = np.lexsort((item, -value, query))
        query, item, value = query[by], item[by], value[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.kept, rank = (query[keep], item[keep], value[keep]), rank[keep]
        full = rank == self.k - 1
        self.last[self.kept[0][full]] = self.kept[2][full]
        self.new, self.waiting = [], 0
        self._bar()
        return *self.kept, rank

    def top(self, absent: float) -> np.ndarray:
        """The best score of each query."""
        out = np.full(len(self.last), absent)
        query, _, value, rank = self.settle()
        out[query[rank == 0]] = value[rank == 0]
        return out


@dataclass(frozen=True)
class Plan:
    """What tasks need to know: files of the index, channels of the words and of each encoder, columns to carry on."""

    files: list[str]
    words: list[View]
    encoders: list[list[View]]
    of_query: list[str]
    of_item: list[str]
    names: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.names.extend(v.name for views in [self.words, *self.encoders] for v in views)


#: Query's terms by use: which terms and weights of the items they meet, and whether shared terms are counted.
USES = {"full": "full", "title": "title", "filter": "full"}


def _zones(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places that zones have, and for each (and last, for all others) which queries have it."""
    asked = Asked(batch["zone_codes"])
    test = np.zeros((len(asked.codes) + 1, asked.n), bool)
    test[asked.at, asked.query] = True
    return asked.codes, test


def _place(codes: np.ndarray, column: pa.Array) -> np.ndarray:
    """Row of the zones' test for each item."""
    if not len(codes):
        return np.zeros(len(column), np.int64)
    value = np.asarray(pc.fill_null(column, 0))
    at = np.minimum(np.searchsorted(codes, value), len(codes) - 1)
    return np.where((codes[at] == value) & np.asarray(column.is_valid()), at, len(codes))


def _work(block: pa.RecordBatch, plan: Plan, names: list[str]) -> Iterator[pa.RecordBatch]:
    n, encoders = block.num_rows, range(len(plan.encoders))
    places, zone = _zones(block)
    wanted, score = Asked(block["wanted_codes"]), Asked(block["score_terms"], block["score_counts"])
    uses = {u: Asked(block[f"{u}_terms"], block[f"{u}_counts"]) for u in USES}
    vector = [_matrix(block[f"vector_{e}"]) for e in encoders]
    sent = [half(v) if e else v for e, (v, _) in enumerate(vector)]
    best = {v.name: Best(n, v.k, e > 0) for e, views in enumerate([[], *plan.encoders], -1) for v in views}
    best |= {v.name: Best(n, v.k) for v in plan.words}
    # maxima over all items and over the zone: first of a channel, or kept beside them where no channel has it
    channel = [{v.zone: v.name for v in views if not v.tags} for views in [plan.words, *plan.encoders]]
    tops = [{z: Best(n, 1, e > 0) for z in (False, True) if z not in c} for e, c in enumerate(channel, -1)]
    hits = np.zeros((3, n))
    tagged = wanted.size > 0

    def reach(view: View, geo: np.ndarray, held: np.ndarray, base: np.ndarray | None) -> np.ndarray | None:
        ok = base
        for use, mask in ((view.zone, geo), (view.tags, held)):
            if use:
                ok = mask if ok is None else ok & mask
        return ok & tagged if view.tags else ok

    for start, b in _tiles(plan.files, ["place", "held_codes", "full_terms", "full_weights", *(f"vector_{e}" for e in encoders)]):
        rows = b.num_rows
        geo = zone[_place(places, b["place"])]
        held = wanted.scores(rows, *wanted.here(b["held_codes"])) == wanted.size if tagged.any() else np.ones((rows, n), bool)
        s = score.scores(rows, *score.here(b["full_terms"], b["full_weights"]))
        shared = s > 0  # weights are above 0
        geo_shared = shared & geo
        one = np.ones(rows, np.float32)
        for k, mask in enumerate((shared, geo_shared, geo_shared & held)):
            hits[k] += one @ mask
        for view in plan.words:
            best[view.name].add(start, s, reach(view, geo, held, shared))
        for zoned, top in tops[0].items():
            top.add(start, s, geo_shared if zoned else shared)
        for e, views in enumerate(plan.encoders):
            m, there = _matrix(b[f"vector_{e}"])
            if not there.any() or not vector[e][1].any():
                continue
            s = (half(m) if e else m) @ sent[e].T
            known = None if there.all() and vector[e][1].all() else there[:, None] & vector[e][1]
            for view in views:
                best[view.name].add(start, s, reach(view, geo, held, known))
            for zoned, top in tops[1 + e].items():
                top.add(start, s, reach(View("", 1, zone=zoned), geo, held, known))

    absent = [(0.0, 0.0)] + [(np.nan, -1.0) for _ in encoders]
    most = [[(best[c[z]] if z in c else t[z]).top(absent[k][z]) for z in (False, True)] for k, (c, t) in enumerate(zip(channel, tops, strict=True))]
    found = [best[c].settle() for c in plan.names]
    key, at = np.unique(np.concatenate([item * n + query for query, item, _, _ in found]), return_inverse=True)
    ranks, stop = np.full((len(found), len(key)), NO_RANK, np.int32), 0
    for k, (*_, rank) in enumerate(found):
        ranks[k, at[stop : (stop := stop + len(rank))]] = rank
    del found, best
    item, query = key // n, key % n

    for start, b in _tiles(plan.files, [*plan.of_item, "place", "held_codes", "full_terms", "full_weights", "title_terms", "title_weights", *(f"vector_{e}" for e in encoders)]):
        i, j = np.searchsorted(item, [start, start + b.num_rows])
        if i == j:
            continue
        rows, r, q = b.num_rows, item[i:j] - start, query[i:j]
        rank = ranks[:, i:j]
        out = {c: block[c].take(pa.array(q)) for c in plan.of_query} | {c: b[c].take(pa.array(r)) for c in plan.of_item}
        out |= {f"rank_{c}": pa.array(x) for c, x in zip(plan.names, rank, strict=True)} | {"n_channels": pa.array((rank < NO_RANK).sum(axis=0).astype(np.int32))}
        out["in_geo"] = pa.array(zone[_place(places, b["place"])[r], q].astype(np.int32))
        out["n_held"] = pa.array(wanted.pairs(*wanted.here(b["held_codes"]), rows, r, q)[0])
        out["bm25"] = pa.array(score.pairs(*score.here(b["full_terms"], b["full_weights"]), rows, r, q)[1])
        for u, side in USES.items():
            shared, total = uses[u].pairs(*uses[u].here(b[f"{side}_terms"], b[f"{side}_weights"]), rows, r, q)
            size = uses[u].size[q]
            out[f"{u}_cov"] = pa.array(np.round(shared / np.maximum(size, 1), 6), mask=size == 0)
            out[f"{u}_bm25"] = pa.array(total)
        out |= {c: pa.array(h[q].astype(np.int64)) for c, h in zip(("n_hits", "n_geo", "n_geo_filt"), hits, strict=True)}
        out |= {"best_bm25": pa.array(most[0][0][q]), "best_bm25_geo": pa.array(most[0][1][q])}
        for e in encoders:
            m, there = _matrix(b[f"vector_{e}"])
            known = there[r] & vector[e][1][q]
            cos = np.zeros(len(r))
            if known.any():
                x, y = (half(m) if e else m)[r[known]], sent[e][q[known]]
                cos[known] = half(np.einsum("ij,ij->i", x, y)) if e else np.round(np.einsum("ij,ij->i", x, y), 6)
            top, top_geo = (x[q] for x in most[1 + e])
            none = np.isnan(top)  # without vectors on one side there is nothing to compare with
            out |= {f"cos_{e}": pa.array(cos, mask=~known), f"best_{e}": pa.array(top, mask=none), f"best_geo_{e}": pa.array(top_geo, mask=none)}
        yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)


def candidates(queries: DataFrame, index: DataFrame, plan: Plan) -> DataFrame:
    """One row per pair that a channel of the plan has, with ranks, scores and the carried columns.

    queries: zone_codes, wanted_codes, {score, full, title, filter}_terms and _counts, vector_<encoder>. index (of
    write_index): place, held_codes, {full, title}_terms and _weights, vector_<encoder>.
    """
    kinds = {c: queries.schema[c].dataType for c in plan.of_query} | {c: index.schema[c].dataType for c in plan.of_item}
    kinds |= {f"rank_{c}": T.IntegerType() for c in plan.names} | {"n_channels": T.IntegerType(), "in_geo": T.IntegerType(), "n_held": T.LongType(), "bm25": T.DoubleType()}
    kinds |= {f"{u}_{x}": T.DoubleType() for u in USES for x in ("cov", "bm25")} | {c: T.LongType() for c in ("n_hits", "n_geo", "n_geo_filt")}
    kinds |= {c: T.DoubleType() for c in ("best_bm25", "best_bm25_geo")} | {f"{c}_{e}": T.DoubleType() for e in range(len(plan.encoders)) for c in ("cos", "best", "best_geo")}
    names = list(kinds)

    def work(batches):
        def blocks():
            waiting: list[pa.RecordBatch] = []
            for b in batches:
                for i in range(0, b.num_rows, BLOCK):
                    waiting.append(b.slice(i, BLOCK))
                    if sum(x.num_rows for x in waiting) >= BLOCK:
                        yield waiting
                        waiting = []
            if waiting:
                yield waiting

        for some in blocks():
            yield from _work(pa.Table.from_batches(some).combine_chunks().to_batches()[0], plan, names)

    n = queries.count()
    parts = max(-(-n // BLOCK), min(n, queries.sparkSession.sparkContext.defaultParallelism), 1)
    return queries.repartition(parts).mapInArrow(work, T.StructType([T.StructField(c, t) for c, t in kinds.items()]))
