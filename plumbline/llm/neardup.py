"""MinHash near-duplicates: fast similarity sketching, banding and exact verification.

A text's set is its distinct w-word shingles (64-bit hashes of the lower-cased words). The sketch fills its coordinates
in rounds: in round i < t every shingle is thrown into the coordinate that its i-th hash names, in rounds t to 2t-1 all
are thrown into coordinate i - t, and a coordinate keeps the smallest value of the first round that reached it. So every
coordinate is filled, after about one pass for long texts, with the concentration of t independent coordinates.

Texts with equal sets form a class; only classes are compared. Bands of the sketch deal the classes to buckets:
1. In each bucket every class is paired with the bucket's smallest class. Pairs are verified on whole sets; components
   of verified links are found by label propagation with all state in tables.
2. In buckets that still hold several components every class is paired with the class of another component whose
   sketch agrees most with its own.
3. In buckets that still do, all pairs of classes of different components are verified in place, the most alike first,
   whose sketches agree in a share of coordinates that a linked pair falls below with probability under 1e-6; only links
   that join components leave the task.
Steps 2 and 3 compare sketches block against block, so that no task holds a bucket. Inside one component no pair needs
verification, so the pairs of a group of near copies grow about as its size, not as its square. Nothing is capped: a
link of similarity s shares no bucket with probability (1 - s**ROWS)**BANDS, below 2e-7 for s = 0.8.

A key that many rows share (a bucket, the smallest class of one, a component, a set with many copies) is dealt to several
tasks: its rows are salted, and the one row that they meet is sent to each. Keys are hot from a share of all rows on, so
their number is bounded. `exact` leaves out the sketches' judgement in the third step: every pair of classes of a bucket
in different components is then verified.

Texts that are null or without words have the empty set and are linked with nothing. Rows without an id have their set
counted, are in no group, have a null component and are kept. Repeated rows share their id's component. Equal ids and
ties of agreement are settled by the smaller id; very long texts are one set each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPREAD, U64, fresh, hash_strings, hot_keys, mix, ngram_hashes, read_table, released, sized_ids, split_words, spread_join, tuned, whole, written

BANDS, ROWS = 40, 5
#: A coordinate value holds the round above and the hash below.
_ROUND = U64(52)
#: Classes with candidates up to this many have their ids broadcast to the pass that reads their sets.
BROADCAST_CLASSES = 1_000_000
#: Keys of large buckets up to this many are broadcast to the pass that picks their members.
BROADCAST_KEYS = 200_000
#: Classes of one block of a bucket, and standard deviations (of the sketch's share) below the least similarity that
#: still count as close.
BLOCK, DEVIATIONS = 256, 5.0


def shingles(hashes: np.ndarray, w: int) -> np.ndarray:
    """Sorted distinct hashes of w-word shingles; fewer words make one shingle, none none."""
    if not len(hashes):
        return np.empty(0, U64)
    return np.unique(ngram_hashes(hashes, min(w, len(hashes))))


def sketch(items: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: per coordinate round << 52 | value."""
    out = np.full(size, np.iinfo(np.uint64).max, U64)
    for i in range(2 * size):
        with np.errstate(over="ignore"):
            h = mix(items + U64(i) * U64(0x9E3779B97F4A7C15))
        value = (U64(i) << _ROUND) | (h >> U64(12))
        if i < size:
            # the bin comes from other bits than most of the value: a second mix
            np.minimum.at(out, (mix(h ^ U64(0xD6E8FEB86659FD93)) % U64(size)).astype(np.int64), value)
        else:
            out[i - size] = min(out[i - size], value.min())
        if i < size and out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    with np.errstate(over="ignore"):
        v = mix(values.reshape(bands, rows))
        total = np.arange(bands, dtype=U64) * U64(0xA0761D6478BD642F)
        for k in range(rows):
            total = mix(total + v[:, k])
    return total.astype(np.int64)


def summary(items: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys, and 8 bits of each coordinate for estimates; both empty for an empty set."""
    if not len(items):
        return np.empty(0, np.int64), b""
    values = sketch(items)
    return band_keys(values), mix(values).astype(np.uint8).tobytes()


def _sets(texts: pa.Array, w: int):
    words = split_words(pc.ascii_lower(texts))
    h = mix(hash_strings(words.dictionary))
    for i in range(len(texts)):
        yield shingles(h[words.ids[words.offsets[i] : words.offsets[i + 1]]], w)


SKETCH = [T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]


def sketches(docs: DataFrame, w: int, id_col: str, text_col: str) -> DataFrame:
    """doc, set size, 128-bit hash of the set, band keys (none for empty sets)."""

    def work(batches):
        memo: dict[tuple[int, int, int], tuple[np.ndarray, bytes]] = {}
        for b in batches:
            n, h1, h2, keys, short = [], [], [], [], []
            for s in _sets(whole(b.column(1)), w):
                with np.errstate(over="ignore"):
                    a, c = int(s.sum(dtype=U64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
                if (len(s), a, c) not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[len(s), a, c] = summary(s)
                n.append(len(s))
                h1.append(a)
                h2.append(c)
                keys.append(memo[len(s), a, c][0])
                short.append(memo[len(s), a, c][1])
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, U64).astype(np.int64)), pa.array(np.array(h2, U64).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))), pa.array(short, pa.binary())], names=["doc", *(f.name for f in SKETCH)])

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(work), T.StructType([source.schema["doc"], *SKETCH]))


def sets_of(docs: DataFrame, ids: DataFrame, w: int, id_col: str, text_col: str) -> DataFrame:
    """doc and set of the documents with these ids (one column, doc), one row each."""

    def work(batches):
        for b in batches:
            found = list(_sets(whole(b.column(1)), w))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate([np.sort(s.astype(np.int64)) for s in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc", "items"])

    few = ids.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    source = source.join(F.broadcast(ids) if few else ids, "doc", "left_semi")
    return source.mapInArrow(released(work), T.StructType([source.schema["doc"], T.StructField("items", T.ArrayType(T.LongType()))]))


def could_link(n: Column, m: Column, percent: int) -> Column:
    """Sizes alone leave a link possible."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label for the nodes (one column) of links (a, b): the smallest node reachable, by hooking and jumping.

    Each round gives every node the smallest label among its own and its neighbours', then the label of that label.
    Aggregation by node is combined before the shuffle; labels are checkpointed each round.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degree = written(both.groupBy("other").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPREAD), "degrees")
    hubs = hot_keys(degree, ["other"])
    labels = nodes.select("node", F.col("node").alias("label"))
    total = None
    while True:
        told = labels.select(F.col("node").alias("other"), F.col("label").alias("there"))
        near = spread_join(both, told, ["other"], hubs, "node").groupBy("node").agg(F.min("there").alias("there"))
        hooked = labels.join(near, "node", "left").select("node", F.least("label", "there").alias("label"), (F.col("there") < F.col("label")).alias("moved"))
        hooked = hooked.checkpoint()
        total = hooked.count() if total is None else total
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        large = hot_keys(hooked.groupBy("label").agg(F.count(F.lit(1)).alias("size")), ["label"], total=total)
        labels = spread_join(hooked, jump, ["label"], large, "node", "left").select("node", F.coalesce("next", "label").alias("label")).checkpoint()
        if hooked.where("moved").isEmpty():
            return labels


class Verifier:
    """Verified links among candidate pairs; sets are read from the documents once for each class that needs them."""

    def __init__(self, docs: DataFrame, w: int, percent: int, id_col: str, text_col: str):
        self.docs, self.w, self.percent, self.id_col, self.text_col = docs, w, percent, id_col, text_col

    def sets(self, ids: DataFrame) -> DataFrame:
        return written(sets_of(self.docs, ids, self.w, self.id_col, self.text_col).dropDuplicates(["doc"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b): those with percent * |union| <= 100 * |intersection|."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        total = pairs.count()
        hot = [hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("size")), [c], total=total) for c in ("a", "b")]
        left = spread_join(pairs, sets.select(F.col("doc").alias("a"), F.col("items").alias("left")), ["a"], hot[0], "b")
        both = spread_join(left, sets.select(F.col("doc").alias("b"), F.col("items").alias("right")), ["b"], hot[1], "a")
        shared = F.size(F.array_intersect("left", "right"))
        return both.where(100 * shared >= self.percent * (F.size("left") + F.size("right") - shared)).select("a", "b")


def agreeing(left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in which each left sketch agrees with each right one, and whether they share a band before this one."""
    total = np.zeros((len(left), len(right)), np.int32)
    earlier = np.zeros(total.shape, bool)
    for k in range(BANDS):
        here = np.zeros(total.shape, np.uint8)
        for i in range(k * ROWS, (k + 1) * ROWS):
            here += left[:, i, None] == right[None, :, i]
        total += here
        if k < band:
            earlier |= here == ROWS
    return total, earlier


def close_pairs(table: pa.Table, best_only: bool, percent: int, exact: bool = False) -> pa.Table:
    """Pairs of one block pair of a bucket: classes of different components with agreeing sketches.

    best_only: for each class the one that agrees most, to be verified. Otherwise verified links, as many as join the
    components that these pairs can join; a pair that shares an earlier band is left to that bucket.
    """
    node, label, n = (np.asarray(table[c]) for c in ("node", "label", "n"))
    values = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
    block, low, high = np.asarray(table["block"]), table["low_block"][0].as_py(), table["high_block"][0].as_py()
    x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(x) or not len(y):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    total, earlier = agreeing(values[x], values[y], table["band"][0].as_py())
    s = percent / 100
    least = 0 if exact and not best_only else BANDS * ROWS * s - DEVIATIONS * np.sqrt(BANDS * ROWS * s * (1 - s))
    sizes = 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
    ok = sizes & (total >= least) & (label[x][:, None] != label[y][None, :])
    if best_only:
        total = np.where(ok, total, -1)
        i, j = np.concatenate([np.arange(len(x)), total.argmax(0)]), np.concatenate([total.argmax(1), np.arange(len(y))])
        good = ok[i, j]
        i, j = x[i[good]], y[j[good]]
    else:
        i, j = np.nonzero(ok & ~earlier)
        order = np.argsort(-total[i, j], kind="stable")
        i, j = joining(x[i[order]], y[j[order]], label.tolist(), items_of(table["items"]), percent)
    pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def items_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = pa.concat_arrays(column.chunks)
    values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def joining(i: np.ndarray, j: np.ndarray, label: list[int], items: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that are links and join components that no earlier one has joined; items are sorted sets."""
    parent = {v: v for v in label}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(label[p]), root(label[q])
        if a != b:
            u, v = items[p], items[q]
            shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
            if 100 * shared >= percent * (len(u) + len(v) - shared):
                parent[max(a, b)] = min(a, b)
                kept.append(k)
    return i[kept], j[kept]


def pairing(best_only: bool, percent: int, exact: bool):
    return lambda table: close_pairs(table, best_only, percent, exact)


def near_duplicates(docs: DataFrame, w: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc, n_shingles, component_id for each row (ids are whole numbers); w words a shingle, percent for a link."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    verifier = Verifier(rows.where(F.col(id_col).isNotNull()), w, percent, id_col, text_col)
    found = written(sketches(rows, w, id_col, text_col), "sketches")
    told = found.where("n > 0 and doc is not null")
    classes = written(told.groupBy("n", "h1", "h2").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    # one row of each class carries its keys: the smallest id may occur in repeated rows, whose keys are equal
    firsts = written(told.join(classes.select(F.col("node").alias("doc")), "doc", "left_semi").dropDuplicates(["doc", "h1", "h2"]).select(F.col("doc").alias("node"), "n", "keys", "sketch"), "firsts")
    members = firsts.select("node", "n", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(buckets, "buckets")
    sizes = firsts.select("node", "n")
    two = buckets.where("size = 2").select(F.col("pivot").alias("a"), F.col("last").alias("b")).distinct()
    two = two.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("y")), "b").where(could_link(F.col("x"), F.col("y"), percent)).select("a", "b")
    pivots = buckets.where("size > 2").select("key", "pivot", "size").join(sizes.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n")), "pivot")
    pivots = written(pivots, "pivots")
    counted = pivots.agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("rows")).first()
    hot = hot_keys(pivots, ["key"], total=counted["rows"] or 0)
    picked = pivots.select("key", "pivot", "pivot_n")
    large = members.join(F.broadcast(picked), "key") if counted["keys"] <= BROADCAST_KEYS else spread_join(members, picked, ["key"], hot, "node")
    large = written(large, "members")
    star = large.where((F.col("node") != F.col("pivot")) & could_link(F.col("n"), F.col("pivot_n"), percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = written(two.unionByName(star).distinct(), "pairs")
    links = written(verifier.links(pairs), "links")
    short = firsts.select("node", "sketch")

    def component_labels() -> DataFrame:
        return components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    labels, rest = component_labels(), large.select("key", "band", "node", "n")
    for best_only in (True, False):
        marked = labelled(rest)
        several = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("low < high").select("key", "blocks")
        rest = written(spread_join(marked, several, ["key"], hot, "node").select("key", "band", "node", "n", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks"), "open")
        if not best_only:
            sets = verifier.sets(rest.select(F.col("node").alias("doc")).distinct())
            short = short.join(sets.select(F.col("doc").alias("node"), "items"), "node")
        dealt = rest.join(short, "node").withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"low_block": F.least("block", "facing"), "high_block": F.greatest("block", "facing")})
        close = dealt.groupBy("key", "low_block", "high_block").applyInArrow(pairing(best_only, percent, exact), "a long, b long")
        new = close.distinct()
        if best_only:
            new = verifier.links(written(new.join(pairs, ["a", "b"], "left_anti"), "pairs"))
        links = written(links.unionByName(new), "links")
        labels = component_labels()
        rest = rest.select("key", "band", "node", "n")
    named = labelled(classes.select("n", "h1", "h2", "node")).select("n", "h1", "h2", "label")
    copies = hot_keys(classes, ["n", "h1", "h2"])
    of_class = spread_join(told.select("doc", "n", "h1", "h2"), named, ["n", "h1", "h2"], copies, "doc").select("doc", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    alone = found.where("n = 0 or doc is null").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return of_class.unionByName(alone)


def keep_one_of_each(docs: DataFrame, w: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id, one row for each id; rows without an id stay.

    Of several rows of one id the one of smallest hash of all columns (but maps) stays. Only the ids that go and the ids of
    several rows are joined to docs: broadcast if they are few (counted), by a shuffle otherwise.
    """
    found = written(near_duplicates(docs, w, percent, id_col, text_col).where("doc is not null").select("doc", "component_id"), "components")
    gone, few = sized_ids(found.where(F.col("doc") != F.col("component_id")).select("doc"), BROADCAST_CLASSES)
    key, mark = fresh(docs.columns, "gone"), fresh(docs.columns, "mark")
    gone = gone.select(F.col("doc").alias(key))
    kept = docs.join(F.broadcast(gone) if few else gone, docs[id_col] == F.col(key), "left_anti")
    several = written(found.groupBy("doc").count().where("count > 1").select(F.col("doc").alias(key)), "repeated")
    if several.isEmpty():
        return kept
    several, few = sized_ids(several, BROADCAST_CLASSES)
    right = F.broadcast(several) if few else several
    alone = kept.join(right, kept[id_col] == F.col(key), "left_anti")
    again = kept.join(right, kept[id_col] == F.col(key), "left_semi").withColumn(mark, F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t]))
    first = again.groupBy(id_col).agg(F.min(mark).alias(mark))
    return alone.unionByName(again.join(first, [id_col, mark], "left_semi").dropDuplicates([id_col]).select(*docs.columns))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, by four-word shingles and similarity 0.8."""
    docs = read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    rows = near_duplicates(docs, w=4, percent=80)
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_sql(w: int = 4, percent: int = 80) -> str:
    """The same rows in DuckDB's SQL: all pairs that share a shingle."""
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - {w - 1}, 1) + 1), lambda i: array_to_string(words[i : i + {w - 1}], ' '))) END AS items FROM worded
), single AS (SELECT doc_id, unnest(items) AS item FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM single a JOIN single b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= {percent} * (len(a.items) + len(b.items) - n)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, there) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON r.there = l.x),
found AS (SELECT doc_id, min(there) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)"""
