"""Language-model scoring with an Elias-Fano n-gram trie.

Words (and one end token per text) are counted in the training documents by Spark. Word hashes in order are the
vocabulary; a word's id is its rank. The trie has a level for words, one for pairs under their first word and one for
triples under their first two words, in shards by the first word's hash; a shard with many tokens is cut into parts by the
second word, so that what follows a frequent word is no single task or file. Each level keeps its sequences in Elias-Fano
form: monotone pointers to children, and child ids made monotone by their parent. A triple's last word is stored as its
rank among the successors of the middle word in its part (context-relative), so that it takes few bits; a query finds the pair by
successor search, turns it into that rank and searches the triple by it. Probabilities are smoothed by interpolated
absolute discounting down to add-one words, and kept as 16-bit codes of -log10 p.

Shards are files in the shared folder, written once per task and mapped by every executor, so no model passes through
the driver or a broadcast; their number grows with the vocabulary. All triples are kept (MIN_TRIPLES is 1; with a larger
one, the back-off weights take over the exact mass of the rest). A null text is an empty one: the end token alone. Repeated
rows are counted and scored each. Very long texts are counted and scored whole. Without training documents every word is
unknown, with probability one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, annotate, hash_strings, mix, new_path, read_table, split_words, sums_by_text, tuned, whole, written
from .eliasfano import EliasFano, drop, encode, mapped, packed, put

#: Discount of both upper levels, least count of a kept triple, words of a shard, tokens of a part of a shard, tokens
#: counted before they are sent on.
DISCOUNT, MIN_TRIPLES, SHARD_WORDS, PART_TOKENS, FLUSH = 0.75, 1, 1 << 16, 1 << 22, 1_000_000
#: Codes of a unit of -log10 p: 16 bits reach 10**-16.
STEPS = 4096.0
#: Hash of the end token; no string is hashed to it on purpose.
END = U64(0x5EED_0E4D_0F7E_8701)


def code(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 65535).astype(np.uint16)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a batch (the end token's last), places of all tokens among them, and each text's borders."""
    words = split_words(pc.ascii_lower(texts))
    distinct = np.append(mix(hash_strings(words.dictionary)), END)
    n = len(texts)
    borders = words.offsets + np.arange(n + 1)
    at = np.full(int(borders[-1]), len(distinct) - 1, np.int64)
    at[np.arange(len(words.ids)) + words.text_of()] = words.ids
    return distinct, at, borders


class Trie:
    """The shards of a model in a folder, opened as they are needed."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], n: int, parts: tuple[int, ...] = (), successors: int = 0):
        self.folder, self.bits, self.n, self.successors = folder, bits, n, successors
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.v = int(self.offsets[-1])
        self.parts = np.array(parts or [1] * max(1, len(sizes)), np.int64)
        #: Parts are numbered through all shards.
        self.first_part = np.concatenate([[0], np.cumsum(self.parts)])
        self._open: dict[tuple[int, int], dict] = {}

    def level(self, k: int, part: int) -> dict:
        """Words of a shard (k = 1), pairs or triples of a part."""
        if (k, part) not in self._open:
            arrays = mapped(f"{self.folder}/{k}-{part}.bin")
            if k == 2:
                arrays |= mapped(f"{self.folder}/c-{part}.bin")
            self._open[k, part] = sequences(arrays)
        return self._open[k, part]

    def part_of(self, shard: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Part of pairs with these second words (unknown ones: the shard's first part)."""
        n = self.parts[shard]
        chosen = (mix(second.astype(U64) ^ U64(0x5EED)) % n.astype(U64)).astype(np.int64)
        return self.first_part[shard] + np.where(second >= 0, chosen, 0)

    def shard_of_part(self, part: int) -> int:
        return int(np.searchsorted(self.first_part, part, side="right")) - 1

    def shard_of_hash(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """Shard of word ids; the start token (id v) belongs to the last one."""
        return np.minimum(np.searchsorted(self.offsets, ids, side="right") - 1, len(self.offsets) - 2)

    def _each(self, shard: np.ndarray, use: np.ndarray):
        rows = np.flatnonzero(use)
        shard = shard[rows]
        # numbers of 16 bits are put in order by counting
        order = np.argsort(shard.astype(np.uint16) if int(self.first_part[-1]) <= 1 << 16 else shard, kind="stable")
        rows, shard = rows[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
            yield int(shard[i]), rows[i:j]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if self.v:
            for s, rows in self._each(self.shard_of_hash(hashes), np.ones(len(hashes), bool)):
                level = self.level(1, s)
                if len(level["hash"]):
                    at = np.minimum(np.searchsorted(level["hash"], hashes[rows]), len(level["hash"]) - 1)
                    hit = level["hash"][at] == hashes[rows]
                    ids[rows[hit]] = at[hit] + self.offsets[s]
                    counts[rows[hit]] = level["count"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, rows in self._each(self.shard_of(ids), ids >= 0):
            out[rows] = self.level(1, s)["count"][ids[rows] - self.offsets[s]]
        return out

    def word_p(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.n + self.v + 1)

    def pairs(self, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        """Of pairs of ids: found, place in the part, rank among first's successors, code, and first's back-off code."""
        n = len(first)
        out = {"found": np.zeros(n, bool), "place": np.zeros(n, np.int64), "rank": np.zeros(n, np.int64), "code": np.zeros(n, np.uint16), "back": np.zeros(n, np.uint16)}
        shards = self.shard_of(first)
        for g, rows in self._each(self.part_of(shards, second), first >= 0):
            level, s = self.level(2, g), self.shard_of_part(g)
            word = first[rows] - self.offsets[s]
            out["back"][rows] = level["back"][word]
            known = second[rows] >= 0
            rows, word = rows[known], word[known]
            place, hit = level["child"].successor(word.astype(U64) * U64(self.v) + second[rows].astype(U64))
            rows, place, word = rows[hit], place[hit], word[hit]
            out["found"][rows] = True
            out["place"][rows] = place
            own, where = np.unique(word, return_inverse=True)
            out["rank"][rows] = (place - level["pointer"][own].astype(np.int64)[where]) * self.parts[s] + (g - self.first_part[s])
            out["code"][rows] = level["code"][place]
        return out

    def triples(self, first: np.ndarray, second: np.ndarray, place: np.ndarray, rank: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs, their places, and context-relative last words: found, code, and the pair's back-off code."""
        found, codes, back = np.zeros(len(first), bool), np.zeros(len(first), np.uint16), np.zeros(len(first), np.uint16)
        for g, rows in self._each(self.part_of(self.shard_of(first), second), use):
            level = self.level(3, g)
            back[rows] = level["back"][place[rows]]
            rows = rows[rank[rows] >= 0]
            at, hit = level["child"].successor(place[rows].astype(U64) * U64(self.successors) + rank[rows].astype(U64))
            found[rows[hit]] = True
            codes[rows[hit]] = level["code"][at[hit]]
        return found, codes, back


def sequences(arrays: dict[str, np.ndarray]) -> dict:
    """Arrays of a file, those of Elias-Fano sequences put together."""
    found: dict = {name: a for name, a in arrays.items() if "." not in name}
    for name in {x.split(".")[0] for x in arrays if "." in x}:
        found[name] = EliasFano({x.split(".")[1]: a for x, a in arrays.items() if x.startswith(name + ".")})
    return found


@lru_cache(maxsize=2)
def opened(folder: str, bits: int, sizes: tuple[int, ...], n: int, parts: tuple[int, ...], successors: int) -> Trie:
    """One trie per worker and model."""
    return Trie(folder, bits, sizes, n, parts, successors)


def _contexts(ids: np.ndarray, borders: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token (the start token at a text's beginning) and the one before that (-1 where none)."""
    before, earlier = np.roll(ids, 1), np.roll(ids, 2)
    first = borders[:-1]
    before[first] = start
    second = first[np.diff(borders) > 1] + 1
    earlier[first] = -1
    earlier[second] = start
    return before, earlier


def _count_words(batches):
    """(hash, count) of the tokens of a partition."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h, c = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[new], np.add.reduceat(c, new)

    def sent(h, c):
        for i in range(0, len(h), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)].astype(np.int64)), pa.array(c[i : i + (1 << 17)])], names=["h", "c"])

    for b in batches:
        distinct, at, _ = token_hashes(whole(b.column(0)))
        c = np.bincount(at, minlength=len(distinct))
        kept.append((distinct[c > 0], c[c > 0]))
        if sum(len(k[0]) for k in kept) > FLUSH:
            kept = [merged()]
            if len(kept[0][0]) > FLUSH:
                yield from sent(*kept.pop())
    if kept:
        yield from sent(*merged())


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys merged, in order, with the sum of their counts (None: one each)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(_changes(keys))
    if counts is None:
        return keys[at], np.diff(at, append=len(keys))
    return keys[at], np.add.reduceat(counts, at, dtype=np.int64) if len(at) else counts


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _summed_triples(place: np.ndarray, third: np.ndarray, counts: np.ndarray | None, pairs: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal triples merged, in order: the places of their contexts among so many pairs, last words, and the sum of their
    counts (None: one each).
    """
    if pairs * (v + 1) < 1 << 63:  # both in one number
        keys, n = _summed(place.astype(U64) * U64(v + 1) + third.astype(U64), counts)
        return (keys // U64(v + 1)).astype(np.int64), (keys % U64(v + 1)).astype(third.dtype), n
    order = np.lexsort((third, place))
    place, third = place[order], third[order]
    at = np.flatnonzero(_changes(place) | _changes(third))
    n = np.diff(at, append=len(place)) if counts is None else np.add.reduceat(counts[order], at, dtype=np.int64) if len(at) else counts
    return place[at], third[at], n


def _count_grams(batches, trie: Trie):
    """Packed n-grams of a partition, a row for each part: pairs with counts, and triples (pair key, third word) with
    counts."""
    pairs: list[np.ndarray] = []
    follows: list[np.ndarray] = []
    narrow = np.uint32 if trie.v < 1 << 32 else np.int64

    def sent():
        k, use = np.concatenate(pairs), np.flatnonzero(np.concatenate(follows))
        pairs.clear()
        follows.clear()
        order = np.argsort(k)
        third = (k[use] % U64(trie.v + 1)).astype(narrow)
        k = k[order]
        new = _changes(k)
        at = np.flatnonzero(new)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        k, c = k[at], np.diff(at, append=len(k))
        # the context of a triple is the pair before: the triples under each pair are told by their number
        place, t, d = _summed_triples(place[use - 1], third, None, len(k), trie.v)
        children = np.bincount(place, minlength=len(k))
        first, second = (k // U64(trie.v + 1)).astype(np.int64), (k % U64(trie.v + 1)).astype(np.int64)
        part = trie.part_of(trie.shard_of(first), second)
        order = np.argsort(part, kind="stable")
        start = (np.cumsum(children) - children)[order]
        first, second, part, c, children = first[order], second[order].astype(narrow), part[order], c[order], children[order]
        below = np.concatenate([[0], np.cumsum(children)])
        at = np.repeat(start - below[:-1], children) + np.arange(len(t))
        t, d = t[at], d[at]
        cuts = np.searchsorted(part, np.arange(trie.first_part[-1] + 1))
        for s in range(len(cuts) - 1):
            i, j = slice(cuts[s], cuts[s + 1]), slice(below[cuts[s]], below[cuts[s + 1]])
            if cuts[s] < cuts[s + 1]:
                firsts, runs = np.unique(first[i], return_counts=True)
                parts = (firsts.astype(narrow).tobytes(), _small(runs), second[i].tobytes(), _small(c[i]), _small(children[i]), t[j].tobytes(), _small(d[j]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], names=GRAMS)

    for b in batches:
        distinct, at, borders = token_hashes(whole(b.column(0)))
        ids = trie.words(distinct)[0][at]
        before, earlier = _contexts(ids, borders, trie.v)
        pairs.append(before.astype(U64) * U64(trie.v + 1) + ids.astype(U64))
        follows.append(earlier >= 0)
        if sum(map(len, pairs)) >= FLUSH:
            yield from sent()
    if pairs:
        yield from sent()


GRAMS = ["part", "first", "runs", "second", "pair_n", "children", "third", "triple_n"]


def _small(counts: np.ndarray) -> bytes:
    """Counts in 16 bits each if they all fit, in 64 otherwise."""
    return counts.astype(np.uint16 if int(counts.max(initial=0)) < 1 << 16 else np.int64).tobytes()


def _least(counts: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _counts_of(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data.size == 2 * n else np.int64).astype(np.int64)


def _gathered(table: pa.Table, v: int):
    """Merged pairs (keys, counts) and triples (places of their pairs, third words, counts) of a part."""
    narrow = np.dtype(np.uint32 if v < 1 << 32 else np.int64)
    pairs, pair_n, children, thirds, triple_n = [], [], [], [], []
    for row in range(table.num_rows):
        data = {name: table[name][row].as_buffer() for name in GRAMS[1:]}
        first, second, third = (np.frombuffer(data[x], narrow) for x in ("first", "second", "third"))
        key = np.repeat(first.astype(U64) * U64(v + 1), _counts_of(data["runs"], len(first))) + second.astype(U64)
        pairs.append(key)
        pair_n.append(_counts_of(data["pair_n"], len(key)).astype(np.int32))
        children.append(_counts_of(data["children"], len(key)))
        thirds.append(third)
        triple_n.append(_counts_of(data["triple_n"], len(third)).astype(np.int32))
    keys, counts = _summed(np.concatenate(pairs), np.concatenate(pair_n))
    place = np.concatenate([np.repeat(np.searchsorted(keys, key), n) for key, n in zip(pairs, children, strict=True)])
    return keys, counts, *_summed_triples(place, np.concatenate(thirds), np.concatenate(triple_n), len(keys), v)


def _write_words(table: pa.Table, folder: str) -> pa.Table:
    h, c = np.asarray(table["h"]).astype(U64), np.asarray(table["c"])
    order = np.argsort(h)
    s = table["shard"][0].as_py()
    put(f"{folder}/1-{s}.bin", packed({"hash": h[order], "count": c[order]}))
    return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})


def _write_pairs(table: pa.Table, trie: Trie) -> pa.Table:
    """Pairs of a part without their codes, and its kept triples with their contexts for the steps that follow."""
    g = table["part"][0].as_py()
    s = trie.shard_of_part(g)
    keys, counts, context, third, n = _gathered(table, trie.v)
    first, second = (keys // U64(trie.v + 1)).astype(np.int64) - trie.offsets[s], (keys % U64(trie.v + 1)).astype(np.int64)
    words = int(trie.offsets[s + 1] - trie.offsets[s]) + (s == len(trie.offsets) - 2)
    kinds = np.bincount(first, minlength=words)
    arrays = {f"child.{k}": a for k, a in encode(first.astype(U64) * U64(trie.v) + second.astype(U64), words * trie.v).items()}
    arrays |= {f"pointer.{k}": a for k, a in encode(np.concatenate([[0], np.cumsum(kinds)]), len(first) + 1).items()}
    put(f"{trie.folder}/2-{g}.bin", packed(arrays))
    put(f"{trie.folder}/k-{g}.bin", packed({"kinds": _least(kinds)}))
    put(f"{trie.folder}/p-{g}.bin", packed({"count": _least(counts)}))
    new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    place = context[new]
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))
    sums = np.add.reduceat(n, new) if len(new) else n
    kept = n >= MIN_TRIPLES
    # for a pair no more than the number of its triples and their sum, for a triple its last word and its count
    kids, below = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    kids[place], below[place] = np.bincount(group[kept], minlength=len(new)), sums
    put(f"{trie.folder}/t-{g}.bin", packed({"kids": _least(kids), "sum": _least(below), "third": third[kept], "n": _least(n[kept])}))
    return pa.table({"part": pa.array([g], pa.int32()), "n": pa.array([int(kinds.max(initial=1)) * int(trie.parts[s])], pa.int64())})


def _write_codes(g: int, trie: Trie, texts: int) -> None:
    """Codes of a part's pairs: what a first word leaves depends on its successors in all parts of its shard."""
    s = trie.shard_of_part(g)
    try:
        counts = mapped(f"{trie.folder}/p-{g}.bin")["count"].astype(np.int64)
    except FileNotFoundError:  # the task has run before, up to here
        return
    found = sequences(mapped(f"{trie.folder}/2-{g}.bin"))
    kinds = np.sum([mapped(f"{trie.folder}/k-{x}.bin")["kinds"].astype(np.int64) for x in range(trie.first_part[s], trie.first_part[s + 1])], 0)
    # a word is followed by one token each time that it occurs, the start by one in each text
    total = np.zeros(len(kinds), np.int64)
    own = int(trie.offsets[s + 1] - trie.offsets[s])
    total[:own] = trie.level(1, s)["count"]
    total[own:] = texts
    back = np.where(kinds > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    codes = np.zeros(len(counts), np.uint16)
    for i in range(0, len(counts), FLUSH):
        at = slice(i, i + FLUSH)
        value = found["child"][np.arange(i, min(i + FLUSH, len(counts)))]
        first, second = (value // U64(trie.v)).astype(np.int64), (value % U64(trie.v)).astype(np.int64)
        codes[at] = code((counts[at] - DISCOUNT) / total[first] + back[first] * trie.word_p(trie.counts(second)))
    put(f"{trie.folder}/c-{g}.bin", packed({"code": codes, "back": code(back)}))
    drop(f"{trie.folder}/p-{g}.bin")


def _write_triples(g: int, trie: Trie) -> None:
    """Level 3 of a part: kept triples under their pairs, last words by their rank among the middle word's successors."""
    try:
        t = mapped(f"{trie.folder}/t-{g}.bin")
    except FileNotFoundError:  # the task has run before, up to here
        return
    kids, below, seconds = t["kids"].astype(np.int64), t["sum"].astype(np.float64), trie.level(2, g)["child"]
    borders = np.concatenate([[0], np.cumsum(kids)])
    taken = np.concatenate([[0], np.cumsum(t["n"], dtype=np.int64)])[borders]
    # what the kept triples leave of each pair's mass
    left = np.where(below > 0, 1 - (np.diff(taken) - DISCOUNT * kids) / np.maximum(below, 1), 1.0)
    place = np.repeat(np.arange(len(kids), dtype=np.int32), kids)
    codes, value = np.zeros(len(place), np.uint16), np.zeros(len(place), U64)
    for i in range(0, len(place), FLUSH):
        at = slice(i, i + FLUSH)
        own, where = np.unique(place[at], return_inverse=True)
        second = (seconds[own].astype(U64) % U64(trie.v)).astype(np.int64)[where]
        inner = trie.pairs(second, t["third"][at].astype(np.int64))
        codes[at] = code((t["n"][at] - DISCOUNT) / below[place[at]] + left[place[at]] * 10 ** (inner["code"] / -STEPS))
        value[at] = place[at].astype(U64) * U64(trie.successors) + inner["rank"].astype(U64)
    order = np.argsort(value, kind="stable")  # the parts of the middle word's successors put ranks out of order
    arrays = {"code": codes[order], "back": code(left)} | {f"child.{k}": a for k, a in encode(value[order], max(1, len(kids)) * trie.successors).items()}
    put(f"{trie.folder}/3-{g}.bin", packed(arrays))
    drop(f"{trie.folder}/t-{g}.bin")


def build(training: DataFrame, shard_words: int = SHARD_WORDS, part_tokens: int = PART_TOKENS) -> tuple[str, int, tuple[int, ...], int, tuple[int, ...], int]:
    """Count and write the trie of a table's one text column; what opens it (see opened).

    The driver gets a row per shard and per part.
    """
    spark = tuned(training.sparkSession)
    folder = new_path(spark, "trie")
    counted = written(training.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    end = int(END.astype(np.int64))
    said = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.sum(F.when(F.col("h") == end, F.col("c"))).alias("texts")).first()
    v, n = said["v"], said["n"] or 0
    if not v:
        return folder, 0, (), 0, (), 1
    bits = max(0, (-(-v // shard_words) - 1).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    shards = counted.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: _write_words(t, folder), "shard int, n long, tokens long").collect()
    sizes, tokens = {r["shard"]: r["n"] for r in shards}, {r["shard"]: r["tokens"] for r in shards}
    for s in range(1 << bits):
        if s not in sizes:  # a shard without words, as small vocabularies may have
            put(f"{folder}/1-{s}.bin", packed({"hash": np.zeros(0, U64), "count": np.zeros(0, np.int64)}))
    tokens[(1 << bits) - 1] = tokens.get((1 << bits) - 1, 0) + said["texts"]  # what follows the start
    parts = tuple(max(1, -(-tokens.get(s, 0) // part_tokens)) for s in range(1 << bits))
    known = (folder, bits, tuple(sizes.get(s, 0) for s in range(1 << bits)), n, parts)
    grams = training.mapInArrow(lambda it: _count_grams(it, opened(*known, 0)), "part int, " + ", ".join(f"{x} binary" for x in GRAMS[1:]))
    rows = grams.groupBy("part").applyInArrow(lambda t: _write_pairs(t, opened(*known, 0)), "part int, n long").collect()
    for g in set(range(sum(parts))) - {r["part"] for r in rows}:
        _write_empty(g, Trie(*known))
    successors = max(r["n"] for r in rows)
    texts = said["texts"]

    def each(work):
        def run(batches):
            for b in batches:
                for g in b.column(0).to_pylist():
                    work(g)
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["part"])

        spark.range(sum(parts)).select(F.col("id").cast("int").alias("part")).repartition(sum(parts)).mapInArrow(run, "part int").count()

    each(lambda g: _write_codes(g, opened(*known, 0), texts))
    each(lambda g: _write_triples(g, opened(*known, successors)))
    return *known, successors


def _write_empty(g: int, trie: Trie) -> None:
    """What _write_pairs leaves, for a part that no pair fell into."""
    s = trie.shard_of_part(g)
    words = int(trie.offsets[s + 1] - trie.offsets[s]) + (s == len(trie.offsets) - 2)
    none = np.zeros(0, np.int64)
    arrays = {f"child.{k}": a for k, a in encode(none, 1).items()} | {f"pointer.{k}": a for k, a in encode(np.zeros(words + 1, np.int64), 1).items()}
    put(f"{trie.folder}/2-{g}.bin", packed(arrays))
    put(f"{trie.folder}/k-{g}.bin", packed({"kinds": np.zeros(words, np.uint8)}))
    put(f"{trie.folder}/p-{g}.bin", packed({"count": none}))
    put(f"{trie.folder}/t-{g}.bin", packed({"kids": none, "sum": none, "third": none, "n": none}))


SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score_texts(trie: Trie, texts: pa.Array) -> list[np.ndarray]:
    """The columns of SCORES for a batch."""
    distinct, at, borders = token_hashes(texts)
    ids, counts = trie.words(distinct)
    known = ids >= 0
    base = np.log10(trie.word_p(counts))
    before, earlier = _contexts(ids[at], borders, trie.v)
    cost = code(trie.word_p(counts))[at].astype(np.float64)
    if trie.v:
        pair = trie.pairs(before, ids[at])
        cost = np.where(pair["found"], pair["code"], pair["back"] + cost)
        context = np.roll(pair["found"], 1) & (earlier >= 0)
        found, codes, back = trie.triples(earlier, before, np.roll(pair["place"], 1), np.where(pair["found"], pair["rank"], -1), context)
        cost = np.where(found, codes, np.where(context, back, 0) + cost)
    n = np.diff(borders)
    return [n, sums_by_text(known[at].astype(np.int64), borders), np.full(len(n), trie.n, np.int64), sums_by_text(base[at], borders), -sums_by_text(cost, borders) / STEPS]


def lm_scores(docs: DataFrame, training: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Each row with a struct of SCORES under the model of training's one text column."""
    known = build(training)
    return annotate(docs, lambda b: [pa.array(c) for c in score_texts(opened(*known), whole(b.column(b.schema.get_field_index(text_col))))], SCORES, carry, [text_col])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of six sevenths of them."""
    docs = read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    found, s = lm_scores(docs, docs.where(~held_out()).select("text"), carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), f"{s}.*")
