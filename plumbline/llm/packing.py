"""Best-fit packing by bin completion.

Documents become token pieces of at most `limit` tokens (only longer ones are cut). Pieces are dealt to groups of a
bounded number of pieces by a hash of their row, so that no key can gather in one task, and each group is packed by
itself: best-fit decreasing gives the incumbent, a lower bound tells whether it is optimal, and if not branch and
bound completes one bin at a time around the largest piece left, with undominated fillings only, the fullest first,
pruned by the waste that the incumbent allows. Fillings are enumerated lazily and none is left out; the search opens
nodes for two whole solutions and `nodes` more (None: until the result is proved), and fillings that are looked at
without opening a node are paid for as well, so a group's time is bounded too. Every piece is packed in any case.

A null or empty text is one piece, the end token alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, read_table, release, released, split_words, tuned, whole, written

LIMIT, END = 2048, 0
#: Pieces of one group (on average), and nodes that branch and bound may open beyond two whole solutions.
GROUP, NODES = 16_384, 1_000
#: Small steps (branches of a walk) that take about as long as opening a node does, and those of comparing two fillings.
STEPS, COMPARE = 300, 10


class Effort:
    """What a search may still spend, in small steps (None: without end)."""

    def __init__(self, left: int | None = None):
        self.left = left

    def spend(self, steps: int = 1) -> bool:
        """Pay for steps; False once all is spent."""
        if self.left is None:
            return True
        self.left -= steps
        return self.left > 0


def counted(sizes: list[int], limit: int) -> np.ndarray:
    return np.bincount(np.asarray(sizes, np.int64), minlength=limit + 1)


def bound(counts: np.ndarray, limit: int) -> int:
    """Lower bound of the bins for counts by size: the fuller of the sum's and Martello and Toth's L2."""
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * np.arange(limit + 1))])
    half = limit // 2
    k = np.flatnonzero(counts[: half + 1])
    large = n[-1] - n[limit - k + 1]
    middle = n[limit - k + 1] - n[half + 1]
    room = middle * limit - (total[limit - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    best = np.concatenate([[-(-total[-1] // limit), n[-1] - n[half + 1]], large + middle + np.maximum(0, -(-(small - room) // limit))])
    return int(best.max())


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing; open bins by room, found by the lowest set bit of a whole number."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for s in sorted(sizes, reverse=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(s)
        open_bins[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def dominated(filling: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Can the pieces of filling be placed inside the pieces of other? Then other is as good (a greedy test)."""
    rooms = sorted(other)
    for s in sorted(filling, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            return False
        rooms[at] -= s
        rooms.sort()
    return True


def _sums(sizes: list[int], counts: np.ndarray, total: int) -> list[int]:
    """For each place of descending sizes, the sums up to total that the sizes from there on can make, as set bits."""
    full, reach = (1 << (total + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, left, step = reach[-1], min(int(counts[s]), total // s), 1
        while left > 0:  # 1, 2, 4, ... and the rest: every number of copies is a sum of these
            take = min(step, left)
            bits |= (bits << (take * s)) & full
            left, step = left - take, 2 * step
        reach.append(bits)
    return reach[::-1]


def exact_sums(counts: np.ndarray, low: int, total: int, effort: Effort):
    """Every multiset of pieces larger than low whose sum is total, once each; few large pieces come first.

    Lazy: one and two pieces are looked up, more are searched for along the sums that can be reached. It ends early when
    the effort is spent.
    """
    if not total:
        yield ()
        return
    if total > low and counts[total]:
        yield (total,)
    there = counts[: total + 1] > 0
    there[: low + 1] = False
    for a in np.flatnonzero(there & there[::-1])[::-1].tolist():
        if 2 * a > total or 2 * a == total and counts[a] > 1:
            yield (a, total - a)
        elif 2 * a < total:
            break
    sizes = np.flatnonzero(there)[::-1].tolist()
    if not sizes or 3 * sizes[-1] > total:
        return
    reach = _sums(sizes, counts, total)

    def walk(i: int, left: int, chosen: tuple[int, ...]):
        if not left:
            if len(chosen) > 2:
                yield chosen
            return
        while reach[i] >> left & 1 and effort.spend():
            s = sizes[i]
            i += 1
            for n in range(min(int(counts[s]), left // s), 0, -1):
                if reach[i] >> (left - n * s) & 1:
                    yield from walk(i, left - n * s, chosen + (s,) * n)

    yield from walk(0, total, ())


def fillings(counts: np.ndarray, room: int, most: int | None = None, effort: Effort | None = None):
    """Maximal multisets of pieces within room that leave `most` of it at most (None: all of them), the fullest first and
    each made when it is asked for, until the effort (None: without end) is spent.

    A filling that leaves some room holds every piece that would still fit there: those are set, and the others make up
    the rest of its sum exactly.
    """
    if counts[room]:
        yield (room,)  # an exact fit by one piece dominates every other filling
        return
    effort = effort or Effort()
    forced: list[int] = []
    rest, one = room, False
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    reach = None
    for spare in range((room if most is None else min(room, most)) + 1):
        if spare and counts[spare]:
            forced += [spare] * int(counts[spare])
            rest -= spare * int(counts[spare])
        if rest < spare or not effort.spend():
            return
        if spare and reach is None:
            reach = _sums(sizes, counts, room)[0]
        if spare and not reach >> (room - spare) & 1:
            continue
        if spare and not effort.spend(STEPS):
            return
        for f in exact_sums(counts, spare, rest - spare, effort):
            if len(f) == 1 and not forced:
                if one:
                    continue  # the larger piece that came first dominates it
                one = True
                if 2 * sizes[-1] > room:
                    yield f
                    return
            yield (*f, *forced)


def pack(sizes: list[int], limit: int = LIMIT, nodes: int | None = NODES) -> list[list[int]]:
    """Bins of sizes: best-fit decreasing, improved by bin completion.

    nodes: how many nodes the search may open beyond two whole solutions, or small steps worth as much; None searches
    until the bins are proved to be the fewest.
    """
    incumbent = best_fit(sizes, limit)
    counts = counted(sizes, limit)
    least, total = bound(counts, limit), sum(sizes)
    effort = Effort(None if nodes is None else STEPS * (nodes + 2 * len(incumbent)))
    stack: list[list[int]] = []

    def allowed() -> int:
        return (len(incumbent) - 1) * limit - total

    def search(largest: int, remaining: int, waste: int):
        """A generator for each node, so that the depth is bounded by the list of generators and not by recursion."""
        nonlocal incumbent
        if not remaining:
            if len(stack) < len(incumbent):
                incumbent = [list(b) for b in stack]
            return
        while not counts[largest]:
            largest -= 1
        counts[largest] -= 1
        tried: list[tuple[int, ...]] = []
        for f in fillings(counts, limit - largest, allowed() - waste, effort):
            lost = limit - largest - sum(f)
            if waste + lost > allowed():
                break  # the fullest comes first
            if not effort.spend(COMPARE * len(tried)):
                break
            if any(dominated(f, t) for t in tried):
                continue
            tried.append(f)
            for s in f:
                counts[s] -= 1
            stack.append([largest, *f])
            yield largest, remaining - 1 - len(f), waste + lost
            stack.pop()
            for s in f:
                counts[s] += 1
        counts[largest] += 1

    if len(incumbent) > least:
        open_nodes = [search(limit, len(sizes), 0)]
        while open_nodes and effort.spend(STEPS) and len(incumbent) > least:
            step = next(open_nodes[-1], None)
            if step is None:
                open_nodes.pop()
            else:
                open_nodes.append(search(*step))
    return incumbent


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """One tokenizer per worker; special tokens' strings in a text are ordinary text."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


#: Fixed values of the vocabulary file: how it normalises a text, and what it cuts it into. With a line's end added.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pretokens of one string that the tokenizer is given.
CHUNK = 2000
#: Pretokens, and characters of them, that a worker knows before it starts anew.
KNOWN, KNOWN_CHARACTERS = 400_000, 8_000_000


def cuts_into_words(path: str) -> bool:
    """Does the file normalise and cut as WordCoder does? Others are given whole texts."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = (said.get("normalizer") or {}).get("normalizers", [])
    cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == NORMALIZERS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0] == {"type": "Split", "pattern": {"Regex": PRETOKENS}, "behavior": "Removed", "invert": True}
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    )


class WordCoder:
    """Ids of words. Words are normalised and cut here; distinct pretokens are encoded in long strings, and known from
    then on to the batches that follow, up to a number of pretokens and of their characters.

    Only the last id of a pretoken ends a word in this vocabulary, so the ids of a string of pretokens fall apart by
    themselves. A string whose ids do not fall into as many parts is encoded pretoken by pretoken.
    """

    def __init__(self, path: str):
        import regex

        self.coder, self.cut = tokenizer(path), regex.compile(PRETOKENS + r"|\n")
        self.by_word = cuts_into_words(path)
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Start anew with the line's end, which is no pretoken and has no ids."""
        self.place, self.characters = {"\n": 0}, 0
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _flat(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each pretoken has."""
        chunks = [pretokens[i : i + CHUNK] for i in range(0, len(pretokens), CHUNK)]
        flat, size = [], []
        for chunk, coded in zip(chunks, self.coder.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(chunk) or stops[-1] != len(ids):
                each = [e.ids for e in self.coder.encode_batch_fast(chunk, add_special_tokens=False)]
                ids, stops = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            flat.append(ids)
            size.append(np.diff(stops, prepend=0))
        return (np.concatenate(flat), np.concatenate(size)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (free of white space of ASCII), and how many each word has."""
        joined = "\n".join(words)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        found = self.cut.findall(joined.lower())
        if len(self.place) > KNOWN or self.characters > KNOWN_CHARACTERS or len(self.place) != len(self.size):  # the last: a batch broke off
            self.forget()
        place, before = self.place, len(self.place)
        at = np.fromiter((place.setdefault(p, len(place)) for p in found), np.int64, len(found))
        new = list(islice(place, before, None))
        self.characters += sum(map(len, new))
        flat, size = self._flat(new)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        line = at == 0
        word, at = np.cumsum(line)[~line], at[~line]
        ids, stops = gather(self.flat, self.size, at)
        return ids, np.bincount(word, weights=np.diff(stops), minlength=len(words)).astype(np.int64)


def gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat numbered by at, one after the other, and their borders."""
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    each = size[at]
    stops = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    return flat[np.repeat(first[at] - stops[:-1], each) + np.arange(stops[-1])], stops


_CODERS: dict[str, WordCoder] = {}


def encode_words(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and each text's end among them.

    Where the file drops white space before it merges (its own description is compared), a text's ids are those of its
    words, and each distinct word of the batch is encoded once; other files get whole texts.
    """
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    coder = _CODERS[path]
    if not coder.by_word:
        each = [np.array(e.ids, np.uint32) for e in coder.coder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    words = split_words(texts)
    if not len(words.ids):
        return np.zeros(0, np.uint32), np.zeros(len(words.offsets), np.int64)
    flat, size = coder.encode(words.dictionary.to_pylist())
    ids, stops = gather(flat, size, words.ids)
    return ids, stops[words.offsets]


PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("spread", T.LongType())]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document; spread: a hash of the row's place, equal for no two rows of a task."""

    def work(batches):
        task, row = TaskContext.get(), 0
        part = task.partitionId() if task else 0
        for b in batches:
            ids, border = encode_words(path, whole(b.column(1)))
            columns: list[list[int]] = [[], [], [], [], []]
            for i in range(b.num_rows):
                mine = np.append(ids[border[i] : border[i + 1]], np.uint32(end)).astype("<u4")
                for p in range(-(-len(mine) // limit)):
                    cut = mine[p * limit : (p + 1) * limit]
                    for column, value in zip(columns, (i, p, p * limit, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        column.append(value)
            n = len(columns[0])
            spread = mix(np.arange(row, row + n, dtype=np.uint64) + (np.uint64(part) << np.uint64(40))) >> np.uint64(1)
            row += n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]), pa.array(spread.astype(np.int64))], names=["doc_id", *(f.name for f in PIECES)])

    tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(work), T.StructType([source.schema["doc_id"], *PIECES]))


def pack_group(table: pa.Table, limit: int, nodes: int | None) -> pa.Table:
    """Sequence and offset of each piece of one group; equal sizes are dealt in order of document and piece."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("spread", "ascending")])
    length = np.asarray(table["length"]).tolist()
    places: dict[int, list[tuple[int, int]]] = {}
    for k, content in enumerate(pack(length, limit, nodes)):
        at = 0
        for s in content:
            places.setdefault(s, []).append((k, at))
            at += s
    for p in places.values():
        p.reverse()
    dealt = [places[s].pop() for s in length]
    del places
    release()
    group = table["group"][0].as_py()
    out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return out.append_column("sequence_id", pa.array([(group << 32) + k for k, _ in dealt], pa.int64())).append_column("offset", pa.array([at for _, at in dealt], pa.int64()))


def best_fit_packing(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, group: int = GROUP, nodes: int | None = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset. Pieces (without ids) are written to the shared folder to be counted."""
    found = written(pieces(docs, path, limit, end, id_col, text_col), "pieces")
    groups = max(1, -(-found.count() // group))
    schema = T.StructType([found.schema["doc_id"], *PIECES[:4], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return found.withColumn("group", F.col("spread") % groups).groupBy("group").applyInArrow(lambda t: pack_group(t, limit, nodes), schema)


def vocabulary() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    return best_fit_packing(read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), vocabulary())
