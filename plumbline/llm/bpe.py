"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

The merges of a rank file are compiled into a trie of token bytes and a relation "may stand side by side": tokens a, b
are compatible if merging the bytes of a b gives a, b again. A sequence of tokens is the BPE encoding of its bytes
exactly if each token is the encoding of its own bytes and each neighbouring pair is compatible. So the transducer
runs all compatible token chains at once: a hypothesis is (tokens not yet emitted, last token, place in the trie). A
state is a set of hypotheses; its successor under a byte is computed once, when first met, and kept. What all
hypotheses agree on is emitted as soon as one chain is left; the lookahead is bounded by the longest tokens.

Short pieces go through the transducer side by side, a byte of each at a time, with the moves in arrays; long ones are
streamed. Whole pieces that are tokens are emitted as such, as the rank-file libraries do. A null text is an empty one, without
ids. Repeated rows are coded each, with equal results. Very long texts are read whole: what is held beyond the ids
themselves is bounded by a text's longest piece and the memos.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import annotate, read_table, tuned, whole

#: Kept entries of each memo of a worker (states, pairs, pieces); a full one is emptied, which changes no result.
STATES, PAIRS, PIECES = 200_000, 400_000, 100_000
#: Bytes up to which a piece is short; bytes of short pieces that run side by side; characters of texts split at a time.
SHORT, RUN, GROUP = 256, 1 << 17, 1 << 20
#: Tokens that a query's streaming decoder takes at a time.
BLOCK = 2048
#: No token; and one more than the places of the trie. Both allow ranks and places below 2**24.
NONE, PLACE = (1 << 25) - 1, 1 << 24


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """BPE by its definition: merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


class Moves:
    """Numbers by key in arrays (open addressing), many at a time. Keys are not negative."""

    def __init__(self, slots: int = 1 << 12):
        self.keys, self.values, self.n = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        shift = 64 - (len(self.keys).bit_length() - 1)
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where unknown."""
        slot = self._slot(keys)
        out = self.values[slot]
        rest = np.flatnonzero(self.keys[slot] != keys)
        slot, last = slot[rest], len(self.keys) - 1
        while len(rest):
            have = self.keys[slot]
            same = have == keys[rest]
            out[rest[same]] = self.values[slot[same]]
            out[rest[have < 0]] = -1
            on = ~same & (have >= 0)
            rest, slot = rest[on], (slot[on] + 1) & last
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(1 << (4 * len(keys)).bit_length())
        self.n += len(keys)
        slot, last = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & last


class Transducer:
    """encode(piece) gives the ids of BPE; states are determinised as bytes call for them.

    A move yields the next state and the token that ends the encoding of the bytes so far (NONE: no encoding ends here).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for c in word:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                at = to
            self.token[at] = rank
        #: How the merges make a token: its two halves (unknown until asked for), itself twice if it can't be made.
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.depth = self._depths()
        self.length = np.zeros(max(self.tokens) + 1, np.int64)
        self.length[list(self.tokens)] = [len(x) for x in self.tokens.values()]
        self._restart()

    def _restart(self) -> None:
        """Forget all states. A hypothesis is last * PLACE + place; a move is (state << 25 | token), by state << 8 | byte."""
        start = (NONE * PLACE,)
        self.number = {start: 0}
        self.states = [start]
        self.moves: dict[int, int] = {}
        self.many = Moves()
        #: Bytes since the last border that the one chain of a state has, -1 where several are alive.
        self.settled = [-1]

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a single byte or what merges never make."""
        known = self.halves.get(token)
        if known is None and len(self.tokens[token]) == 1:
            known = self.halves[token] = (token, token)
        elif known is None:
            parts = merge({k: v for k in self._inner(token) if (v := self.ranks.get(k)) is not None and v != token}, self.tokens[token])
            known = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return known

    def _inner(self, token: int):
        word = self.tokens[token]
        return (word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1))

    def _sound(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        return len(self.tokens[token]) == 1 or self._split(token)[0] != token

    def _compatible(self, a: int, b: int) -> bool:
        """Do the merges leave the border between tokens a and b alone?

        Walk back through the merges along the border, latest first: a pair that stood there at some time and merges
        with a lower rank than the next merge on either side would have been merged.
        """
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known, ranks, tokens, limit = True, self.ranks, self.tokens, len(self.token) + len(self.ranks)
            while True:
                joined = ranks.get(tokens[a] + tokens[b])
                if joined is not None and joined < limit and self._split(joined) == (a, b):
                    known = False
                    break
                left, right = self._split(a)[1], self._split(b)[0]
                if left == a and right == b:
                    break
                # undo the later of the two merges; of two equal ones the right one came later
                if right == b or left != a and a > b:
                    a, limit = left, a
                else:
                    b, limit = right, b + 1
            self.pairs[key] = known
        return known

    def _move(self, state: int, c: int, keep: bool = False) -> int:
        """The move of a state under a byte. keep: forget no state, and leave it to the caller to keep the move."""
        live, ended, onward, token, pairs = [], NONE, self.next, self.token, self.pairs
        for hypothesis in self.states[state]:
            last, at = divmod(hypothesis, PLACE)
            to = onward[at].get(c)
            if to is None:
                continue
            if onward[to]:
                live.append(last * PLACE + to)
            if ended == NONE and (t := token[to]) >= 0 and self._sound(t):
                fits = last == NONE or pairs.get(last << 24 | t)
                if fits is None:
                    fits = self._compatible(last, t)
                if fits:
                    ended = t
                    live.append(t * PLACE)
        if not live:
            raise ValueError("the rank file lacks a single byte")
        live.sort()
        target = tuple(live)
        number, full = self.number.get(target), not keep and len(self.states) >= STATES
        if number is None:
            if full:
                self._restart()
            number = self.number[target] = len(self.states)
            self.states.append(target)
            self.settled.append(self.depth[target[0] % PLACE] if len(target) == 1 else -1)
        out = number << 25 | ended
        if not keep and (number < len(self.states) - 1 or not full):  # the state that this move leaves is still known
            self.moves[state << 8 | c] = out
        return out

    def _back(self, ends: list[int], start: int, stop: int) -> list[int]:
        """Tokens between two borders, followed back from the later one."""
        out: list[int] = []
        while stop > start:
            t = ends[stop - 1]
            out.append(t)
            stop -= len(self.tokens[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        return [known] if known is not None else list(self.encode_stream((piece,)))

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces that are not empty, as little-endian unsigned 32-bit integers."""
        out, i = [], 0
        while i < len(pieces):
            j, size = i + 1, len(pieces[i])
            while j < len(pieces) and size + len(pieces[j]) <= RUN:
                size += len(pieces[j])
                j += 1
            out += self._side_by_side(pieces[i:j])
            i = j
        return out

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """States are forgotten before a run only, which adds one for each of its bytes at most."""
        if len(self.states) >= STATES or self.many.n >= 2 * STATES + RUN:
            self._restart()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")  # the pieces that go on are the first ones
        begin = (np.cumsum(size) - size)[order]
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        going = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
        ends = np.empty(len(data), np.int64)
        state = np.zeros(len(pieces), np.int64)
        for step, n in enumerate(going.tolist()):
            at = begin[:n] + step
            key = state[:n] << 8 | data[at]
            to = self.many.find(key)
            unknown = np.flatnonzero(to < 0)
            if len(unknown):
                new, which = np.unique(key[unknown], return_inverse=True)
                made = np.array([self._move(k >> 8, k & 255, keep=True) for k in new.tolist()], np.int64)
                self.many.add(new, made)
                to[unknown] = made[which]
            state = to >> 25
            ends[at] = to & NONE
        # followed back from the last tokens
        row, stop, found = np.arange(len(pieces)), begin + size[order], []
        while len(row):
            token = ends[stop - 1]
            found.append((row, token))
            stop = stop - self.length[token]
            on = stop > begin[row]
            row, stop = row[on], stop[on]
        count = np.zeros(len(pieces), np.int64)
        for row, _ in found:
            count[row] += 1
        borders = np.zeros(len(pieces) + 1, np.int64)
        count[order] = count.copy()
        np.cumsum(count, out=borders[1:])
        last = borders[1:][order] - 1
        ids = np.empty(int(borders[-1]), "<u4")
        for back, (row, token) in enumerate(found):
            ids[last[row] - back] = token
        packed, cuts = ids.tobytes(), (borders * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_stream(self, pieces_of_bytes):
        """Tokens of a stream of byte strings (taken as one piece), each emitted once only one chain is left alive.

        What is not yet emitted is kept as one token for each byte; it reaches no further back than the longest token
        and the bytes that it takes to tell the chains apart.
        """
        ends: list[int] = []
        state, sent, get, settled = 0, 0, self.moves.get, self.settled
        for data in pieces_of_bytes:
            for c in data:
                to = get(state << 8 | c) or self._move(state, c)
                if settled is not self.settled:  # the states have been forgotten meanwhile
                    get, settled = self.moves.get, self.settled
                state = to >> 25
                ends.append(to & NONE)
                depth = settled[state]
                if depth >= 0 and len(ends) - depth > sent:
                    border = len(ends) - depth
                    yield from self._back(ends, sent, border)
                    del ends[:border]
        yield from self._back(ends, sent, len(ends))

    def _depths(self) -> list[int]:
        depth = [0] * len(self.next)
        for at, onward in enumerate(self.next):  # children have higher numbers than their parents
            for to in onward.values():
                depth[to] = depth[at] + 1
        return depth


NOT_ASCII = re.compile(rb"[\x80-\xff]+")


class Utf8:
    """Feed bytes in any cuts, get text; a sequence that can't go on becomes U+FFFD (one per maximal part).

    Short runs that lead from the machine's first state back to it are kept with their text.
    """

    runs: dict[bytes, str] = {}

    def __init__(self) -> None:
        self.have, self.left, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        for m in NOT_ASCII.finditer(data):  # runs of ASCII leave the machine's first state where it is
            if m.start() > at:
                if self.left:
                    out.append(self.end())
                out.append(data[at : m.start()].decode("ascii"))
            run, at = m[0], m.end()
            said = None if self.left else self.runs.get(run)
            if said is None:
                begun, first = self.left, len(out)
                self._multi(run, out)
                if not begun and not self.left and len(run) <= 16 and len(self.runs) < PIECES:
                    self.runs[run] = "".join(out[first:])
            else:
                out.append(said)
        if at < len(data):
            out += [self.end(), data[at:].decode("ascii")]
        return "".join(out)

    def _multi(self, data: bytes, out: list[str]) -> None:
        """Bytes from 0x80 on."""
        for c in data:
            if self.left:
                if self.low <= c <= self.high:
                    self.have += bytes((c,))
                    self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                    if not self.left:
                        out.append(self.have.decode())
                        self.have = b""
                    continue
                out.append(self.end())
            if 0xC2 <= c <= 0xF4:
                self.have, self.left = bytes((c,)), 1 if c < 0xE0 else 2 if c < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(c, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(c, 0xBF)
            else:
                out.append("�")

    def end(self) -> str:
        """What an unfinished sequence becomes; the machine is in its first state again."""
        left, self.left, self.have, self.low, self.high = self.left, 0, b"", 0x80, 0xBF
        return "�" if left else ""


class Codec:
    """Texts to ids and back, with a memo of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.fst, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decoded: dict[int, bytes] = self.fst.tokens

    def _learn(self, new: set[str]) -> None:
        """Put pieces into the memo."""
        ranks, short = self.fst.ranks, {}
        for p in new:
            out = self.older.get(p)
            if out is None:
                data = p.encode()
                rank = ranks.get(data)
                if rank is None and len(data) <= SHORT:
                    short[p] = data
                    continue
                ids = self.fst.encode(data) if rank is None else [rank]
                out = struct.pack(f"<{len(ids)}I", *ids)
            self.pieces[p] = out
        self.pieces.update(zip(short, self.fst.encode_many(list(short.values())), strict=True))

    def _joined(self, groups: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces, all of which stay in the memo meanwhile."""
        if len(self.pieces) >= PIECES:
            self.pieces, self.older = {}, self.pieces
        self._learn(set().union(*groups) - self.pieces.keys())
        return [b"".join(map(self.pieces.__getitem__, found)) for found in groups]

    def pack(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts are taken together up to GROUP characters,
        longer ones in blocks of pieces.
        """
        out: list[bytes] = []
        while len(out) < len(texts):
            if len(texts[len(out)]) > GROUP:
                pieces, parts = (m[0] for m in self.pattern.finditer(texts[len(out)])), []
                while block := list(islice(pieces, GROUP >> 2)):
                    parts += self._joined([block])
                out.append(b"".join(parts))
                continue
            group, size = [], 0
            for t in islice(texts, len(out), None):
                size += len(t)
                if size > GROUP:
                    break
                group.append(self.pattern.findall(t))
            out += self._joined(group)
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.pack([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids))

    def decode_stream(self, ids, block: int = 1):
        """Text as it becomes known, a block of tokens at a time."""
        machine = Utf8()
        for i in range(0, len(ids), block):
            if said := machine.feed(self.decode_bytes(ids[i : i + block])):
                yield said
        if said := machine.end():
            yield said


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path), pattern)
    return _CODECS[key]


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """ids of every text (null: none), as a struct with one array column."""
    tuned(docs.sparkSession)

    def work(b):
        c = codec(path, pattern)
        packed = c.pack(whole(b.column(b.schema.get_field_index(text_col))).to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))]

    return annotate(docs, work, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), carry, [text_col])


def decode_column(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Text of every list of ids; null stays null, bytes that are no UTF-8 become U+FFFD."""
    tuned(docs.sparkSession)

    def work(b):
        c = codec(path, pattern)
        return [pa.array([None if ids is None else "".join(c.decode_stream(ids)) for ids in b.column(b.schema.get_field_index(ids_col)).to_pylist()], pa.string())]

    return annotate(docs, work, T.StructType([T.StructField("text", T.StringType())]), carry, [ids_col])


ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Counts and digests of each text's ids and of the UTF-8 of the text that the streaming decoder makes of them."""
    tuned(docs.sparkSession)

    def work(b):
        c = codec(path, pattern)
        n, a, d = [], [], []
        for packed in c.pack(whole(b.column(b.schema.get_field_index(text_col))).to_pylist()):
            n.append(len(packed) // 4)
            a.append(hashlib.sha256(packed).hexdigest())
            decoded = hashlib.sha256()
            for said in c.decode_stream(np.frombuffer(packed, "<u4").tolist(), BLOCK):
                decoded.update(said.encode())
            d.append(decoded.hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]

    return annotate(docs, work, ROUND_TRIP, carry, [text_col])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public multilingual rank file. A null text is an empty one."""
    import public_tokenizers as P

    found, s = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, carry=["doc_id"])
    return found.select("doc_id", f"{s}.*")
