"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text byte by byte (ASCII letters in lower case), over words, spaces, digits and punctuation alike, and
gives every position a distribution over the learned languages; a text's probabilities are the mean over the positions of
its letters. Texts are read whole, in windows of SPAN bytes side by side: each window's recurrences start WARM bytes
before and after it, so that the states at its borders know their surroundings, and every position is labelled once.

The network is trained on the driver by backpropagation through time, in numpy, for a fixed number of steps, from windows
of a bounded sample of labelled documents that gives every language its own share (documented parameters below). Null
texts and texts without a letter are `und` with score 0; so is everything if nothing is labelled. Ties go to the language
that sorts first. Each row is judged alone, so repeated rows get equal values; a very long text is many windows, which are
run in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, read_table, released, tuned, whole

#: Labelled documents and windows of a language that train the network: what the driver collects at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 1_500
#: States of each direction, bytes of a window and before and after it, and bytes of a window of the sample.
HIDDEN, SPAN, WARM, SAMPLE_SPAN = 8, 192, 16, 96
#: Windows of a step, steps, and step size of the training; windows of a block when texts are judged.
BATCH, STEPS, RATE, BLOCK = 256, 300, 0.02, 2048
#: Least score of a document that the pipeline keeps.
MIN_SCORE = 0.3
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, ASCII letters in lower case, and each text's borders among them."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]], offsets - offsets[0]


def windows(borders: np.ndarray, span: int, warm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its text, where its bytes begin and end with what goes before and after, and where its own begin."""
    size = np.diff(borders)
    parts = -(-size // span)
    text = np.repeat(np.arange(len(size)), parts)
    own = borders[text] + span * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
    return text, np.maximum(own - warm, borders[text]), np.minimum(own + span + warm, borders[text + 1]), own


def rows_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (n, longest) from begin to end, filled up by 0, and their lengths."""
    length = end - begin
    at = np.arange(int(length.max(initial=0)))
    return np.where(at < length[:, None], data[np.minimum(begin[:, None] + at, max(0, len(data) - 1))], 0), length


class BiGru:
    """Weights of both directions and of the labels, with forward pass and gradients."""

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.hidden = hidden
        self.weights = {f"x{d}": draw(256, 3 * hidden) for d in "fb"} | {f"h{d}": draw(hidden, 3 * hidden) for d in "fb"}
        self.weights |= {f"b{d}": np.zeros(3 * hidden, np.float32) for d in "fb"} | {"o": draw(2 * hidden, labels), "c": np.zeros(labels, np.float32)}

    def run(self, data: np.ndarray, length: np.ndarray, direction: str, keep: bool = False):
        """States (n, T, hidden) of one direction. Rows must come longest first, so that live rows are a prefix."""
        n, span, k = len(data), int(length[0]) if len(length) else 0, self.hidden
        table = self.weights["x" + direction] + self.weights["b" + direction]
        u = self.weights["h" + direction]
        states = np.zeros((n, span, k), np.float32)
        h, trace = np.zeros((n, k), np.float32), []
        live = np.searchsorted(-length, -np.arange(span), side="left")
        for t in range(span) if direction == "f" else range(span - 1, -1, -1):
            m = int(live[t])
            now = h[:m]
            g = table[data[:m, t]]
            a = now @ u
            gates = np.tanh((g[:, : 2 * k] + a[:, : 2 * k]) * np.float32(0.5))
            gates += 1
            gates *= np.float32(0.5)
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
            out = new + z * (now - new)
            if keep:
                trace.append((t, m, now.copy(), z, r, new, a[:, 2 * k :]))
            h[:m] = out
            states[:m, t] = out
        return (states, trace) if keep else states

    def positions(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities (T, n, labels) of every position; rows longest first. States are not kept."""
        k, half = self.hidden, np.float32(0.5)
        data = np.ascontiguousarray(data.T)
        span, n = data.shape
        live = np.searchsorted(-length, -np.arange(span), side="left")
        z = np.zeros((span, n, len(self.weights["c"])), np.float32)
        for d, part in (("f", self.weights["o"][:k]), ("b", self.weights["o"][k:])):
            table, u = self.weights["x" + d] + self.weights["b" + d], self.weights["h" + d]
            h = np.zeros((n, k), np.float32)
            for t in range(span) if d == "f" else range(span - 1, -1, -1):
                m = int(live[t])
                now = h[:m]
                g, a = table[data[t, :m]], now @ u
                gates = g[:, : 2 * k] + a[:, : 2 * k]
                gates *= half
                np.tanh(gates, out=gates)
                gates += 1
                gates *= half
                new = gates[:, k:] * a[:, 2 * k :]
                new += g[:, 2 * k :]
                np.tanh(new, out=new)
                now -= new
                now *= gates[:, :k]
                now += new
                z[t, :m] += now @ part
        z += self.weights["c"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return z

    def gradients(self, data: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean cross entropy over positions) and its gradients; rows longest first."""
        states, traces = {}, {}
        for d in "fb":
            states[d], traces[d] = self.run(data, length, d, keep=True)
        both = np.concatenate([states["f"], states["b"]], 2)
        z = both @ self.weights["o"] + self.weights["c"]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        inside = (np.arange(p.shape[1]) < length[:, None]) * weight[:, None]
        total = max(float(inside.sum()), 1e-9)
        rows = np.arange(len(data))
        loss = -float((np.log(p[rows, :, label] + 1e-12) * inside).sum()) / total
        p[rows, :, label] -= 1
        dz = p * (inside / total)[:, :, None].astype(np.float32)
        out = {"o": np.einsum("ntk,ntl->kl", both, dz), "c": dz.sum((0, 1))}
        dboth = dz @ self.weights["o"].T
        k = self.hidden
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            u = self.weights["h" + d]
            du, slopes = np.zeros_like(u), np.zeros((*data.shape, 3 * k), u.dtype)
            back = np.zeros((len(data), k), np.float32)
            for t, m, before, zt, rt, new, an in reversed(traces[d]):
                dh = back[:m] + part[:m, t]
                dnew = dh * (1 - zt) * (1 - new * new)
                da = np.concatenate([dh * (before - new) * zt * (1 - zt), dnew * an * rt * (1 - rt), dnew * rt], 1)
                slopes[:m, t, : 2 * k], slopes[:m, t, 2 * k :] = da[:, : 2 * k], dnew
                du += before.T @ da
                back[:m] = dh * zt + da @ u.T
            # the rows of each byte are summed by one product
            dx = np.zeros_like(self.weights["x" + d])
            seen, at = np.unique(data, return_inverse=True)
            dx[seen] = (np.arange(len(seen))[:, None] == at.reshape(1, -1)).astype(u.dtype) @ slopes.reshape(-1, 3 * k)
            out |= {"x" + d: dx, "h" + d: du, "b" + d: dx.sum(0)}
        return loss, out


def train(data: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray, labels: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> BiGru:
    """Adam over shuffled batches; the same sample gives the same network."""
    net, rng = BiGru(labels, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(data))
        rows, order = order[:batch], order[batch:]
        rows = rows[np.argsort(-length[rows], kind="stable")]
        _, slope = net.gradients(data[rows], length[rows], label[rows], weight[rows])
        pace = rate * (1 - 0.9 * step / steps)
        for k, g in slope.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: BiGru, texts: pa.Array, block: int = BLOCK) -> np.ndarray:
    """Mean probabilities (texts, labels) over the positions of letters; zeros where there are none."""
    data, borders = text_bytes(texts)
    text, begin, end, own = windows(borders, SPAN, WARM)
    sums, letters = np.zeros((len(texts), len(net.weights["c"]))), np.zeros(len(texts))
    order = np.argsort(begin - end, kind="stable")
    for i in range(0, len(order), block):
        rows = order[i : i + block]
        values, length = rows_of(data, begin[rows], end[rows])
        p = net.positions(values, length)
        place = begin[rows][:, None] + np.arange(values.shape[1])
        use = (_LETTER[values] & (place >= own[rows][:, None]) & (place < np.minimum(own[rows] + SPAN, end[rows])[:, None])).astype(np.float32)
        np.add.at(sums, text[rows], np.einsum("tnl,nt->nl", p, use))
        np.add.at(letters, text[rows], use.sum(1))
    return sums / np.maximum(letters, 1)[:, None]


def predict(net: BiGru | None, names: list[str], texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}")).astype(bool)
    if net is None or not len(texts):
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    mean = pooled(net, texts)
    best = mean.argmax(1)
    score = np.clip(mean[np.arange(len(best)), best], 0, 1)
    return [names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters, strict=True)], np.where(letters, score, 0.0).tolist()


def _sample_windows(batches):
    """Windows with a letter of the sampled documents of a partition."""
    for b in batches:
        data, borders = text_bytes(whole(b.column(1)))
        text, begin, end, _ = windows(borders, SAMPLE_SPAN, 0)
        inside = np.concatenate([[0], np.cumsum(_LETTER[data])])
        rows = np.flatnonzero(inside[end] > inside[begin])
        language = b.column(0).take(pa.array(text[rows]))
        yield pa.RecordBatch.from_arrays([language, pa.array([data[x:y].tobytes() for x, y in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)], pa.binary())], names=["lang", "piece"])


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> tuple[BiGru | None, list[str]]:
    """Train on usable rows with a language. The sample: of each language the documents, then the windows of smallest hash."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # twice the share that is wanted passes by its hash, so that a language's window stays small whatever its documents
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.select("lang", "id").join(sizes, "lang").where(place * F.col("rows") < 2 * sample_docs)
    by_hash = W.partitionBy("lang").orderBy(place, "id")
    chosen = few.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= sample_docs).select(F.col("id").alias("chosen"), F.col("lang").alias("chosen_lang"))
    texts = labelled.join(F.broadcast(chosen.distinct()), (F.col("id") == F.col("chosen")) & (F.col("lang") == F.col("chosen_lang"))).select("lang", "text")
    pieces = texts.mapInArrow(released(_sample_windows), "lang string, piece binary").distinct()
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    rows = pieces.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= sample_windows).select("lang", "piece").orderBy("lang", "k").toArrow()
    if not rows.num_rows:
        return None, []
    names = sorted(set(rows["lang"].to_pylist()))
    pieces = rows["piece"].to_pylist()
    size = np.array([len(x) for x in pieces])
    ends = np.cumsum(size)
    data, length = rows_of(np.frombuffer(b"".join(pieces), np.uint8), ends - size, ends)
    label = np.array([names.index(x) for x in rows["lang"].to_pylist()])
    share = np.bincount(label, minlength=len(names))
    return train(data, length, label, 1 / share[label], len(names)), names


LANGUAGE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language_id(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Each row with a struct of LANGUAGE; predictions read the text alone."""
    spark = tuned(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, usable, id_col, text_col, lang_col))

    def work(b):
        names, scores = predict(*model.value, whole(b.column(b.schema.get_field_index(text_col))))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return annotate(docs, work, LANGUAGE, carry, [text_col])


def held_out(id_col: str = "doc_id", parts: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == rest, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    found, s = language_id(docs, ~held_out(), carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), f"{s}.*")
