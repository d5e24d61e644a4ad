"""A small head on frozen text vectors: two gated residual blocks, in numpy over Arrow batches, and its training.

Block: LayerNorm(x + down(gate(x) * gelu(up(x)))). Output vectors are L2-normalised. Training is InfoNCE with in-batch
negatives and Adam with warm-up, on the driver, from a bounded sample of pairs.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import seeded
from plumbline.sources.tables import materialised

from .evaluation import macro_recall
from .splits import distractors
from .vectors import dense_topk

SCALE = 20.0
#: The published rational approximation of the error function (error below 1.5e-7).
_ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + _ERF[0] * np.abs(x))
    total = np.zeros_like(t)
    for c in reversed(_ERF[1]):
        total = (total + c) * t
    return np.sign(x) * (1 - total * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def new_head(dim: int, hidden: int | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    rng, hidden = np.random.default_rng(seed), hidden or 2 * dim
    w = {}
    for k in (1, 2):
        for name, shape in (("gate", (dim, hidden)), ("up", (dim, hidden)), ("down", (hidden, dim))):
            w[f"{name}{k}"] = rng.normal(0, shape[0] ** -0.5, shape)
        w[f"g{k}"], w[f"b{k}"] = np.ones(dim), np.zeros(dim)
    return w


def _block(w: dict, k: int, x: np.ndarray):
    up, gate = x @ w[f"up{k}"], x @ w[f"gate{k}"]
    act = gelu(up)
    y = x + (gate * act) @ w[f"down{k}"]
    centred = y - y.mean(1, keepdims=True)
    std = np.sqrt((centred**2).mean(1, keepdims=True) + 1e-5)
    return centred / std * w[f"g{k}"] + w[f"b{k}"], (x, up, gate, act, centred, std)


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Unit vectors of the head."""
    for k in (1, 2):
        x, _ = _block(w, k, x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _back(w: dict, k: int, kept, d: np.ndarray, out: dict) -> np.ndarray:
    x, up, gate, act, centred, std = kept
    z = centred / std
    out[f"g{k}"] = out.get(f"g{k}", 0) + (d * z).sum(0)
    out[f"b{k}"] = out.get(f"b{k}", 0) + d.sum(0)
    dz = d * w[f"g{k}"]
    dy = (dz - dz.mean(1, keepdims=True) - z * (dz * z).mean(1, keepdims=True)) / std
    dh = dy @ w[f"down{k}"].T
    out[f"down{k}"] = out.get(f"down{k}", 0) + (gate * act).T @ dy
    dgate = dh * act
    slope = 0.5 * (1 + erf(up / math.sqrt(2))) + up * np.exp(-(up**2) / 2) / math.sqrt(2 * math.pi)
    dup = dh * gate * slope
    out[f"gate{k}"] = out.get(f"gate{k}", 0) + x.T @ dgate
    out[f"up{k}"] = out.get(f"up{k}", 0) + x.T @ dup
    return dy + dgate @ w[f"gate{k}"].T + dup @ w[f"up{k}"].T


def info_nce(w: dict, q: np.ndarray, p: np.ndarray, scale: float = SCALE) -> tuple[float, dict]:
    """Loss of matching q[i] to p[i] among the batch, and its gradients."""
    kept, outs = [], []
    for x in (q, p):
        trace = []
        for k in (1, 2):
            x, t = _block(w, k, x)
            trace.append(t)
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept.append((trace, norm))
        outs.append(x / norm)
    s = scale * outs[0] @ outs[1].T
    s -= s.max(1, keepdims=True)
    soft = np.exp(s)
    total = soft.sum(1, keepdims=True)
    soft /= total
    n = len(q)
    loss = float((np.log(total[:, 0]) - np.diag(s)).mean())
    ds = (soft - np.eye(n)) * scale / n
    grads: dict = {}
    for (trace, norm), u, du in ((kept[0], outs[0], ds @ outs[1]), (kept[1], outs[1], ds.T @ outs[0])):
        d = (du - u * (du * u).sum(1, keepdims=True)) / norm
        for k in (2, 1):
            d = _back(w, k, trace[k - 1], d, grads)
    return loss, grads


def train(queries: np.ndarray, items: np.ndarray, measure: Callable[[dict], float] | None = None, epochs: int = 10, batch: int = 256, rate: float = 2e-4, warmup: float = 0.1, decay: float = 0.01, hidden: int | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of the best epoch by measure (the last without one); rows of both sides are pairs."""
    w, rng = new_head(queries.shape[1], hidden, seed), np.random.default_rng(seed)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    steps, t, best = epochs * -(-len(queries) // batch), 0, (-np.inf, w)
    for _ in range(epochs):
        order = rng.permutation(len(queries))
        for i in range(0, len(order), batch):
            _, g = info_nce(w, queries[order[i : i + batch]], items[order[i : i + batch]])
            t += 1
            pace = rate * min(1.0, t / max(1, warmup * steps)) * (1 - t / (steps + 1))
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w[k] = w[k] - pace * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + decay * w[k])
        if measure is not None and (got := measure(w)) > best[0]:
            best = (got, dict(w))
    return best[1] if measure is not None else w


def sampled_pairs(pairs: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, query: str, item: str, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of at most `most` pairs, the first in seeded order: what the driver collects for training."""
    drawn = pairs.select(query, item).distinct().withColumn("_h", seeded(F.concat_ws("|", F.col(query), F.col(item)), seed)).orderBy("_h", query, item).limit(most)
    rows = drawn.join(query_vectors.select(query, F.col("embedding").alias("_q")), query).join(item_vectors.select(item, F.col("embedding").alias("_i")), item).orderBy("_h").select("_q", "_i").toArrow().combine_chunks()
    side = lambda k: np.asarray(pa.concat_arrays(rows.column(k).chunks).flatten(), np.float64).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    return side(0), side(1)


def recall_of_head(weights: dict[str, np.ndarray], positives: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, others: DataFrame, query: str, item: str, k: int = 50) -> float:
    """Macro recall@k of the head's vectors, over the positives' items and the distractors (one column, the item's id)."""
    corpus = positives.select(item).unionByName(others.select(item)).distinct()
    asked = positives.select(query).distinct()
    encoded = lambda v, ids, key: apply_head(v.join(ids, key, "left_semi").select(key, "embedding"), weights).select(key, F.col("encoded").alias("embedding"))
    found = dense_topk(encoded(item_vectors, corpus, item), item, "embedding", encoded(query_vectors, asked, query), query, "embedding", k)
    hits = found.join(positives.select(query, item).distinct().withColumn("label", F.lit(1)), [query, item])
    relevant = positives.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"))
    return macro_recall(hits, relevant, query).first()["recall"] or 0.0


def train_head(train_pairs: DataFrame, valid_pairs: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, query: str = "query_id", item: str = "item_id", most: int = 100_000, n_distractors: int = 20_000, k: int = 50, seed: int = 42, **how) -> dict[str, np.ndarray]:
    """A head trained on a bounded sample of pairs; the epoch with the best recall@k of the held-out pairs among
    distractors is kept. `how` goes to train.
    """
    others = materialised(distractors(item_vectors, valid_pairs, item, n_distractors, seed), "distractors")
    q, i = sampled_pairs(train_pairs, query_vectors, item_vectors, query, item, most, seed)
    return train(q, i, lambda w: recall_of_head(w, valid_pairs, query_vectors, item_vectors, others, query, item, k), seed=seed, **how)


def apply_head(df: DataFrame, weights: dict[str, np.ndarray], vec_col: str = "embedding", out_col: str = "encoded") -> DataFrame:
    """df with the head's vectors in out_col; a null vector stays null. Weights have a fixed size and are broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in df.columns if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def work(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(vec_col))
            rows = [i for i, x in enumerate(column.is_valid().to_pylist()) if x]
            made: list = [None] * b.num_rows
            if rows:
                known = column.take(pa.array(rows))
                for i, x in zip(rows, forward(sent.value, np.asarray(known.flatten(), np.float64).reshape(len(rows), -1)), strict=True):
                    made[i] = x.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, out_col])

    return df.select(*rest).mapInArrow(work, schema)


def encode(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], out_col: str = "embedding", size: int = 64) -> DataFrame:
    """Hook for any encoder of lists of texts, applied in batches on the executors; put the encoder's prefix before the
    texts with functions.text.prefixed.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def work(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            made = [v for i in range(0, len(texts), size) for v in np.asarray(encoder(texts[i : i + size]), np.float64).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, out_col])

    return df.mapInArrow(work, schema)


def dumps(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def loads(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}
