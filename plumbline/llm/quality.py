"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are runs of characters other than ASCII white space. Each text's word unigrams and bigrams fall into a fixed
number of hash buckets. Two multinomials over the buckets are counted over all documents: the raw one from every
document, the target one from every trusted document, shrunk towards the raw one by a fixed pseudo-count. A text's
score is the mean over its n-grams of log(target / raw); a text is kept if no base rule fails and its score is at
least a fixed threshold, so every document gets the same verdict whatever else is in its partition.

Null and empty texts: zero counts, score 0, base_failed (under min_words) and not kept. Repeated rows: each is judged
alone. Without trusted documents both multinomials agree, every score is 0 and the base rules alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, annotate, hash_strings, mix, ngram_hashes, read_table, released, sized_ids, split_words, sums_by_text, tuned, whole

#: log2 of the number of buckets: what the counts that reach the driver and the broadcast model are bounded by.
BITS = 16
#: Pseudo-count with which the target multinomial leans on the raw one.
LEAN = float(1 << 18)
#: Least score (nats an n-gram) of a kept text.
THRESHOLD = -0.15
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Trusted ids up to this many are broadcast; beyond, the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

RULES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def buckets(words, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and of every bigram within a text."""
    h, text = hashes[words.ids], words.text_of()
    shift = U64(64 - bits)
    inside = text[1:] == text[:-1]
    two = (ngram_hashes(h, 2) >> shift)[inside]
    return np.concatenate([h >> shift, two]).astype(np.int64), np.concatenate([text, text[1:][inside]])


def _counts(batches, bits: int):
    """One row per bucket that a partition saw: how often in all its documents and in the trusted ones."""
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for b in batches:
        words = split_words(whole(b.column(0)))
        where, text = buckets(words, mix(hash_strings(words.dictionary)), bits)
        trusted = np.asarray(pc.fill_null(b.column(1), False)).astype(bool)
        raw += np.bincount(where, minlength=1 << bits)
        target += np.bincount(where[trusted[text]], minlength=1 << bits)
    seen = np.flatnonzero(raw)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, lean: float = LEAN) -> np.ndarray:
    """log(target / raw) of each bucket. trusted: one column of ids; every trusted document counts.

    What reaches the driver is a row per bucket, 2**bits at most, whatever the corpus.
    """
    ids, few = sized_ids(trusted.select(F.col(trusted.columns[0]).alias("trusted_id")), BROADCAST_IDS)
    right = F.broadcast(ids) if few else ids
    marked = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(right, F.col("i") == F.col("trusted_id"), "left")
    counted = marked.select("t", F.col("trusted_id").isNotNull().alias("k")).mapInArrow(released(lambda it: _counts(it, bits)), "bucket int, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    where = np.asarray(rows["bucket"])
    raw[where], target[where] = np.asarray(rows["raw"]), np.asarray(rows["target"])
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + lean * p) / (target.sum() + lean)) - np.log(p)


def repeated_words(hashes: np.ndarray, words, window: int = 3) -> np.ndarray:
    """Per text, the words inside windows that the text has twice or more."""
    n, text = len(words.ids), words.text_of()
    marked = np.zeros(n + window, np.int64)
    if n >= window:
        inside = text[window - 1 :] == text[: n - window + 1]
        with np.errstate(over="ignore"):
            keys = mix(ngram_hashes(hashes[words.ids], window) + mix(text[: n - window + 1].astype(U64) + U64(1)))
        ordered = np.sort(keys[inside])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            start = np.flatnonzero(inside & (twice[at] == keys))
            for k in range(window):
                marked[start + k] = 1
    return sums_by_text(marked[:n], words.offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(texts, "\n")
    coded = lists.flatten().dictionary_encode()
    ids, offsets = np.asarray(coded.indices).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    has_word = np.asarray(pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "")).astype(bool)
    use = has_word[ids] if len(ids) else np.zeros(0, bool)
    distinct = np.unique(text[use] * max(1, len(has_word)) + ids[use]) // max(1, len(has_word))
    return np.bincount(text[use], minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def symbols(texts: pa.Array) -> np.ndarray:
    """Per text, its characters among the symbols (all ASCII, so bytes serve)."""
    large = texts.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    flags = SYMBOLS[np.frombuffer(data, np.uint8)] if data else np.zeros(0, bool)
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offsets))


def judge(texts: pa.Array, ratio: np.ndarray, threshold: float, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED_PERCENT) -> list[np.ndarray]:
    """The columns of RULES for a batch of texts."""
    words = split_words(texts)
    hashes = mix(hash_strings(words.dictionary))
    n = np.diff(words.offsets)
    length = np.asarray(pc.utf8_length(words.dictionary)).astype(np.int64)
    chars = sums_by_text(length[words.ids] if len(words.ids) else np.zeros(0, np.int64), words.offsets)
    again = repeated_words(hashes, words)
    where, text = buckets(words, hashes, int(np.log2(len(ratio))))
    total = np.bincount(text, weights=ratio[where], minlength=len(texts))
    score = total / np.maximum(np.bincount(text, minlength=len(texts)), 1)
    failed = (n < min_words) | (100 * again > max_repeated * n)
    return [n, chars, symbols(texts), repeated_lines(texts), again, failed, ~failed & (score >= threshold), score]


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, bits: int = BITS, lean: float = LEAN, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """docs' columns and a struct of RULES for every row, and that struct's name."""
    spark = tuned(docs.sparkSession)
    ratio = spark.sparkContext.broadcast(fit(docs, trusted, id_col, text_col, bits, lean))
    k = len(docs.columns if carry is None else carry)

    def work(b):
        at = b.schema.names.index(text_col) if text_col in b.schema.names[:k] else k
        return [pa.array(x) for x in judge(whole(b.column(at)), ratio.value, threshold)]

    return annotate(docs, work, RULES, carry, [text_col])


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that labels call good."""
    return read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and the n-gram verdict of every document."""
    found, s = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", f"{s}.*")
