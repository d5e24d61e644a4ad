"""Shared pieces of the text operators: shared folders, Arrow word columns, vectorised 64-bit hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers for the word places of an n-gram; any odd values serve.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
#: Rows and bytes of one Arrow batch sent to a Python worker: what bounds the worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, so that very long texts cannot fill a worker.

    The settings stay in the session: a plan is made, and reads them, when the caller runs it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, with its file system's name, so that workers resolve it
    as Spark does. Unset, it is a folder of our own in local mode (tests) and an error on a cluster, whose executors
    share no local folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    p = sc._jvm.org.apache.hadoop.fs.Path(where)
    where = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            forget(spark, path)
        except Exception:  # the session has gone before; nothing can be deleted through it
            return

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: Tabulation: a random 64-bit word for each byte value at each of SPOTS places, from splitmix64.
SPOTS = 64
with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 256 * SPOTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string's UTF-8: the sum of its bytes' table words (longer strings go through the table again,
    multiplied by another odd number), mixed with the length. All strings at once, without Python objects.
    """
    values = values.cast(pa.large_binary())
    n = len(values)
    if not n or values.buffers()[2] is None:
        return mix(np.zeros(n, U64))
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    with np.errstate(over="ignore"):
        words = _TABLE[(place % SPOTS) * 256 + data]
        if len(place) and place.max() >= SPOTS:
            words = words * (mix((place // SPOTS).astype(U64)) | U64(1))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(words, dtype=U64)])
        at = offsets - offsets[0]
        return mix(total[at[1:]] - total[at[:-1]] + size.astype(U64) * PLACES[1])


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array of strings, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.string()), "")


@dataclass
class Words:
    """The words of a batch: text i has ids[offsets[i]:offsets[i+1]], places in dictionary."""

    offsets: np.ndarray
    ids: np.ndarray
    dictionary: pa.Array

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def split_words(texts: pa.Array) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each text, as dictionary places (all in Arrow's C++)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids, dictionary = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    empty = np.flatnonzero(np.asarray(pc.equal(dictionary, "")))
    offsets = offsets - offsets[0]
    if len(empty):
        keep = ids != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
    return Words(offsets, ids, dictionary)


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hash of each window of n word hashes; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        total = h[: len(h) - n + 1] * PLACES[0]
        for i in range(1, n):
            total = total + h[i : len(h) - n + 1 + i] * PLACES[i % 8]
    return mix(total)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Give memory that is free in this process back to the system. Python workers live on from stage to stage, and what
    one operator has freed would count beside what the next one holds.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work: Callable) -> Callable:
    """work, a generator over a task's batches, that releases free memory when the task is done."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def annotate(docs: DataFrame, fn, schema, carry: list[str] | None = None, uses: list[str] | None = None) -> tuple[DataFrame, str]:
    """Add to each row a struct that fn computes from Arrow batches, in one pass and without a shuffle.

    fn(batch) -> arrays, one for each field of schema. carry: columns kept (None: all). uses: further columns that
    fn reads. Returns the table and the struct's name, which clashes with no column.
    """
    from pyspark.sql import types as T

    carry = docs.columns if carry is None else carry
    name = fresh(docs.columns, "found")
    chosen = list(dict.fromkeys([*carry, *(uses or [])]))
    out = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, schema)])
    names, n = schema.fieldNames(), len(carry)

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.StructArray.from_arrays(fn(b), names)], names=[*b.schema.names[:n], name])

    return docs.select(*chosen).mapInArrow(released(work), out), name


def sized_ids(ids: DataFrame, bound: int) -> tuple[DataFrame, bool]:
    """Distinct non-null values of ids' one column, and whether they are few enough to be broadcast (counted, not guessed)."""
    c = ids.columns[0]
    ids = ids.where(ids[c].isNotNull()).distinct()
    return ids, ids.limit(bound + 1).count() <= bound


#: Rows of one key beyond which it is hot, and how many keys can be hot at most.
SPREAD, HOT_KEYS = 256, 10_000


def hot_keys(counts: DataFrame, keys: list[str], count: str = "size", total: int | None = None) -> DataFrame:
    """(keys, copies) of the hot keys among counts: those with more than SPREAD rows and more than 1 in HOT_KEYS of all.

    So there are HOT_KEYS of them at most, whatever the table, and a broadcast of them is bounded.
    """
    if total is None:
        total = counts.agg(F.sum(count)).first()[0] or 0
    most = max(SPREAD, total // HOT_KEYS)
    return counts.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("copies"))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many joined to one (unique by keys): rows of a hot key are dealt by another column to several copies of its row."""
    copies = F.coalesce("copies", F.lit(1))
    hot = F.broadcast(hot)
    left = many.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("copies")
    right = one.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return left.join(right, [*keys, "salt"], how).drop("salt")
