"""Sources and sinks: tables by name, vectors, materialised steps, answer files and parameter files.

Everything goes through Spark's own file systems, so paths may be on any store that the cluster reads.
"""

from __future__ import annotations

import atexit
import json
import ntpath
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a pool that hold flags or a few channels.
NARROW = {"n_channels", "filter_ok", "location_match", "in_geo", "query_loc_has_items", "search_category_is0", "has_filter", "item_phone_hidden", "item_message_forbidden", "rating_ok", "tok_mc_is_top", "label"}


def read(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to the columns that are asked for and exist."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_vectors(spark: SparkSession, path: str, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Vectors keyed by id; says what is missing where there are none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no vectors at {path}: write (id, embedding) rows there first")
    return spark.read.parquet(path).select(id_col, vec_col)


def id_column(df: DataFrame, names: tuple[str, ...] = ("query_uid", "query_id")) -> str:
    """The id column that a table of queries has."""
    found = [c for c in names if c in df.columns]
    if not found:
        raise KeyError(f"none of {names} in {df.columns}")
    return found[0]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Unset, it is a folder of our own in local mode (tests) and an
    error on a cluster.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: steps are written to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a step that later steps read several times, and read it back; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has gone before; nothing can be deleted through it
            return

    atexit.register(drop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written only if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats; ranks as 16-bit and flags and channel counts as 8-bit whole numbers."""
    def kind(name: str, now: str) -> str:
        if now == "double":
            return "float"
        if now == "int" and name.startswith("rank_"):
            return "smallint"
        return "tinyint" if now == "int" and name in NARROW else now

    return df.select(*[F.col(c).cast(kind(c, t)).alias(c) if kind(c, t) != t else F.col(c) for c, t in df.dtypes])


def write_pool(df: DataFrame, path: str) -> None:
    """A pool with its features narrowed."""
    narrowed(df).write.mode("overwrite").parquet(path)


def append_pool(batches: Iterable[DataFrame], path: str) -> int:
    """Pools of one batch of queries after the other, in one table with the first one's columns; how many there were."""
    names, n = None, 0
    for n, df in enumerate(batches, 1):  # noqa: B007
        names = names or df.columns
        narrowed(df.select(*names)).write.mode("overwrite" if n == 1 else "append").parquet(path)
    return n


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str = "embedding") -> None:
    """Vectors by id, as single-precision arrays."""
    df.select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col)).write.mode("overwrite").parquet(path)


def write_npy(df: DataFrame, path: str, id_col: str, vec_col: str = "embedding", most: int = 1_000_000) -> None:
    """A matrix file for numpy, rows in order of id; at most `most` rows, else an error (write_vectors has no bound)."""
    import io

    import numpy as np

    rows = df.select(id_col, vec_col).orderBy(id_col).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} vectors; write them with write_vectors")
    flat = np.concatenate([np.zeros(0, np.float32), *(np.asarray(c.flatten(), np.float32) for c in rows[vec_col].chunks)])
    out = io.BytesIO()
    np.save(out, flat.reshape(rows.num_rows, -1) if rows.num_rows else flat.reshape(0, 0))
    write_bytes(df.sparkSession, path, out.getvalue())


def write_answers(answers: DataFrame, path: str) -> None:
    """query_id and space-joined items, as CSV with a header."""
    answers.select(F.col("query_id").cast("string"), "answer").write.mode("overwrite").option("header", True).csv(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, whole, through Spark's file systems."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report for spreadsheet programs: one CSV file in UTF-8 with a byte order mark; at most `most` rows, else an error."""
    import csv
    import io

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it with write.csv")
    out = io.StringIO()
    sheet = csv.writer(out)
    sheet.writerow(df.columns)
    sheet.writerows(rows)
    write_text(df.sparkSession, path, "﻿" + out.getvalue())


def save_params(spark: SparkSession, path: str, params: dict) -> None:
    write_text(spark, path, json.dumps(params, ensure_ascii=False, indent=1))


def load_params(spark: SparkSession, path: str) -> dict:
    """Selection parameters; the neutral ones where there is no file."""
    text = read_text(spark, path)
    return json.loads(text) if text else {"quotas": {}, "hard": [], "diversity": {}}


def save_ensemble(spark: SparkSession, path: str, models: dict[str, str], weights: dict[str, float], features: list[str], rrf_k: int = 60) -> None:
    save_params(spark, path, {"models": [{"name": n, "file": f} for n, f in models.items()], "weights": weights, "features": features, "rrf_k": rrf_k})


def load_ensemble(spark: SparkSession, path: str) -> dict:
    """An ensemble's description; older ones name a model by its path."""
    found = json.loads(read_text(spark, path) or "{}")
    for m in found.get("models", []):
        if "file" not in m:
            m["file"] = ntpath.basename(m.get("path", ""))  # splits at both kinds of slashes
    return found
