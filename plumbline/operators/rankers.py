"""Learning to rank on the pool: pointwise gradient boosting, and pairwise boosting with NDCG-weighted lambdas.

Trees are pyspark.ml's. Missing features get a value below all others and a flag, since these trees have no branch for
them. Lambdas are computed per query in Arrow groups, from the pairs that have one row among the first `top`, so time and
memory grow with a query's rows and not with their square. Scores are checkpointed between rounds.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.tables import read_text, shared_dir, write_text

from .ranking import rank_within
from .splits import with_positive

#: Stands for a missing feature; features are above it.
MISSING = -1e6
#: Pairs of rows of a query that are weighted at a time.
PAIRS = 1_000_000


def feature_columns(df: DataFrame, other: tuple[str, ...] = ("query_id", "item_id", "microcat", "label", "split", "score")) -> list[str]:
    """All columns but ids and labels."""
    return [c for c in df.columns if c not in other]


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Features and their missing flags as one vector."""
    values = {f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in features}
    return VectorAssembler(inputCols=list(values), outputCol=out).transform(df.withColumns(values)).drop(*values)


@dataclass
class Ranker:
    """A trained model: predict adds `score`."""

    kind: str
    features: list[str]
    trees: list = field(default_factory=list)
    rate: float = 0.1
    pipeline: PipelineModel | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        ready = assembled(df, self.features)
        if self.pipeline is not None:
            scored = self.pipeline.transform(ready)
            return scored.withColumn("score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")
        for k, tree in enumerate(self.trees):
            ready = tree.copy().setPredictionCol(f"_t{k}").transform(ready)
        total = sum((F.col(f"_t{k}") * self.rate for k in range(len(self.trees))), F.lit(0.0))
        return ready.withColumn("score", F.round(total, 9)).drop("features", *[f"_t{k}" for k in range(len(self.trees))])

    @property
    def n_iter(self) -> int:
        return self.pipeline.stages[-1].getNumTrees if self.pipeline is not None else len(self.trees)

    def importance(self) -> dict[str, float]:
        """Gain of each feature, its missing flag included, as a share."""
        models = [self.pipeline.stages[-1]] if self.pipeline is not None else self.trees
        total = np.sum([m.featureImportances.toArray() for m in models], 0)
        n = len(self.features)
        both = total[:n] + total[n:]
        return dict(zip(self.features, (both / max(both.sum(), 1e-12)).tolist(), strict=True))

    def save(self, path: str, spark: SparkSession) -> None:
        """The model and, beside it, what describes it."""
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/{self.kind}")
        for k, t in enumerate(self.trees):
            t.write().overwrite().save(f"{path}/{self.kind}/{k}")
        said = {"kind": self.kind, "features": self.features, "trees": len(self.trees), "rate": self.rate}
        write_text(spark, f"{path}/{self.kind}.json", json.dumps(said))

    @staticmethod
    def load(path: str, kind: str, spark: SparkSession) -> Ranker:
        said = json.loads(read_text(spark, f"{path}/{kind}.json") or "{}")
        if not said:
            raise FileNotFoundError(f"no {kind} ranker at {path}")
        if said["trees"] == 0:
            return Ranker(kind, said["features"], pipeline=PipelineModel.load(f"{path}/{kind}"))
        return Ranker(kind, said["features"], [DecisionTreeRegressionModel.load(f"{path}/{kind}/{k}") for k in range(said["trees"])], said["rate"])


def train_binary(train: DataFrame, features: list[str], rounds: int = 20, depth: int = 5, valid: DataFrame | None = None, seed: int = 7) -> Ranker:
    """Pointwise boosting of the label; with validation rows it stops early."""
    rows = assembled(train, features).withColumn("_valid", F.lit(False))
    kw = {}
    if valid is not None:
        rows = rows.unionByName(assembled(valid, features).withColumn("_valid", F.lit(True)))
        kw["validationIndicatorCol"] = "_valid"
    gbt = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, **kw)
    return Ranker("binary", features, pipeline=Pipeline(stages=[gbt]).fit(rows))


def tiles(i: np.ndarray, j: np.ndarray):
    """Blocks of i and of j whose product is all pairs, PAIRS at most in a block."""
    step = max(1, PAIRS // max(1, min(len(i), len(j))))
    for at in range(0, max(len(i), len(j)) if len(i) and len(j) else 0, step):
        yield (i, j[at : at + step]) if len(j) >= len(i) else (i[at : at + step], j)


def lambdas(score: np.ndarray, label: np.ndarray, top: int = 50, draws: int = 0, seed: int | tuple[int, ...] = 0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and weight of each row of a query: pairs weighted by what swapping them changes in NDCG@top.

    draws: average over that many rankings of noisy scores instead of the one ranking (a smoothed variant). Equal scores
    are ranked in the order of the rows.
    """
    n = len(score)
    g, w = np.zeros(n), np.zeros(n)
    positive = label > 0
    if not positive.any() or positive.all():
        return g, w
    ideal = (1 / np.log2(np.arange(min(int(positive.sum()), top)) + 2)).sum()
    rng = np.random.default_rng(seed)
    for _ in range(max(1, draws)):
        noisy = score + (rng.gumbel(size=n) if draws else 0)
        order = np.lexsort((np.arange(n), -noisy))
        gain = np.zeros(n)
        gain[order[:top]] = 1 / np.log2(np.arange(min(n, top)) + 2)
        # a swap changes nothing unless one of the two is among the first `top`: pairs are top rows with all others
        first = np.zeros(n, bool)
        first[order[:top]] = True
        for i, j in ((positive & first, ~positive), (positive & ~first, ~positive & first)):
            i, j = np.flatnonzero(i), np.flatnonzero(j)
            for a, b in tiles(i, j):
                change = np.abs(gain[a][:, None] - gain[b][None, :]) / ideal
                rho = 1 / (1 + np.exp(np.clip(score[a][:, None] - score[b][None, :], -50, 50)))
                force, curve = change * rho, change * rho * (1 - rho)
                g[a] += force.sum(1)
                g[b] -= force.sum(0)
                w[a] += curve.sum(1)
                w[b] += curve.sum(0)
    return g / max(1, draws), w / max(1, draws)


def ndcg(rows: DataFrame, query: str, item: str, score: str, label: str = "label", top: int = 50) -> DataFrame:
    """One row: ndcg, the mean of NDCG@top over queries with a positive."""
    ranked = rank_within(rows, query, item, score, "_r")
    gain = F.when((F.col("_r") < top) & (F.col(label) > 0), 1 / F.log2(F.col("_r") + 2)).otherwise(0.0)
    per = ranked.groupBy(query).agg(F.sum(gain).alias("got"), F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("n")).where("n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(top)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.agg(F.round(F.avg(F.col("got") / ideal), 6).alias("ndcg"))


def lambda_step(top: int, draws: int, seed: int, turn: int):
    """One round for the rows of a query: target and weight of each, in order of item."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", kind="stable")
        noise = (seed, turn, zlib.crc32(str(pdf["query_id"].iloc[0]).encode()))
        g, w = lambdas(pdf["score"].to_numpy(), pdf["label"].to_numpy(), top, draws, noise)
        return pdf.assign(target=np.where(w > 0, g / np.maximum(w, 1e-9), 0.0), weight=w)

    return step


def train_lambda(train: DataFrame, features: list[str], rounds: int = 10, depth: int = 5, rate: float = 0.1, top: int = 50, draws: int = 0, valid: DataFrame | None = None, patience: int = 100, seed: int = 7) -> Ranker:
    """Boosted regression trees on the lambdas' Newton steps; draws > 0 gives the smoothed variant, with noise of its own
    for each round and query.

    With validation rows, training ends when NDCG@top has not risen for `patience` rounds, and the trees of the best round
    are kept. Rows of a query are put in order of item, so their order in the table changes nothing.
    """
    shared_dir(train.sparkSession)
    start = lambda df: assembled(df, features).select("query_id", "item_id", "label", "features", F.lit(0.0).alias("score")).checkpoint()
    state, held = start(with_positive(train, "query_id", "label")), None if valid is None else start(valid)
    trees, best = [], (-1.0, 0)
    for turn in range(rounds):
        step = lambda_step(top, draws, seed, turn)
        # features go along as arrays: one pass gives the tree's rows, without a join back
        moved = state.withColumn("features", vector_to_array("features"))
        moved = moved.groupBy("query_id").applyInPandas(step, T.StructType([*moved.schema.fields, T.StructField("target", T.DoubleType()), T.StructField("weight", T.DoubleType())]))
        rows = moved.where("weight > 0").withColumn("features", array_to_vector("features")).sort("query_id", "item_id").checkpoint()
        if rows.isEmpty():
            break
        tree = DecisionTreeRegressor(labelCol="target", weightCol="weight", maxDepth=depth, seed=seed).fit(rows)
        trees.append(tree)
        add = lambda df: tree.transform(df).withColumn("score", F.col("score") + rate * F.col("prediction")).drop("prediction").checkpoint()  # noqa: B023, E731
        state = add(state)
        if held is not None:
            held = add(held)
            got = ndcg(held, "query_id", "item_id", "score", top=top).first()["ndcg"] or 0.0
            if got > best[0]:
                best = (got, len(trees))
            if len(trees) - best[1] >= patience:
                break
    return Ranker("yetirank" if draws else "lambdarank", features, trees if held is None else trees[: best[1]], rate)


TRAINERS = {"binary": train_binary, "lambdarank": train_lambda, "yetirank": lambda train, features, **kw: train_lambda(train, features, draws=4, **kw)}


def train_one(kind: str, train: DataFrame, features: list[str], n_iter: int | None = None, **kw) -> Ranker:
    """A ranker by name; n_iter fixes its rounds (a refit takes 1.1 times the rounds found, 50 at least)."""
    return TRAINERS[kind](train, features, **({"rounds": n_iter} if n_iter else {}), **kw)


def refit_rounds(found: int, factor: float = 1.1, least: int = 50) -> int:
    return max(least, int(found * factor))


def model_ranks(df: DataFrame, rankers: dict[str, Ranker]) -> DataFrame:
    """rank_model_<name> of every ranker."""
    for name, r in rankers.items():
        df = rank_within(r.predict(df), "query_id", "item_id", "score", f"rank_model_{name}").drop("score")
    return df
