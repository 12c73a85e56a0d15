"""Dense retrieval by cosine and its union with other scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def encode_texts(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", name: str = "embedding") -> DataFrame:
    """Add the encoder's vectors, scaled to length 1; it is given batches of texts on the executors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            v = np.asarray(encoder(batch.fillna("").tolist()), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm > 0, norm, 1)))

    return texts.withColumn(name, pandas_udf(run, ArrayType(FloatType()))(text))


def score_pairs(pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], np.ndarray], left: str = "left", right: str = "right", name: str = "neural_score") -> DataFrame:
    """Add the sigmoid of the scorer's output for pairs of texts; it is given batches on the executors."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(1 / (1 + np.exp(-np.asarray(scorer(list(zip(a.fillna(""), b.fillna(""), strict=True))), np.float64))))

    return pairs.withColumn(name, pandas_udf(run, DoubleType())(left, right))


_PACK = "block string, part int, ids array<long>, width int, vectors binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Unit vectors of a block in matrices of at most ``size`` rows."""
    wanted = "block string, part int, ids array<long>, width int, vectors binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, group in pdf.groupby("block", dropna=False):
                for i in range(0, len(group), size):
                    some = group.iloc[i : i + size]
                    m = np.stack(some["v"].to_list()).astype(np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(norm > 0, norm, 1)
                    yield pd.DataFrame({"block": [block], "part": [i // size], "ids": [some["id"].tolist()], "width": [m.shape[1]], "vectors": [m.tobytes()]})

    return rows.mapInPandas(run, wanted)


def dense_top_k(queries: DataFrame, targets: DataFrame, k: int = 20, least: float = 0.6, size: int = 512) -> DataFrame:
    """``queries(qid, block, vector)`` and ``targets(tid, block, vector)`` -> each query's k targets of highest cosine over ``least`` within
    its block: (qid, tid, dense_score, rank); exact, ties by tid.

    Matrices of a block meet as wholes, never vector by vector, and each meeting keeps its k best only.
    """
    q = _packed(queries.select(F.col("qid").cast("long").alias("id"), F.col("block").cast("string").alias("block"), F.col("vector").alias("v")), size)
    t = _packed(targets.select(F.col("tid").cast("long").alias("id"), F.col("block").cast("string").alias("block"), F.col("vector").alias("v")), size)
    met = q.join(t.toDF("block", "t_part", "t_ids", "t_width", "t_vectors"), "block").select("ids", "width", "vectors", "t_ids", "t_width", "t_vectors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.vectors).reshape(-1, r.width)
                b = np.frombuffer(r.t_vectors).reshape(-1, r.t_width)
                tids = np.array(r.t_ids)
                scores = np.round(a @ b.T, 6)
                for qid, s in zip(r.ids, scores, strict=True):
                    good = np.flatnonzero(s > least)
                    best = good[np.lexsort((tids[good], -s[good]))[:k]]
                    if len(best):
                        yield pd.DataFrame({"qid": qid, "tid": tids[best], "dense_score": s[best]})

    hits = met.mapInPandas(run, "qid long, tid long, dense_score double")
    order = Window.partitionBy("qid").orderBy(F.desc("dense_score"), "tid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_scores(neural: DataFrame, dense: DataFrame) -> DataFrame:
    """``neural(qid, tid, neural_score)``, ``dense(qid, tid, dense_score)`` -> one row for each pair: the higher score, and which it was.

    A dense score that stands alone is a cosine, not a calibrated score; ``score_origin`` says so."""
    both = neural.join(dense, ["qid", "tid"], "full")
    score = F.greatest("neural_score", "dense_score")
    origin = F.when(F.col("neural_score").isNull(), "dense").when(F.col("dense_score") > F.col("neural_score"), "dense_higher").otherwise("neural")
    return both.select("qid", "tid", score.alias("score"), origin.alias("score_origin"))
