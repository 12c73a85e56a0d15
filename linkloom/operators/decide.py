"""From scored pairs to links: thresholds, gates, guards and owners."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.similarity import jaro_winkler_bytes

# Score thresholds by country, and the default
COUNTRY_THRESHOLDS = {"India": 0.48, "US": 0.52, "France": 0.55}
DEFAULT_THRESHOLD = 0.55


def resolve_conflicts(scored: DataFrame, margin: float | None) -> DataFrame:
    """``scored(qid, tid, score, ...)``: a pair keeps its score if its reference is the target's best (smaller qid in a tie)
    and leads the second by ``margin``, else gets 0. A missing second counts as 0. margin None: nothing changes."""
    if margin is None:
        return scored
    order = Window.partitionBy("tid").orderBy(F.desc("score"), "qid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = scored.schema["score"].dataType
    ranked = scored.withColumns({"__rank": F.row_number().over(order), "__best": F.first("score").over(order), "__second": F.nth_value("score", 2).over(whole)})
    leads = (F.col("__rank") == 1) & (F.col("__best") - F.coalesce("__second", F.lit(0).cast(kind)) >= F.lit(margin).cast(kind))
    return ranked.withColumn("score", F.when(leads, F.col("score")).otherwise(F.lit(0).cast(kind))).drop("__rank", "__best", "__second")


def by_value(column: str, values: Mapping[object, float], default: float) -> Column:
    out = F
    for key, value in values.items():
        out = out.when(F.col(column) == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if values else F.lit(default)


def source_gate(scored: DataFrame, thresholds: Mapping[int, float], default: float, gate: float = 0.0) -> DataFrame:
    """Pairs at or above their source's threshold, of references whose best score is at or above the gate."""
    kind = scored.schema["score"].dataType
    best = F.max("score").over(Window.partitionBy("qid"))
    kept = scored.withColumn("__best", best).where(F.col("score") >= by_value("source", thresholds, default).cast(kind))
    return kept.where(F.col("__best") >= F.lit(gate).cast(kind)).drop("__best")


def own_targets(scored: DataFrame) -> DataFrame:
    """Each target goes to its best reference (smaller qid in a tie); a reference may own many."""
    order = Window.partitionBy("tid").orderBy(F.desc("score"), "qid")
    return scored.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def country_guard(scored: DataFrame, thresholds: Mapping[str, float] = COUNTRY_THRESHOLDS, default: float = DEFAULT_THRESHOLD, name_similarity: float | None = 0.55, override: float | None = None) -> DataFrame:
    """``scored(qid, tid, score, country, q_name, t_name)``: thresholds by country and a guard on the names, then one owner for
    each target. A pair that fails a filter never owns, so the next best may.

    The cheap filter runs before names are compared."""
    kind = scored.schema["score"].dataType
    least = F.lit(override) if override is not None else by_value("country", thresholds, default)
    kept = scored.where(F.col("score") >= least.cast(kind))
    if name_similarity is not None:
        lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
        kept = kept.where(jaro_winkler_bytes(lower("q_name"), lower("t_name")) >= name_similarity)
    return own_targets(kept)


def threshold_grid() -> list[float]:
    """0.05 to 0.95 in steps of 0.025, and five values near 1."""
    return [round(0.05 + 0.025 * i, 3) for i in range(37)] + [0.97, 0.98, 0.99, 0.995, 0.999]
