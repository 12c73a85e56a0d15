"""Audits of record tables and of packed results. Each check is a row (name, n), all computed in Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.sources.tables import unpack_links


def audit_sources(records: DataFrame) -> DataFrame:
    """``records(src, entity_id, name, address, country)`` -> a row for each source: rows and what is wrong with them."""
    prefix = F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"))
    return records.groupBy("src").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("entity_id")).alias("duplicate_ids"),
        F.count_if(~F.startswith("entity_id", prefix)).alias("bad_prefix"),
        F.count_if(F.col("name") == "").alias("missing_name"),
        F.count_if(F.col("address") == "").alias("missing_address"),
    )


def _checks(checks: dict[str, DataFrame | Column]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for name, (df, n) in checks.items()])


def _count(df: DataFrame) -> tuple[DataFrame, Column]:
    return df.agg(F.count("*").alias("n")), F.col("n")


def audit_truth(references: DataFrame, targets: DataFrame, truth_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """References and targets (entity_id, country), truth_rows(source1_entity_id), truth(qid, tid) -> checks.

    shared_targets and cross_country_pairs are facts to know; the others should be 0.
    """
    ref, rows = references.select("entity_id"), truth_rows.select(F.col("source1_entity_id").alias("entity_id"))
    tids = targets.select(F.col("entity_id").alias("tid"))
    away = truth.join(references.select(F.col("entity_id").alias("qid"), F.col("country").alias("q_country")), "qid").join(targets.select(F.col("entity_id").alias("tid"), "country"), "tid")
    return _checks(
        {
            "missing_truth_rows": _count(ref.join(rows, "entity_id", "left_anti")),
            "unknown_truth_references": _count(rows.join(ref, "entity_id", "left_anti")),
            "duplicate_truth_rows": (rows.agg((F.count("*") - F.count_distinct("entity_id")).alias("n")), F.col("n")),
            "duplicate_truth_pairs": _count(truth.groupBy("qid", "tid").count().where("count > 1")),
            "invalid_targets": _count(truth.join(tids, "tid", "left_anti")),
            "shared_targets": _count(truth.groupBy("tid").agg(F.count_distinct("qid").alias("k")).where("k > 1")),
            "cross_country_pairs": _count(away.where("q_country <> country")),
        }
    )


def require_clean(checks: DataFrame, informative: tuple[str, ...] = ("shared_targets", "cross_country_pairs")) -> None:
    bad = [r["check"] for r in checks.where("n > 0").collect() if r["check"] not in informative]
    if bad:
        raise ValueError(f"the audit failed: {bad}")


def malformed_rows(packed: DataFrame, ids: str, reference: str = "source1_entity_id", prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """Packed rows with a blank or untrimmed reference, or an id that is blank, untrimmed, of another source, or there twice."""
    listed = F.when(F.coalesce(ids, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ","))
    wrong = F.exists(listed, lambda x: (x == "") | (x != F.trim(x)) | ~reduce(Column.__or__, [x.startswith(p) for p in prefixes]))
    twice = F.size(listed) != F.size(F.array_distinct(listed))
    blank = F.coalesce(reference, F.lit("")) == ""
    return packed.where(blank | (F.col(reference) != F.trim(reference)) | wrong | twice)


def validate_output(matches: DataFrame, candidates: DataFrame, references: DataFrame, targets: DataFrame, ids: str = "ids", reference: str = "source1_entity_id") -> DataFrame:
    """Two packed tables (reference, ids) against all references and targets (entity_id) -> checks, all of which should be 0."""
    ref = references.select(F.col("entity_id").alias(reference))
    tids = targets.select(F.col("entity_id").alias("tid"))
    out: dict = {}
    pairs = {}
    for name, packed in (("matches", matches), ("candidates", candidates)):
        pairs[name] = unpack_links(packed, ids, reference)
        out[f"{name}_malformed"] = _count(malformed_rows(packed, ids, reference))
        out[f"{name}_duplicate_rows"] = (packed.agg((F.count("*") - F.count_distinct(reference)).alias("n")), F.col("n"))
        out[f"{name}_missing_rows"] = _count(ref.join(packed, reference, "left_anti"))
        out[f"{name}_unknown_reference"] = _count(packed.join(ref, reference, "left_anti"))
        out[f"{name}_unknown_target"] = _count(pairs[name].join(tids, "tid", "left_anti"))
    out["matches_not_candidates"] = _count(pairs["matches"].join(pairs["candidates"], [reference, "tid"], "left_anti"))
    return _checks(out)
