"""Host-level quality rules.

Rules are tried on every document; their failures are added up by host (the document's domain), the
hosts' failure rates are shrunk by an empirical beta prior, so that a host with three documents is not
judged on three documents, and the hosts' verdicts go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import WordHashes, slices, windows
from linkloom.session import Scratch

_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_metrics(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """The five METRICS of a text. A line or word counts as equal to another by all its bytes."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if n >= 4:
        _, back, times = np.unique(windows(hashes.of(words), 3), return_inverse=True, return_counts=True)
        twice = times[back] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : n - 2 + i] |= twice
        repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _metrics(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "__text"):
            rows = np.array([text_metrics(t, hashes) for t in batch.column("__text").to_pylist()], np.int64).reshape(-1, len(METRICS))
            yield pa.record_batch([*(batch.column(c) for c in columns), *map(pa.array, rows.T)], [*columns, *METRICS])

    return run


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """Failures that speak against a host: the base rule, symbol-ridden texts, repeated lines, words too short or long on average."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "lines": F.col("n_dup_lines") > 5,
        "words": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def host_verdicts(flags: DataFrame, host: str, failed: str, most: float) -> DataFrame:
    """``flags`` -> a row for each host: n_docs, n_failed, failure_rate (shrunk), host_bad (the rate is over ``most``).

    The beta prior is fitted to the hosts' rates by moments; its strength is at least 1 document and at most 10,000.
    A null host is a host of its own.
    """
    hosts = flags.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.avg(rate), F.coalesce(F.var_pop(rate), F.lit(0.0)), F.avg(1 / F.col("n_docs"))).first()
    pooled, mean, var, per_doc = (float(v) if v is not None else 0.0 for v in m)
    center = min(max((pooled + mean) / 2, 1e-6), 1 - 1e-6)
    between = max(var - center * (1 - center) * per_doc, 0.0)  # what the hosts differ by beyond chance
    strength = min(max(center * (1 - center) / between - 1 if between else 1e4, 1.0), 1e4)
    shrunk = (F.col("n_failed") + F.lit(center * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("failure_rate", shrunk).withColumn("host_bad", F.col("failure_rate") > F.lit(most))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """-> id, host, the five METRICS, base_failed, failed_rules (names), host's failure_rate, kept; a row for each row.

    kept: the document passes the base rule (50 words, at most half of them in repeated 3-word windows) and its
    host's shrunk failure rate is at most ``most``. Other rules weigh on the host, not on their document. A null text has no words
    and fails. Rows that repeat count each. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rules = default_rules() if rules is None else rules
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    rows = rows.mapInArrow(_metrics(["id", "host"]), f"{kinds}, {', '.join(f'{c} long' for c in METRICS)}")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    rows = scratch.table("metrics", rows)
    hosts = host_verdicts(rows.select("host", (F.size("failed_rules") > 0).alias("failed")), "host", "failed", most)
    hosts = hosts.select(F.col("host").alias("judged"), "failure_rate", "host_bad")
    out = rows.join(hosts, F.col("host").eqNullSafe(F.col("judged")), "left").drop("judged")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")).drop("host_bad").withColumnsRenamed({"id": id_col, "host": host_col})
