"""Tokens of each section of a document, by offset-mapped attribution.

A document is encoded once, as a whole, so that the counts add up to what a model will see; encoding
sections apart would tokenize differently at every cut. Each token's place in the text (code points) is
then joined to the sections' intervals. A token that crosses a boundary goes to one section by an
explicit rule: ``start`` (where its first code point lies), ``end`` (its last one), or ``most`` (where most
of its code points lie, the earlier section in a tie).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tokens import encoding
from linkloom.llm.words import slices, tidied


def attribute(places: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses a boundary.

    places: begin and end of each token; bounds: starts of the sections, rising from 0. A token without
    code points lies where it begins.
    """
    begin, last = places[:, 0], np.maximum(places[:, 1] - 1, places[:, 0])
    first_in, last_in = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(bounds, last, "right") - 1
    crosses = first_in != last_in
    if rule == "start":
        return first_in, crosses
    if rule == "end":
        return last_in, crosses
    if rule != "most":
        raise ValueError(f"no such rule: {rule}")
    out = first_in.copy()
    for i in np.flatnonzero(crosses):
        edges = np.r_[begin[i], bounds[first_in[i] + 1 : last_in[i] + 1], last[i] + 1]
        out[i] = first_in[i] + int(np.argmax(np.diff(edges)))
    return out, crosses


def quarters(n: int) -> list[int]:
    """Starts of four parts of n code points, as equal as can be, the first ones shorter."""
    return [n * i // 4 for i in range(4)]


_OUT = "id long, section int, start long, n_chars long, n_tokens long, n_crossing long"


def _count(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as held:
            for batch in slices(batches, "text", 1 << 20):
                parts: list[list] = [[] for _ in range(6)]
                texts = batch.column("text").to_pylist()
                for key, text, starts, (_, places) in zip(batch.column("id").to_pylist(), texts, batch.column("starts").to_pylist(), held.encode_with_places(texts), strict=True):
                    n = len(text or "")
                    at = np.array(starts if starts is not None else quarters(n), np.int64)
                    section, crosses = attribute(places, at, rule)
                    for to, x in zip(parts, ([key] * len(at), range(len(at)), at, np.diff(np.r_[at, n]), np.bincount(section, minlength=len(at)), np.bincount(section[crosses], minlength=len(at))), strict=True):
                        to.extend(x)
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], ["id", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", starts_col: str | None = None) -> DataFrame:
    """Tokens by section -> id, section (from 0), start, n_chars, n_tokens, n_crossing (of those, tokens that also lie in another).

    starts_col: an array of the sections' first code points, rising from 0; without it, a document's four
    quarters. The sections' n_tokens add up to the document's tokens. A null or empty text has its sections, without
    tokens. Sections may be empty; a token at the start that two share goes to the later. Rows that repeat, or share an id, are counted
    each for itself. Other columns are not looked at.
    """
    if rule not in ("start", "end", "most"):
        raise ValueError(f"no such rule: {rule}")
    starts = F.col(starts_col).cast("array<long>") if starts_col else F.lit(None).cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), starts.alias("starts"))
    return rows.mapInArrow(tidied(_count(tokenizer, rule)), _OUT).withColumnRenamed("id", id_col)
