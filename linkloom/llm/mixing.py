"""Mixing sources to target weights.

Each source's documents stand in a fixed order as one long row of words, cut into blocks of a
fixed length. How many slots each output shard gets of a source is a multinomial draw of all
that the source is owed, so that the sum over shards is exactly its target; a source's draw
needs no other source's, so sources of any number are drawn side by side. Slot i of a source
holds block permutation(i): a keyed Feistel network on the block indices, one for each source
and epoch. No epoch holds a block twice, so a block comes at most ceil(target / size) times and
no table of the permutation exists anywhere. Slots and blocks are joined by index. The table of
sources stays a table: only sums over it reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from linkloom.llm.words import mix, slices, tidied
from linkloom.session import Scratch
from linkloom.sources.tables import dense_ids

WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 4


class Permutation:
    """A pseudorandom permutation of range(n) that can be evaluated anywhere at any index."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = mix(np.uint64(key & ((1 << 64) - 1)) + np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + k) & self.mask)
        return left << self.half | right

    def _walk(self, x, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._pass(np.asarray(x, np.uint64), back)
            while (out := x >= np.uint64(self.n)).any():  # walk the cycle until it is back in range
                x[out] = self._pass(x[out], back)
        return x.astype(np.int64)

    def at(self, i) -> np.ndarray:
        return self._walk(i, False)

    def index(self, x) -> np.ndarray:
        return self._walk(x, True)


@dataclass(frozen=True)
class Source:
    size: int
    target: float
    blocks: int
    key: int


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """``sources(size, weight)`` -> the level at which min(cap * size, level * weight) adds up to ``share`` of all sizes.

    Sources under the level are full; each round adds up the others, and its level fills more of them, until none is new. A
    round is one aggregate over the table of sources.
    """
    total = share * (sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    level, was = 0.0, -1
    while True:
        full = F.lit(cap) * F.col("size") <= F.lit(level) * F.col("weight")
        # full sizes are whole numbers and weights few, so that the sums do not depend on their order
        n, sizes, weights = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == was or not weights:
            return level if weights else float("inf")
        level, was = (total - cap * sizes) / weights, n


def slots_of(source: Source, block: int) -> list[tuple[int, int, int]]:
    """(epoch, slots, words of the last slot): whole epochs, then a part that ends exactly at the target."""
    out, left, epoch = [], int(source.target + 0.5), 0
    tail = source.size - (source.blocks - 1) * block if source.blocks else 0
    while left > 0 and source.blocks:
        if left >= source.size:
            out.append((epoch, source.blocks, block))
            left -= source.size
        else:
            # the short last block stands at one place of the permutation
            short = int(Permutation(source.blocks, source.key + epoch).index([source.blocks - 1])[0])
            n = -(-left // block)
            last = left - (n - 1) * block
            if short < n - 1:  # it came before: so many words are missing
                missing = block - tail
                n, last = (n, last + missing) if last + missing <= block else (n + 1, last + missing - block)
            if short == n - 1 and last > tail:
                n, last = n + 1, last - tail
            out.append((epoch, n, last))
            left = 0
        epoch += 1
    return out


def draw(slots: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """A multinomial draw of ``slots`` over ``shards`` equal shards: the shards with any, and how many each."""
    rng = np.random.default_rng(key & ((1 << 64) - 1))
    if slots < shards:
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    counts = rng.multinomial(slots, np.full(shards, 1 / shards))
    some = np.flatnonzero(counts)
    return some, counts[some]


_RANGES = "shard int, first long, n long, source_index long, size long, target double, blocks long, key long"


def _ranges(shards: int, block: int):
    """Sources -> the slots that each shard gets of them, as ranges, with what their slots need to be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, size, target, blocks, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, n = draw(sum(k for _, k, _ in slots_of(Source(size, target, blocks, key), block)), shards, key)
                if len(shard):
                    same = [pa.array(np.full(len(shard), x)) for x in (index, size, target, blocks, key)]
                    yield pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(np.cumsum(n) - n), pa.array(n.astype(np.int64)), *same], ["shard", "first", "n", "source_index", "size", "target", "blocks", "key"])

    return run


_SLOTS = "shard int, slot long, source_index long, epoch int, block long, words int"


def _slots(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, index, *about in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, begin = Source(*about), 0
                for epoch, k, last in slots_of(source, block):
                    perm = Permutation(source.blocks, source.key + epoch)
                    for a in range(max(first, begin), min(first + n, begin + k), 100_000):
                        i = np.arange(a, min(a + 100_000, first + n, begin + k))
                        words = np.full(len(i), block, np.int32)
                        words[i == begin + k - 1] = last
                        cols = np.full(len(i), shard, np.int32), i, np.full(len(i), index, np.int64), np.full(len(i), epoch, np.int32), perm.at(i - begin), words
                        yield pa.record_batch([pa.array(c) for c in cols], ["shard", "slot", "source_index", "epoch", "block", "words"])
                    begin += k

    return run


@dataclass(frozen=True)
class Mixture:
    """sources: a row for each. sized: the input's rows with their place in their source. pieces: the mix, one row for each part of a document in a slot."""

    sources: DataFrame
    sized: DataFrame
    pieces: DataFrame


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns: rows that share it, and their id, are the same row over again."""
    return F.xxhash64(*[F.col(f"`{f.name}`") if not isinstance(f.dataType, MapType) else F.map_entries(f"`{f.name}`") for f in docs.schema])


def _source_table(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """source, source_index (by code point, null last), size, target, blocks, key: a row for each source."""
    found = scratch.table("found", sized.groupBy("source").agg(F.sum("size").alias("size")))
    # numbered in order without one task for all of them; the null source comes after the others
    named = dense_ids(found.where("source IS NOT NULL"), "source", "place").withColumn("source_index", F.col("place") - 1).drop("place")
    nameless = found.where("source IS NULL").withColumn("source_index", F.lit(found.where("source IS NOT NULL").count()).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    numbered = scratch.table("numbered", named.unionByName(nameless).withColumn("weight", weight))
    level = water_level(numbered, share, cap)
    most = F.lit(float(cap)) * F.col("size")
    target = F.least(most, F.lit(level) * F.col("weight")) if level != float("inf") else most
    key = F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.lit(seed))
    return scratch.table("sources", numbered.select("source", "source_index", "size", target.alias("target"), F.ceil(F.col("size") / F.lit(block)).cast("long").alias("blocks"), key.alias("key")))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 256,
    shards: int | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Mix the words of ``docs`` so that sources by code point (null last) get ``weights`` in turn of ``share`` times all words.

    -> ``sources``; ``sized``: id, h (hash of the row), source_index, size, start (of the document in its source's words),
    source_size, target; ``pieces``: shard, slot, source_index, epoch, id, h, start (same), from_word, words.

    A source's words are its target, rounded; the same input gives the same mix. A null or blank text has size 0
    and no pieces. A very long text lies in many blocks, which go where their slots go. Rows that repeat, or share an id, are documents
    of their own. Null ids are ids like any other. Other columns only tell rows apart. An empty table has an empty mix.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.table("sizes", docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), _row_hash(docs).alias("h")))
    sources = _source_table(sized, scratch, weights, share, cap, block, seed)
    rows, total = sized.count(), sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]

    # places in a source: documents in chunks by hash, so that a source of any size is summed in parallel
    chunks_each = max(256, rows // 100_000)
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("id", "h"), F.lit(chunks_each)).cast("int"))
    table = sources.select("source", "source_index", F.col("size").alias("source_size"), "target")
    sized = sized.join(table, sized["source"].eqNullSafe(table["source"])).drop("source")
    in_chunk = Window.partitionBy("source_index", "chunk").orderBy("id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_index").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sized.groupBy("source_index", "chunk").agg(F.sum("size").alias("n")).select("source_index", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sized = sized.withColumn("inner", F.coalesce(F.sum("size").over(in_chunk), F.lit(0))).join(chunks, ["source_index", "chunk"])
    sized = scratch.table("places", sized.select("id", "h", "source_index", "size", (F.col("inner") + F.col("base")).alias("start"), "source_size", "target"))

    if shards is None:
        shards = max(16, int(total) >> 22)
    ranges = sources.select("source_index", "size", "target", "blocks", "key").mapInArrow(_ranges(shards, block), _RANGES)
    # dealt anew, as one source may own most slots; sized for about a million slots a task
    ranges = ranges.repartition(max(4 * spark.sparkContext.defaultParallelism, int(total / block) >> 20), "shard", "source_index")
    # as many slots as the mix has: never to be broadcast, though the ranges they come from are few
    drawn = ranges.mapInArrow(_slots(block), _SLOTS).hint("merge")

    def div(x: Column) -> Column:
        return F.floor(x / F.lit(block)).cast("long")

    parts = sized.where("size > 0").select("id", "h", "source_index", "start", "size", F.explode(F.sequence(div(F.col("start")), div(F.col("start") + F.col("size") - 1))).alias("block"))
    # a part's words within its block, and the first of them within its document
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.select("id", "h", "source_index", "block", "start", begin.alias("begin"), end.alias("end"), F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_word"))
    met = drawn.join(parts, ["source_index", "block"]).withColumn("n", F.least("end", "words") - F.col("begin")).where("n > 0")
    pieces = met.select("shard", "slot", "source_index", "epoch", "id", "h", "start", "from_word", F.col("n").cast("long").alias("words"))
    return Mixture(sources, sized, pieces)


def taken_by_document(mixture: Mixture) -> DataFrame:
    """-> id, size, source_size, target, taken (words of the document in the mix, repeats counted)."""
    taken = mixture.pieces.groupBy("source_index", "start").agg(F.sum("words").alias("taken"))
    # documents without words share a start with the next one, and are not in the mix
    out = mixture.sized.join(taken, ["source_index", "start"], "left")
    return out.select("id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def _cut(columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for said, ranges in zip(batch.column(text).to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                words = said.encode().split()
                parts = [words[r["from_word"] : r["from_word"] + r["words"]] for r in ranges]
                out.append(said if sum(map(len, parts)) == len(words) else b" ".join(w for p in parts for w in p).decode())
            cols = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.record_batch(cols, columns)

    return run


def mixed_documents(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: ``docs`` with, for each epoch, the words of each document that the mix takes in it.

    A document that is whole in an epoch keeps its text; of others the taken words are joined by one space, in order. Documents
    that the mix takes twice come twice, those it does not take do not come. Of rows that repeat each one is a
    document, taken or not for itself. Null and blank texts, which have no words, do not come.
    """
    ranges = mixture.pieces.groupBy("source_index", "start", "epoch", "id", "h").agg(F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("__ranges"))
    ranges = ranges.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "__ranges")
    # rows that are the same in all columns are met by one of them: each place in the mix has its own ranges
    one = docs.withColumn("__hash", _row_hash(docs)).dropDuplicates([id_col, "__hash"])
    met = one.join(ranges, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
    return met.select(*docs.columns, "__ranges").mapInArrow(tidied(_cut(docs.columns, text_col)), docs.schema)
