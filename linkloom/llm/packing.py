"""Best-fit packing of tokenized documents into sequences of a fixed length.

Pieces (documents, the long ones cut) are packed by length: all that matters of a piece is its
length, and there are no more lengths than the capacity. The plan is made on the
histogram of lengths, at a cost that does not grow with the number of documents:

1.  *Martello-Toth reduction.* For the longest pieces left, the best single partner is taken
    if it provably dominates: it fills the sequence, or no two or more of the pieces left that
    fit beside it hold more than it does. Such pairs (or a piece that nothing fits beside)
    are part of some optimal packing and are fixed for good, whole classes at a time.
2.  *Best fit, decreasing*, of the rest: each class goes to the fullest sequences it fits in.

The plan gives each length's pieces, by rank, a sequence and an offset. Ranks are counted in
parallel: a length's pieces are dealt to groups by hash, the more groups the more pieces it has, so that a
length shared by a third of all pieces is no bottleneck.
"""

from __future__ import annotations


import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.tokens import encoding
from linkloom.llm.words import slices, tidied
from linkloom.session import Scratch

# (length, first rank, pieces, first sequence, offset): ranks and sequences go up together
Run = tuple[int, int, int, int, int]


def _best_two(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """The most that two or more of the pieces left can fill of ``room``: a bound from above that is exact for pairs.

    Three or more pieces are bounded by the room itself once the three smallest fit.
    """
    small = []
    for x in lengths:
        small += [x] * min(3, counts[x])
        if len(small) >= 3:
            break
    if len(small) >= 3 and sum(small[:3]) <= room:
        return room
    best, j = 0, len(lengths) - 1
    for i, x in enumerate(lengths):
        if x + lengths[0] > room:
            break
        while j >= 0 and lengths[j] + x > room:
            j -= 1
        k = j if j != i or counts[x] > 1 else j - 1
        if k >= 0:
            best = max(best, x + lengths[k])
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sequences that provably dominate. -> [(lengths in the sequence, how many such)], the counts left."""
    left = {x: n for x, n in counts.items() if n}
    lengths, fixed = sorted(left), []
    for x in sorted(left, reverse=True):
        while x in left:
            room, n = capacity - x, left[x]
            at = bisect_left(lengths, room + 1) - 1
            if at >= 0 and lengths[at] == x and n == 1:
                at -= 1
            if at < 0:  # nothing fits beside it
                chosen, times = (x,), n
            else:
                y = lengths[at]
                if y != room and _best_two(lengths, left, room) > y:
                    break  # undecided: left for best fit
                chosen, times = (x, y), n // 2 if y == x else min(n, left[y])
            fixed.append((chosen, times))
            for z in chosen:
                left[z] -= times
                if not left[z]:
                    del left[z]
                    lengths.remove(z)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int, used: dict[int, int], first_sequence: int) -> tuple[list[Run], int]:
    """Best fit decreasing on whole classes. used: pieces of each length already placed. -> runs, next sequence."""
    runs: list[Run] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, how many)]
    rooms: list[int] = []
    nxt = first_sequence

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for x in sorted(counts, reverse=True):
        left, rank = counts[x], used.get(x, 0)
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):  # as many pieces to a new sequence as it holds
                each = capacity // x
                n = max(1, left // each)
                each = min(each, left)
                for i in range(each):
                    runs.append((x, rank, n, nxt, i * x))
                    rank += n
                put(capacity - each * x, nxt, n)
                nxt += n
                left -= each * n
                continue
            room = rooms[at]
            first, n = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[at]
            k = min(n, left)
            runs.append((x, rank, k, first, capacity - room))
            rank += k
            left -= k
            put(room - x, first, k)
            if n > k:
                put(room, first + k, n - k)
        used[x] = rank
    return runs, nxt


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Where each piece goes, by length and rank. -> runs sorted by (length, rank), number of sequences."""
    runs: list[Run] = []
    used: dict[int, int] = {}
    fixed, left = reduce_by_dominance(counts, capacity)
    sequence = 0
    for lengths, n in fixed:
        offset = 0
        for x in lengths:
            runs.append((x, used.get(x, 0), n, sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    more, sequence = best_fit(left, capacity, used, sequence)
    return sorted(runs + more), sequence


_PIECES = "id long, row long, piece int, start long, length int, ids_crc32 long"
_RANKED_TOGETHER = 20_000


def _pieces(path: str, end_id: int | None, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as held:
            end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
            for batch in slices(batches, "text", 1 << 20):
                out = []
                for key, row, data in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), held.encode(batch.column("text").to_pylist()), strict=True):
                    data += end
                    for i, a in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[a : a + 4 * capacity]
                        out.append((key, row, i, a // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
                names = ["id", "row", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _place(runs: list[Run]):
    length, rank, _, sequence, offset = (np.array(c, np.int64) for c in zip(*runs, strict=True))
    step = int(rank.max()) + 1
    begin = length * step + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, r = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            # the run of this length that the rank lies in; a rank past the last run's first one is cut to it
            at = np.searchsorted(begin, x * step + np.minimum(r, step - 1), "right") - 1
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` tokens as the method finds.

    -> a row for each piece: the id, ``piece``, ``start`` (ids of the document before it), ``length``, ``ids_crc32``,
    ``sequence_id`` (from 0, none unused), ``offset`` (gapless within a sequence), and with keep_ids ``ids``
    (little-endian unsigned 32-bit numbers).

    Only documents longer than ``capacity`` are cut. ``end_id`` follows each document; with None, a document
    without tokens has no piece. A null text is empty. A very long text has as many pieces as it needs. Rows that repeat, or
    share an id, are packed each for itself. Null ids are kept; other columns are not looked at. An empty table has no
    pieces. tokenizer: a file that every worker can read at this path.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    schema = _PIECES + (", ids binary" if keep_ids else "")
    pieces = scratch.table("pieces", rows.mapInArrow(tidied(_pieces(tokenizer, end_id, capacity, keep_ids)), schema))

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).withColumnRenamed("id", id_col).select(*names)
    runs, _ = plan(counts, capacity)
    # each length's pieces are ranked in as many groups as they need to stay small, and groups one after the other
    ways = F.split(F.lit(",".join(str(max(1, -(-counts.get(x, 0) // _RANKED_TOGETHER))) for x in range(capacity + 1))), ",").cast("array<int>")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece", "ids_crc32"), F.get(ways, F.col("length"))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "id", "piece"))
    ranked = salted.withColumn("inner", inner).join(base, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("inner") - 1 + F.col("base")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    out = ranked.mapInArrow(_place(runs), f"{kinds}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col).select(*names)
