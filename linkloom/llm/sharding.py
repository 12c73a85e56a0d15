"""Shards of near-equal bytes by histogram sort. DataFrame operations only.

Rows get a 64-bit key: the top half from the text, the lower half from the id, so
copies lie side by side and a large group of copies can still be cut. Keys and sizes
go to one small table. Then, level by level, the exact bytes and rows below candidate
boundaries are counted across all partitions: evenly spaced probes over the whole key
range first, then probes inside each cell that a wanted splitter falls into, until no
more than ``tolerance`` (or one key) is left to place. At most ``most_cells`` counts, or four for
each output range, reach the driver at a time. At last the rows are exchanged once, to
the ranges between splitters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import Scratch

_ROW_OVERHEAD = 16
_KEY_BITS = 63
_LAST = (1 << 63) - 1
_RANGE_BYTES = 128 << 20


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(_ROW_OVERHEAD)


def _key(text: Column, key: Column) -> Column:
    """Order of rows, as a non-negative number below the largest long."""
    high = F.shiftright(F.xxhash64(text), 32).bitwiseAND(F.lit((1 << 31) - 1))
    low = F.shiftrightunsigned(F.xxhash64(key), 32)
    return F.least(F.shiftleft(high, 32).bitwiseOR(low), F.lit(_LAST - 1))


def _constant(numbers: list[int]) -> Column:
    """A constant array, as one literal whatever its length."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def splitters(keys: DataFrame, wanted: dict[int, int], most_cells: int) -> dict[int, tuple[int, int, int]]:
    """``keys(key, size)`` -> for each wanted number of bytes below, (boundary key, bytes below, rows below).

    wanted: bytes below -> tolerance. An answer is the boundary whose bytes below are nearest to the wanted
    ones, to within the tolerance or one key. most_cells: of the counts that reach the driver at once.
    """
    found: dict[int, tuple[int, int, int]] = {}
    # the cell that a splitter lies in: its first key and its width in bits; and bytes and rows below that cell
    open_at = {want: (0, _KEY_BITS, 0, 0) for want in wanted}
    while open_at:
        want, (start, width, *_) = next(iter(open_at.items()))
        starts = {s for s, *_ in open_at.values()}
        fine = max(0, width - max(1, (most_cells // len(starts)).bit_length() - 1))
        inside = keys
        if width < _KEY_BITS:
            at = keys.sparkSession.range(1).select(F.explode(_constant(sorted(s >> width for s in starts))).alias("open"))
            inside = keys.join(F.broadcast(at), F.shiftright("key", width) == F.col("open"), "left_semi")  # one row a splitter at most
        counted = inside.groupBy(F.shiftright("key", fine).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        cells: dict[int, list] = {}
        for cell, size, rows in sorted(zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True)):
            cells.setdefault(cell << fine >> width << width, []).append((cell << fine, size, rows))
        left = {}
        for want, (start, _, below, rows_below) in open_at.items():
            for cell, size, rows in cells[start]:
                if below + size < want and cell != cells[start][-1][0]:
                    below, rows_below = below + size, rows_below + rows
                elif fine and size > wanted[want]:
                    left[want] = (cell, fine, below, rows_below)
                    break
                elif abs(below + size - want) < abs(want - below):
                    found[want] = (cell + (1 << fine), below + size, rows_below + rows)
                    break
                else:
                    found[want] = (cell, below, rows_below)
                    break
        open_at = left
    return found


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0005, most_cells: int = 1 << 16) -> DataFrame:
    """Deal rows to ``shards`` shards of near-equal bytes (UTF-8 bytes of the text plus 16 a row).

    -> the columns of ``docs``, ``size``, ``shard`` (int) and ``slot`` (long, the place in the shard, without gaps from 0),
    arranged so that each output partition is one range of one shard. Columns of ``docs`` with these names are replaced.

    A boundary lies within ``tolerance`` of a shard's bytes, or half a row, of the ideal one. Rows with equal text and
    id have one key and stay together. A null or empty text has size 16; null ids are values like any other. A very long
    text is a row like any other: its shard is over the ideal by at most that row. With few rows some shards are empty; no row
    is ever dropped, and an empty table has no rows. Repeated rows are rows of their own, with slots of their own.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    scratch = Scratch(docs.sparkSession, "sharding")
    # the key distinguishes null from '' and from any other text
    key = _key(F.col(text_col), F.col(id_col))
    keys = scratch.table("keys", docs.select(key.alias("key"), _size(F.col(text_col)).alias("size")))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # each shard is cut into ranges, so that a task stays small however large a shard is
    ranges = max(1, math.ceil(total / shards / _RANGE_BYTES))
    parts = shards * ranges
    cuts = [total * i // parts for i in range(1, parts)]
    wanted = {c: max(1, int(total / shards * tolerance) if i % ranges == 0 else total // parts // 4) for i, c in reversed([*enumerate(cuts, 1)])}
    found = splitters(keys, wanted, max(most_cells, 4 * parts)) if rows else {}
    edges = [(0, 0, 0), *(found[c] if rows else (0, 0, 0) for c in cuts), (1 << _KEY_BITS, total, rows)]
    for i in range(shards):  # a coarse boundary may fall outside its shard's exact ones
        low, high = edges[i * ranges], edges[(i + 1) * ranges]
        edges[i * ranges + 1 : (i + 1) * ranges] = sorted(min(max(e, low), high) for e in edges[i * ranges + 1 : (i + 1) * ranges])
    bounds, above = [e[0] for e in edges[1:-1]], [e[2] for e in edges[:-1]]
    before = [above[i] - above[i // ranges * ranges] for i in range(parts)]

    # the number of bounds at or below the key, by halving: the bounds are one constant array, of any length
    width = 1 << max(1, len(bounds).bit_length())
    sorted_bounds = _constant([min(b, _LAST) for b in bounds] + [_LAST] * (width - len(bounds)))
    steps = F.array(*[F.lit(width >> i) for i in range(1, width.bit_length())])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_bounds, at + step - 1) <= F.col("__key"), at + step).otherwise(at))

    rest = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    ranged = docs.select(*rest, _size(F.col(text_col)).alias("size"), key.alias("__key"))
    ranged = ranged.withColumn("__range", place)
    ranged = ranged.repartitionById(parts, F.col("__range"))
    in_range = F.row_number().over(Window.partitionBy("__range").orderBy("__key", F.col(id_col)))
    offset = F.get(_constant(before), F.col("__range"))
    return ranged.select(*rest, "size", F.floor(F.col("__range") / F.lit(ranges)).cast("int").alias("shard"), (in_range - 1 + offset).cast("long").alias("slot"))
