"""Overlaps of word sets within groups: all pairs of a group, in cells of bounded size.

A group of m records has m * m / 2 pairs, each of two whole sets. Its records are dealt into chunks and every chunk of the one side meets
every chunk of the other in a cell, so that a large group is the work of many tasks; a cell's pairs are counted together, by a product of matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.session import Scratch, shuffle_partitions

# of one side of a cell: rows and characters
ROWS, CHARS = 1024, 1_500_000
SLICE = 4096
FEW, EXPANDED = 2000, 4_000_000  # pairs of a word that is counted by pair; of all such words at once
GROUP_BYTES, SHARED_BYTES = 128, 32 << 20
BEST_CHARS = 4_000_000  # CHARS where only the best pairs are sent on
PAIRS = 300_000  # sent at once, or those of one cell


def _chunks(rows: Column, chars: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / ROWS), F.ceil(chars / most), F.lit(1)).cast("int")


def _shared(rows: np.ndarray, words: np.ndarray, of: int, left: int) -> np.ndarray:
    """Words that each of the first ``left`` rows shares with each of the others. words: numbers, each once in a row."""
    from_left = rows < left
    both = np.intersect1d(words[from_left], words[~from_left])
    out = np.zeros((left, of - left), np.int32)
    at = np.searchsorted(both, words)
    at[at == len(both)] = 0
    kept = both[at] == words if len(both) else np.zeros(len(words), bool)
    rows, at, from_left = rows[kept], at[kept], from_left[kept]
    # a word of few pairs is counted by pair, the others by a product
    q, t = np.bincount(at[from_left], minlength=len(both)), np.bincount(at[~from_left], minlength=len(both))
    few = q * t <= FEW
    rare = few[at]
    _count_few(out, rows[rare], at[rare], from_left[rare], left, len(both))
    place = np.cumsum(~few) - 1
    rows, at = rows[~rare], place[at[~rare]]
    for low in range(0, int((~few).sum()), SLICE):
        here = (at >= low) & (at < low + SLICE)
        held = np.zeros((of, min(SLICE, int((~few).sum()) - low)), np.float32)
        held[rows[here], at[here] - low] = 1
        out += (held[:left] @ held[left:].T).astype(np.int32)
    return out


def _count_few(out: np.ndarray, rows: np.ndarray, at: np.ndarray, from_left: np.ndarray, left: int, words: int) -> None:
    """Add to ``out`` the words ``at`` that a row of each side holds."""
    sides = []
    for mine in (from_left, ~from_left):
        order = np.argsort(at[mine], kind="stable")
        sides.append((rows[mine][order], np.bincount(at[mine], minlength=words)))
    (q, qn), (t, tn) = sides
    each = np.repeat(tn, qn)  # a word of a left row meets so many right rows
    start, total = np.repeat(np.cumsum(tn) - tn, qn), np.concatenate([[0], np.cumsum(each)])
    low = 0
    while low < len(each):
        high = max(int(np.searchsorted(total, total[low] + EXPANDED, "right")) - 1, low + 1)
        n = each[low:high]
        right = np.repeat(start[low:high] - (total[low:high] - total[low]), n) + np.arange(total[high] - total[low])
        out += np.bincount(np.repeat(q[low:high], n) * out.shape[1] + t[right] - left, minlength=out.size).reshape(out.shape)
        low = high


def _pairs(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole cells; the left rows of each come first."""
    col = {n: table[n].combine_chunks() for n in table.column_names}
    side, ids = (col[n].to_numpy(zero_copy_only=False) for n in ("side", "id"))
    cell, same = (col[n].dictionary_encode().indices.to_numpy(zero_copy_only=False) for n in ("cell", "text"))
    lists = pc.split_pattern(col["text"], " ")
    known = lists.flatten().dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    blank = pc.equal(known.dictionary, "").to_numpy(zero_copy_only=False)
    kept, many = ~blank[code], max(len(blank), 1)
    key = np.unique(row[kept] * many + code[kept])  # a set's words once each, in order of rows
    row, words = key // many, key % many
    size = np.bincount(row, minlength=len(ids))
    start = np.concatenate([[0], np.cumsum(size)])
    bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    names = ("at", "left", "right", "shared", "either", "equal", "to")
    out, waiting = {n: [] for n in names}, 0

    def made() -> pa.RecordBatch:
        flat = {n: np.concatenate(x) for n, x in out.items()}
        columns = [col["country"].take(pa.array(flat["at"])), *[pa.array(flat[n].astype(np.int64)) for n in names[1:5]], pa.array(flat["equal"])]
        return pa.RecordBatch.from_arrays([*columns, col["tag"].take(pa.array(flat["at"])), col["tag"].take(pa.array(flat["to"]))], names=["country", *names[1:6], "left_tag", "right_tag"])

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        m = int((side[a:b] == 0).sum())
        n = int(b - a) - m
        if not m or not n:
            continue
        shared = _shared(row[start[a] : start[b]] - a, words[start[a] : start[b]], m + n, m)
        either = size[a : a + m, None] + size[None, a + m : b] - shared
        x, y = np.nonzero(shared >= least * either)  # all, for 0
        out["at"].append(a + x)
        out["to"].append(a + m + y)
        out["left"].append(ids[a + x])
        out["right"].append(ids[a + m + y])
        out["shared"].append(shared[x, y])
        out["either"].append(either[x, y])
        out["equal"].append(same[a + x] == same[a + m + y])
        waiting += len(x)
        if waiting >= PAIRS:
            yield made()
            out, waiting = {n: [] for n in names}, 0
    if waiting:
        yield made()


def _measure(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on whole cells."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        last = held["cell"][-1]  # it may go on in the next batch
        whole = int(pc.sum(pc.not_equal(held["cell"], last)).as_py() or 0)
        if not whole:
            continue
        yield from work(held.slice(0, whole))
        held = held.slice(whole)
    if held is not None and held.num_rows:
        yield from work(held)


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], chars: int) -> DataFrame:
    """Rows of both sides by cell and side: country, side, id, text, other columns, cell."""
    sides = [df.select(*keys, "id", "text", *columns, F.lit(side).alias("side")) for side, df in enumerate((left, right))]
    rows = sides[0].unionByName(sides[1])
    mine = lambda c, side: F.sum(F.when(F.col("side") == side, c).otherwise(0))
    sums = rows.groupBy(*keys).agg(*[mine(c, side).alias(f"{name}{side}") for side in (0, 1) for name, c in (("rows", F.lit(1)), ("chars", F.length("text")))])
    groups = sums.where("rows0 > 0 AND rows1 > 0").select(*keys, *[_chunks(F.col(f"rows{side}"), F.col(f"chars{side}"), chars).alias(f"n{side}") for side in (0, 1)])
    groups = Scratch(left.sparkSession, "groups").table("groups", groups)
    groups = F.broadcast(groups) if groups.count() * GROUP_BYTES <= SHARED_BYTES else groups  # so that texts are shuffled once, to their cells
    # ids are spread by their hash: as even as chance, and the same again if a task is repeated
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cells = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda j: chunk("n0") * F.col("n1") + j))
    cells = cells.otherwise(F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda i: i * F.col("n1") + chunk("n1")))
    name = F.concat_ws(":", F.col("at").cast("string"), *[x for k in keys for x in (F.length(k).cast("string"), F.col(k))])  # lengths keep keys apart
    dealt = rows.join(groups, keys).withColumn("at", F.explode(cells)).select("country", "side", "id", "text", *columns, name.alias("cell"))
    return dealt.repartition(4 * shuffle_partitions(left.sparkSession), "cell").sortWithinPartitions("cell", "side", "id")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """``left`` and ``right`` (keys with a country, id, text) -> country, left, right (ids), shared, either (words in both; in one or both) and equal (texts)
    of all pairs of equal keys. A text is words with one space between; its set may be empty. A column ``tag``, of both or none, comes as left_tag and right_tag.
    least: only pairs that share so much of their words; two empty sets share all."""
    left, right = (df if "tag" in df.columns else df.withColumn("tag", F.lit(None).cast("string")) for df in (left, right))
    dealt = _dealt(left, right, keys, ["tag"], CHARS)
    return dealt.mapInArrow(lambda batches: _measure(batches, lambda cells: _pairs(cells, least)), "country string, left long, right long, shared long, either long, equal boolean, left_tag string, right_tag string")


MILLIONTHS = 1_000_000
TRIES, COMPARED = 4, 100_000  # of best pairs by themselves, before the names of all of a record's pairs are compared; names at once


def _alike(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the names of places i of x and j of y are as similar."""
    keys, back = np.unique(i.astype(np.int64) * len(y) + j, return_inverse=True)
    a, b = (n.take(pa.array(at)).cast(pa.binary()).to_pylist() for n, at in ((x, keys // len(y)), (y, keys % len(y))))
    return (S.jaro_winkler_of_bytes(a, b) >= least)[back]


def _best_of_cell(cell: pa.Table, similarity: float) -> pa.RecordBatch | None:
    """The best left row of each right one; left rows come first, by id, so that the first of equal scores has the smallest."""
    col = {n: cell[n].combine_chunks() for n in cell.column_names}
    m = int(pc.sum(pc.equal(col["side"], 0)).as_py() or 0)
    of = cell.num_rows
    if not m or m == of:
        return None
    lists = pc.split_pattern(col["text"], " ")
    known = lists.flatten().dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(of), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    many = max(len(known.dictionary), 1)
    key = np.unique((row * many + code)[~pc.equal(known.dictionary, "").to_numpy(zero_copy_only=False)[code]])
    row, words = key // many, key % many
    size = np.bincount(row, minlength=of)
    shared = _shared(row, words, of, m).astype(np.int64)
    either = np.maximum(size[:m, None] + size[None, m:] - shared, 1)
    score = (2 * MILLIONTHS * shared + either) // (2 * either)  # rounded, halves upwards, without a fraction that would blur a half
    score[score < col["least"].to_numpy()[None, m:]] = -1
    names = col["name"].dictionary_encode()
    q, t = names.indices.to_numpy()[:m], names.indices.to_numpy()[m:]
    left, best = np.full(of - m, -1), np.full(of - m, -1, np.int64)
    waiting = np.arange(of - m)
    for attempt in range(TRIES + 1):
        if attempt == TRIES:  # names that are rarely alike: all of what is left
            i, j = np.nonzero(score[:, waiting] >= 0)
            for low in range(0, len(i), COMPARED):
                x, y = i[low : low + COMPARED], waiting[j[low : low + COMPARED]]
                bad = ~_alike(names.dictionary, names.dictionary, q[x], t[y], similarity)
                score[x[bad], y[bad]] = -1
        first = score[:, waiting].argmax(axis=0)
        value = score[first, waiting]
        first, waiting, value = first[value >= 0], waiting[value >= 0], value[value >= 0]
        if not len(waiting):
            break
        good = _alike(names.dictionary, names.dictionary, q[first], t[waiting], similarity) if attempt < TRIES else np.ones(len(waiting), bool)
        left[waiting[good]], best[waiting[good]] = first[good], value[good]
        first, waiting = first[~good], waiting[~good]
        score[first, waiting] = -1
    found = np.flatnonzero(left >= 0)
    ids = col["id"].to_numpy()
    return pa.RecordBatch.from_arrays([col["country"].take(pa.array(m + found)), pa.array(ids[left[found]]), pa.array(ids[m + found]), pa.array(best[found])], names=["country", "left", "right", "score"])


def _best(cells: pa.Table, similarity: float) -> Iterator[pa.RecordBatch]:
    code = cells["cell"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0, [True]]))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if (found := _best_of_cell(cells.slice(low, high - low), similarity)) is not None:
            yield found


def best_overlaps(left: DataFrame, right: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """``left`` and ``right`` (keys with a country, id, text, name, least) -> country, left, right, score: for each right row the left one of equal keys whose words overlap
    most, the smallest id of equal ones, among those with a score (shared over all words, in millionths) of the right row's ``least`` (over 0) or more and names whose Jaro-Winkler
    similarity by bytes is ``similarity`` or more. Cells choose among their own pairs, so that no pair is sent on but a right row's best of each."""
    dealt = _dealt(left, right, keys, ["name", "least"], BEST_CHARS)
    found = dealt.mapInArrow(lambda batches: _measure(batches, lambda cells: _best(cells, similarity)), "country string, left long, right long, score long")
    best = found.groupBy("right").agg(F.max(F.struct("score", (-F.col("left")).alias("left"), "country")).alias("b"))
    return best.select("b.country", (-F.col("b.left")).alias("left"), "right", "b.score")
