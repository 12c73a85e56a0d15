"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. Within a bucket a query's running k-th score becomes a
threshold on the cosine: score / (length of the query * largest length in the bucket). Above 1, the
bucket is skipped; if it is high, the query's largest coordinates bound what a candidate's coordinates can be,
and candidates outside are dropped (coordinate pruning); else only candidates long enough are looked at
(length pruning). What is left is verified by its product.

Queries meet buckets in cells: a group of queries and a group of buckets per task. A first pass over the bucket
of the longest vectors gives every query a threshold before the cells begin. Groups are ranges: buckets by length, queries
by the least length that a vector needs to matter to them (threshold over own length), so a group of queries
is not sent to, nor met by, buckets that are too short for all of it. What is left of the meetings grows with queries
times vectors where lengths are alike, as an exact search must; cells are large, so that few copies are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.words import deal_rows
from linkloom.session import Scratch

_BUCKET = 1024
_CELL = 128
_COORDINATES = 3
_HIGH = 0.7


def _matrix(data: list[bytes]) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros."""
    width = max((len(d) for d in data), default=0)
    return np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.int64).reshape(len(data), width // 8)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where every partial sum is exact there, else in integers (or Python's)."""
    width = max(q.shape[1], p.shape[1])
    q, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, p))
    bound = width * float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(p.astype(np.float64)).max(initial=0))
    if bound < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ p.T
    raise OverflowError("scores over 63 bits")


def _vectors(scale: int):
    """(id, query, v) -> id, query, length and the whole numbers of each vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            edge = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(edge[0], edge[-1] - edge[0])
            edge = edge - edge[0]
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
            bad = ~np.isfinite(x)
            before = np.r_[0, np.cumsum(bad)]
            good = np.asarray(lists.is_valid()) & (before[edge[1:]] == before[edge[:-1]])
            with np.errstate(over="ignore"):
                x = np.floor(np.where(bad, 0.0, x) * scale)
            if len(x) and np.abs(x).max() >= 2.0**62:
                raise OverflowError("components over 62 bits")
            # a row's own sum: no row is touched by the size of others
            some = np.flatnonzero(edge[1:] > edge[:-1])
            squares = np.zeros(len(edge) - 1)
            if len(some):
                squares[some] = np.add.reduceat(x * x, edge[some])
            data = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge * 8), pa.py_buffer(x.astype(np.int64))])
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(np.sqrt(squares)), data.cast(pa.binary())], ["id", "query", "length", "v"])
            yield out.filter(pa.array(good))

    return run


class Bucket:
    """Vectors by falling length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray):
        self.ids, self.lengths, self.vectors = ids, lengths, vectors
        with np.errstate(invalid="ignore"):
            self.unit = np.nan_to_num(vectors / lengths[:, None]) if len(ids) else vectors

    def candidates(self, q: np.ndarray, length: float, least: float) -> np.ndarray:
        """Places of the vectors whose product with ``q`` may be ``least`` or more (all that are, and some that are not)."""
        n = len(self.ids)
        if not n or least <= 0 or not np.isfinite(least) or not length:
            return np.arange(n)
        slack = 1 - 1e-9
        local = least * slack / (length * self.lengths[0])  # a cosine below this can't reach ``least`` in this bucket
        if local > 1:
            return np.zeros(0, np.int64)
        # length pruning: lengths fall
        at = np.arange(int(np.searchsorted(-self.lengths, -least * slack / length, "right")))
        if local >= _HIGH:
            u = q / length
            for f in np.argsort(-np.abs(u))[:_COORDINATES]:
                reach = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - local**2))) + 1e-6
                at = at[np.abs(self.unit[at, f] - u[f] * local) <= reach + abs(u[f]) * (1 - local)]
        return at

    def top(self, q: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its best k here of at least ``least``, itself not left out: place, ids, scores. Ties go to smaller ids."""
        width = max(q.shape[1], self.vectors.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        lists = [self.candidates(q[i], lengths[i], least[i]) for i in range(len(q))]
        full = [i for i, c in enumerate(lists) if 2 * len(c) > len(self.ids)]  # cheaper in one product
        scores = dict(zip(full, _products(q[full], self.vectors), strict=True)) if full else {}
        for i, c in enumerate(lists):
            if not len(c):
                continue
            s = scores[i][c] if i in scores else _products(q[i : i + 1], self.vectors[c])[0]
            c, s = c[s >= least[i]], s[s >= least[i]]
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                c, s = c[s >= kth], s[s >= kth]
            best = np.lexsort((self.ids[c], -s))[:k]
            if len(best):
                yield i, self.ids[c[best]], s[best]


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    ids, lengths, data = [], [], []
    for batch in batches:
        for key, length, v in zip(*(batch.column(c).to_pylist() for c in ("id", "length", "v")), strict=True):
            ids.append(key), lengths.append(length), data.append(v)
            if len(ids) == rows:
                yield np.array(ids, np.int64), np.array(lengths), data
                ids, lengths, data = [], [], []
    if ids:
        yield np.array(ids, np.int64), np.array(lengths), data


_PACK = {"most": pa.float64(), "n": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "lengths": pa.binary(), "vectors": pa.binary()}
_PACK_SQL = "most double, n int, width int, ids binary, lengths binary, vectors binary"


def _packs(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, data in _pack(batches, rows):
            m = _matrix(data)
            yield deal_rows([(float(lengths[0]), len(ids), m.shape[1], ids.tobytes(), lengths.tobytes(), m.tobytes())], _PACK)

    return run


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, ids, lengths, vectors = row
    return np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.float64), np.frombuffer(vectors, np.int64).reshape(n, width)


_SEEDED = _PACK | {"least": pa.binary(), "need": pa.float64()}


def _seed(first: Bucket | None, k: int):
    """Give each query its k-th score in the bucket of the longest vectors, as a threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids, lengths, vectors = _unpack(row[1:])
                least = np.full(len(ids), -np.inf)
                if first is not None:
                    for i, _, s in first.top(vectors, lengths, least, k):
                        if len(s) == k:
                            least[i] = s[-1]
                # the length below which a vector cannot reach any of these queries' thresholds
                need = np.where((least > 0) & (lengths > 0), least * (1 - 1e-9) / np.where(lengths > 0, lengths, 1.0), 0.0)
                yield deal_rows([(*row, least.tobytes(), float(need.min()))], _SEEDED)

    return run


def _in_groups(packs: DataFrame, by: str, tie: str, groups: int) -> DataFrame:
    """Deal packs to ranges of a column, of about as many packs each."""
    cuts = packs.approxQuantile(by, [i / groups for i in range(1, groups)], 0.25 / groups) if groups > 1 else []
    lower = F.split(F.lit(",".join(map(repr, cuts)) or "inf"), ",").cast("array<double>")
    tied = F.size(F.filter(lower, lambda c: c < F.col(by))), F.size(F.filter(lower, lambda c: c <= F.col(by)))
    # packs of one value lie anywhere between the cuts that are equal to it
    return packs.withColumn("group", (tied[0] + F.pmod(F.xxhash64(tie), tied[1] - tied[0] + 1)).cast("int"))


_HITS = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "own": pa.int64()}
_HITS_SQL = "query_row long, query_id long, vec_id long, score long, own long"


def _cell(k: int):
    """A cell's query packs and then its buckets, longest first -> the best k of each query in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list] = {}  # by cell
        for batch in batches:
            for cell, side, row_no, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "row_no", "n", "width", "ids", "lengths", "vectors", "least")), strict=True):
                unpacked = _unpack(row[:5])
                if side == 0:
                    queries.setdefault(cell, []).append((row_no, *unpacked, np.frombuffer(row[5], np.float64).copy(), {}))
                    continue
                bucket = Bucket(*unpacked)
                for vectors, lengths, least, found in ((q[3], q[2], q[4], q[5]) for q in queries.get(cell, [])):
                    for i, hit, score in bucket.top(vectors, lengths, least, k):
                        if i in found:
                            hit, score = np.r_[found[i][0], hit], np.r_[found[i][1], score]
                            best = np.lexsort((hit, -score))[:k]
                            hit, score = hit[best], score[best]
                        found[i] = hit, score
                        if len(score) == k:
                            least[i] = max(least[i], score[-1])
        for packs in queries.values():
            for row_no, ids, _, vectors, _, found in packs:
                own = {i: int(_products(vectors[i : i + 1], vectors[i : i + 1])[0, 0]) for i in found}
                out = [(row_no * _BUCKET + i, int(ids[i]), int(h), int(s), own[i]) for i, (hit, score) in found.items() for h, s in zip(hit, score, strict=True)]
                if out:
                    yield deal_rows(out, _HITS)

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer products of each query with all other vectors -> query_id, rank (from 1), vec_id, score.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by ``every``; a query does not
    meet its own row, but any other, also of its id. Ties go to the smaller id. With fewer than k candidates all are returned. Rows with
    a null id, a null vector or a null or non-finite component take no part; a shorter vector is as if filled up with
    zeros, an empty one is all zeros. Repeated rows are candidates, and queries, of their own; the ranks of each are its own. Components
    over 62 bits, or products over 63, raise OverflowError. An empty table has no hits; other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(id_col) % every == 0).alias("query"), F.col(vector_col).alias("v"))
    whole = scratch.table("vectors", rows.mapInArrow(_vectors(scale), "id long, query boolean, length double, v binary"))
    total, asked = whole.agg(F.count("*"), F.count_if("query")).first()
    ways = spark.sparkContext.defaultParallelism
    parts = max(1, min(-(-total // _BUCKET), max(ways, total // (64 * _BUCKET))))
    buckets = whole.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    buckets = scratch.table("buckets", buckets.mapInArrow(_packs(_BUCKET), _PACK_SQL))
    # one bucket, of at most _BUCKET vectors
    longest = buckets.orderBy(F.desc("most"), "ids").limit(1).collect()
    first = Bucket(*_unpack(tuple(longest[0])[1:])) if longest else None

    # one more than k: the query's own row may be among them, and goes at the end
    packs = whole.where("query").repartition(max(1, min(ways, -(-asked // 64)))).sortWithinPartitions(F.desc("length"), "id").mapInArrow(_packs(_BUCKET // 4), _PACK_SQL)
    packs = scratch.table("queries", packs.mapInArrow(_seed(first, k + 1), _PACK_SQL + ", least binary, need double").withColumn("row_no", F.monotonically_increasing_id()))

    # cells of at most _CELL query packs and _CELL buckets; more, smaller ones while there are idle cores
    n_packs, n_buckets = packs.count(), buckets.count()
    high = max(1, -(-n_packs // _CELL))
    wide = max(1, -(-n_buckets // _CELL), min(n_buckets, -(-2 * ways // high)))
    buckets = _in_groups(buckets, "most", "ids", wide)
    packs = _in_groups(packs, "need", "row_no", high)
    # the longest vector of each group of buckets, rising: a group of queries meets those from the first that is long enough
    most = np.zeros(wide)
    for r in buckets.groupBy("group").agg(F.max("most").alias("most")).collect():
        most[r["group"]] = r["most"]
    most = F.split(F.lit(",".join(map(repr, np.maximum.accumulate(most).tolist()))), ",").cast("array<double>")
    needs = packs.groupBy(F.col("group").alias("p")).agg(F.min("need").alias("need"))
    needs = needs.withColumn("from", F.size(F.filter(most, lambda m: m < F.col("need")))).where(F.col("from") < wide)
    cells = scratch.table("cells", needs.select("p", F.explode(F.sequence("from", F.lit(wide - 1))).alias("b")).withColumn("cell", F.col("p") * wide + F.col("b")))
    columns = ["most", "n", "width", "ids", "lengths", "vectors"]
    left = packs.join(cells, F.col("group") == F.col("p")).select("cell", F.lit(0).alias("side"), "row_no", *columns, "least")
    right = buckets.join(cells, F.col("group") == F.col("b")).select("cell", F.lit(1).alias("side"), F.lit(0).cast("long").alias("row_no"), *columns, F.lit(None).cast("binary").alias("least"))
    met = left.unionByName(right).repartitionById(high * wide, "cell").sortWithinPartitions("cell", "side", F.desc("most"))
    hits = met.mapInArrow(_cell(k + 1), _HITS_SQL)
    by_query = Window.partitionBy("query_row")
    ranked = hits.withColumn("at", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    # the query's own row: of those that share its id and score any one, they are the same in the result
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("at"))).over(by_query)
    ranked = ranked.withColumn("self", F.coalesce(itself, F.lit(k + 2))).where(F.col("at") != F.col("self"))
    rank = F.col("at") - (F.col("at") > F.col("self")).cast("int")
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
