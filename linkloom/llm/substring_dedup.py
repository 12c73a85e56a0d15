"""Removal of repeated word passages across and inside documents.

Super-k-mer partitioning. A window is ``k`` consecutive words of one document. Its
minimiser is the smallest hash among its runs of ``m`` words, so equal windows have
equal minimisers, and consecutive windows mostly share one. Such a run of windows
travels as one packed string (a super-k-mer) to the bucket of its minimiser, about
three words a window in place of twenty. A bucket numbers its words in one pass of Arrow, sorts the
windows and compares those that look equal word for word, so counts are exact.

A super-k-mer that a task meets again in the same flush is not sent: its windows
certainly start earlier elsewhere, and only their places travel on. A group of
thousands of copies thus reaches a bucket once from each flush.

A run of ``m`` words that stands in a large share of all texts, each time among other words,
would fill the one bucket of its hash. Such runs are found beforehand in a sample of the texts and
come last in the order of minimisers: a window takes one only if it holds nothing else, so their
windows are dealt by their rarer words. The sample decides where windows meet, never which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import WordHashes, deal_rows, mix, runs, slices, tidied, windows
from linkloom.session import Scratch, column_bytes, partitions_for

_LAST = (1 << 63) - 1
_FLUSH = 6 << 20
_SAMPLE, _SHARE, _BUCKET_BYTES = 8 << 20, 1e-5, 3 << 20


def super_kmers(hashes: np.ndarray, k: int, m: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts at which a new minimiser begins (and the end), and each run's minimiser. common: runs of words that come last, sorted."""
    grams = windows(hashes, m)
    order = grams >> np.uint64(1)
    if len(common):
        order[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams] |= np.uint64(1 << 63)
    first = np.lib.stride_tricks.sliding_window_view(order, k - m + 1).argmin(axis=1)
    first += np.arange(len(first))
    cut = runs(first)
    return cut, grams[first[cut[:-1]]]


def _grams(k: int, m: int):
    """(text) -> partial counts of the runs of ``m`` words in texts that have windows, each text's different ones."""

    def counted(grams: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, grams, held = WordHashes(), [], 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                if len(words) >= k:
                    grams.append(np.unique(windows(hashes.of(words), m)))
                    held += len(grams[-1])
                if held > 1_000_000:
                    yield counted(grams)
                    grams, held = [], 0
        if grams:
            yield counted(grams)

    return run


def common_grams(docs: DataFrame, text_col: str, k: int, m: int, parts: int, scratch: Scratch, share: float = _SHARE) -> np.ndarray:
    """Runs of ``m`` words that make up more than an eighth of a bucket's, in a sample of different texts, sorted.

    The sample is 8 MB of text or a thousandth of all, if that is more. At most 1 / share runs can have that share, so many reach the
    driver at most.
    """
    size = column_bytes(docs, text_col)
    kept = min(1.0, max(_SAMPLE, size / 1000) / size) if size else 0.0
    # chosen by a hash of the text: copies of a text, which do not fill buckets, are in or out together
    sampled = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < int(kept * (1 << 20))).dropDuplicates()
    counts = scratch.table("grams", sampled.mapInArrow(tidied(_grams(k, m)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    found = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(20, found * max(share, 1 / (8 * parts)))).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in hot], np.int64).view(np.uint64))


class _Flush:
    def __init__(self):
        self.ids, self.tags, self.starts, self.counts, self.keys = [], [], [], [], []
        self.texts: list[bytes] = []
        self.first: dict[bytes, int] = {}
        self.sent = 0

    def add(self, doc: int, tag: int, start: int, count: int, key: int, text: bytes) -> None:
        """Keep the earliest place of ``text``; a later one is only marked."""
        at = len(self.ids)
        had = self.first.setdefault(text, at)
        if had != at and (doc, tag, start) == (self.ids[had], self.tags[had], self.starts[had]):
            return  # a repeated row: what goes from the first goes from it
        self.ids.append(doc), self.tags.append(tag), self.starts.append(start), self.counts.append(count), self.keys.append(key)
        if had == at or doc == self.ids[had] and tag != self.tags[had]:  # new, or another row of that id: neither starts earlier
            self.texts.append(text)
            self.sent += len(text)
        elif (doc, start) < (self.ids[had], self.starts[had]):
            self.first[text] = at
            self.texts.append(text)
            self.texts[had] = None
        else:
            self.texts.append(None)

    def rows(self, buckets: int) -> pa.RecordBatch:
        ids, tags, starts, counts = np.array(self.ids, np.int64), np.array(self.tags, np.int32), np.array(self.starts, np.uint32), np.array(self.counts, np.uint32)
        bucket = ((mix(np.array(self.keys, np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        sent = np.fromiter((t is not None for t in self.texts), bool, len(self.texts))
        order = np.argsort(bucket, kind="stable")
        cut, out = runs(bucket[order]), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:b]
            go, stay = at[sent[at]], at[~sent[at]]
            blob = pa.compress(b"\n".join(self.texts[i] for i in go), codec="zstd", asbytes=True) if len(go) else b""
            size = sum(len(self.texts[i]) + 1 for i in go)
            out.append((int(bucket[at[0]]), size, blob, ids[go].tobytes(), tags[go].tobytes(), starts[go].tobytes(), ids[stay].tobytes(), tags[stay].tobytes(), starts[stay].tobytes(), counts[stay].tobytes()))
        return deal_rows(out, _PACKETS)


_PACKETS = {"bucket": pa.int32(), "size": pa.int64()} | dict.fromkeys(("blob", "ids", "tags", "starts", "m_ids", "m_tags", "m_starts", "m_counts"), pa.binary())
_PACKETS_SQL = "bucket int, size long, blob binary, ids binary, tags binary, starts binary, m_ids binary, m_tags binary, m_starts binary, m_counts binary"


def _packets(k: int, m: int, buckets: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flush = WordHashes(), _Flush()
        for batch in slices(batches, "text"):
            for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text")), strict=True):
                words = (text or "").encode().split()
                if len(words) < k:
                    continue
                cut, keys = super_kmers(hashes.of(words), k, m, common)
                cut = cut.tolist()
                for a, b, key in zip(cut[:-1], cut[1:], keys.tolist(), strict=True):
                    flush.add(doc, tag, a, b - a, key, b" ".join(words[a : b + k - 1]))
                if flush.sent > _FLUSH or len(flush.ids) > 100_000:
                    yield flush.rows(buckets)
                    flush = _Flush()
        if flush.ids:
            yield flush.rows(buckets)

    return run


def word_numbers(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lines of words with one space between -> a number for each word, equal for equal words only, and the words of each line.

    A word is taken with the byte after it, made a space everywhere: so the words lie end to end, and Arrow numbers them where they are.
    """
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    ends = data == 10
    after = np.flatnonzero(ends | (data == 32))
    lengths = np.diff(np.flatnonzero(ends[after]), prepend=-1)
    data = np.where(ends, np.uint8(32), data)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(after), [None, pa.py_buffer(np.r_[0, after + 1]), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().view(np.uint32), lengths


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k items from each place on, by doubling; the last k - 1 places hold no whole window."""
    with np.errstate(over="ignore"):
        h, width = mix(items.astype(np.uint64) + np.uint64(0xA4093822299F31D0)), 1
        kept, missing = {}, k - (1 << k.bit_length() - 1)
        while width * 2 <= k:
            if width & missing:  # the widths that k needs besides the largest
                kept[width] = h
            h = mix(h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
            width *= 2
        done = width
        for bit in sorted(kept, reverse=True):
            part, n = kept.pop(bit), len(items) - done - bit + 1
            h = mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + part[done : done + n])
            done += bit
        return h


def later_windows(items: np.ndarray, at: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Which windows (k items from ``at``, of document ``doc`` from word ``start``) repeat one that starts earlier.

    Rows of one ``doc`` with different tags are different rows: neither's windows start earlier than the other's.
    """
    h = window_hashes(items, k)[at]
    order = np.argsort(h)
    s = h[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    some = order[twice]
    out = np.zeros(len(at), bool)
    if not len(some):
        return out
    some = some[np.lexsort((start[some], tag[some], doc[some], h[some]))]
    cut = runs(h[some])
    head = np.repeat(cut[:-1], np.diff(cut))
    # the first of the same hash and row: the window's own row counts only up to where it starts
    new = np.ones(len(some), bool)
    new[1:] = (h[some[1:]] != h[some[:-1]]) | (doc[some[1:]] != doc[some[:-1]]) | (tag[some[1:]] != tag[some[:-1]])
    own = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    later = (doc[some] != doc[some[head]]) | (start[some] != start[some[own]])
    same = np.ones(len(some), bool)
    for i in range(k):
        same &= items[at[some] + i] == items[at[some[head]] + i]
    out[some] = later
    if not same.all():  # equal hashes of different words: compare the words themselves
        for r in np.unique(head[~same]):
            seen: dict[bytes, int] = {}
            own_first: dict[tuple, int] = {}
            for w in some[r : cut[np.searchsorted(cut, r, "right")]]:
                words = items[at[w] : at[w] + k].tobytes()
                out[w] = doc[w] != seen.setdefault(words, doc[w]) or start[w] != own_first.setdefault((words, doc[w], tag[w]), start[w])
    return out


_MARKS = {"owner": pa.int32()} | dict.fromkeys(("ids", "tags", "starts", "counts"), pa.binary())
_MARKS_SQL = "owner int, ids binary, tags binary, starts binary, counts binary"


def _marks(k: int, owners: int):
    """A bucket's packets -> runs of windows to remove (document, first start, windows), dealt to their documents' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for bucket in list(held):
            blobs, ids, tags, starts, m_ids, m_tags, m_starts, m_counts = ([] for _ in range(8))
            packets = held.pop(bucket)
            while packets:
                size, blob, *rest = packets.pop()
                for to, data, kind in zip((ids, tags, starts, m_ids, m_tags, m_starts, m_counts), rest, (np.int64, np.int32, np.uint32, np.int64, np.int32, np.uint32, np.uint32), strict=True):
                    to.append(np.frombuffer(data, kind))
                if size:
                    blobs.append(pa.decompress(blob, decompressed_size=size - 1, codec="zstd", asbytes=True))
            m_id, m_tag, m_start, m_count = np.concatenate(m_ids), np.concatenate(m_tags), np.concatenate(m_starts).astype(np.int64), np.concatenate(m_counts).astype(np.int64)
            if blobs:
                item, length = word_numbers(blobs)
                del blobs
                n = length - k + 1
                begin = np.cumsum(length) - length
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(begin, n) + step
                doc, tag, start = np.repeat(np.concatenate(ids), n), np.repeat(np.concatenate(tags), n), np.repeat(np.concatenate(starts).astype(np.int64), n) + step
                gone = later_windows(item, at, doc, tag, start, k)
                m_id, m_tag, m_start, m_count = np.r_[m_id, doc[gone]], np.r_[m_tag, tag[gone]], np.r_[m_start, start[gone]], np.r_[m_count, np.ones(gone.sum(), np.int64)]
            if len(m_id):
                order = np.lexsort((m_start, m_tag, m_id))
                m_id, m_tag, m_start, m_count = m_id[order], m_tag[order], m_start[order], m_count[order]
                new = np.ones(len(m_id), bool)
                new[1:] = (m_id[1:] != m_id[:-1]) | (m_tag[1:] != m_tag[:-1]) | (m_start[1:] != m_start[:-1] + m_count[:-1])
                head = np.flatnonzero(new)
                yield _dealt(m_id[head], m_tag[head], m_start[head].astype(np.uint32), np.add.reduceat(m_count, head).astype(np.uint32), owners)

    return run


def _dealt(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, owners: int) -> pa.RecordBatch:
    owner = (mix(doc.view(np.uint64) ^ tag.astype(np.uint64)) % np.uint64(owners)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    cut = runs(owner[order])
    return deal_rows([(int(owner[order[a]]), *(x[order[a:b]].tobytes() for x in (doc, tag, start, count))) for a, b in zip(cut[:-1], cut[1:], strict=True)], _MARKS)


_BY_ROW = {"id": pa.int64(), "tag": pa.int32(), "starts": pa.binary(), "counts": pa.binary()}


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[list] = [[], [], [], []]
    for batch in batches:
        for i, kind in enumerate((np.int64, np.int32, np.uint32, np.uint32)):
            parts[i] += [np.frombuffer(x, kind) for x in batch.column(i + 1).to_pylist()]
    if not parts[0]:
        return
    doc, tag, start, count = (np.concatenate(p) for p in parts)
    order = np.lexsort((start, tag, doc))
    doc, tag, start, count = doc[order], tag[order], start[order], count[order]
    cut = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1, len(doc)]
    for i in range(0, len(cut) - 1, 2000):
        yield deal_rows([(int(doc[a]), int(tag[a]), start[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cut[i : i + 2000], cut[i + 1 : i + 2001], strict=False)], _BY_ROW)


def _keep(k: int, rest: list[str]):
    """(text, starts, counts, others) -> the kept words joined by one space, both counts, and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            texts, n_words, n_removed = [], [], []
            for text, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("__text", "__starts", "__counts")), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if starts is None:
                    n_removed.append(0)
                    texts.append(b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                a, n = np.frombuffer(starts, np.uint32).astype(np.int64), np.frombuffer(counts, np.uint32)
                np.add.at(edge, np.minimum(a, len(words)), 1)
                np.add.at(edge, np.minimum(a + n + k - 1, len(words)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*rest, "kept", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4) -> DataFrame:
    """Remove each word covered by a ``k``-word window that also starts earlier.

    Earlier: in a row of smaller id, or before in the same row. Windows are judged on
    the input. -> the columns of ``docs`` (text untouched), ``kept`` (words left, joined by one
    space), ``n_words``, ``n_removed`` (long). Columns of ``docs`` with these names are replaced.

    A null, blank or short text (under k words) loses nothing; its ``kept`` is its words, '' for none. A very long text is
    cut into super-k-mers like any other. A null id counts as larger than any other; among null ids a hash of the text
    decides. Rows that share id and text start at the same places, so neither is earlier; different texts under one id are
    different rows, neither earlier than the other, and each loses what starts earlier under a smaller id or in itself (texts of one
    id are told apart by 32 bits of a hash). Other columns are kept as they are; an empty table stays empty.
    """
    if not 1 <= m <= k:
        raise ValueError("m must be from 1 to k")
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    parts = partitions_for(docs, text_col, _BUCKET_BYTES)
    common = common_grams(docs, text_col, k, m, parts, scratch)
    text_hash = F.xxhash64(text_col)
    nameless = F.lit(_LAST) - F.pmod(text_hash, F.lit(1 << 40))
    whole = F.coalesce(F.col(id_col).cast("long"), nameless)
    tag = F.shiftright(text_hash, 32).cast("int")
    packets = docs.select(whole.alias("id"), tag.alias("tag"), F.col(text_col).alias("text")).mapInArrow(tidied(_packets(k, m, parts, common)), _PACKETS_SQL)
    marks = packets.repartitionById(parts, "bucket").mapInArrow(tidied(_marks(k, parts)), _MARKS_SQL)
    marks = scratch.table("marks", marks.repartitionById(parts, "owner").mapInArrow(tidied(_by_row), "id long, tag int, starts binary, counts binary"))
    rest = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    full = docs.select(*rest, F.col(text_col).alias("__text"), whole.alias("__id"), tag.alias("__tag"))
    full = full.join(marks.toDF("__id", "__tag", "__starts", "__counts"), ["__id", "__tag"], "left").drop("__id", "__tag")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    return full.mapInArrow(tidied(_keep(k, rest)), f"{kinds}, kept string, n_words long, n_removed long")
