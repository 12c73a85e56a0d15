"""Set-similarity join of texts on word n-grams.

Rare-first prefix filtering with length, positional and suffix filters; a pair is
verified once. Texts become sets of 64-bit shingle hashes; equal sets become one
node, named by a hash of the set, so groups of copies never meet in the join.

0.  *Heads.* The head of a set is its smallest hashes: a little more than the quarter that two
    linked sets may lack. Two linked sets share a good part of their heads, so a set whose head
    shares less with all others cannot have a link; with text that is mostly original three
    sets of four go here, and with them most of what would travel: a shingle takes its node's
    name along, as in many buckets few shingles of a set meet. Heads travel without sizes. The
    sets left are told by a Bloom filter of their texts, which lets some more in but none out.
1.  *Counts.* Each task reads the texts left and deals their shingles to buckets by the
    top hash bits, in packed arrays with one node name per run, not one row per shingle.
    A bucket counts, for each shingle, the different sets that hold it.
2.  *Prefixes.* Shingles that two sets share go back to their nodes. All others
    come first in the global order (frequency, shingle) and can never match, so a
    set whose prefix holds only those drops out here. With text that is mostly
    original this leaves only near copies.
3.  *Candidates.* Nodes meet on prefix shingles under the length and positional
    filters. Pairs inside one known component need no proof: the most central
    node of each shingle's list is compared with the others first, components are
    joined, and only shingles whose nodes are still in different components go on,
    at last with all pairs across components. A group of thousands of near copies
    costs about as many comparisons as it has members.
4.  *Verification.* Each new pair meets once with both sets; a suffix filter
    bounds the overlap before the exact count.
5.  *Link counts.* Which links steps 3 and 4 prove depends on the order, their
    transitive closure does not: any pair left out lies within one component. So
    the nodes of each component are cut into blocks, each two blocks meet in a
    cell, and a cell counts the overlaps of all its pairs: every link of two
    different sets is counted once. A component of m nodes costs m * m / 2
    overlaps, but no more rows than m times its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import WordHashes, deal_rows, mix, runs, slices, tidied, windows
from linkloom.operators.graph import connected_components
from linkloom.session import Scratch, partitions_for, shuffle_partitions

_LOW = np.uint64((1 << 48) - 1)
_FLUSH = 400_000
_BLOCK_NODES, _BLOCK_SHINGLES = 1000, 500_000
_HEAD_STEP, _HEAD_BYTES, _BUCKET_SHINGLES = 16, 30 << 20, 1_300_000
_FILTER_BITS, _FILTER_BLOCK, _FILTER_BLOCKS = 16, 1 << 15, 1 << 13


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(windows(hashes.of(words), k))


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set, whatever its order; 0 for the empty one."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        one = mix(shingles + np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
        two = mix(shingles ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
        return int(mix(np.array([one], np.uint64) ^ mix(np.array([two], np.uint64))).view(np.int64)[0])


def head_length(n: int, num: int, den: int) -> int:
    """How many of n shingles, the smallest first, make a set's head.

    Sets x and y that are linked share s >= ceil(num * max(|x|, |y|) / den) shingles. For any e <= s, the e smallest shared ones are
    among the first |x| - s + e of x, and of y likewise. With e the smaller of both sets' ``1 + n // step``, both heads hold these e.
    """
    least = -(-n * num // den)
    return n - least + min(1 + n // _HEAD_STEP, least)


def head_hits(num: int, den: int) -> F.Column:
    """How many shingles of its head a set of ``n`` must share at least to have a link: the e above for the smallest set that it can be linked with."""
    least = f"((n * {num} + {den - 1}) div {den})"
    return F.expr(f"least(1 + {least} div {_HEAD_STEP}, ({least} * {num} + {den - 1}) div {den})")


class HashFilter:
    """A Bloom filter of 64-bit hashes in blocks that are made apart: 2 bytes a hash up to 16 million, 32 MB at most; then it lets more in."""

    def __init__(self, blocks: int):
        self.blocks, self.bits = blocks, np.zeros((blocks, _FILTER_BLOCK // 8), np.uint8)

    @staticmethod
    def places(hashes: np.ndarray) -> list[np.ndarray]:
        mixed = mix(hashes.view(np.uint64))
        return [(mixed >> np.uint64(15 * i)).astype(np.int64) % _FILTER_BLOCK for i in range(4)]

    @classmethod
    def of(cls, near: DataFrame, size: int) -> HashFilter:
        found = cls(min(max(1, -(-size * _FILTER_BITS // _FILTER_BLOCK)), _FILTER_BLOCKS))
        blocks = near.select(F.pmod("hash", F.lit(found.blocks)).cast("int").alias("block"), "hash")
        blocks = blocks.repartition(min(found.blocks, shuffle_partitions(near.sparkSession)), "block").mapInArrow(tidied(_filter_blocks), "block int, bits binary")
        for row in blocks.collect():
            found.bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        return found

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        block, out = hashes % self.blocks, np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        block, places = np.asarray(batch.column(0)), HashFilter.places(np.asarray(batch.column(1)))
        order = np.argsort(block, kind="stable")
        cut = runs(block[order])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = bits.setdefault(int(block[order[a]]), np.zeros(_FILTER_BLOCK, np.uint8))
            for at in places:
                own[at[order[a:b]]] = 1
    for block, own in bits.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["block", "bits"])


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.uint32)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_PACKETS = "bucket int, nodes binary, sizes binary, counts binary, tokens binary, facts binary"
_PACKET_KINDS = {"bucket": pa.int32()} | dict.fromkeys(("nodes", "sizes", "counts", "tokens", "facts"), pa.binary())
# what is known of a row: its number within a flush is its place in the flush's ids
_FACT = np.dtype([("id", "<i8"), ("known", "<i8"), ("hash", "<i8"), ("n", "<i8"), ("name", "<i8")])


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each shingle by its top 32 bits: rising with the shingle, and as many in use as there are."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _packets(k: int, buckets: int, head: tuple[int, int] | None = None, among: HashFilter | None = None):
    """(id, hash, text) -> shingles dealt to buckets, and a record of facts for each row. Copies within a flush are sent once.

    head: (num, den) deals only the sets' heads, mixed anew as they are no even sample of the hashes, and no sizes.
    among: only texts whose hash it holds, and no facts.
    Up to 65,536 buckets a bucket tells at least a shingle's top bits, and 48 bits of it travel; beyond that all 64 do.
    """
    packed = _pack48 if buckets <= 1 << 16 else lambda x: x.astype("<u8").tobytes()

    def deal(nodes: list, sets: list) -> list[tuple]:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        bucket = bucket_of(tokens, buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        names, sizes = np.array(nodes, np.int64), np.array([len(s) for s in sets], np.uint32)
        cut, rows = runs(bucket), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            r = runs(owner[a:b])
            own = owner[a:b][r[:-1]]
            rows.append((int(bucket[a]), names[own].tobytes(), None if head else _narrow(sizes[own]), _narrow(np.diff(r)), packed(tokens[a:b]), None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, nodes, sets, held, seen, facts = WordHashes(), [], [], 0, set(), []

        def flush():
            # facts go along with the packets, to a bucket chosen by the first of them
            rows = deal(nodes, sets) if nodes else []
            known = np.array(facts, _FACT)
            to = int(mix(known["hash"][:1].astype(np.uint64))[0] % np.uint64(buckets)) if len(known) else 0
            return deal_rows([*rows, *([(to, None, None, None, None, known.tobytes())] if facts else [])], _PACKET_KINDS)

        if among:
            batches = (b.filter(pa.array(among.holds(np.asarray(b.column("hash"))))) for b in batches)
        for batch in slices(batches, "text"):
            for key, h, text in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "text")), strict=True):
                s = shingle_set((text or "").encode().lower().split(), k, hashes)
                name = set_name(s)
                if not among:
                    facts.append((key or 0, key is not None, h, len(s), name))
                if len(s) and name not in seen:
                    s = mix(s[: head_length(len(s), *head)]) if head else s
                    seen.add(name), nodes.append(name), sets.append(s)
                    held += len(s)
                if held >= _FLUSH or len(facts) >= _FLUSH // 8:
                    yield flush()
                    nodes, sets, held, facts = [], [], 0, []
                    if len(seen) > 1_000_000:
                        seen.clear()
        if facts or nodes:
            yield flush()

    return run


def _unpacked_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            known = np.frombuffer(data, _FACT)
            key = pa.array(known["id"], mask=known["known"] == 0)
            yield pa.record_batch([key, *(pa.array(np.ascontiguousarray(known[c])) for c in ("hash", "n", "name"))], ["id", "hash", "n", "name"])


_SHARED = "owners int, nodes binary, sizes binary, counts binary, tokens binary, dfs binary, facts binary"
_SHARED_KINDS = {"owners": pa.int32()} | dict.fromkeys(("nodes", "sizes", "counts", "tokens", "dfs", "facts"), pa.binary())


def _shared(owners: int, buckets: int, heads: bool = False):
    """A bucket's packets -> the shingles in two sets or more, with their counts, dealt to their nodes' partitions; facts go through.

    heads: of each node only how many of its shingles are shared.
    """
    unpacked = _unpack48 if buckets <= 1 << 16 else lambda data: np.frombuffer(data, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            facts = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] is not None:
                    facts.append((-1, None, None, None, None, None, row[5]))
                else:
                    held.setdefault(row[0], []).append(row[1:5])
            if facts:
                yield deal_rows(facts, _SHARED_KINDS)
        for bucket in list(held):
            packets = held.pop(bucket)
            node = np.concatenate([np.frombuffer(p[0], np.int64) for p in packets])
            size = None if heads else np.concatenate([_widened(p[1], len(p[0]) // 8) for p in packets])
            count = np.concatenate([_widened(p[2], len(p[0]) // 8) for p in packets])
            token = np.concatenate([unpacked(p[3]) for p in packets])
            del packets
            run_of = np.repeat(np.arange(len(node), dtype=np.int32), count)
            order = np.argsort(token)
            token, run_of = token[order], run_of[order]
            twice = np.zeros(len(token), bool)
            twice[1:] = token[1:] == token[:-1]
            twice[:-1] |= twice[1:]
            token, run_of = token[twice], run_of[twice]
            if not len(token):
                continue
            # a set that several tasks sent counts once
            order = np.lexsort((node[run_of], token))
            token, run_of = token[order], run_of[order]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (node[run_of[1:]] != node[run_of[:-1]])
            token, run_of = token[first], run_of[first]
            cut = runs(token)
            df = np.repeat(np.diff(cut), np.diff(cut))
            token, run_of, df = token[df > 1], run_of[df > 1], df[df > 1].astype(np.uint32)
            if not len(token):
                continue
            who = node[run_of]
            owner = (mix(who.view(np.uint64)) % np.uint64(owners)).astype(np.int32)
            order = np.lexsort((who, owner))
            owner, who, df = owner[order], who[order], df[order]
            token = token[order] if buckets > 1 << 16 else token[order] | np.uint64(bucket) << np.uint64(48)
            cut, rows = runs(owner), []
            size = None if heads else size[run_of[order]]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                r = runs(who[a:b])
                at = a + r[:-1]
                if heads:
                    rows.append((int(owner[a]), who[at].tobytes(), None, _narrow(np.diff(r)), None, None, None))
                    continue
                rows.append((int(owner[a]), who[at].tobytes(), size[at].tobytes(), np.diff(r).astype(np.uint32).tobytes(), token[a:b].tobytes(), df[a:b].tobytes(), None))
            yield deal_rows(rows, _SHARED_KINDS)

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of shared shingles by bucket -> by node."""
    nodes, hits = [], []
    for batch in batches:
        for node, n in zip(batch.column("nodes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            nodes.append(np.frombuffer(node, np.int64))
            hits.append(_widened(n, len(nodes[-1])))
    if nodes:
        names, slot = np.unique(np.concatenate(nodes), return_inverse=True)
        yield pa.record_batch([pa.array(names), pa.array(np.bincount(slot, np.concatenate(hits)).astype(np.int64))], ["node", "hits"])


_SETS = "node long, n int, alone int, shared binary, prefix array<long>"


def _sets(num: int, den: int):
    """Shared shingles by node -> nodes that may have a link: shared shingles in hash order, and those of the prefix in global order.

    alone: how many of the node's n shingles no other set holds; they come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], [], [], [], []]
        for batch in batches:
            for i, kind in enumerate((np.int64, np.uint32, np.uint32, np.uint64, np.uint32)):
                parts[i] += [np.frombuffer(x, kind) for x in batch.column(i + 1).to_pylist()]
        if not parts[0]:
            return
        node, size, count, token, df = (np.concatenate(p) for p in parts)
        del parts
        # drop nodes with too few shared shingles before sorting the rest
        names, at, slot = np.unique(node, return_index=True, return_inverse=True)
        shared = np.bincount(slot, count).astype(np.int64)
        n = size[at].astype(np.int64)
        keep = shared * den >= n * num
        kept = keep[slot]
        chosen = np.repeat(kept, count)
        slot, token, df = np.repeat(slot[kept], count[kept]), token[chosen], df[chosen]
        order = np.lexsort((token, df, slot))
        slot, token = slot[order], token[order]
        cut, out = runs(slot), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = slot[a]
            alone = n[s] - (b - a)
            prefix = n[s] - -(-n[s] * num // den) + 1
            out.append((int(names[s]), int(n[s]), int(alone), np.sort(token[a:b]).tobytes(), token[a : a + prefix - alone].view(np.int64)))
            if len(out) == 500:
                yield _set_rows(out)
                out = []
        if out:
            yield _set_rows(out)

    return run


def _set_rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "n", "alone", "shared", "prefix"])


def hamming_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the elements in just one of two sorted sets: halve ``y``, cut ``x`` at the same value, compare sizes."""
    low = abs(len(x) - len(y))
    if low > most or not depth or not len(x) or not len(y):
        return low
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = at < len(x) and x[at] == y[mid]
    halves = (x[:at], y[:mid]), (x[at + hit :], y[mid + 1 :])
    left, right = (abs(len(p) - len(q)) for p, q in halves)
    miss = 0 if hit else 1
    if left + right + miss <= most:
        left = hamming_bound(*halves[0], most - right - miss, depth - 1)
    if left + right + miss <= most:
        right = hamming_bound(*halves[1], most - left - miss, depth - 1)
    return left + right + miss


def overlap_if_linked(x: np.ndarray, y: np.ndarray, nx: int, ny: int, num: int, den: int) -> int:
    """Shared elements if the Jaccard similarity is at least num/den, else -1."""
    need = -(-num * (nx + ny) // (num + den))
    most = nx + ny - 2 * need - (nx - len(x)) - (ny - len(y))
    if most < 0 or hamming_bound(x, y, most) > most:
        return -1
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    same = int((x[at] == y).sum()) if len(x) else 0
    return same if same >= need else -1


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, na, nb, x, y in zip(*(batch.column(i) for i in range(6)), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                out.append((a.as_py(), b.as_py(), overlap_if_linked(x, y, na.as_py(), nb.as_py(), num, den)))
            if out:
                a, b, same = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.int32())], ["a", "b", "same"])

    return run


def _close(x: str, y: str, num: int, den: int) -> F.Column:
    """Length and positional filters for entries x and y of one shingle's list."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (rest.cast("long") * (num + den) >= (nx.cast("long") + ny) * num)


def overlaps(x: list[np.ndarray], y: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Shared elements of each set in x with each in y."""
    owner_x, owner_y = (np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y))
    x, y = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(x, y)
    out = np.zeros((owner_x.max(initial=-1) + 1, owner_y.max(initial=-1) + 1), np.int64)
    sides = []
    for tokens, owner in ((x, owner_x), (y, owner_y)):
        at = np.searchsorted(both, tokens)
        at[at == len(both)] = 0
        held = both[at] == tokens if len(both) else np.zeros(len(tokens), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], owner[held][order]))
    for low in range(0, len(both), width):
        grids = []
        for (at, owner), rows in zip(sides, out.shape, strict=True):
            a, b = np.searchsorted(at, (low, low + width))
            grid = np.zeros((rows, min(width, len(both) - low)), np.float32)
            grid[owner[a:b], at[a:b] - low] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _count_links(num: int, den: int):
    """Cells, row by row and sorted -> for each node the copies of the nodes it is linked with in this cell."""

    def count(i: int, j: int, rows: list) -> pa.RecordBatch:
        sides = [[r for r in rows if r[0] == own] for own in (i, j)]
        names, sizes, copies = ([np.array([r[c] for r in side], np.int64) for side in sides] for c in (1, 2, 3))
        if not len(names[0]) or not len(names[1]):
            return pa.record_batch([pa.array([], pa.int64())] * 2, ["node", "linked"])
        same = overlaps(*([np.frombuffer(r[4], np.uint64) for r in side] for side in sides))
        linked = same * (num + den) >= num * (sizes[0][:, None] + sizes[1][None, :])
        if i == j:
            np.fill_diagonal(linked, False)
            out = names[0], linked @ copies[0]
        else:
            out = np.concatenate(names), np.concatenate([linked @ copies[1], linked.T @ copies[0]])
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], ["node", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != cell:
                    if rows:
                        yield count(*cell[1:], rows)
                    cell, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield count(*cell[1:], rows)

    return run


def _link_counts(sets: DataFrame, labels: DataFrame, nodes: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """-> node, linked: documents of other sets that the node's documents are linked with."""
    light = labels.join(sets.select("node", "n"), "node").join(nodes.select("node", "copies"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / _BLOCK_NODES, F.sum("n") / _BLOCK_SHINGLES))
    sized = light.groupBy("label").agg(F.count("*").alias("m"), blocks.cast("int").alias("blocks")).where("m > 1").select("label", "blocks")
    dealt = light.join(sized, "label").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.join(sets.select("node", "shared"), "node").select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "copies", "shared")
    cells = cells.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j")
    return cells.mapInArrow(tidied(_count_links(num, den)), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: tuple[int, int] = (3, 4), rounds: int = 2, count_links: bool = True) -> DataFrame:
    """Link texts whose sets of word k-grams have a Jaccard similarity of at least ``similarity``.

    -> one row per input row: the id, ``n_shingles`` (set size, long), ``component_id`` (smallest id that links
    reach, its own included), ``n_links`` (other rows that the row is linked with, copies included), ``set_id`` (equal for
    equal sets), ``group`` (equal within a component, not null where there are shingles), ``text_hash`` (xxhash64).

    ASCII letters are lower-cased. A text of fewer than k words is one shingle of all of them; a null or blank text has
    none, links with nothing and is its own component. A very long text is one set like any other. Rows that repeat, or share an
    id, are compared as rows, each by its own text. A null id is ignored by the minimum, and its row links like
    any other; a component of null ids only has a null component_id. Other columns of ``docs`` are not looked at. An empty table
    has no rows. Sets are told apart by a 64-bit name: among n different sets about n * n / 2 ** 65 pairs would
    be taken for equal, less than one up to some 10 ** 9 sets.

    rounds: comparisons with a central node before all pairs across components.
    count_links: without it there is no ``n_links``, and only as many links are proven as the components need.
    """
    spark, (num, den) = docs.sparkSession, similarity
    if not 0 < num <= den:
        raise ValueError("similarity must be over 0 and at most 1")
    scratch = Scratch(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))

    # facts of rows travel with the packets of the heads
    parts = partitions_for(docs, text_col, _HEAD_BYTES)
    owners = max(shuffle_partitions(spark), parts // 8)
    packets = texts.mapInArrow(tidied(_packets(k, parts, head=similarity)), _PACKETS)
    heads = scratch.table("heads", packets.repartitionById(parts, "bucket").mapInArrow(tidied(_shared(owners, parts, heads=True)), _SHARED))
    facts = scratch.table("facts", heads.where("owners < 0").select("facts").mapInArrow(tidied(_unpacked_facts), "id long, hash long, n long, name long"))
    nodes = scratch.table("nodes", facts.where("n > 0").groupBy(F.col("name").alias("node")).agg(F.min("id").alias("lowest"), F.count("*").alias("copies"), F.min("hash").alias("hash"), F.max("n").alias("n")))
    hits = heads.where("owners >= 0").select("owners", "nodes", "counts").repartitionById(owners, "owners").mapInArrow(tidied(_hits), "node long, hits long")
    near = scratch.table("near", nodes.join(hits, "node").where(F.col("hits") >= head_hits(num, den)).select("hash", "n"))
    nodes = nodes.drop("hash", "n")

    # one text of each set left, and those that the filter takes for one, are read again
    many, shingles = near.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    among = HashFilter.of(near, many)
    parts = max(shuffle_partitions(spark), -(-shingles // _BUCKET_SHINGLES))
    packets = texts.mapInArrow(tidied(_packets(k, parts, among=among)), _PACKETS).repartitionById(parts, "bucket")
    shared = packets.mapInArrow(tidied(_shared(parts, parts)), _SHARED).drop("facts").repartitionById(parts, "owners")
    sets = scratch.table("sets", shared.mapInArrow(tidied(_sets(num, den)), _SETS))

    # only nodes with a prefix left can have links; a component's label is its smallest node, which is never null
    labels = scratch.table("labels", sets.select("node", F.col("node").alias("label")))
    first = labels
    posts = scratch.table("posts", sets.select("node", "n", "alone", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("alone")))
    links = known = None
    for r in range(rounds + 1):
        here = posts.join(labels, "node")
        split = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
        posts = scratch.table("posts", here.join(split, "token").select(*posts.columns, "label"))
        if posts.isEmpty():
            break  # every shingle's nodes are in one component
        if r < rounds:
            # round 0: the node with the smallest share of its own shingles; later: that of a component chosen anew
            rank = F.struct(*([F.xxhash64("label", F.lit(r))] if r else []), (F.col("alone") / F.col("n")).alias("own"), "node")
            lead = posts.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "label"), rank).alias("y")).select("token", "y.*")
        else:
            lead = posts
        x, y = posts.alias("x"), lead.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label") if r < rounds else F.col("x.label") < F.col("y.label")) & _close("x", "y", num, den))
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = scratch.table("pairs", pairs)
        known = pairs if known is None else known.unionByName(pairs)
        side = sets.select("node", F.col("n").alias("size"), "shared")
        full = pairs.join(side.toDF("a", "na", "xa"), "a").join(side.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb")
        proven = scratch.table("links", full.mapInArrow(tidied(_verify(num, den)), "a long, b long, same int").where("same >= 0"))
        posts = posts.drop("label")
        if proven.isEmpty():
            continue
        links = proven if links is None else links.unionByName(proven)
        labels = scratch.table("labels", connected_components(first, links, scratch))

    members = labels.join(nodes, "node")
    lowest = members.groupBy("label").agg(F.min("lowest").alias("component"))
    best = nodes.join(labels, "node", "left").join(lowest, "label", "left").select("node", "copies", F.when(F.col("label").isNull(), F.col("lowest")).otherwise(F.col("component")).alias("component"), F.coalesce("label", "node").alias("group"))
    if count_links:
        best = best.join(scratch.table("counts", _link_counts(sets, labels, nodes, parts, num, den)), "node", "left")
    out = facts.join(best, (F.col("name") == F.col("node")) & (F.col("n") > 0), "left")
    some = F.col("n") > 0
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        *([F.when(some, F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(0).alias("n_links")] if count_links else []),
        F.when(some, F.col("name")).alias("set_id"),
        F.when(some, F.col("group")).alias("group"),
        F.col("hash").alias("text_hash"),
    )
