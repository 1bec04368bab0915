"""SimHash near-duplicates by the generalised pigeonhole principle.

Signatures of 128 bits over the set of a document's words. Correlated bits share a partition; a dynamic
program gives each partition its own threshold from estimated candidate counts; signatures that meet in a
partition are verified on all bits, and the pairs that hold are joined to groups.

The principle: if the thresholds t_i satisfy sum(t_i + 1) >= threshold + 1, two signatures within the
threshold are within t_i in some partition i (Qin et al., 2018). A partition with t_i = -1 is not probed.
Two values within 2r of each other have a value within r of both, so a partition with t_i = 2r is probed by
emitting the ball of radius r around each value: every row is a query and an entry at once, and one
grouping of the emitted keys finds all pairs. No bucket is capped. In a large bucket members are held
against leaders, and what lies between clusters is compared unless the triangle inequality excludes it,
so that thousands of near copies cost a star instead of all pairs, with the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, connected_components, cut, drop_ids, in_arrow, mix, text_steps, words, written

BITS, THRESHOLD = 128, 16
#: Costs for the dynamic program, in microseconds: of a row of a ball made and sorted, of one sent through the
#: exchange, and of a candidate pair held against the threshold.
ROW_US, SEND_US, CANDIDATE_US = 1.3, 1.0, 0.05
SMALL_BUCKET = 48
#: The bits of a partition's value that decide which task a row goes to: MIN_KEY at least, and as many more as it
#: takes to leave about 2 ** ROWS_A_KEY signatures to each key. Neighbours in the other bits are made behind the exchange.
MIN_KEY, ROWS_A_KEY = 6, 14
#: Nodes that a task's union-find holds before it starts afresh (which only sends some edges again).
FOREST_NODES = 1 << 20


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 signatures and whether the text has a word at all."""
    sigs, some = [np.zeros((0, 2), U64)], [np.zeros(0, bool)]
    for _, data, offsets in text_steps(texts):
        n = len(offsets) - 1
        h, row, _, _ = words(data, offsets)
        out = np.zeros((n, BITS), np.int32)
        # rows of a step fit 20 bits: each has a byte at least, or is one of the empty rows, which are not words
        key = (row.astype(U64) << U64(44)) | (h >> U64(20))
        key.sort()
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        row, h = (key >> U64(44)).astype(np.int64), mix(key & U64((1 << 44) - 1))
        count = np.bincount(row, minlength=n)
        for at in range(0, len(h), 1 << 16):  # so many words at once keep the bit matrix at 8 MB
            part, mine = h[at : at + (1 << 16)], row[at : at + (1 << 16)]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            packed = np.stack([mix(part), mix(part + U64(0x9E3779B97F4A7C15))], 1).view(np.uint8)
            out[mine[first]] += np.add.reduceat(np.unpackbits(packed, axis=1), first, axis=0, dtype=np.int32)
        sigs.append(np.packbits(2 * out > count[:, None], axis=1).view(U64))
        some.append(count > 0)
    return np.concatenate(sigs), np.concatenate(some)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, some = signatures(batch.column(1))
        sig = sig.view(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig[:, 0]), pa.array(sig[:, 1])], ["doc_id", "s1", "s2"])
        yield out.filter(pa.array(some))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, s1, s2); null doc_ids and texts without a word are left out."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").transform(in_arrow, _sign, "doc_id long, s1 long, s2 long")


def _bits(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([s1, s2], 1).astype(np.int64).view(np.uint8), axis=1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS + 1, BITS + 1), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            b = _bits(part.column(0).to_numpy(), part.column(1).to_numpy()).astype(np.float32)
            b = np.concatenate([b, np.ones((len(b), 1), np.float32)], 1)
            total += np.rint(b.T @ b).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "n"])


def moments(distinct: DataFrame) -> np.ndarray:
    """Counts of each pair of bits being set together, the last row and column being a constant 1; over all signatures."""
    rows = distinct.select("s1", "s2").transform(in_arrow, _moments, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((BITS + 1) ** 2, np.float64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(BITS + 1, BITS + 1)


def group_bits(second: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal width, each grown from a seed by the strongest mean correlation to it."""
    n = max(second[-1, -1], 1)
    mean = second[-1, :-1] / n
    var = np.maximum(mean * (1 - mean), 1e-9)
    corr = np.abs((second[:-1, :-1] / n - np.outer(mean, mean)) / np.sqrt(np.outer(var, var)))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        width = BITS * (i + 1) // parts - BITS * i // parts
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group, pull = [seed], corr[seed].copy()
        left.discard(seed)
        while len(group) < width:
            nxt = max(sorted(left), key=lambda b: pull[b])
            group.append(nxt)
            left.discard(nxt)
            pull += corr[nxt]
        groups.append(sorted(group))
    return groups


def _within(disagree: np.ndarray) -> np.ndarray:
    """P(at most t bits differ) for t = 0, 1, ...; bits taken as independent."""
    p = np.zeros(len(disagree) + 1)
    p[0] = 1
    for q in disagree:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def key_bits(width: int, n: float) -> int:
    return min(width, max(MIN_KEY, int(np.ceil(np.log2(max(n, 2)))) - ROWS_A_KEY))


def allocate(second: np.ndarray, threshold: int = THRESHOLD, n: float | None = None) -> tuple[list[list[int]], list[int]]:
    """Partitions of bits and their thresholds, of least estimated cost over all numbers of partitions.

    Candidates are estimated for n signatures (those of second, unless given) from how often each bit is set. A
    partition's bits are ordered by balance, those nearest to even last.
    """
    mean = second[-1, :-1] / max(second[-1, -1], 1)
    n = max(second[-1, -1] if n is None else n, 1)
    disagree, best = 2 * mean * (1 - mean), None
    for parts in range(3, threshold + 2):
        groups = group_bits(second, parts)
        options = []  # per partition: (threshold, cost)
        for g in groups:
            within, w, own = _within(disagree[g]), len(g), [(-1, 0.0)]
            for r in range(3):
                rows = _ball(w, r) * ROW_US + _ball(key_bits(w, n), r) * SEND_US
                pairs = n * n / 2 * within[min(2 * r, w)] * comb(2 * r, r)
                own.append((2 * r, n * rows + pairs * CANDIDATE_US))
            options.append(own)
        need = threshold + 1
        least = {0: (0.0, ())}
        for own in options:
            now: dict[int, tuple] = {}
            for have, (cost, chosen) in least.items():
                for t, c in own:
                    to = min(need, have + t + 1)
                    if to not in now or cost + c < now[to][0]:
                        now[to] = (cost + c, (*chosen, t))
            least = now
        if need in least and (best is None or least[need][0] < best[0]):
            best = (least[need][0], groups, list(least[need][1]))
    even = np.abs(mean - 0.5)
    return [sorted(g, key=lambda b: (-even[b], b)) for g in best[1]], best[2]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)], dtype=np.int64)


def _emitter(groups: list[list[int]], thresholds: list[int], keys: list[int]):
    """Rows (ball, node, s1, s2): of a value's ball only what differs in its key bits, with the radius left for the others."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = []
        for i, (g, t, k) in enumerate(zip(groups, thresholds, keys)):
            if t >= 0:
                high = _masks(k, t // 2)
                left = np.int64(t // 2) - np.bitwise_count(high)
                probes.append((np.array(g), high << (len(g) - k), (np.int64(i) << np.int64(57)) | (left << np.int64(55))))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node, s1, s2 = (part.column(k).to_numpy() for k in range(3))
                bits = _bits(s1, s2).astype(np.int64)
                for g, masks, tag in probes:
                    value = bits[:, g] @ (np.int64(1) << np.arange(len(g), dtype=np.int64))
                    ball = ((value[:, None] ^ masks[None, :]) | tag[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(ball), *(pa.array(np.repeat(x, len(masks))) for x in (node, s1, s2))], ["ball", "node", "s1", "s2"])

    return emit


class _Forest:
    """Union-find over the nodes a task has seen in pairs; says which edges join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        if len(a):
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            keep = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            for x, y in zip(lo[keep].tolist(), hi[keep].tolist()):
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    out.append((y, x))
        return out

    def bound(self) -> None:
        if len(self.up) > FOREST_NODES:
            self.up.clear()


def _distance(a1, a2, b1, b2) -> np.ndarray:
    return np.bitwise_count(a1 ^ b1).astype(np.int16) + np.bitwise_count(a2 ^ b2)


def _large(node: np.ndarray, s1: np.ndarray, s2: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what all pairs within the threshold connect, among one bucket's members."""
    node, at = np.unique(node, return_index=True)
    s1, s2 = s1[at], s2[at]
    left, src, dst, clusters = np.arange(len(node)), [], [], []
    while len(left):
        lead = left[0]
        d = _distance(s1[left], s2[left], s1[lead], s2[lead])
        near = d <= threshold
        mine = left[near]
        src.append(node[mine])
        dst.append(np.full(len(mine), node[lead]))
        clusters.append((lead, mine, int(d[near].max())))
        left = left[~near]
    lead1, lead2 = s1[[c[0] for c in clusters]], s2[[c[0] for c in clusters]]
    radius = np.array([c[2] for c in clusters])
    joined = _Forest()
    for i, (lead, mine, r) in enumerate(clusters):
        gap = _distance(lead1[i + 1 :], lead2[i + 1 :], s1[lead], s2[lead])
        for j in np.flatnonzero(gap <= threshold + r + radius[i + 1 :]) + i + 1:
            other = clusters[j][1]
            if joined.root(i) == joined.root(int(j)):
                continue
            for k in range(0, len(mine), 1024):
                m = mine[k : k + 1024]
                d = _distance(s1[m][:, None], s2[m][:, None], s1[other][None, :], s2[other][None, :])
                hit = np.argwhere(d <= threshold)
                if len(hit):
                    src.append(node[m[hit[:1, 0]]])
                    dst.append(node[other[hit[:1, 1]]])
                    joined.add(np.array([i]), np.array([int(j)]))
                    break
    src, dst = np.concatenate(src), np.concatenate(dst)
    return src[src != dst], dst[src != dst]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined to tables of at least so many rows; none is empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _bucketer(threshold: int):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), None

        def done(key, node, s1, s2) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(edge, len(key)))
            out = []
            for at in np.flatnonzero(size > SMALL_BUCKET):
                a, b = edge[at], edge[at] + size[at]
                out += forest.add(*_large(node[a:b], s1[a:b], s2[a:b], threshold))
            keep = np.repeat((size > 1) & (size <= SMALL_BUCKET), size)
            key, node, s1, s2 = key[keep], node[keep], s1[keep], s2[keep]
            for step in range(1, SMALL_BUCKET):
                near = np.flatnonzero(key[step:] == key[:-step])
                if not len(near):
                    break
                d = _distance(s1[near], s2[near], s1[near + step], s2[near + step])
                near = near[d <= threshold]
                a, b = node[near], node[near + step]
                out += forest.add(a[a != b], b[a != b])
            forest.bound()
            return out

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["src", "dst"])

        for batch in _gathered(batches, 1 << 14):
            # unsigned, as bitwise_count takes the absolute value of a signed number
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), *(batch.column(k).to_numpy().view(U64) for k in (2, 3))]
            if held is not None:
                new = [np.concatenate([h, x]) for h, x in zip(held, new)]
            last = np.searchsorted(new[0], new[0][-1])  # the last bucket may go on in the next batch
            held = [x[last:] for x in new]
            if last:
                yield batch_of(done(*(x[:last] for x in new)))
        if held is not None:
            yield batch_of(done(*held))

    return buckets


def near_pairs(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(src, dst) edges that connect every two nodes of distinct(node, s1, s2) within the threshold, and no others."""
    second = moments(distinct)
    groups, thresholds = allocate(second, threshold)
    keys = [key_bits(len(g), second[-1, -1]) for g in groups]
    balls = distinct.select("node", "s1", "s2").transform(in_arrow, _emitter(groups, thresholds, keys), "ball long, node long, s1 long, s2 long")
    value, part = F.col("ball").bitwiseAND(~(3 << 55)), F.shiftright("ball", 57)
    left = F.shiftright("ball", 55).bitwiseAND(3)
    low = [len(g) - k for g, k in zip(groups, keys)]
    shift = F.element_at(F.array(*map(F.lit, low)), part.cast("int") + 1)
    # a value's neighbours in its low bits share its key bits, so they are made behind the exchange
    flips = F.array(*(F.array(*(F.lit(int(m)).cast("bigint") for m in _masks(w, r))) for w in low for r in range(3)))
    flip = F.explode(F.element_at(flips, (part * 3 + left).cast("int") + 1)).alias("flip")
    rows = balls.repartition(part, F.call_function("shiftright", value, shift)).select(value.alias("value"), flip, "node", "s1", "s2")
    keyed = rows.select(F.col("value").bitwiseXOR(F.col("flip")).alias("key"), "node", "s1", "s2")
    return keyed.sortWithinPartitions("key").transform(in_arrow, _bucketer(threshold), "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, group_size) for each document that has a near copy and is not the one to keep.

    docs has doc_id and text; other columns are ignored. Two documents are near copies if their signatures
    differ in at most threshold of 128 bits; groups are connected through near copies, exactly, and the
    smallest doc_id of a group is kept. group_size counts its distinct doc_ids. Documents without a copy
    give no row. Null doc_ids and texts that are null or have no letter or digit have no copies. Repeated
    rows of one doc_id are the same document. An empty table gives no rows. Every word of a text counts,
    however long it is; short texts are near copies only if their word sets nearly agree.
    """
    signed = written(sign(docs), "signatures")
    distinct = cut(signed.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    member = connected_components(near_pairs(distinct, threshold))
    grouped = distinct.join(member, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("kept_doc_id"))
    of_doc = signed.distinct().join(grouped, ["s1", "s2"]).groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id"))
    size = of_doc.groupBy("kept_doc_id").agg(F.count("*").alias("group_size"))
    return of_doc.where("doc_id <> kept_doc_id").join(size, "kept_doc_id").select("doc_id", "kept_doc_id", "group_size")


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the documents that near_duplicates would drop; null doc_ids and wordless texts stay."""
    return drop_ids(docs, near_duplicates(docs, threshold).select("doc_id"))
