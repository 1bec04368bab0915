"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the benchmark's words; a randomised SVD, computed over every
passage in distributed passes, gives the latent space; passages near a benchmark piece by cosine are candidates,
which the longest common subsequence of words and a check of the piece's answer (its last sentence) confirm.

A document is a sequence of word numbers throughout, -1 standing for words the benchmark doesn't use, written
once to the shared folder: the text is read and cut into words a single time. Nothing is shuffled but sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, drop_ids, in_arrow, text_steps, words, written

#: Words of a passage and of the step between passages; latent dimensions and the extra ones of the sketch;
#: least cosine of a candidate.
WINDOW, STEP, RANK, EXTRA, COSINE, SEED = 48, 24, 240, 16, 0.3, 11
#: Share of a piece's words in its longest common subsequence with the passage: enough alone, or enough if the
#: answer's is at least ANSWER. Pieces under SHORT words must be there whole.
SURE, LIKELY, ANSWER, SHORT, PIECE = 0.75, 0.5, 0.8, 8, 60
#: Characters of the benchmark that are searched for in one pass over the documents; a larger one takes more passes.
GROUP_CHARS = 4 << 20


@dataclass
class Bench:
    """The benchmark in numbers: its vocabulary's hashes in order, and per piece the item, words and answer's start."""

    vocabulary: np.ndarray
    items: np.ndarray
    pieces: list[np.ndarray]
    answers: list[int]


def prepare(benchmark: DataFrame) -> Bench:
    """A group of the benchmark, which fits the driver's memory, on the driver. Null ids and texts and wordless texts are left out."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").collect()
    hashes, items, answers = [], [], []
    for r in rows:
        data = r["text"].encode()
        h, _, start, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        if not len(h):
            continue
        ends = [m.end() for m in re.finditer(rb"[.!?]\s+", data)]
        last = int(np.searchsorted(start, ends[-1])) if ends else 0
        parts = -(-len(h) // PIECE)
        for k in range(parts):
            a, b = len(h) * k // parts, len(h) * (k + 1) // parts
            hashes.append(h[a:b])
            items.append(r["item_id"])
            answers.append(min(max(last - a, 0), b - a))
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
    return Bench(vocabulary, np.array(items, np.int64), [np.searchsorted(vocabulary, h).astype(np.int32) for h in hashes], answers)


def _numberer(vocabulary: np.ndarray):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)
        maybe[(vocabulary >> U64(44)).astype(np.int64)] = True
        kind = "<i2" if len(vocabulary) < 32767 else "<i4"
        for batch in batches:
            for first, data, offsets in text_steps(batch.column(1)):
                h, row, _, _ = words(data, offsets)
                ids = np.full(len(h), -1, kind)
                look = np.flatnonzero(maybe[(h >> U64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, h[look]), len(vocabulary) - 1)
                ids[look] = np.where(vocabulary[at] == h[look], at, -1)
                n = len(offsets) - 1
                edge = np.searchsorted(row, np.arange(n + 1)) * ids.itemsize
                binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), binary.cast(pa.binary())], ["doc_id", "ids"])

    return number


def number(docs: DataFrame, bench: Bench) -> DataFrame:
    """(doc_id, ids): each document's words as numbers of the benchmark's vocabulary, -1 for others."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").transform(in_arrow, _numberer(bench.vocabulary), "doc_id long, ids binary")


def _sequences(column: pa.Array, size: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, numbers, offsets in numbers) of runs of rows with about step bytes."""
    kind = np.dtype("<i2" if size < 32767 else "<i4")
    for first, data, offsets in text_steps(column, step):
        yield first, np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize


def _cells(ids: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, word) of each weighty word, distinct in its cell of STEP words, and per document its first cell; cells end with documents."""
    length = np.diff(offsets)
    cells = (length + STEP - 1) // STEP
    first = np.append(0, np.cumsum(cells))
    at = np.flatnonzero(ids >= 0)
    at = at[weight[ids[at]] > 0]
    doc = np.searchsorted(offsets, at, side="right") - 1
    cell = first[doc] + (at - offsets[doc]) // STEP
    key = np.unique(cell * np.int64(len(weight)) + ids[at])
    return key // len(weight), key % len(weight), first, cells


def _sums(cell: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, k) sums of values' rows by cell; cell ascends."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(cell):
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out[cell[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


#: Bytes of word numbers that one step turns into latent rows, so few that the rows stay in a core's cache.
SIDE_BYTES = 1 << 14
#: Words of a vocabulary whose pairs a task counts in one matrix (four bytes a pair), and the bytes of a step of that.
PAIR_WORDS, PAIR_BYTES = 6000, 1 << 17


def _frequency(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, one = np.zeros(size, np.int64), 0, np.ones(size)
        for batch in batches:
            for _, ids, offsets in _sequences(batch.column(0), size, 1 << 20):
                _, word, first, _ = _cells(ids, offsets, one)
                df += np.bincount(word, minlength=size)
                n += int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size, dtype=np.int32)), pa.array(np.append(n, df))], ["cell", "n"])

    return count


def weights(numbered: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of passages (of STEP words, side by side) and the inverse document frequency of each word, above 0, over all of them."""
    rows = numbered.select("ids").transform(in_arrow, _frequency(size), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + 1, np.float64)
    total[rows["cell"].to_numpy() + 1] = rows["n"].to_numpy()
    n, df = total[0], total[1:]
    return int(n), np.log((n + 1) / (df + 1)) + 1e-3


#: Cells of a block of a matrix on its way between tasks, and tasks whose matrices are added first.
BLOCK_CELLS, FAN_IN = 1 << 14, 32


def _adder(kind: type):
    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column("block"):
                x = np.frombuffer(b.as_buffer(), kind).astype(np.float64)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() // FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "task", "block"])

    return add


def _summed(df: DataFrame, work, height: int, width: int) -> np.ndarray:
    """The sum over tasks of work's (height, width) matrices, added as a tree: FAN_IN tasks at a time, block by block.

    No task reads more than FAN_IN times a block of each matrix, however many tasks there are, until the last step,
    and the driver gets one matrix.
    """
    rows_in_block = max(1, BLOCK_CELLS // width)
    schema = "at int, task int, block binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = work(batches), TaskContext.get().partitionId() // FAN_IN
        for at in range(0, height, rows_in_block):
            block = total[at : at + rows_in_block].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["at", "task", "block"])

    tasks = df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0  # reads no column
    parts = df.transform(in_arrow, send, schema).groupBy("at", "task").applyInArrow(_adder(np.float32), schema)
    left = tasks // FAN_IN
    while left:
        parts = parts.groupBy("at", "task").applyInArrow(_adder(np.float64), schema)
        left //= FAN_IN
    out = np.zeros((height, width))
    for r in parts.collect():
        part = np.frombuffer(r["block"], np.float64).reshape(-1, width)
        out[r["at"] : r["at"] + len(part)] += part
    return out


def _piece_matrices(bench: Bench, weight: np.ndarray) -> Iterator[np.ndarray]:
    """The pieces' TF-IDF rows, some at a time: all at once would be pieces times words."""
    for lo in range(0, len(bench.pieces), 256):
        some = bench.pieces[lo : lo + 256]
        x = np.zeros((len(some), len(weight)))
        for i, p in enumerate(some):
            x[i, p] = weight[p]
        yield x


def latent(numbered: DataFrame, bench: Bench, n: int, weight: np.ndarray, rank: int = RANK, extra: int = EXTRA, seed: int = SEED) -> np.ndarray:
    """(words, rank) right singular vectors of the passages' TF-IDF matrix in a single randomised pass.

    The matrix holds every passage of the documents, and the benchmark's pieces with as much weight as all of them
    together, so that the directions in which pieces differ are among the first. One pass over the passages multiplies
    their second moments by a random matrix; the rest is small and done on the driver (Tropp et al., 2017).
    """
    size, width = len(weight), min(rank + extra, len(weight))
    balance = max(n, 1) / max(len(bench.pieces), 1)
    omega = np.random.default_rng(seed).normal(size=(size, width)).astype(np.float32)

    scaled = omega * weight[:, None].astype(np.float32)

    def pairs(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """How many cells have each pair of words, which are few numbers for each cell, then once for all times the random matrix."""
        both = np.zeros(size * size, np.float32)
        for batch in batches:
            for _, ids, offsets in _sequences(batch.column(0), size, PAIR_BYTES):
                cell, word, _, _ = _cells(ids, offsets, weight)
                live, apart = np.arange(len(cell)), 0
                while len(live):  # words of a cell are neighbours, in ascending order
                    np.add.at(both, word[live] * size + word[live + apart], np.ones(len(live), np.float32))
                    apart += 1
                    live = live[live + apart < len(cell)]
                    live = live[cell[live] == cell[live + apart]]
        both = both.reshape(size, size)
        return (both @ scaled + both.T @ scaled - both.diagonal()[:, None] * scaled) * weight[:, None]

    def rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """The same sums by way of each cell's row, for vocabularies whose pairs are too many."""
        out = np.zeros((size, width), np.float32)
        for batch in batches:
            for _, ids, offsets in _sequences(batch.column(0), size, SIDE_BYTES):
                cell, word, first, _ = _cells(ids, offsets, weight)
                z = _sums(cell, scaled[word], int(first[-1]))
                order = np.argsort(word, kind="stable")
                begin = np.flatnonzero(np.append(True, word[order][1:] != word[order][:-1])) if len(word) else np.zeros(0, np.int64)
                if len(begin):
                    out[word[order][begin]] += np.add.reduceat(z[cell[order]], begin, axis=0)
        return out * weight[:, None]

    sketch = pairs if size <= PAIR_WORDS else rows
    y = _summed(numbered.select("ids"), sketch, size, width)
    for x in _piece_matrices(bench, weight):
        y += balance * (x.T @ (x @ omega))
    # Nystrom: with A the passages' second moments, y = A omega and A ~ y (omega' y)^-1 y'
    y = y + 1e-7 * np.linalg.norm(y) * omega
    core = omega.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, value.max() * 1e-9)
    return np.linalg.svd(y @ (vector / np.sqrt(value)), full_matrices=False)[0][:, :rank]


class Verifier:
    """Longest common subsequences of many (passage, piece) pairs at once, bits of a 64-bit word standing for a piece's words."""

    def __init__(self, bench: Bench) -> None:
        self.size = np.int64(len(bench.vocabulary))
        pairs: dict[int, int] = {}
        for i, piece in enumerate(bench.pieces):
            for k, w in enumerate(piece.tolist()):
                key = i * int(self.size) + w
                pairs[key] = pairs.get(key, 0) | (1 << k)
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.masks = keys, np.array([pairs[int(k)] for k in keys], U64)
        length = np.array([len(p) for p in bench.pieces], np.int64)
        self.length, self.answer = length, length - np.array(bench.answers, np.int64)
        full = np.array([(1 << int(n)) - 1 for n in length], U64)
        self.tail = full & ~np.array([(1 << a) - 1 for a in bench.answers], U64)
        self.full = full

    def common(self, passage: np.ndarray, piece: np.ndarray, only: np.ndarray) -> np.ndarray:
        """passage: (pairs, words); only: bits of the piece's words that count."""
        v = np.full(len(piece), ~U64(0))
        base = piece * self.size
        for k in range(passage.shape[1]):
            w = passage[:, k]
            at = np.minimum(np.searchsorted(self.keys, base + w), len(self.keys) - 1)
            m = np.where((w >= 0) & (self.keys[at] == base + w), self.masks[at], U64(0)) & only[piece]
            u = v & m
            v = (v + u) | (v - u)
        return np.bitwise_count(~v & only[piece]).astype(np.int64)

    def confirm(self, passage: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(confirmed, share of the piece, share of its answer)"""
        share = self.common(passage, piece, self.full) / self.length[piece]
        answer = np.zeros(len(piece))
        look = np.flatnonzero((share >= LIKELY) & (self.answer[piece] > 0))
        if len(look):
            answer[look] = self.common(passage[look], piece[look], self.tail) / self.answer[piece[look]]
        short = self.length[piece] < SHORT
        return np.where(short, share >= 1, (share >= SURE) | ((share >= LIKELY) & (answer >= ANSWER))), share, answer


def _searcher(bench: Bench, weight: np.ndarray, space: np.ndarray, cosine: float):
    size = len(weight)
    asked = np.concatenate([x @ space for x in _piece_matrices(bench, weight)])
    norm = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = np.divide(asked, norm, out=np.zeros_like(asked), where=norm > 0).astype(np.float32)
    scaled = (space * weight[:, None]).astype(np.float32)
    rows_in_step = max(1, (1 << 22) // len(asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier, reach = Verifier(bench), WINDOW // STEP
        for batch in batches:
            for row, ids, offsets in _sequences(batch.column(1), size, SIDE_BYTES):
                cell, word, first, cells = _cells(ids, offsets, weight)
                n = int(first[-1])
                if not len(cell):
                    continue
                one = _sums(cell, scaled[word], n)
                doc = np.repeat(np.arange(len(cells)), cells)
                both = one.copy()
                for k in range(1, reach):  # a passage is reach cells of one document
                    same = doc[k:] == doc[:-k]
                    both[:-k][same] += one[k:][same]
                length = np.linalg.norm(both, axis=1)
                live = np.flatnonzero(length > 0)
                if not len(live):
                    continue
                found_cell, found_piece, found_cos = [], [], []
                for lo in range(0, len(live), rows_in_step):
                    mine = live[lo : lo + rows_in_step]
                    cos = (both[mine] @ asked.T) / length[mine][:, None]
                    a, b = np.nonzero(cos >= cosine)
                    found_cell.append(mine[a])
                    found_piece.append(b)
                    found_cos.append(np.minimum(cos[a, b], 1))
                at, piece, cos = (np.concatenate(x) for x in (found_cell, found_piece, found_cos))
                for lo in range(0, len(at), 4096):
                    c, p, s = at[lo : lo + 4096], piece[lo : lo + 4096], cos[lo : lo + 4096]
                    d = doc[c]
                    begin = (c - first[d]) * STEP - STEP  # a step more on either side
                    place = begin[:, None] + np.arange(WINDOW + 2 * STEP)
                    inside = (place >= 0) & (place < np.diff(offsets)[d][:, None])
                    passage = np.where(inside, ids[np.clip(offsets[d][:, None] + place, 0, len(ids) - 1)], -1).astype(np.int64)
                    yes, share, answer = verifier.confirm(passage, p.astype(np.int64))
                    yes = np.flatnonzero(yes)
                    if len(yes):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + d[yes])), pa.array(bench.items[p[yes]]), pa.array(np.maximum(begin[yes], 0)), pa.array(s[yes].astype(np.float64)), pa.array(share[yes]), pa.array(answer[yes])],
                            ["doc_id", "item_id", "word", "cosine", "share", "answer_share"],
                        )

    return search


LEAKS = "doc_id long, item_id long, word long, cosine double, share double, answer_share double"


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, word, cosine, share, answer_share) for each document that holds a benchmark item.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Every passage of WINDOW
    words of every document is held against every piece of at most PIECE words of the benchmark. share is the
    longest common subsequence in words with the passage (and STEP words on either side) as a share of the
    piece, answer_share that of its last sentence; word is where the passage begins. Of several finds of an item
    in a document the one with the greatest share counts (then cosine, then the earliest).

    Null doc_ids, item_ids and texts, and texts without a letter or digit, match nothing. Repeated rows of a
    document or an item are one. A word weighs something however many passages have it, so a piece that is
    everywhere is searched for like others. An empty docs or benchmark gives no rows. The cosine is that of the two
    vectors' projections, so a copy of a piece keeps a high one when there are more pieces than dimensions: rank
    decides how many passages must be verified, hardly which are found. A benchmark of any size is searched for,
    GROUP_CHARS of it in each pass, so that what tasks and driver hold is bounded.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    groups = -(-chars // GROUP_CHARS)
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for k in range(groups):  # groups of whole items, so one item's finds are in one group
        mine = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k)
        found = found.unionByName(_group_leaks(docs, mine, rank, cosine))
    return found


def _group_leaks(docs: DataFrame, items: DataFrame, rank: int, cosine: float) -> DataFrame:
    bench = prepare(items)
    if not len(bench.pieces):
        return docs.sparkSession.createDataFrame([], LEAKS)
    numbered = written(number(docs, bench), "numbers")
    n, weight = weights(numbered, len(bench.vocabulary))
    space = latent(numbered, bench, n, weight, rank)
    found = numbered.select("doc_id", "ids").transform(in_arrow, _searcher(bench, weight, space, cosine), LEAKS)
    best = F.max(F.struct("share", "cosine", (-F.col("word")).alias("back"), "answer_share")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("word"), "best.cosine", "best.share", "best.answer_share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without the documents in which leaks finds an item; null doc_ids stay."""
    return drop_ids(docs, leaks(docs, benchmark, **parameters).select("doc_id"))
