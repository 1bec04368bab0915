"""Quality classifier: a byte-level convolutional network in numpy.

Filters over 6 bytes slide over the whole document; each is max-pooled over overlapping chunks of 256
bytes (every 128), and a document's chunks are combined by their maximum and their mean into one
probability. Trained on the driver with Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_arrow, text_steps

WIDTH, FILTERS, HOP = 6, 16, 128
#: Bound of the labelled sample; training passes; documents with a probability below REJECT go.
TRAIN_ROWS, EPOCHS, REJECT, SEED = 1200, 24, 0.4, 5
PASS_BYTES = 1 << 17

Model = dict[str, np.ndarray]


def _pairs(tables: np.ndarray) -> np.ndarray:
    """(WIDTH / 2, 65536, FILTERS): what two neighbouring bytes add to each filter."""
    return np.stack([(tables[k][:, None, :] + tables[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)])


def _block_max(data: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(blocks, FILTERS) maxima of the filters that begin in each HOP bytes; data ends with WIDTH spare bytes.

    At ends, where the next document begins, filters see zeros instead.
    """
    n, zeros = len(data) - WIDTH, pairs[:, 0].sum(0)
    code = (data[:-1].astype(np.uint16) << 8) | data[1:]
    out = np.empty((n // HOP, FILTERS), np.float32)
    for at in range(0, n, PASS_BYTES):
        end = min(at + PASS_BYTES, n)
        y = pairs[0].take(code[at:end], axis=0)
        for k in range(1, WIDTH // 2):
            y += pairs[k].take(code[at + 2 * k : end + 2 * k], axis=0)
        over = ends[(ends > at) & (ends <= end)] - at
        for k in range(1, WIDTH):
            y[over - k] = zeros
        out[at // HOP : end // HOP] = y.reshape(-1, HOP, FILTERS).max(1)
    return out


def _block_arg(data: np.ndarray, tables: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_block_max from the tables of single bytes, and where in each block each maximum is."""
    n, zeros = len(data) - WIDTH, tables[:, 0].sum(0)
    out, where = np.empty((n // HOP, FILTERS), np.float32), np.empty((n // HOP, FILTERS), np.int64)
    for at in range(0, n, PASS_BYTES):
        end = min(at + PASS_BYTES, n)
        y = tables[0].take(data[at:end], axis=0)
        for k in range(1, WIDTH):
            y += tables[k].take(data[at + k : end + k], axis=0)
        over = ends[(ends > at) & (ends <= end)] - at
        for k in range(1, WIDTH):
            y[over - k] = zeros
        y = y.reshape(-1, HOP, FILTERS)
        mine = slice(at // HOP, end // HOP)
        where[mine] = y.argmax(1)
        out[mine] = np.take_along_axis(y, where[mine][:, None], 1)[:, 0]
    return out, where


def _laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents each on their own blocks, with WIDTH zero bytes after each at least; and each one's first block."""
    length = np.diff(offsets)
    blocks = (length + WIDTH + HOP - 1) // HOP
    first = np.append(0, np.cumsum(blocks))
    out = np.zeros(first[-1] * HOP + WIDTH, np.uint8)
    for i in np.flatnonzero(length):
        out[first[i] * HOP : first[i] * HOP + length[i]] = data[offsets[i] : offsets[i + 1]]
    return out, first


def _chunks(block: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maxima of overlapping chunks of two blocks; a document's last block stands alone."""
    nxt = np.append(block[1:], block[-1:], axis=0)
    last = first[1:] - 1
    nxt[last] = block[last]
    return np.maximum(np.maximum(block, nxt), 0)


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """One probability of being good per text; null and empty texts have one like any other."""
    out, pairs = [np.zeros(0)], model["pairs"]
    for _, data, offsets in text_steps(texts):
        laid, first = _laid(data, offsets)
        chunk = _chunks(_block_max(laid, pairs, first[1:] * HOP) + model["bias"], first)
        top = np.maximum.reduceat(chunk, first[:-1], axis=0)
        mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.diff(first)[:, None]
        z = np.concatenate([top, mean], 1) @ model["weight"] + model["offset"]
        out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
    return np.concatenate(out).astype(np.float64)


def train(texts: list[str], good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the log loss with both classes weighed alike; gradients pass through the maxima that were taken."""
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.08, (WIDTH, 256, FILTERS)).astype(np.float32)
    p = {"tables": tables, "bias": np.zeros(FILTERS, np.float32), "weight": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32)}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    raw = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    share = np.where(good == 1, 0.5 / max((good == 1).sum(), 1), 0.5 / max((good == 0).sum(), 1)) * len(good)
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), 32):
            mine = order[at : at + 32]
            offsets = np.append(0, np.cumsum([len(raw[i]) for i in mine]))
            laid, first = _laid(np.concatenate([raw[i] for i in mine]), offsets)
            block, where = _block_arg(laid, p["tables"], first[1:] * HOP)
            chunk = _chunks(block + p["bias"], first)
            docs = len(mine)
            of = np.repeat(np.arange(docs), np.diff(first))
            top = np.maximum.reduceat(chunk, first[:-1], axis=0)
            mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.diff(first)[:, None]
            feat = np.concatenate([top, mean], 1)
            prob = 1 / (1 + np.exp(-np.clip(feat @ p["weight"] + p["offset"], -30, 30)))
            dz = ((prob - good[mine]) * share[mine] / docs).astype(np.float32)
            dfeat = dz[:, None] * p["weight"]
            is_top = (chunk == top[of]) & (chunk > 0)
            ties = np.maximum(np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0), 1)
            dchunk = is_top * (dfeat[:, :FILTERS] / ties)[of] + (chunk > 0) * (dfeat[:, FILTERS:] / np.diff(first)[:, None])[of]
            nxt = np.append(block[1:], block[-1:], axis=0)
            nxt[first[1:] - 1] = -np.inf
            later = nxt > block
            dblock = np.where(later, 0, dchunk)
            dblock[1:] += np.where(later, dchunk, 0)[:-1]
            b, f = np.nonzero(dblock)
            pos, g, limit = b * HOP + where[b, f], dblock[b, f], (first[1:] * HOP)[of[b]]
            dt = np.zeros_like(p["tables"])
            for k in range(WIDTH):
                seen = np.where(pos + k < limit, laid[pos + k], 0).astype(np.int64)
                dt[k] = np.bincount(seen * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS)
            grads = {"tables": dt + 1e-5 * p["tables"], "bias": dblock.sum(0), "weight": feat.T @ dz + 1e-4 * p["weight"], "offset": dz.sum(keepdims=True)}
            t += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return {"tables": p["tables"], "bias": p["bias"], "weight": p["weight"].astype(np.float64), "offset": p["offset"].astype(np.float64)}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    """A model of labels.quality from at most rows labelled documents, taken by a hash of doc_id.

    Labels that are null or neither 0 nor 1 don't count, nor do null doc_ids and texts; of several labels of a
    document the smallest counts, of several texts the greatest. Without documents of both classes the model
    says 1 to all.
    """
    picked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so few rows whatever the input's size
    text = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = text.groupBy("doc_id", "good").agg(F.max("text").alias("text")).orderBy("doc_id").toPandas()
    good = sample["good"].to_numpy(np.float32)
    if len(set(good.tolist())) < 2:
        return {"tables": np.zeros((WIDTH, 256, FILTERS), np.float32), "bias": np.zeros(FILTERS, np.float32), "weight": np.zeros(2 * FILTERS), "offset": np.array([40.0])}
    return train(sample["text"].tolist(), good, epochs)


def _scorer(model: Model, reject: float, keep: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model | {"pairs": _pairs(model["tables"])}
        for batch in batches:
            p = probabilities(batch.column("text"), ready)
            if keep:
                yield batch.filter(pa.array(p >= reject))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= reject)], ["doc_id", "probability", "keep"])

    return score


def classify(docs: DataFrame, labels: DataFrame, reject: float = REJECT, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, probability, keep) for each row of docs; keep is probability >= reject.

    docs has doc_id and text, labels doc_id and quality; other columns are ignored. The whole of every text is
    read, however long. A null text counts as the empty text; both get the network's answer for no bytes.
    Null doc_ids and repeated rows are classified like any row. Empty docs give no rows; without labels of
    both classes every probability is 1.
    """
    return docs.select("doc_id", "text").transform(in_arrow, _scorer(fit(docs, labels, rows), reject, False), "doc_id long, probability double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = REJECT, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify keeps, with docs' columns."""
    return docs.transform(in_arrow, _scorer(fit(docs, labels, rows), reject, True), docs.schema)
