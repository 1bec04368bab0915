"""Language identification by nearest centroid.

A document is the normalised TF-IDF vector of its hashed byte trigrams; every language has several centroids
from spherical k-means; the nearest by cosine decides, and a document too far from all of them is rejected.
Document frequencies cover all documents; only the centroids are fitted on a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import STEP_BYTES, cut, fold, in_arrow, text_steps

DIMS = 4096
#: Bounds of the labelled sample: documents of a language, and languages, those with the most documents; centroids
#: per language; rejection: this quantile of the sample's own cosine to the nearest centroid of its language, less MARGIN.
SAMPLE_PER_LANG, MAX_LANGS, CENTROIDS, QUANTILE, MARGIN, SEED = 400, 256, 4, 0.001, 0.05, 3
UNKNOWN = "und"


def _codes(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that begins at each byte but the last two; digits are one class, as are other ASCII signs."""
    low = fold(data)
    low = _CLASS[low].astype(np.uint32)
    h = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int64)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:48] = 32
_CLASS[48:58] = 48
_CLASS[[*range(58, 65), *range(91, 97), *range(123, 128)]] = 32
_CLASS[65:91] += 32


def counts(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, trigram counts by row); a text is read as if between spaces, and longer ones piece by piece."""
    for first, data, offsets in text_steps(texts, step):
        n = len(offsets) - 1
        for lo in range(0, n, 512):
            hi = min(lo + 512, n)
            size = np.diff(offsets[lo : hi + 1])
            total = np.zeros((hi - lo) * DIMS, np.float32)
            if hi - lo == 1 and size[0] > 4 * step:
                whole = data[offsets[lo] : offsets[hi]]
                total += np.bincount(_codes(np.concatenate([[32], whole[: step + 1]]).astype(np.uint8)), minlength=DIMS)
                for at in range(step - 1, len(whole), step):
                    piece = whole[at : at + step + 2]
                    if at + step + 2 >= len(whole):
                        piece = np.append(piece, np.uint8(32))
                    if len(piece) > 2:
                        total += np.bincount(_codes(piece), minlength=DIMS)
            else:
                spaced = np.full(int(size.sum()) + 2 * (hi - lo), 32, np.uint8)
                begin = np.cumsum(size + 2) - size - 1
                row = np.repeat(np.arange(hi - lo), size + 2)
                body = np.ones(len(spaced), bool)
                body[begin - 1] = False
                body[begin + size] = False
                spaced[body] = data[offsets[lo] : offsets[hi]]
                code = _codes(spaced)
                inside = row[:-2] == row[2:]
                total += np.bincount((row[:-2] * DIMS + code)[inside], minlength=len(total))
            yield first + lo, total.reshape(hi - lo, DIMS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + log count) x idf; a text without trigrams is the zero vector."""
    x = np.zeros_like(count)
    at = count > 0
    x[at] = 1 + np.log(count[at])
    x *= idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, null, n) of trigrams' document frequencies, dim -1 counting documents, and (-2, lang, n) of each language's texts."""
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, c in counts(batch.column(0)):
            df += (c > 0).sum(0)
            n += len(c)
        some = pc.fill_null(pc.greater(pc.binary_length(batch.column(0)), 0), False)
        said = pc.value_counts(batch.column(1).filter(some).drop_null())
        if len(said):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(said), -2, np.int32)), said.field("values"), said.field("counts").cast(pa.int64())], ["dim", "lang", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)), pa.nulls(DIMS + 1, pa.string()), pa.array(np.append(n, df))], ["dim", "lang", "n"])


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray, DataFrame]:
    """The number of documents and of those with each trigram, over all rows; and (lang, n_lang), counting texts that aren't empty."""
    rows = cut(docs.select("text", "lang").transform(in_arrow, _frequency, "dim int, lang string, n long").groupBy("dim", "lang").agg(F.sum("n").alias("n")))
    dims = rows.where("dim >= -1").select("dim", "n").toPandas()
    out = np.zeros(DIMS + 1, np.int64)
    out[dims["dim"].to_numpy() + 1] = dims["n"].to_numpy()
    return int(out[0]), out[1:], rows.where("dim = -2").select("lang", F.col("n").alias("n_lang"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their trigram counts, which are of bounded size however long a text is."""
    for batch in batches:
        for first, c in counts(batch.column(3)):
            at = [np.flatnonzero(x).astype("<u2") for x in c]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(first, len(c)) for k in range(3)), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([r[x].astype("<f4").tobytes() for r, x in zip(c, at)], pa.binary())],
                ["lang", "doc_id", "h", "at", "count"],
            )


def _dense(at: Sequence[bytes], count: Sequence[bytes]) -> np.ndarray:
    x = np.zeros((len(at), DIMS), np.float32)
    for row, a, c in zip(x, at, count):
        row[np.frombuffer(a, "<u2")] = np.frombuffer(c, "<f4")
    return x


def k_means(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 25) -> np.ndarray:
    """Spherical k-means with a farthest-first start; empty clusters vanish."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    while len(centre) < min(k, len(x)):
        centre.append(x[np.argmin(np.max(x @ np.array(centre).T, axis=1))])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if new.shape == c.shape and np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, clusters: int = CENTROIDS) -> dict:
    """Centroids, their languages, the idf of all documents and each language's least cosine.

    Languages are the distinct non-null values of docs.lang; if they are more than MAX_LANGS, the most frequent (ties:
    by name). Of each, the per_lang documents with a text that have the smallest hash of doc_id are the sample, sent
    to the driver as trigram counts.
    """
    n, df, by_lang = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    rate = F.broadcast(by_lang.orderBy(F.desc("n_lang"), "lang").limit(MAX_LANGS))
    # the smallest hashes of each language: what lies under 1.5 times the rate that is needed comes to the driver
    under = F.lit(1.5 * per_lang * 2.0**63) / F.col("n_lang") + F.lit(1.0)
    h = F.abs(F.xxhash64("doc_id").cast("double"))
    thin = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text", "lang").join(rate, "lang").where(h <= under)
    rows = thin.select("lang", "doc_id", h.alias("h"), "text").transform(in_arrow, _sparse, "lang string, doc_id long, h double, at binary, count binary").toPandas()
    langs, centres, least = [], [], []
    for lang, part in rows.groupby("lang", sort=True):
        part = part.sort_values(["h", "doc_id", "at", "count"]).head(per_lang)
        x = vectors(_dense(part["at"].tolist(), part["count"].tolist()), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if len(x):
            c = k_means(x, clusters)
            centres.append(c)
            langs += [lang] * len(c)
            least += [float(np.quantile((x @ c.T).max(1), QUANTILE)) - MARGIN] * len(c)
    return {"idf": idf, "centres": np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, DIMS), np.float32), "langs": langs, "least": np.array(least)}


def predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    langs, scores = [], [np.zeros(0)]
    for _, c in counts(texts):
        if not len(model["langs"]):
            langs += [UNKNOWN] * len(c)
            scores.append(np.zeros(len(c)))
            continue
        cos = vectors(c, model["idf"]) @ model["centres"].T
        best = cos.argmax(1)
        top = cos[np.arange(len(cos)), best].astype(np.float64)
        langs += [model["langs"][b] if s > 0 and s >= model["least"][b] else UNKNOWN for b, s in zip(best.tolist(), top.tolist())]
        scores.append(top)
    return langs, np.concatenate(scores)


def _scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, cos = predict(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(cos)], ["doc_id", "predicted", "cosine"])

    return score


def identify(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, clusters: int = CENTROIDS) -> DataFrame:
    """(doc_id, predicted, cosine) for each row of docs; predicted is "und" where the nearest centroid is too far.

    docs has doc_id, text and lang; other columns are ignored, and lang only chooses the sample for the
    centroids (per_lang documents of each of MAX_LANGS languages at most), rows with a null lang none. Null and empty texts are "und" with cosine 0. Every trigram of a
    text counts, however long it is. Repeated rows each get a row and each count in the document frequencies.
    Ties go to the language first in the alphabet. An empty table gives no rows; without any lang all are "und".
    """
    return docs.select("doc_id", "text").transform(in_arrow, _scorer(fit(docs, per_lang, clusters)), "doc_id long, predicted string, cosine double")
