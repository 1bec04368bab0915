"""Vector, keyword and hybrid top-k search, embedding and chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens, keyword_score

Embed = Callable[[list[str]], np.ndarray]


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a literal query in double; null where lengths differ or a norm is 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add)) * float(np.linalg.norm(np.asarray(query, np.float64)))
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / norm)


def top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, where: Column | None = None) -> DataFrame:
    """The k rows most like the query (O1): the filter comes first, then TakeOrderedAndProject; ties by key.

    k <= 0 gives no rows. Each task keeps k rows, so the driver merges k per task whatever the table's size.
    """
    if where is not None:
        df = df.where(where)
    scored = df.withColumn("score", F.round(cosine(F.col(vector), query), 6)).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), key).limit(max(k, 0))


def keyword_top_k(df: DataFrame, text: str, query: str, k: int, key: str) -> DataFrame:
    """The k best by keyword score (O2); rows with score 0 are no hits."""
    return df.withColumn("score", keyword_score(query, F.col(text))).where("score > 0").orderBy(F.desc("score"), key).limit(max(k, 0))


def hybrid(words: DataFrame, vectors: DataFrame, k: int, key: str, enough: int = 4, scale: float = 10.0) -> DataFrame:
    """Keyword hits, with vector hits at scale times their score beside them unless the best keyword hit scores enough (O2).

    Both have key and score and are top-k results already, so the decision is a scalar over k rows.
    """
    best = words.agg(F.coalesce(F.max("score"), F.lit(0)).alias("_best"))
    extra = vectors.crossJoin(best).where(F.col("_best") < enough).select(key, (F.col("score") * scale).alias("score"), F.lit("vector").alias("via"))
    fresh = extra.join(words.select(key), key, "left_anti")
    return words.select(key, F.col("score").cast("double").alias("score"), F.lit("keyword").alias("via")).unionByName(fresh).orderBy(F.desc("score"), key).limit(max(k, 0))


def hashing_embedder(dim: int = 256) -> Embed:
    """A deterministic embedder for use without a network: signed hashed words, normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed_table(df: DataFrame, text: str, embed: Embed | None = None, batch: int = 64, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """df with an embedding column (T6): Arrow batches cut to the service's size, calls tried again with doubled waits.

    An embed that raises RetryLater is called again; any other error fails the task.
    """
    embed = embed or hashing_embedder()
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(names.index(text)).to_pylist()
                for attempt in range(retries + 1):
                    try:
                        vectors = embed(texts)
                        break
                    except RetryLater:
                        if attempt == retries:
                            raise
                        time.sleep(wait_s * 2**attempt)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(list, np.asarray(vectors, np.float32))), pa.list_(pa.float32()))], [*names, "embedding"])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "embedding array<float>"]))


class RetryLater(Exception):
    """Raised by an embedder or summariser for errors that pass (too many requests, server errors)."""


class TooLong(Exception):
    """Raised by a summariser whose answer was cut off; the batch is then halved."""


def summarize_table(df: DataFrame, key: str, summarize: Callable[[list[dict]], list[str]] | None = None, batch: int = 8, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """(key, summary, fallback) for each row (T7): batches, tried again with doubled waits, halved when cut off.

    What still fails gets a fallback card made of its own columns; one bad row never costs the others theirs.
    """
    names = df.columns

    def card(row: dict) -> str:
        return ", ".join(f"{k}: {v}" for k, v in row.items() if v not in (None, "", []))

    def attempt(rows: list[dict], left: int) -> list[tuple[str, bool]]:
        import time

        if summarize is None:
            return [(card(r), True) for r in rows]
        try:
            out = summarize(rows)
            if len(out) != len(rows):
                raise TooLong
            return [(s, False) for s in out]
        except RetryLater:
            if not left:
                return [(card(r), True) for r in rows]
            time.sleep(wait_s * 2 ** (retries - left))
            return attempt(rows, left - 1)
        except TooLong:
            if len(rows) == 1:
                return [(card(rows[0]), True)]
            half = len(rows) // 2
            return attempt(rows[:half], left) + attempt(rows[half:], left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                done = attempt(part.to_pylist(), retries)
                yield pa.RecordBatch.from_arrays([part.column(names.index(key)), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done])], [key, "summary", "fallback"])

    return df.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, summary string, fallback boolean")


def split_semantic(df: DataFrame, text: str, split: Callable[[str], list[dict]] | None = None, budget: int = 800, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """df with part, title and text of each chunk in place of its text (T2): texts that fit the budget stay whole.

    A longer text goes to split, which gives dicts of title and text; RetryLater is tried again with doubled waits.
    Without split, and where it fails for good or gives nothing usable, the text is cut where paragraphs end, or in
    equal pieces where there is none, so no text is lost and one failure costs only the better cut.
    """
    names = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    at = df.columns.index(text)

    def local(t: str) -> list[tuple[str, str]]:
        parts, size = [""], 4 * budget
        for p in t.split("\n\n"):
            for piece in [p[k : k + size] for k in range(0, len(p), size)] or [""]:
                if parts[-1] and len(parts[-1]) + 2 + len(piece) > size:
                    parts.append("")
                parts[-1] = f"{parts[-1]}\n\n{piece}" if parts[-1] else piece
        return [(next((x.lstrip("# ").strip() for x in p.split("\n") if x.strip()), ""), p) for p in parts if p]

    def chunks(t: str) -> list[tuple[str, str]]:
        import time

        if len(t.strip()) <= 4 * budget or split is None:
            return local(t)
        for attempt in range(retries + 1):
            try:
                found = [(str(c.get("title") or ""), c["text"]) for c in split(t) if isinstance(c, dict) and isinstance(c.get("text"), str) and c["text"].strip()]
                return found or local(t)
            except RetryLater:
                if attempt < retries:
                    time.sleep(wait_s * 2**attempt)
            except (ValueError, TypeError, KeyError, AttributeError):
                break
        return local(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, part, *c) for row, t in enumerate(b.column(at).to_pylist()) for part, c in enumerate(chunks(t or ""))]
            rest = [b.column(df_at).take(pa.array([f[0] for f in found], pa.int64())) for df_at in range(b.num_columns) if df_at != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string())], [*names, "part", "chunk_title", "chunk"])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "part int, chunk_title string, chunk string"]))


def pack_paragraphs(text: Column, limit: int = 800, separator: str = "\n") -> Column:
    """Paragraphs packed greedily into chunks of at most limit characters (T5); a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.lit(len(separator)) + F.length(p) <= limit
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(separator), p).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))
        )

    end = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    return F.aggregate(F.filter(F.split(text, separator), lambda p: p != ""), start, step, end)


def split_oversized(df: DataFrame, text: str, budget: int, depth: int = 5) -> DataFrame:
    """Rows whose text needs more than budget tokens, halved up to depth times (T3); part is its place, from 0.

    The halves are cut in one expression: 2^n equal pieces, n being the least that makes them fit, or depth.
    """
    need = estimate_tokens(F.col(text))
    n = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(need / budget)))).cast("int")
    pieces = F.coalesce(F.pow(F.lit(2), n).cast("int"), F.lit(1))
    size = F.greatest(F.ceil(F.length(text) / pieces), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substr(F.col(text), i * size + 1, size))
    return df.select(*(c for c in df.columns if c != text), F.posexplode(F.filter(cut, lambda x: x != "")).alias("part", text))


def chunk_id(*parts: Column) -> Column:
    """A chunk's id from what it is, so that indexing again gives the same ids."""
    return F.sha2(F.concat_ws("|", *parts), 256)
