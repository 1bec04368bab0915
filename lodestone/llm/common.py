"""What the training-data operators share: the shared folder, byte batches, hashing and components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shared import cut, shared_dir

U64 = np.uint64
#: Bytes of text that one numpy step works on, so that its temporaries stay in tens of MB.
STEP_BYTES = 1 << 20


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clear
        pass


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(functools.partial(_delete, spark, path))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids up to which the side of an id join is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 200_000


def _small(ids: DataFrame) -> DataFrame:
    ids = cut(ids.toDF("_id").distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids' only column; null doc_ids stay."""
    ids = _small(ids)
    return docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti")


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs' rows whose doc_id is in ids' only column, where null equals null."""
    ids = _small(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


ARROW_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(work, schema), at whose end a worker gives the memory it freed back to the machine.

    Workers live on for the tasks of later stages, so without it an executor holds what its largest task once took.
    Rows go to Python TEXT_ROWS at a time where the session has Spark's own number, which is meant for short rows.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS, "10000") == "10000":
        conf.set(ARROW_ROWS, str(TEXT_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library than glibc
            pass

    return df.mapInArrow(run, schema)


def text_steps(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about step bytes; null counts as empty. No Python strings."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, 1 << 64))
        have += more
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        _POW[name] = have = powers(base, max(n, STEP_BYTES + 4096))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Bytes of a word: letters and digits of ASCII and every byte of a longer UTF-8 sequence; upper case folds to lower.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of U+00C0..U+00DE in UTF-8; lengths stay."""
    low = _FOLD[data]
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[at] += 32
    return low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word; no word spans two rows. A longer run of bytes goes piece by piece."""
    if len(data) <= 4 * STEP_BYTES:
        return _words(data, offsets)
    found, at = [], 0
    while at < len(data):
        end = min(at + 2 * STEP_BYTES, len(data))
        if end < len(data):  # back to the last byte that is no word's, if there is one
            gap = np.flatnonzero(~_WORD[data[at:end]])
            end = at + int(gap[-1]) + 1 if len(gap) else end
        h, row, start, stop = _words(data[at:end], np.clip(offsets - at, 0, end - at))
        found.append((h, row, start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none
    low = fold(data)
    is_word = np.zeros(len(data) + 1, bool)
    is_word[:-1] = _WORD[data]
    begins = is_word[:-1].copy()
    begins[1:] &= ~is_word[:-2]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = is_word[:-1][edge]  # a row's first byte begins a word even right after one
    start = np.flatnonzero(begins)
    ends = is_word[:-1] & ~is_word[1:]
    ends[edge - 1] = is_word[:-1][edge - 1]
    end = np.flatnonzero(ends) + 1
    up, down = _table("up", _BASE, len(data) + 1), _table("down", _UNBASE, len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    row = np.searchsorted(offsets, start, side="right") - 1
    return h, row, start, end


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for each node of edges(src, dst), component being its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum with
    map-side combine and a join that AQE may split, and cuts lineage by checkpoint() after each pair.
    Null ends and loops are dropped; no edges give no rows.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = rest.unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
