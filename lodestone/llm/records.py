"""Token ids as length-delimited binary records with masked checksums, and their offset index.

A record is: uint64 length, uint32 masked CRC-32C of those 8 bytes, the payload, uint32 masked CRC-32C of the
payload; all little endian. A payload is a document's token ids as uint16, the end-of-text id last. Records of a
shard stand end to end; the index has one row per record with its shard, offset and length, so a shuffled
reader seeks straight to any record.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import delete_at_exit, in_arrow, shared_dir

VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
END_OF_TEXT = 50256
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, shard int, offset long, length long, n_tokens long, record binary"

_CRC_POLY = 0x82F63B78


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (_CRC_POLY if c & 1 else 0)
        one[i] = c
    v = np.arange(65536, dtype=np.uint32)

    def zeros(c: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            c = one[c & 0xFF] ^ (c >> np.uint32(8))
        return c

    return one, zeros(v, 4), zeros(v << np.uint32(16), 4)  # four bytes at a time, by halves


_ONE, _LOW, _HIGH = _crc_tables()
BLOCK = 256


def _shift_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes do to a checksum's low and high half."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        basis = _ONE[basis & 0xFF] ^ (basis >> np.uint32(8))

    def table(part: np.ndarray) -> np.ndarray:
        out = np.zeros(65536, np.uint32)
        for k in range(16):
            out[1 << k : 2 << k] = out[: 1 << k] ^ part[k]
        return out

    return table(basis[:16]), table(basis[16:])


_SHIFTS = {k: _shift_tables(1 << k) for k in range(3)} | {8: _shift_tables(BLOCK)}


def _apply(tables: tuple[np.ndarray, np.ndarray], c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFFFF] ^ tables[1][c >> np.uint32(16)]


def crc32c(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of data[begin : begin + size] for each pair, in numpy: blocks in lanes, then blocks joined.

    Zero bytes before a message don't change a checksum that starts at 0, so messages are padded in front to
    whole blocks; the usual start value is put in by inverting the first four bytes (of a copy).
    """
    n = len(size)
    blocks = np.maximum((np.maximum(size, 4) + BLOCK - 1) // BLOCK, 1)
    last = np.cumsum(blocks)
    lane = np.zeros(int(last[-1]) * BLOCK, np.uint8) if n else np.zeros(0, np.uint8)
    for i in range(n):
        end = int(last[i]) * BLOCK
        s = int(size[i])
        if s >= 4:
            lane[end - s : end] = data[begin[i] : begin[i] + s]
            lane[end - s : end - s + 4] ^= 0xFF
    word = lane.view("<u4").reshape(-1, BLOCK // 4)
    c = np.zeros(len(word), np.uint32)
    for k in range(BLOCK // 4):
        c ^= word[:, k]
        c = _LOW[c & 0xFFFF] ^ _HIGH[c >> np.uint32(16)]
    out, at = np.zeros(n, np.uint32), last - blocks
    live = np.arange(n)
    while len(live):
        out[live] = _apply(_SHIFTS[8], out[live]) ^ c[at[live]]
        at[live] += 1
        live = live[at[live] < last[live]]
    for i in np.flatnonzero(size < 4):  # too short for the trick
        x = 0xFFFFFFFF
        for b in data[begin[i] : begin[i] + size[i]].tolist():
            x = int(_ONE[(x ^ b) & 0xFF]) ^ (x >> 8)
        out[i] = x
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def encoder(ranks: bytes) -> Callable[[str], list[int]]:
    """Text to ids with a byte-level BPE vocabulary file of ranks, special tokens being ordinary text."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def _ranks(vocabulary: str) -> bytes:
    """The vocabulary file, read on the driver and sent to the tasks: executors need not have it."""
    with open(vocabulary, "rb") as f:
        return f.read()


def tokenize(text: str, encode: Callable[[str], list[int]]) -> bytes:
    """The text's ids as uint16 bytes, without the end."""
    return np.array(encode(text), dtype="<u2").tobytes()


def frame(payloads: list[bytes]) -> list[bytes]:
    if not payloads:
        return []
    size = np.array([len(p) for p in payloads], np.int64)
    heads = size.astype("<u8").view(np.uint8)
    eight = np.arange(len(size)) * 8
    head_crc = masked(crc32c(heads, eight, np.full(len(size), 8))).astype("<u4").tobytes()
    body = np.frombuffer(b"".join(payloads), np.uint8)
    body_crc = masked(crc32c(body, np.cumsum(size) - size, size)).astype("<u4").tobytes()
    head = heads.tobytes()
    return [b"".join((head[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], p, body_crc[4 * i : 4 * i + 4])) for i, p in enumerate(payloads)]


def _framed(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray]]:
    """(doc_ids, records, their lengths) of about 4 MB of text at once; batches have doc_id and text."""
    encode, end = encoder(ranks), np.array([END_OF_TEXT], dtype="<u2").tobytes()
    for batch in batches:
        at, rows = 0, batch.num_rows
        while at < rows:
            stop, size, payloads = at, 0, []
            while stop < rows and size < 4 << 20:
                text = batch.column(1)[stop].as_py() or ""
                payloads.append(tokenize(text, encode) + end)
                size += len(text)
                stop += 1
            records = frame(payloads)
            yield batch.column(0).slice(at, stop - at), records, np.array([len(r) for r in records], np.int64)
            at = stop


def _writer(ranks: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset = TaskContext.get().partitionId(), 0
        for ids, records, length in _framed(batches, ranks):
            begin = offset + np.cumsum(length) - length
            offset += int(length.sum())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(records), shard, np.int32)), pa.array(begin), pa.array(length), pa.array((length - 16) // 2), pa.array(records, pa.binary())], ["doc_id", "shard", "offset", "length", "n_tokens", "record"])

    return write


def records(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, shard, offset, length, n_tokens, record) for each row of docs: the framed record and its place.

    docs has doc_id and text; other columns are ignored. A shard is what one task reads, in its order, so nothing
    is shuffled and no task's output depends on another's; offset is the record's first byte in the shard. Null
    and empty texts are sequences of the end alone. Whole texts are encoded, however long; strings of special
    tokens are ordinary text. Null doc_ids and repeated rows get records like any row. An empty table gives none.
    """
    return docs.select("doc_id", "text").transform(in_arrow, _writer(_ranks(vocabulary)), SCHEMA)


INDEX = "doc_id long, file string, offset long, length long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes docs' records as shard files and a separate index of them into folder, and returns the index.

    folder is a URI that all executors share. Each task streams its shard to a file with a name of its own, which the
    index rows of the same task name; of a task that runs again or twice only the attempt that commits its index rows
    counts, so a lost executor leaves at most a file that no index row names. The index, (doc_id, file, offset, length,
    n_tokens), is Parquet in folder/index, a few bytes for each record: it can be shuffled without the records.
    """

    ranks = _ranks(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, offset = None, 0
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"
        for ids, records, length in _framed(batches, ranks):
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}")
            out.write(b"".join(records))
            yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(records), pa.string()), pa.array(offset + np.cumsum(length) - length), pa.array(length), pa.array((length - 16) // 2)], ["doc_id", "file", "offset", "length", "n_tokens"])
            offset += int(length.sum())
        if out is not None:
            out.close()

    docs.select("doc_id", "text").transform(in_arrow, write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """index with a column record: the framed bytes at each row's place, whatever the order of the rows."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in (1, 2, 3))
            at = 0
            while at < len(files):  # about 4 MB of records at once
                records, size, first = [], 0, at
                while at < len(files) and size < 4 << 20:
                    if files[at] != name:
                        if file is not None:
                            file.close()
                        name, file = files[at], fs.open_input_file(f"{root}/{files[at]}")
                    records.append(file.read_at(lengths[at], offsets[at]))
                    size += lengths[at]
                    at += 1
                yield pa.RecordBatch.from_arrays([*(c.slice(first, at - first) for c in batch.columns), pa.array(records, pa.binary())], [*batch.schema.names, "record"])
        if file is not None:
            file.close()

    return index.select("doc_id", "file", "offset", "length", "n_tokens").transform(in_arrow, fetch, f"{INDEX}, record binary")


def publish(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, file, offset, length, n_tokens, record) for each row of docs, read through the index of the shards it writes.

    What records says of docs holds here too. folder is where the shard files and the index go; without one it is a
    folder of its own in the one that all executors share, deleted when the session ends. The records are read back
    from the shard files by their index rows.
    """
    if folder is None:
        folder = f"{shared_dir(docs.sparkSession)}/lodestone/tokens-{uuid.uuid4().hex}"
        delete_at_exit(docs.sparkSession, folder)
    return read_shards(write_shards(docs, folder, vocabulary), folder)


def read_record(data: bytes) -> np.ndarray:
    """The ids of one framed record; raises ValueError if a length or checksum is wrong."""
    head = np.frombuffer(data[:8], np.uint8)
    if len(data) < 16 or int(masked(crc32c(head, np.array([0]), np.array([8])))[0]) != int.from_bytes(data[8:12], "little"):
        raise ValueError("the record's length is damaged")
    n = int.from_bytes(data[:8], "little")
    if len(data) != n + 16:
        raise ValueError("the record is cut off")
    body = np.frombuffer(data, np.uint8)[12 : 12 + n]
    if int(masked(crc32c(body, np.array([0]), np.array([n])))[0]) != int.from_bytes(data[12 + n :], "little"):
        raise ValueError("the record's payload is damaged")
    return body.view("<u2")


def read_at(folder: str, file: str, offset: int, length: int) -> np.ndarray:
    """One record of a shard by its index row, without reading the rest of the shard."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        return read_record(f.read_at(length, offset))
