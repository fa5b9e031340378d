"""Token-id files: ids in the fewest bits that the vocabulary needs, in blocks with offsets.

A file set is a folder with two Parquet tables. ``blocks`` has one row for each block of about
``BLOCK`` ids: the shard and its running number, the ids before it in its shard, the packed ids (64-bit
little-endian words, the first id in the lowest bits), and the doc_id, start and length of each document in it. A
document is never split over blocks. ``shards`` has the ids before each shard. Shards and blocks follow
doc_id in ascending order, so the position of every document and of any id is known without a scan.

Null and empty texts hold only the end id. Documents with equal or null doc_id follow each other in the order of their texts,
nulls first. An empty table gives an empty file set.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, shared_folder, text_batches

BLOCK = 65_536
_BLOCKS = "shard long, block long, before long, bits int, n_ids long, packed binary, doc_ids array<long>, starts array<long>, lengths array<long>"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, one after the other, in 64-bit words."""
    if not len(ids):
        return b""
    at = np.arange(len(ids), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    values = ids.astype(np.uint64)
    words = np.zeros((len(ids) * bits + 63) // 64, dtype="<u8")
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + bits > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return words.tobytes()


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; reads only the words that hold them."""
    if not count:
        return np.zeros(0, dtype=np.uint32)
    at = (start + np.arange(count, dtype=np.int64)) * bits
    words = np.append(np.frombuffer(packed, dtype="<u8", offset=(start * bits >> 6) * 8), np.uint64(0))
    word, shift = (at >> 6) - (start * bits >> 6), (at & 63).astype(np.uint64)
    low = words[word] >> shift
    over = (at & 63) + bits > 64
    low[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return (low & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_token_files(docs: DataFrame, encode: Callable[[list[bytes]], list[bytes]], vocabulary: int, end_id: int, path: str | None = None, block: int = BLOCK) -> str:
    """Encode, pack and write; gives the folder. ``encode`` makes the 32-bit ids of a list of texts.

    One range shuffle of the texts by doc_id; encoding and packing happen behind it, block by block. The
    driver gets one sum for each shard.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    path = path or f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = before = number = 0

        def block_row() -> pa.RecordBatch:
            nonlocal held, size, before, number
            lengths = [len(b) // 4 for _, b in held]
            starts = np.cumsum([0, *lengths[:-1]])
            packed = pack(np.frombuffer(b"".join(b for _, b in held), dtype="<u4"), bits)
            row = [[shard], [number], [before], [bits], [size], [packed], [[d for d, _ in held]], [starts.tolist()], [lengths]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            out = pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])
            before, number, held, size = before + size, number + 1, [], 0
            return out

        for batch in batches:
            for step in range(0, batch.num_rows, 1_000):
                part = batch.slice(step, 1_000)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(text_batches(part))):
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= block:
                        yield block_row()
        if held:
            yield block_row()

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    total, shards = 0, []
    for s in sums:
        shards.append((s["shard"], total))
        total += s["n"]
    spark.createDataFrame(shards, "shard long, shard_start long").coalesce(1).write.parquet(f"{path}/shards")
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids of every document of a file set."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids: ids.astype(np.int64))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, schema: str, of: Callable[[np.ndarray], object]) -> DataFrame:
    # One row for each shard, that is for each task of the write: small enough to broadcast at any size of input.
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    names = [c.split()[0] for c in schema.split(", ")]
    last = pa.list_(pa.int64()) if "array" in schema else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                base = b["shard_start"] + b["before"]
                ids = unpack(b["packed"], b["bits"], 0, b["n_ids"])
                made = [of(ids[s : s + n]) for s, n in zip(b["starts"], b["lengths"])]
                columns = [pa.array(b["doc_ids"], type=pa.int64()), pa.array([base + s for s in b["starts"]], type=pa.int64()), pa.array(b["lengths"], type=pa.int64()), pa.array(made, type=last)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, schema)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole file set, by block offsets: only the blocks that hold them are fetched.

    They go to the driver, so this is for looking at a place; ``read_documents`` reads any number of ids as a table.
    """
    at = F.col("shard_start") + F.col("before")
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    rows = blocks.where((at < start + count) & (at + F.col("n_ids") > start)).select(at.alias("at"), "n_ids", "bits", "packed").orderBy("at").collect()
    out = [np.zeros(0, dtype=np.uint32)]
    for r in rows:
        a, b = max(start, r["at"]) - r["at"], min(start + count, r["at"] + r["n_ids"]) - r["at"]
        out.append(unpack(bytes(r["packed"]), r["bits"], a, b - a))
    return np.concatenate(out)
