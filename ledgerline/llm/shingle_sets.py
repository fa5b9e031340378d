"""Sets of shingles: the hashes of a document's distinct runs of five words, and how many of them other documents have too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_batches
from .hashing import grams, hash_words

WORDS = 5
#: Shingles of a block, documents of a block, and shingles of a bucket.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_TOKENS = 1 << 19, 60_000, 1 << 20
#: The number of buckets is two to the power of this at least.
LEAST_BUCKETS = 6
_LOCAL, _NULL = 0xFFFF, -(1 << 63)
_COUNTS = "kind int, block long, bucket int, tokens binary, owners binary, ids binary, sizes binary, digests binary, counts binary"


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the runs of five words, or of all words where there are fewer."""
    words = text.lower().split()
    return np.unique(grams(hash_words(words), min(WORDS, len(words)))) if words else np.zeros(0, dtype=np.uint64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    begins = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1]) if len(sorted_values) else np.zeros(0, dtype=np.int64)
    return begins, np.diff(np.append(begins, len(sorted_values)))


def shared_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the set, null without words) and shared: how many of its shingles other rows have too.

    A document whose shared shingles are too few for a link can't have one, whatever the others are. Shingles are dealt by hash, a few bytes each, in one
    row for each block of a task's documents and bucket. One that a block has several times goes out once, so a passage that a third
    of all documents hold costs an entry for each block. Shingles are compared by 32 bits of their hash and the bucket's; one
    taken for shared by chance only keeps a document in the search.
    """
    docs = id_and_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS, (int(size / 6 / BUCKET_TOKENS)).bit_length())  # about six bytes a word
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "owners", "ids", "sizes", "digests", "counts"))])

    def rows_of(made: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m.get(f.name) for m in made], type=f.type) for f in schema], schema=schema)

    def out_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, sets, held
            sizes = np.array([len(s) for s in sets], dtype="<i8")
            counts = np.zeros(len(sets), dtype="<i8")
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            tokens = np.concatenate(sets) if held else np.zeros(0, dtype=np.uint64)
            owners = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
            sets = []
            order = np.argsort(tokens)
            tokens, owners = tokens[order], owners[order]
            begins, times = _runs(tokens)
            again = np.repeat(times > 1, times)
            counts += np.bincount(owners[again], minlength=len(counts))
            tokens, sent = tokens[begins], np.where(times > 1, _LOCAL, owners[begins]).astype("<u2") if held else owners
            # the bucket is in the top bits, so the tokens of a bucket lie together
            place = (tokens >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
            begins, times = _runs(place)
            small = ((tokens >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            made = [{"kind": 0, "block": block, "bucket": block % buckets, "ids": np.array([_NULL if i is None else i for i in ids], dtype="<i8").tobytes(), "sizes": sizes.tobytes(), "digests": digests, "counts": counts.tobytes(), "owners": bytes(i is None for i in ids)}]
            made += [{"kind": 1, "block": block, "bucket": int(place[b]), "tokens": small[b : b + t].tobytes(), "owners": sent[b : b + t].tobytes()} for b, t in zip(begins.tolist(), times.tolist())]
            for at in range(0, len(made), 64):
                yield rows_of(made[at : at + 64])
            block, ids, sets, held = block + 1, [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_batches(batch)):
                s = shingles(text)
                if held and (held + len(s) > BLOCK_TOKENS or len(ids) >= BLOCK_DOCS):
                    yield from give()
                elif len(ids) >= BLOCK_DOCS:
                    yield from give()
                ids.append(doc_id)
                sets.append(s)
                held += len(s)
        if ids:
            yield from give()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, blocks = [], [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            keep = pa.array(kind == 0)
            if (kind == 0).any():
                yield batch.filter(keep)
            part = batch.filter(pa.array(kind == 1))
            for block, bucket, t, o in zip(*(part.column(c).to_pylist() for c in ("block", "bucket", "tokens", "owners"))):
                tokens.append((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(t, dtype="<u4").astype(np.uint64))
                owners.append(np.frombuffer(o, dtype="<u2"))
                blocks.append(block)
        if not blocks:
            return
        lengths = [len(t) for t in tokens]
        tokens, owners, block = np.concatenate(tokens), np.concatenate(owners), np.repeat(np.arange(len(blocks)), lengths)
        order = np.argsort(tokens)
        _, times = _runs(tokens[order])
        shared = np.zeros(len(tokens), dtype=bool)
        shared[order] = np.repeat(times > 1, times)
        shared &= owners != _LOCAL
        who, n = np.unique((block[shared].astype(np.int64) << 16) | owners[shared], return_counts=True)
        begins, times = _runs(who >> 16)
        made = [{"kind": 1, "block": blocks[int(who[b] >> 16)], "owners": (who[b : b + t] & 0xFFFF).astype("<u2").tobytes(), "counts": n[b : b + t].astype("<u4").tobytes()} for b, t in zip(begins.tolist(), times.tolist())]
        for at in range(0, len(made), 64):
            yield rows_of(made[at : at + 64])

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts = None, None  # of the block at hand: its first row has its documents

        def give() -> pa.RecordBatch:
            none, sizes = np.frombuffer(head["owners"], dtype=np.bool_), np.frombuffer(head["sizes"], dtype="<i8")
            keys = [head["digests"][k : k + 16] if n else None for k, n in zip(range(0, 16 * len(sizes), 16), sizes.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(head["ids"], dtype="<i8"), mask=none), pa.array(sizes), pa.array(keys, type=pa.binary()), pa.array(counts)], names=["doc_id", "n_shingles", "key", "shared"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if head:
                        yield give()
                    head, counts = r, np.frombuffer(r["counts"], dtype="<i8").copy()
                else:
                    counts[np.frombuffer(r["owners"], dtype="<u2")] += np.frombuffer(r["counts"], dtype="<u4")
        if head:
            yield give()

    sent = docs.mapInArrow(out_of_texts, _COUNTS).repartition(buckets, "bucket").mapInArrow(counted, _COUNTS)
    return sent.drop("bucket", "tokens").repartition("block").sortWithinPartitions("block", "kind").mapInArrow(by_document, "doc_id long, n_shingles long, key binary, shared long")


def least_shared(n: F.Column, percent: int) -> F.Column:
    """ceil(percent * n / 100): so many shingles a linked set has in common with another at least."""
    return F.floor((percent * n + 99) / 100).cast("long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, hashes): the sets of the documents ``ids``; empty ones are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                made = [shingles(t) for t in text_batches(part)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in made], type=pa.int64()), pa.array([s.tobytes() for s in made], type=pa.binary())], names=["id", "n", "hashes"])

    # the ids grow with the input, so they are dealt like the texts, never broadcast; hashed, so that no texts are sorted
    return docs.withColumnRenamed("doc_id", "id").join(ids.select("id").hint("shuffle_hash"), "id", "left_semi").mapInArrow(work, "id long, n long, hashes binary").where("n > 0")
