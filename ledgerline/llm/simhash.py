"""SimHash fingerprints, and all pairs of them within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words, pairs counting four times as much as words and each by
1 + log(count). Every term has a 128-bit hash; each bit of the fingerprint is the sign of the weighted votes of
that bit. ``likeness`` turns the share of differing bits into the cosine it estimates, 0 at the least.

``within`` finds, for a stated set of query documents, how many others have a fingerprint within a radius, by permuted block
tables: with radius + 1 blocks, two fingerprints within the radius agree in a block, so there is a table for each block that has it
as its key. Equal fingerprints go into the tables once with their number. The rows of a key are compared with its queries in parts of
bounded size, and only counts go out; a pair counts in the first table in which it meets.

Null and empty texts have the fingerprint of no votes (all bits 0), and likeness 1 to each other. The next
document of the last is the first; a single document follows itself. Rows with equal doc_id follow each other in the
order of their texts; rows with null doc_id come first and are no queries. A long text takes memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_batches, written
from .hashing import grams, hash_words, mix

BITS = 128
#: Radius of the search, and which rows are its queries: those whose doc_id this number divides.
RADIUS, QUERIES_EACH = 3, 50
#: Rows of a key of a block table that meet its queries at once.
PART = 4_096
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(text: bytes) -> int:
    words = hash_words(text.lower().split())
    if not len(words):
        return 0
    singles, n1 = np.unique(words, return_counts=True)
    pairs, n2 = np.unique(grams(words, 2), return_counts=True)
    terms = np.concatenate([mix(singles), pairs])
    weight = np.concatenate([1 + np.log(n1), 4 * (1 + np.log(n2))]).astype(np.float32)
    votes = np.zeros(BITS, dtype=np.float32)
    for k in range(0, len(terms), 4_096):
        t = terms[k : k + 4_096]
        both = np.stack([t, mix(t ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(t), BITS // 8), axis=1)
        votes += weight[k : k + 4_096] @ bits.astype(np.float32)
    # bits are 0 or 1; more than half of the weight is a vote for 1
    return int.from_bytes(np.packbits(votes > weight.sum() / 2).tobytes(), "big")


def as_text(f: int) -> str:
    return f"{f:0{BITS // 4}x}"


def likeness(a: int, b: int) -> float:
    return round(max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS)), 12)


def with_next(docs: DataFrame) -> DataFrame:
    """Texts dealt to ascending ranges of doc_id, with the first text of the next range at the end of each.

    ``bucket`` numbers the ranges, null ids first, several for each shuffle partition so that these get even shares; ``extra`` marks
    the row that only serves as the next one. Range limits are quantiles of doc_id; these and the first ids of the ranges pass
    through the driver, a few for each shuffle partition.
    """
    docs = id_and_text(docs)
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = np.unique(np.array(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n), dtype=np.int64))

    def bucket_of(ids: pa.Array) -> np.ndarray:
        at = np.searchsorted(limits, ids.fill_null(0).to_numpy(), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0))), batch.column(0)], names=["bucket", "doc_id"])

    firsts = {r["bucket"]: r["first"] for r in docs.select("doc_id").mapInArrow(count, "bucket long, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the last one comes before the first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = bucket_of(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets), pa.array(np.zeros(len(buckets), dtype=np.int32))], names=["doc_id", "text", "bucket", "extra"])
            first = [k for k, (i, b) in enumerate(zip(batch.column("doc_id").to_pylist(), buckets.tolist())) if firsts[b] == i]
            if first:
                some = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([before[b] for b in buckets[first].tolist()], type=pa.int64()), pa.array(np.ones(len(first), dtype=np.int32))], names=["doc_id", "text", "bucket", "extra"])

    return docs.mapInArrow(place, "doc_id long, text string, bucket long, extra int")


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edited text, and how alike they and the next document's are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                yield from zip(part.column("bucket").to_pylist(), part.column("extra").to_pylist(), part.column("doc_id").to_pylist(), text_batches(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        names = [c.split()[0] for c in _ROW.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _ROW.split(", ")]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for bucket, extra, doc_id, raw in rows(batches):
            if held is not None and held[0] != bucket:
                held = None
            if extra and held is None:
                continue
            mark = fingerprint(raw)
            text = raw.decode("utf-8", "replace")
            if held is not None:
                _, before_id, before, before_mark = held
                changed = edited(before, text).encode()
                changed_mark = fingerprint(changed)
                out.append((before_id, len(before), hashlib.sha256(changed).hexdigest(), as_text(before_mark), as_text(changed_mark), likeness(before_mark, changed_mark), likeness(before_mark, mark)))
                if len(out) >= 2_000:
                    yield flush()
            # the first row marked extra ends its range; more of them (equal ids) follow it and serve nothing
            held = None if extra else (bucket, doc_id, text, mark)
        if out:
            yield flush()

    dealt = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")
    return dealt.mapInArrow(run, _ROW)


def _halves(marks: list[str]) -> np.ndarray:
    """Fingerprints as rows of two 64-bit numbers."""
    return np.frombuffer(bytes.fromhex("".join(marks)), dtype=">u8").reshape(-1, BITS // 64)


def within(marks: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, n_near): for each row of ``queries`` the number of other rows of ``marks`` within ``radius`` bits.

    Both have doc_id and fingerprint; the queries are among the marks.
    """
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    masks = [_mask(a, b) for a, b in zip(edges, edges[1:])]
    counted = marks.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = queries.select(F.col("fingerprint")).distinct()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint")
            bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(prints.to_pylist())), dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
            for t, (a, b) in enumerate(zip(edges, edges[1:])):
                keys = [bytes([t]) + x.tobytes() for x in np.packbits(bits[:, a:b], axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), prints, batch.column("n")], names=["key", "fingerprint", "n"])

    rows = counted.mapInArrow(tables, "key binary, fingerprint string, n long")
    asks = asked.withColumn("n", F.lit(0).cast("long")).mapInArrow(tables, "key binary, fingerprint string, n long")
    parts = rows.join(asks.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    mine = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")).drop("parts")
    every = asks.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = mine.unionByName(every).repartition("key", "part").sortWithinPartitions("key", "part", "n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def give() -> pa.RecordBatch:
            prints, ns = [p for p, _ in held], np.array([n for _, n in held])
            table, halves = group[0][0], _halves(prints)
            of = halves[ns > 0]
            out = []
            for p, h in zip((p for p, n in held if n == 0), halves[ns == 0]):
                x = of ^ h
                near = np.bitwise_count(x).sum(1) <= radius
                # a pair that agrees in an earlier block has been counted there
                for t in range(table):
                    near &= (x & masks[t]).any(1)
                out.append((p, int(ns[ns > 0][near].sum())))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["fingerprint", "near"])

        for batch in batches:
            for key, part, p, n in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "fingerprint", "n"))):
                if (key, part) != group:
                    if held:
                        yield give()
                    group, held = (key, part), []
                held.append((p, n))
        if held:
            yield give()

    found = dealt.mapInArrow(count, "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))
    return queries.select("doc_id", "fingerprint").join(found, "fingerprint", "left").select("doc_id", "fingerprint", (F.coalesce("near", F.lit(1)) - 1).alias("n_near"))


def _mask(a: int, b: int) -> np.ndarray:
    """The bits ``a`` to ``b`` of a fingerprint, as its two numbers."""
    whole = sum(1 << (BITS - 1 - k) for k in range(a, b))
    return np.array([whole >> 64, whole & ((1 << 64) - 1)], dtype=np.uint64)


def searched(docs: DataFrame, radius: int = RADIUS, each: int = QUERIES_EACH) -> DataFrame:
    """``fingerprints``, and n_near: for rows whose doc_id ``each`` divides the number of other documents within ``radius``, else null."""
    rows = written(fingerprints(docs), "fingerprints")
    queries = rows.where(F.col("doc_id") % each == 0)
    near = within(rows, queries, radius).groupBy("doc_id", "fingerprint").agg(F.max("n_near").alias("n_near"))
    return rows.join(near, ["doc_id", "fingerprint"], "left")
