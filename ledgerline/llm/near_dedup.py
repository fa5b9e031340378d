"""Near-duplicate groups by MinHash signatures in a multi-index Hamming join, confirmed on full sets.

A document's set holds the hashes of its distinct runs of five words. 60 minimum hashes of 16 bits make its
signature. The signature is split into 15 chunks of four: two signatures that differ in at most 29 places
have, by pigeonhole, a chunk with at most one error, so each chunk is entered under its four keys
with one place left out, and all such pairs meet under a key. Two documents at the similarity of 0.75 differ in
more than 29 places with a chance of 3e-5, closer ones with less.

1. A document with less than 75 % of its shingles in other documents has no link and stops there (see shared_counts). Of the rest,
   documents with equal sets are one class, and only its smallest doc_id goes on.
2. Under each key every signature is compared with that of the smallest id, once for all keys that give the same
   pair. Only the keys whose members are still in several components are compared further, in blocks and only across
   components. These components hold every link within 29 places.
3. In the same way on full sets: every document is compared with the closest one of step 2; then, where a
   component is still in several parts, in blocks across the parts.

A group that hangs together by its first comparisons, as large groups of copies do, costs a few rows for each member. What is still
apart in a large group meets in blocks of like size, and only where sizes and shared shingles allow a link, so texts of a
template that have a part in common, but not enough of it, are never compared (see set_blocks).

Rows without words, with null text or null doc_id are linked with nothing. Rows with the same doc_id count as
one document in the links. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, join_hot, written
from .graph import components, contracted, merged
from .set_blocks import confirmed, forest, linked_pairs, links_across
from .shingle_sets import full_sets, least_shared, shared_counts

PERCENT = 75
PLACES, CHUNK = 60, 4
#: The farthest apart for which a chunk with at most one error is sure.
NEAR = 2 * (PLACES // CHUNK) - 1

_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> bytes:
    """PLACES minimum hashes, cut to 16 bits each."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 4_096):
        np.minimum(least, (hashes[None, k : k + 4_096] * _FACTORS[:, None]).min(1), out=least)
    # the low bits of a minimum are those of its hash times an odd number; mix before cutting
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype("<u2").tobytes()


def signatures(sets: DataFrame) -> DataFrame:
    """(id, n, signature) of sets (id, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(np.frombuffer(v.as_buffer(), dtype="<u8")) for v in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(made, type=pa.binary())], names=["id", "n", "signature"])

    return sets.mapInArrow(run, "id long, n long, signature binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(k, id): the keys of each signature. 16 bits name the chunk and the place left out, 48 are the other places."""
    left_out = [(c, o) for c in range(PLACES // CHUNK) for o in range(CHUNK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u2").reshape(-1, PLACES).astype(np.int64)
            for start in range(0, len(ids), 2_000):
                s, out = sig[start : start + 2_000], []
                for name, (c, o) in enumerate(left_out):
                    a, b, d = (s[:, CHUNK * c + k] for k in range(CHUNK) if k != o)
                    out.append((name << 48) | (a << 32) | (b << 16) | d)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(ids[start : start + 2_000], len(left_out)))], names=["k", "id"])

    return reps.select("id", "signature").mapInArrow(run, "k long, id long")


def _sizes_allow(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, PLACES)


def _close_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b, apart) of the pairs (a, b) whose signatures differ in at most NEAR places. An a may have any number of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_signatures(batch.column("sa")) != _signatures(batch.column("sb"))).sum(1)
            ok = pa.array((apart <= NEAR) & _sizes_allow(batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart)], names=["a", "b", "apart"]).filter(ok)

    left, right = (signatures.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    return join_hot(pairs.join(right, "b"), left, "a", "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, apart long")


def _close_signatures(t: pa.Table, starts: np.ndarray) -> list[np.ndarray]:
    """Pairs of members of each group with other labels, within NEAR places, that join their labels."""
    ids, label, n = (t.column(c).to_numpy() for c in ("id", "label", "n"))
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype="<u2").reshape(-1, PLACES)
    out = []
    for g in range(len(starts) - 1):
        s = slice(starts[g], starts[g + 1])
        gs, gn, gi = sig[s], n[s], ids[s]
        out += [(gi[i], gi[j]) for i, j in forest(label[s], lambda i, o: ((gs[o] != gs[i]).sum(1) <= NEAR) & _sizes_allow(gn[i], gn[o]))]
    return list(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def _candidates(reps: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) that hold every link within NEAR places, and for each b of them the closest
    a it was compared with first: (a, b)."""
    keys = _keys(reps)
    leads = keys.groupBy("k").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1").drop("size")
    met = written(join_hot(keys, leads, "k", "id"), "shared-keys")
    pairs = met.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    close = written(_close_pairs(written(pairs, "pairs"), reps), "close")
    labels = written(components(contracted(close)), "close-groups")

    labelled = met.select("k", "id").join(labels, "id", "left").select("k", "id", F.coalesce("component", "id").alias("label")).join(sizes, "id")
    more = links_across(labelled, reps, PERCENT, _close_signatures)
    wide = written(_over(labels, more), "candidate-groups")
    closest = close.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    return wide, written(closest, "closest")


def _over(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) joined by links ``more`` between them, with the ids that had no component until then."""
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    alone = ends.join(labels.select(F.col("component").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("component"))
    return merged(labels.unionByName(alone), more)


def _links(sets: DataFrame, sizes: DataFrame, wide: DataFrame, closest: DataFrame) -> DataFrame:
    """Components (id, component) of the links on full sets."""
    labels = written(components(linked_pairs(closest, sets, PERCENT)), "linked")
    labelled = wide.join(labels.withColumnRenamed("component", "label"), "id", "left").join(sizes, "id").select(F.col("component").alias("k"), "id", F.coalesce("label", "id").alias("label"), "n", "shared")
    more = links_across(written(labelled, "candidates"), sets.select("id", "hashes"), PERCENT, confirmed(PERCENT))
    return _over(labels, more)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = id_and_text(docs)
    found = written(shared_counts(docs), "shared-counts")
    named = found.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("shared").alias("shared")), "classes")
    sizes = written(classes.where(F.col("shared") >= least_shared(F.col("n"), PERCENT)).select("id", "n", "shared").distinct(), "sizes")
    sets = written(full_sets(docs, sizes), "sets")
    reps = written(signatures(sets), "signatures")

    # a doc_id may stand for several sets where ids repeat: the joins by id then bring all of them
    linked = _links(sets, sizes, *_candidates(reps, sizes))
    over = classes.join(linked, "id").where("component <> id").select("key", "component")
    out = join_hot(named, classes.select("key", "id"), "key", "doc_id").join(over, "key", "left")
    whole = out.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    whole = whole.unionByName(found.where(F.col("key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are the smallest doc_id of their group (those linked with nothing among them)."""
    return docs.join(groups(docs).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
