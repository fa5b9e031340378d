"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector over the terms of the items, its entries the saturated frequencies; an item is the vector of its terms'
weights. The highest scores are the highest inner products.

1. Items go in blocks of at most ITEMS rows and about TERMS terms, each block in a pass of its own; what a task holds of the items is
   bounded by that. A pass reads the texts once and writes, for each document, its length and the frequencies of the block's terms.
   Document counts of terms, N and L are sums over all documents.
2. Each task takes its documents in blocks of at most BLOCK rows and builds a ball tree over each: a node has the
   centroid of its documents and their radius around it, one radius in each of GROUPS groups of terms that items have together, and is halved
   between two documents far apart. An inner product with any of them is at most that with the centroid plus, summed over the groups, the item's
   length there times the radius there, rounded up. One radius over all terms holds as well but prunes next to nothing, as an item's terms are few.
   Space is scaled by the square root of each term's weight on both sides, which leaves inner products as they are.
3. For each item the nodes are visited best bound first, and the visit ends when the best bound left is under the item's tenth score so far, which
   is carried from block to block. Leaves are scored in whole numbers, exactly. A task gives out ten rows an item at most; they meet in two steps.

Null texts, and texts without terms, count nowhere and are not found. Rows that repeat are separate documents and items; a
null doc_id comes after all others among equal scores. Items without terms have no rows. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, text_batches, written

TOP = 10
#: Items and terms of a pass; documents and entries of a tree; documents of a leaf.
ITEMS, TERMS = 256, 16_384
BLOCK, BLOCK_ENTRIES, LEAF = 4_096, 1 << 20, 8
#: Groups of terms with a radius of their own.
GROUPS = 64
#: Bytes of centroids multiplied at once.
CENTROID_BYTES = 32 << 20
#: Places among which a task's best rows of an item are spread first.
SPREAD = 64
_NO_ID = 1 << 63
#: ASCII digits and letters, these in lower case, and all bytes from 0x80 on make terms; the rest parts them.
_TO_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def damping(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms."""
    exact = n if len(n) == 0 or 90 * int(n.max()) * n_docs < 2**63 else n.astype(object)
    return (10 + (90 * exact * n_docs) // total).astype(np.int64)


@dataclass
class Tree:
    """A ball tree over documents as rows of a sparse matrix, rows in the order of its leaves."""

    ids: np.ndarray
    starts: np.ndarray  # of each row's entries, with the end
    terms: np.ndarray
    values: np.ndarray  # whole numbers
    left: list[int] = field(default_factory=list)  # first child; the second follows it; 0 for a leaf
    rows: list[tuple[int, int]] = field(default_factory=list)
    bounds: np.ndarray | None = None  # (nodes, items)


def term_groups(queries: np.ndarray, n_groups: int = GROUPS) -> np.ndarray:
    """The group of each term: items far apart in their terms lead a group each, an item joins the one most like it, a term the one that has it most."""
    has = (queries > 0).T.astype(np.float64)
    alike = (has @ has.T) / np.maximum(np.sqrt(np.outer(has.sum(1), has.sum(1))), 1)
    leads, nearest = [0], alike[0].copy()
    for _ in range(min(n_groups, len(has)) - 1):
        leads.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, alike[leads[-1]])
    own = alike[:, leads].argmax(1)
    return np.array([has[own == g].sum(0) for g in range(len(leads))]).argmax(0)


def build(ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray, queries: np.ndarray, groups: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree, and for each node and item (a column of ``queries``, scaled) a bound that no score exceeds. Rows have entries."""
    scaled = values * scale[terms]
    size = np.diff(starts)
    norms = np.add.reduceat(scaled * scaled, starts[:-1])
    order = np.arange(len(ids))
    n_groups = int(groups.max()) + 1
    lengths = np.sqrt(np.array([np.bincount(groups, q * q, n_groups) for q in queries.T])).T
    tree, n_terms = Tree(ids, starts, terms, values), len(scale)
    todo, spans, centres, radii, bounds = [0], [(0, len(ids))], [], [], []
    tree.left = [0]

    def flush() -> None:
        if centres:
            exact = np.array(centres) @ queries + np.array(radii) @ lengths
            bounds.append(exact * (1 + 1e-9) + 1e-6)
            centres.clear()
            radii.clear()

    node = 0
    while node < len(spans):
        lo, hi = spans[node]
        rows = order[lo:hi]
        count = size[rows]
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        at = np.repeat(starts[rows] - begin, count) + np.arange(int(count.sum()))
        t, v = terms[at], scaled[at]
        centre = np.bincount(t, v, n_terms) / len(rows)
        squares = norms[rows]

        def apart(point: np.ndarray) -> np.ndarray:
            return squares - 2 * np.add.reduceat(v * point[t], begin) + point @ point

        own = np.repeat(np.arange(len(rows)) * n_groups, count) + groups[t]
        by_group = np.bincount(own, v * (v - 2 * centre[t]), len(rows) * n_groups).reshape(-1, n_groups).max(0) + np.bincount(groups, centre * centre, n_groups)
        # the squares are rounded in proportion to what they are taken from
        radii.append(np.sqrt(np.maximum(by_group, 0.0) + 1e-11 * (float(squares.max()) + float(centre @ centre))))
        centres.append(centre)
        if len(centres) * n_terms * 8 >= CENTROID_BYTES:
            flush()
        if len(rows) > leaf:
            one = rows[int(apart(centre).argmax())]
            first = np.bincount(terms[starts[one] : starts[one + 1]], scaled[starts[one] : starts[one + 1]], n_terms)
            from_first = apart(first)
            two = rows[int(from_first.argmax())]
            second = np.bincount(terms[starts[two] : starts[two + 1]], scaled[starts[two] : starts[two + 1]], n_terms)
            half = len(rows) // 2
            order[lo:hi] = rows[np.argpartition(from_first - apart(second), half)]
            tree.left[node] = len(spans)
            spans += [(lo, lo + half), (lo + half, hi)]
            tree.left += [0, 0]
        node += 1
    flush()
    begin = np.concatenate([[0], np.cumsum(size[order])])
    at = np.repeat(starts[order] - begin[:-1], size[order]) + np.arange(int(begin[-1]))
    tree.ids, tree.terms, tree.values, tree.starts, tree.rows, tree.bounds = ids[order], terms[at], values[at], begin, spans, np.concatenate(bounds)
    return tree


def search(tree: Tree, item: int, weight: np.ndarray, best: list[tuple[int, int]], top: int = TOP) -> int:
    """Better ``best``, a heap of at most ``top`` (score, -doc_id), by the tree's rows; gives the number of rows scored."""
    bounds, seen = tree.bounds[:, item], 0
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        least = best[0][0] if len(best) == top else 1
        if -bound < least:
            break
        if tree.left[node]:
            for child in (tree.left[node], tree.left[node] + 1):
                if bounds[child] >= least:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        lo, hi = tree.rows[node]
        a, b = tree.starts[lo], tree.starts[hi]
        scores = np.add.reduceat(tree.values[a:b] * weight[tree.terms[a:b]], tree.starts[lo:hi] - a)
        seen += hi - lo
        for r in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[r]), -int(tree.ids[lo + r]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return seen


@dataclass(frozen=True)
class Block:
    """Items of one pass: their ids, their terms' numbers, and the numbers of all terms."""

    ids: list[int | None]
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


def item_blocks(items: DataFrame) -> DataFrame:
    """(block, item_id, terms): every item's distinct terms, in blocks of bounded size."""
    parts = max(1, -(-items.count() // (8 * ITEMS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for text in text_batches(batch):
                terms = sorted(set(terms_of(text)))
                if rows and (rows >= ITEMS or held + len(terms) > TERMS):
                    block, rows, held = block + 1, 0, 0
                rows, held = rows + 1, held + len(terms)
                out.append((block, terms))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], type=pa.int64()), batch.column("doc_id"), pa.array([t for _, t in out], type=pa.list_(pa.binary()))], names=["block", "item_id", "terms"])

    texts = id_and_text(items.select(F.col("item_id").alias("doc_id"), "text")).repartition(parts)
    return written(texts.mapInArrow(run, "block long, item_id long, terms array<binary>").where(F.size("terms") > 0), "items")


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has terms: its length, and the block's terms with their frequencies."""
    bound = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bound.value.keys()
        for batch in batches:
            ids, lengths, terms, counts = batch.column("doc_id").to_pylist(), [], [], []
            for text in text_batches(batch):
                words = terms_of(text)
                found = Counter(words)
                both = [w for w in found if w in known]
                lengths.append(len(words))
                terms.append(np.array([bound.value[w] for w in both], dtype="<i4").tobytes())
                counts.append(np.array([found[w] for w in both], dtype="<i8").tobytes())
            made = pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(lengths, type=pa.int64()), pa.array(terms, type=pa.binary()), pa.array(counts, type=pa.binary())], names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array([x > 0 for x in lengths], type=pa.bool_()))

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """df of each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4"), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def best_of_tasks(rows: DataFrame, block: Block, weight: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """(item, doc_id, score): for each item of the block the best rows of each task."""
    n_terms = len(weight)
    bound = rows.sparkSession.sparkContext.broadcast((block.terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_terms, weight = bound.value
        scale = np.sqrt(weight.astype(np.float64))
        queries = np.zeros((n_terms, len(item_terms)))
        for k, t in enumerate(item_terms):
            queries[t, k] = scale[t]
        groups = term_groups(queries)
        best: list[list[tuple[int, int]]] = [[] for _ in item_terms]
        held: list[tuple[np.ndarray, ...]] = []

        def give() -> None:
            ids, n, size, terms, counts = (np.concatenate(c) for c in zip(*held))
            held.clear()
            starts = np.concatenate([[0], np.cumsum(size)])
            m = np.repeat(damping(n, n_docs, total), size)
            values = (1_000_000_000 * counts) // (1000 * counts + 8 * m)
            tree = build(ids, starts, terms, values, scale, queries, groups)
            own = np.zeros(n_terms, dtype=np.int64)
            for k, t in enumerate(item_terms):
                own[t] = weight[t]
                search(tree, k, own, best[k], top)
                own[t] = 0

        rows_held = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size = np.array([len(t) // 4 for t in part.column("terms").to_pylist()], dtype=np.int64)
                some = pa.array(size > 0)
                part, size = part.filter(some), size[size > 0]
                if not len(size):
                    continue
                ids = np.array([_NO_ID if i is None else i for i in part.column("doc_id").to_pylist()], dtype=object)
                held.append((ids, part.column("n").to_numpy(), size, np.frombuffer(b"".join(part.column("terms").to_pylist()), dtype="<i4"), np.frombuffer(b"".join(part.column("counts").to_pylist()), dtype="<i8")))
                rows_held, entries = rows_held + len(size), entries + int(size.sum())
                if rows_held >= BLOCK or entries >= BLOCK_ENTRIES:
                    give()
                    rows_held = entries = 0
        if held:
            give()
        out = [(k, None if -i == _NO_ID else -i, s) for k, b in enumerate(best) for s, i in b]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the ``top`` documents of highest score above 0."""
    spark, schema = docs.sparkSession, "item_id long, rank int, doc_id long, score long"
    listed = item_blocks(items)
    out = spark.createDataFrame([], schema)
    for (number,) in sorted(listed.select("block").distinct().collect()):
        found = [(r.item_id, r.terms) for r in listed.where(F.col("block") == number).select("item_id", "terms").collect()]
        numbers = {t: k for k, t in enumerate(sorted({bytes(t) for _, terms in found for t in terms}))}
        block = Block([i for i, _ in found], [np.array([numbers[bytes(t)] for t in terms], dtype=np.int64) for _, terms in found], numbers)
        rows = written(postings(docs, numbers), "postings")
        n_docs, total = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weight = weights(document_counts(rows, len(numbers)), n_docs)
        best = best_of_tasks(rows, block, weight, n_docs, total, top).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        first = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "place").orderBy(*order))).where(F.col("rank") <= top)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        out = out.unionByName(last.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out
