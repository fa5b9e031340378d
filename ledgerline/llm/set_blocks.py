"""Links between sets: pairs confirmed on full sets, and what is left of a group compared in blocks of like size.

A group is a key with rows (k, id, label, n, shared): members whose labels differ are not known to hang together yet; n is the size of a
member's set and shared how many of its hashes another set has as well. The largest set that a member can be linked with has
shared * (100 + percent) / percent - n hashes (``reach``), so a family of texts that have a part in common, but not enough of it, drops out by
its counts, without any comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: About so many members, and so many hashes of their sets, are in one block; smaller groups are one block.
BLOCK, BLOCK_HASHES = 1_024, 1 << 20
#: Sizes in one class differ by this factor at most.
CLASS = 1.06


def by_group(rows: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Give ``work`` whole groups, as many at once as arrive together: the table and where its groups start."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            columns = [t.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            starts = np.concatenate([[0], new])
            end = t.num_rows
            if not last:
                if len(starts) == 1:
                    held = t.to_batches()
                    return
                end, starts = int(starts[-1]), starts[:-1]
            made = work(t.slice(0, end), np.append(starts, end))
            held = t.slice(end).combine_chunks().to_batches() if end < t.num_rows else []
            if made and len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=names)

        for batch in batches:
            step = max(1, min(2_000, batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                held.append(batch.slice(k, step))
                yield from give(False)
        if held:
            yield from give(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, schema)


def forest(labels: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, over the nodes' labels, of the links between nodes; ``linked(i, others)`` gives those of ``others``
    with a link to i. Nodes of one label hang together already.

    Grown from node to node, from the rarest label on, so that each node asks only about those not reached yet.
    """
    _, label, size = np.unique(labels, return_inverse=True, return_counts=True)
    out, free = [], np.argsort(size[label] * (len(size) + 1) + label, kind="stable")
    while len(free):
        with_it = label[free] == label[free[0]]
        todo, free = free[with_it].tolist(), free[~with_it]
        while todo and len(free):
            i = todo.pop()
            hit = free[linked(i, free)]
            if not len(hit):
                continue
            reached, at = np.unique(label[hit], return_index=True)
            out += [(i, int(j)) for j in hit[at]]
            joins = np.isin(label[free], reached)
            todo += free[joins].tolist()
            free = free[~joins]
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links: 100 * |intersection| >= percent * |union|. An a may have any number of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ((np.frombuffer(v.as_buffer(), dtype="<u8") for v in batch.column(c)) for c in ("ha", "hb"))
            ok = pa.array([_linked(p, q, percent) for p, q in zip(x, y)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    left, right = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return join_hot(pairs.join(right, "b"), left, "a", "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def confirmed(percent: int) -> Callable[[pa.Table, np.ndarray], list[np.ndarray]]:
    """Finds the links between members of each group with other labels, that join their labels, on ``hashes``."""

    def work(t: pa.Table, starts: np.ndarray) -> list[np.ndarray]:
        ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), dtype="<u8") for c in t.column("hashes").chunks for v in c]
        out = []
        for g in range(len(starts) - 1):
            group = range(starts[g], starts[g + 1])
            if len(group) < 2:
                continue
            n = np.array([len(sets[i]) for i in group])
            # the group's hashes as numbers, only those that two sets have; a table of who has what gives whole rows of intersections
            _, number, count = np.unique(np.concatenate([sets[i] for i in group]), return_inverse=True, return_counts=True)
            shared = count > 1
            name = np.cumsum(shared) - 1
            edges = np.concatenate([[0], np.cumsum(n)])
            parts = [name[x[shared[x]]] for x in (number[edges[k] : edges[k + 1]] for k in range(len(group)))]
            owner = np.repeat(np.arange(len(group)), [len(p) for p in parts])
            flat = np.concatenate(parts)
            order = np.argsort(flat, kind="stable")
            owners, begins = owner[order], np.searchsorted(flat[order], np.arange(int(shared.sum()) + 1))

            def linked(i: int, others: np.ndarray) -> np.ndarray:
                p = parts[i]
                lengths = begins[p + 1] - begins[p]
                total = int(lengths.sum())
                if not total:
                    return np.zeros(len(others), dtype=bool)
                at = np.repeat(begins[p] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)
                both = np.bincount(owners[at], minlength=len(group))[others]
                return 100 * both >= percent * (n[i] + n[others] - both)

            out += [(ids[group[i]], ids[group[j]]) for i, j in forest(label[starts[g] : starts[g + 1]], linked)]
        return list(np.array(out, dtype=np.int64).reshape(-1, 2).T)

    return work


def cells(rows: DataFrame, percent: int) -> DataFrame:
    """(k, cell, id, label): the rows (k, id, label, n, shared) of groups with several labels, dealt to the cells that have to meet.

    A small group is one cell. A large one goes in blocks: by class of size, by whether the label is the group's most frequent
    one, and by a hash of id. Two blocks have a cell if their sizes and reaches allow a link and they don't all have one label.
    """
    per_label = rows.groupBy("k", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sizes = per_label.groupBy("k").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1").select("k", "top", ((F.col("m") > BLOCK) | (F.col("w") > BLOCK_HASHES)).alias("large"))
    reach = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")
    dealt = join_hot(rows, sizes, "k", "id")
    named = dealt.withColumn("class", F.when(F.col("large"), F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(CLASS))) * 2 + (F.col("label") == F.col("top")).cast("long")).otherwise(-1))
    named = named.select("k", "id", "label", "n", reach.alias("reach"), "class")
    stats = named.groupBy("k", "class").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = F.when(F.col("class") < 0, 1).otherwise(F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_HASHES))).cast("int")
    stats = written(stats.withColumn("blocks", blocks), "block-sizes")
    a, b = (stats.select("k", *(F.col(c).alias(f"{c}_{s}") for c in stats.columns if c != "k")) for s in "ab")
    may = (percent * F.col("least_b") <= 100 * F.col("most_a")) & (percent * F.col("least_a") <= 100 * F.col("most_b")) & (F.col("least_b") <= F.col("reach_a")) & (F.col("least_a") <= F.col("reach_b"))
    many = F.least("low_a", "low_b") != F.greatest("high_a", "high_b")
    meets = a.join(b, "k").where((F.col("class_a") <= F.col("class_b")) & may & many)
    same = F.col("class_a") == F.col("class_b")
    first = meets.select("k", F.col("class_a").alias("class"), F.col("blocks_a").alias("own"), F.col("blocks_b").alias("others"), same.alias("same"), F.lit(True).alias("is_first"), "class_a", "class_b")
    second = meets.where(~same).select("k", F.col("class_b").alias("class"), F.col("blocks_b").alias("own"), F.col("blocks_a").alias("others"), F.lit(False).alias("same"), F.lit(False).alias("is_first"), "class_a", "class_b")
    sent = named.join(first.unionByName(second), ["k", "class"])
    sent = sent.withColumn("block", F.pmod(F.xxhash64("id"), F.col("own")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    one = F.when(F.col("same"), F.least("block", "other")).when(F.col("is_first"), F.col("block")).otherwise(F.col("other"))
    two = F.when(F.col("same"), F.greatest("block", "other")).when(F.col("is_first"), F.col("other")).otherwise(F.col("block"))
    return sent.select("k", F.xxhash64("class_a", "class_b", one, two).alias("cell"), "id", "label")


def links_across(rows: DataFrame, payload: DataFrame, percent: int, work: Callable[[pa.Table, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(a, b) of labels: what ``work`` finds between members with other labels of the groups ``rows``; ``payload`` (id, ...) is what it compares."""
    dealt = written(cells(rows, percent), "cells")
    found = written(by_group(dealt.join(payload, "id"), ["k", "cell"], "a long, b long", work), "links-across")
    label = rows.select("id", "label").join(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").distinct()
    label = written(label, "labels-across")
    joined = found.join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return joined.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
