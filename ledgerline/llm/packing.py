"""Best-fit packing by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens: one over that length is cut into full pieces,
with the rest as its first piece. Pieces, a few numbers each, are dealt evenly over tasks first, whatever lies in the same file, so
that all tasks see the same mix of lengths. Each task packs its pieces best-fit, longest first, and gives out the bins that
are nearly full. The bins that are left go on as items of the next level, on an eighth of the tasks, until one
task holds the rest; of those with more than an eighth of room the pieces go on one by one, as their bin may have
been the best only for want of others. A bin has at most ``capacity`` pieces and moves as one row.

A task passes on CARRY bins at most; if it has more underfull ones, as many of each fill as that allows, and holds the others back. So a task of
the tree holds a bounded number of bins at any size of input. What was held back is packed best-fit at the end, all of it together with what the
last task left: sizes are counted, the counts are packed (``fit_counts``), and each item finds its bin by its place among those of its size.
The number of sequences hangs on how pieces meet: tasks of TASK_PIECES
pieces leave about as many bins underfull as their mixes differ by chance, which is in proportion to the root of that number.

Null and empty texts have one piece that holds the end id only. Repeated rows are separate documents with the same
doc_id, rows without one are packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, text_batches, written

MEMBER = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
_BIN = "sequence_id long, size int, done boolean, held boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
#: So many tasks' bins meet in a task of the next level; pieces of a task of the first one; bins that a task passes on at most.
FAN_IN, TASK_PIECES, CARRY = 8, 1 << 16, 1 << 14


def cut_lengths(n: int, capacity: int) -> list[int]:
    """The lengths of a document's pieces: a shorter first one if need be, then full ones."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit, longest first: the bin of each item, and how full each bin is.

    Open bins are held by the room they have left; a bit set of the rooms in use gives the tightest fit at once.
    """
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, bin_of, full = 0, np.zeros(len(sizes), dtype=np.int64), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        above = in_use >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                in_use &= ~(1 << room)
        else:
            room, b = capacity, len(full)
            full.append(0)
        bin_of[i] = b
        full[b] += n
        if room > n:
            room_bins[room - n].append(b)
            in_use |= 1 << (room - n)
    return bin_of, np.array(full, dtype=np.int64)


def fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``best_fit`` of any number of items by the counts of their sizes: size, first and last place (exclusive) among those of the size, first bin,
    items in each bin, and where they start there. Bins of one room are taken by runs, so that the work hangs on the sizes and not on the items.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    in_use, bins, out = 0, 0, []

    def leave(room: int, first: int, k: int) -> None:
        nonlocal in_use
        if room and k:
            runs[room].append((first, k))
            in_use |= 1 << room

    for n in sorted(counts, reverse=True):
        at, c = 0, counts[n]
        while at < c:
            above = in_use >> n
            if above:
                room = n + (above & -above).bit_length() - 1
                first, k = runs[room].pop()
                if not runs[room]:
                    in_use &= ~(1 << room)
            else:
                room, first, k = capacity, bins, -(-(c - at) // (capacity // n))
                bins += k
            each = room // n
            whole = min(k, (c - at) // each)
            if whole:
                out.append((n, at, at + whole * each, first, each, capacity - room))
                leave(room - each * n, first, whole)
                at += whole * each
            rest = c - at if whole < k else 0
            if rest:
                out.append((n, at, c, first + whole, rest, capacity - room))
                leave(room - rest * n, first + whole, 1)
                at = c
            used = whole + (1 if rest else 0)
            leave(room, first + used, k - used)
    return out


def pieces_of(docs: DataFrame, encode: Callable[[list[bytes]], list[bytes]], end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every whole text with its end id; no shuffle."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema(MEMBER[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, batch.num_rows, 1_000):
                part, rows = batch.slice(step, 1_000), []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(text_batches(part))):
                    ids += end
                    at = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def of_use(full: np.ndarray, capacity: int, carry: int = CARRY) -> np.ndarray:
    """Which underfull bins go on: all if they are ``carry`` at most, else as many of each fill as that allows."""
    order = np.argsort(full, kind="stable")
    fills, starts = np.unique(full[order], return_index=True)
    each = len(full) if len(full) <= carry else max(1, carry // len(fills))
    useful = np.empty(len(full), dtype=bool)
    useful[order] = np.arange(len(full)) - starts[np.searchsorted(fills, full[order])] < each
    return useful


def _pack_level(bins: DataFrame, level: int, capacity: int, gap: int, carry: int) -> DataFrame:
    """Best-fit of each partition's bins; done marks those with at most ``gap`` tokens of room, held those that are too many to go on."""
    kind = pa.struct(MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        sizes = table.column("size").to_numpy().astype(np.int64)
        lists = table.column("members").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        fields = {n: flat.field(n).to_numpy(zero_copy_only=False) for n, _ in MEMBER[1:]}
        bin_of, full = best_fit(sizes, capacity)
        order = np.argsort(bin_of, kind="stable")
        # where each item starts in its bin
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(bin_of[order], np.arange(len(full)))
        shift = np.empty(len(sizes), dtype=np.int64)
        shift[order] = before - before[first][bin_of[order]]
        item = np.repeat(np.arange(len(sizes)), counts)
        rank = np.empty(len(sizes), dtype=np.int64)
        rank[order] = np.arange(len(sizes))
        move = np.argsort(rank[item], kind="stable")
        fields["offset"] = fields["offset"] + shift[item]
        members = pa.StructArray.from_arrays(
            [flat.field("doc_id").take(pa.array(move)), *(pa.array(fields[n][move], type=t) for n, t in MEMBER[1:])], fields=list(kind)
        )
        per_bin = np.bincount(bin_of[item], minlength=len(full))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_bin)]), type=pa.int32())
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        done = capacity - full <= gap
        held = np.zeros(len(full), dtype=bool)
        held[~done] = ~of_use(full[~done], capacity, carry)
        out = pa.RecordBatch.from_arrays(
            [pa.array(base + np.arange(len(full)), type=pa.int64()), pa.array(full, type=pa.int32()), pa.array(done), pa.array(held), pa.ListArray.from_arrays(offsets, members)],
            names=["sequence_id", "size", "done", "held", "members"],
        )
        for k in range(0, out.num_rows, 5_000):
            yield out.slice(k, 5_000)

    return bins.mapInArrow(run, _BIN)


def _items(bins: DataFrame, capacity: int) -> DataFrame:
    """Bins as items of the next level: whole, or, with more than an eighth of room, by piece."""
    alone = F.transform("members", lambda m: F.struct(m["length"].cast("int").alias("size"), F.array(m.withField("offset", F.lit(0).cast("long"))).alias("members")))
    whole = F.array(F.struct("size", "members"))
    some = bins.select(F.explode(F.when(capacity - F.col("size") > capacity // 8, alone).otherwise(whole)).alias("x"))
    return some.select(F.lit(0).cast("long").alias("sequence_id"), "x.size", F.lit(False).alias("done"), "x.members")


def _packed_by_counts(items: DataFrame, capacity: int, level: int = 63) -> DataFrame:
    """Best-fit of all items together. The driver sees a count for each size, of which there are ``capacity`` at most."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("id"), "size", "members"), "held-back")
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-numbered.count() // TASK_PIECES))))
    rows = numbered.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("size", "part").orderBy("id")) - 1)
    parts = numbered.groupBy("size", part.alias("part")).agg(F.count("*").alias("c"))
    before = parts.select("size", "part", (F.sum("c").over(Window.partitionBy("size").orderBy("part")) - F.col("c")).alias("before"))
    counts = {r["size"]: r["c"] for r in parts.groupBy("size").agg(F.sum("c").alias("c")).collect()}
    plan = items.sparkSession.createDataFrame(fit_counts(counts, capacity), "size int, first long, last long, bin long, each long, start long")
    placed = rows.join(before, ["size", "part"]).withColumn("place", F.col("before") + F.col("n")).drop("before", "n", "part")
    placed = placed.join(F.broadcast(plan), "size").where("place >= first AND place < last").withColumn("k", F.col("place") - F.col("first"))
    shift = F.col("start") + F.expr("k % each") * F.col("size")
    members = F.transform("members", lambda m: m.withField("offset", m["offset"] + shift))
    return placed.select((F.lit(level << 56) + F.col("bin") + F.expr("k div each")).alias("sequence_id"), "size", F.lit(True).alias("done"), F.lit(False).alias("held"), members.alias("members"))


def pack_pieces(pieces: DataFrame, capacity: int, fan_in: int = FAN_IN, task_pieces: int = TASK_PIECES, carry: int = CARRY) -> DataFrame:
    """sequence_id and offset for every piece."""
    member = F.struct(*(F.col(n) for n, _ in MEMBER[:5]), F.lit(0).cast("long").alias("offset"))
    bins = pieces.select(F.lit(0).cast("long").alias("sequence_id"), F.col("length").cast("int").alias("size"), F.lit(False).alias("done"), F.array(member).alias("members"))
    level, out, back, gap = 0, [], [], max(1, capacity // 128)
    tasks = max(1, -(-pieces.count() // task_pieces))
    while True:
        packed = written(_pack_level(bins.repartition(tasks), level, capacity, gap, carry), f"packed-{level}")
        left = packed.where("NOT done AND NOT held")
        if tasks <= 1 or not left.limit(1).count():
            break
        out.append(packed.where("done"))
        if packed.where("held").limit(1).count():
            back.append(packed.where("held"))
        tasks, level = -(-tasks // fan_in), level + 1
        bins = _items(left, capacity)
    # one task has packed all that is left, unless bins were held back
    if back:
        rest = packed.where("NOT done")
        for more in back:
            rest = rest.unionByName(more)
        out += [packed.where("done"), _packed_by_counts(_items(rest, capacity), capacity)]
    else:
        out.append(packed)
    bins = out[0]
    for more in out[1:]:
        bins = bins.unionByName(more)
    return bins.select("sequence_id", F.explode("members").alias("m")).select(*(F.col(f"m.{n}").alias(n) for n, _ in MEMBER[:5]), "sequence_id", F.col("m.offset").alias("offset"))


def pack_documents(docs: DataFrame, encode: Callable[[list[bytes]], list[bytes]], end_id: int, capacity: int) -> DataFrame:
    """Every piece with its sequence; texts are read once, and only lengths and checksums move."""
    return pack_pieces(written(pieces_of(docs, encode, end_id, capacity), "pieces"), capacity)
