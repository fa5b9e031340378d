"""Embedding whitening by a bit-sliced scatter matrix.

Entries become whole numbers, x = floor(64 * c) + 1000000. The fit list is each distinct x vector once. Each dimension is shifted
by its least value; each of the bits that its range needs is a plane, packed across rows into 64-bit words. The AND of two planes and a
count of its bits, weighted by the two powers of two, sums up to the exact cross-products. They are centred as integers,
n * sum(x_i x_j) - S_i S_j, divided once, and given to eigh.

What goes through the driver grows with the square of the dimensions, not with the rows: sums and cross-products of each task are
combined in Spark, as two 32-bit halves for each power of 2**32, so that no sum overflows.

* A row whose vector is null, empty, or holds null, NaN or infinite entries is dropped. The dimension is that of most of the rows (the
  larger one if two are as frequent); rows of another length are dropped too. The other columns do not matter.
* Rows that repeat, and rows without a vec_id, each get their result rows; a repeated vector counts once in the fit.
* x saturates at +-2**62. ``deviation`` is null where the exact sum has no room in a long.
* Components without variance (an eigenvalue within rounding of 0, so with one distinct vector all of them) have whitened null and explained 0, or
  null if there is no variance at all; identity_error is that of the others, null if there are none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, FARTHEST = 64.0, 1_000_000, 2**62
COMPONENTS = 16
#: Rows whose planes are held at once; 256 words a plane stay in a core's cache.
BLOCK_ROWS = 1 << 14
#: Bytes of ANDed planes at once.
PLANE_BYTES = 4 << 20


def sound(vector: str) -> F.Column:
    """Whether a vector has entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def dimension_of(rows: DataFrame, vector: str) -> int:
    """The most frequent length among sound vectors; 0 if there are none."""
    top = rows.where(sound(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def whole(entries: np.ndarray) -> np.ndarray:
    """x of each entry, as long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(entries.astype(np.float64) * SCALE)
    return np.clip(scaled, -float(FARTHEST), float(FARTHEST)).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _entries(rows: DataFrame, vector: str, d: int, *others: str) -> DataFrame:
    return rows.where(sound(vector) & (F.size(vector) == d)).select(*others, F.col(vector).cast("array<double>").alias("vector"))


def fit_list(rows: DataFrame, vector: str, d: int) -> DataFrame:
    """Each distinct x vector once: (x binary, narrow boolean), 32 bits an entry where all entries have room in that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(_matrix(batch.column("vector"), d))
            narrow = (np.abs(x) < 2**31).all(1)
            wide = [r.tobytes() for r in x[~narrow]]
            out = np.empty(len(x), dtype=object)
            out[narrow] = [r.tobytes() for r in x[narrow].astype("<i4")]
            out[~narrow] = wide
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary()), pa.array(narrow)], names=["x", "narrow"])

    return _entries(rows, vector, d).mapInArrow(run, "x binary, narrow boolean").distinct()


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    narrow = batch.column("narrow").to_numpy(zero_copy_only=False)
    out = np.empty((batch.num_rows, d), dtype=np.int64)
    for flag, kind in ((True, "<i4"), (False, "<i8")):
        at = np.flatnonzero(narrow == flag)
        if len(at):
            out[at] = np.frombuffer(b"".join(batch.column("x").take(pa.array(at)).to_pylist()), dtype=kind).reshape(-1, d)
    return out


def bit_planes(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """The planes of each dimension's bits, lowest first, packed across rows into words: (planes, words)."""
    words = -(-len(u) // 64)
    planes = np.zeros((sum(bits), words * 8), dtype=np.uint8)
    k = 0
    for j, b in enumerate(bits):
        for bit in range(b):
            packed = np.packbits(((u[:, j] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            planes[k, : len(packed)] = packed
            k += 1
    return planes.view(np.uint64)


def scatter(planes: np.ndarray, bits: list[int]) -> list[list[int]]:
    """The exact sums of u_i * u_j: AND of planes, bits counted, weighted by their powers of two. Upper triangle."""
    total, d = len(planes), len(bits)
    begins = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
    small = 2 * max(bits, default=0) + (64 * planes.shape[1]).bit_length() <= 62
    kind = np.int64 if small else object
    weight = np.array([1 << b for n in bits for b in range(n)], dtype=kind)
    out = [[0] * d for _ in range(d)]
    step = max(1, PLANE_BYTES // max(1, planes.shape[1] * 8))
    has = np.flatnonzero(np.diff(begins))
    for i in range(d):
        row = np.zeros(total, dtype=kind)
        for p in range(begins[i], begins[i + 1]):
            for at in range(begins[i], total, step):
                counts = np.bitwise_count(planes[p] & planes[at : at + step]).sum(axis=1, dtype=np.int64)
                row[at : at + step] += counts.astype(kind) * (1 << int(p - begins[i]))
        if begins[i] == begins[i + 1]:
            continue
        row *= weight
        later = has[has >= i]
        for j, v in zip(later.tolist(), np.add.reduceat(row[begins[i] :], begins[later] - begins[i])):
            out[i][j] = int(v)
    return out


def _halves(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, value) with value >= 0 as (i, j, power of 2**32, 32 bits of it)."""
    for i, j, v in rows:
        k = 0
        while v:
            yield i, j, k, v & 0xFFFFFFFF
            v, k = v >> 32, k + 1


@dataclass(frozen=True)
class Whitener:
    n: int
    least: list[int]  # of each dimension
    sums: list[int]  # S
    ranges: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # unit eigenvectors, one a column
    covariance: np.ndarray
    error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """The components with variance."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.sums) * np.finfo(float).eps

    def _fits(self) -> bool:
        """Whether n * x and its difference from S have room in a long."""
        return 2 * self.n * max(max(abs(m), abs(m + r)) for m, r in zip(self.least, self.ranges)) < 2**63

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding at the division where n * x has room in a long."""
        if self._fits():
            return (x * self.n - np.array(self.sums)) / self.n
        exact = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return np.array([[v / self.n for v in row] for row in exact.tolist()]).reshape(x.shape)

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """The whitened values; NaN for components without variance."""
        k = min(components, len(self.values))
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (self.centred(x) @ self.axes[:, :k]) / np.sqrt(np.maximum(self.values[:k], 0))
        w[:, ~self.live[:k]] = np.nan
        return w

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sum over dimensions of (n * x - S)**2; null where a long has no room for it."""
        ends = [(self.n * m - s, self.n * (m + r) - s) for m, r, s in zip(self.least, self.ranges, self.sums)]
        if sum(max(map(abs, e)) ** 2 for e in ends) < 2**63 and self._fits():
            return pa.array(((x * self.n - np.array(self.sums)) ** 2).sum(1))
        exact = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(1)
        return pa.array([v if v < 2**63 else None for v in exact.tolist()], type=pa.int64())


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitener | None:
    """Covariance, eigenvectors and the measured error over the fit list; None if it is empty."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, sums = 0, None, None, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, d)
                n += len(x)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(low), pa.array(high), pa.array(np.full(d, n))], names=["i", "low", "high", "n"])

    found = vectors.mapInArrow(edges, "i long, low long, high long, n long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("i").collect()
    if not found:
        return None
    n, least, ranges = found[0].n, [r.low for r in found], [r.high - r.low for r in found]
    bits = [r.bit_length() for r in ranges]

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, single = [[0] * d for _ in range(d)], [0] * d
        floor = np.array(least, dtype=np.int64)

        def add(x: np.ndarray) -> None:
            planes = bit_planes(x.view(np.uint64) - floor.view(np.uint64), bits)
            k = 0
            for j, b in enumerate(bits):
                for bit in range(b):
                    single[j] += int(np.bitwise_count(planes[k]).sum(dtype=np.int64)) << bit
                    k += 1
            for i, row in enumerate(scatter(planes, bits)):
                for j in range(i, d):
                    cross[i][j] += row[j]

        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(_vectors(batch, d))
            if sum(map(len, held)) >= BLOCK_ROWS:
                x = np.concatenate(held)
                whole_blocks = len(x) - len(x) % BLOCK_ROWS
                for at in range(0, whole_blocks, BLOCK_ROWS):
                    add(np.ascontiguousarray(x[at : at + BLOCK_ROWS]))
                held = [x[whole_blocks:]]
        if sum(map(len, held)):
            add(np.ascontiguousarray(np.concatenate(held)))
        rows = [(i, j, cross[i][j]) for i in range(d) for j in range(i, d)] + [(-1, j, single[j]) for j in range(d)]
        parts = list(_halves(rows))
        for at in range(0, len(parts), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*parts[at : at + 50_000])], names=["i", "j", "power", "part"])

    summed = vectors.mapInArrow(sliced, "i long, j long, power long, part long").groupBy("i", "j", "power").agg(F.sum("part").alias("part"))
    cross, single = [[0] * d for _ in range(d)], [0] * d
    for r in summed.toLocalIterator():
        if r.i < 0:
            single[r.j] += r.part << (32 * r.power)
        else:
            cross[r.i][r.j] += r.part << (32 * r.power)
    covariance = np.array([[(n * cross[min(i, j)][max(i, j)] - single[i] * single[j]) / (n * n) for j in range(d)] for i in range(d)], dtype=np.float64)
    values, axes = np.linalg.eigh(covariance)
    made = Whitener(n, least, [s + n * m for s, m in zip(single, least)], ranges, values[::-1].copy(), axes[:, ::-1].copy(), covariance)
    return Whitener(**{**made.__dict__, "error": identity_error(vectors, made, components)})


def identity_error(vectors: DataFrame, w: Whitener, components: int) -> float | None:
    """The largest entry of the covariance of the whitened fit list minus the identity, over the components with variance."""
    d = len(w.sums)
    k = min(components, d)
    if not w.live[:k].any():
        return None
    bound = vectors.sparkSession.sparkContext.broadcast(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                p = bound.value.project(_vectors(batch, d), k)
                total += p.sum(0)
                products += p.T @ p
        i, j = np.meshgrid(np.arange(-1, k), np.arange(k), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(np.vstack([total, products]).ravel())], names=["i", "j", "v"])

    table = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        table[r.i + 1, r.j] = r.v
    mean = table[0] / w.n  # 0 but for rounding, as the projected rows are centred
    off = np.abs(table[1:] / w.n - np.outer(mean, mean) - np.eye(k))
    return float(off[np.ix_(w.live[:k], w.live[:k])].max())


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each sound row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    d = dimension_of(rows, vector)
    vectors = written(fit_list(rows, vector, d), "fit-list") if d else None
    w = fit(vectors, d, components) if vectors is not None else None
    if w is None:
        return spark.createDataFrame([], schema)
    bound, k = spark.sparkContext.broadcast(w), min(components, d)
    trace = float(np.trace(w.covariance))
    explained = [None if trace <= 0 else (float(v) / trace if ok else 0.0) for v, ok in zip(w.values[:k], w.live[:k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            x = whole(_matrix(batch.column("vector"), d))
            p = bound.value.project(x, k)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w_n), type=pa.int64()), bound.value.deviations(x).take(each),
                pa.array(p.ravel(), from_pandas=True), pa.array(explained * m, type=pa.float64()), pa.array([bound.value.error] * (m * k), type=pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    w_n = w.n
    return _entries(rows, vector, d, F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(run, schema)
