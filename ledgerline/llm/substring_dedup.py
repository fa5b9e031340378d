"""Substring dedup by level-wise doubling.

A window of words can only repeat where each shorter window inside it repeats. So the search starts at
about half the length, and windows repeated at one length alone are extended to at most twice that
length, until the wanted length is reached or no candidate is left; then the search stops. At the first length only one window in
several is looked at: of the short windows inside each wanted window the one with the least hash, which
is the same one wherever the wanted window stands.

* Texts are dealt by doc_id once; every level and the cut read that same exchange. Rows without a doc_id are spread
  by their text.
* Short windows that hold more than 1 / HOT_SHARE of a sample's rows count as repeated without being counted, so
  that no key of the first level is hot; there are fewer than HOT_SHARE of them at any size. That only adds candidates: the
  wanted windows themselves are always compared, with map-side combination, and their join can be split where it is skewed.
* The windows of a level are written once and read for the count and for the way back.
* Of texts equal to the byte, only the one with the smallest doc_id is searched; the others are its repeats.
* Wanted windows are compared by 96 bits of hash.

Null, empty and short texts (fewer words than the window) lose nothing; kept_sha256 is that of their
words. Rows with the same doc_id are not smaller than each other and stay both. Rows with a null
doc_id come after all others. An empty table gives no rows. All columns of the input stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import released, stored, text_batches
from .hashing import grams, hash_words, mix

WINDOW, START = 13, 7
#: Rows without a doc_id are spread, by their text, over the numbers from here on, which count as one and the same place after
#: every doc_id.
_NULLS, _SPREAD = (1 << 63) - (1 << 20), (1 << 20) - 1
_LOW48 = np.uint64((1 << 48) - 1)
#: One document in so many is in the sample for hot short windows; a hot one has more than 1 / HOT_SHARE of its rows, and OFTEN of them.
SAMPLE, HOT_SHARE, OFTEN = 32, 16_384, 16


def levels(window: int, start: int = START) -> list[int]:
    """Lengths from ``start`` on, each at most double the one before, up to the window."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def least_of_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the least of them."""
    out, done = hashes, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(hashed: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each wanted window the short window that stands for it, as 48 bits."""
    return (least_of_runs(grams(hashed, length), window - length + 1) & _LOW48).view(np.int64)


def candidates(hashed: np.ndarray, window: int, before: int, length: int, first: bool, hits: np.ndarray) -> np.ndarray:
    """Where windows of ``length`` words start all of whose parts repeated at the level before."""
    n = len(hashed) - length + 1
    if before == length:
        return np.arange(n)
    if first:
        ok = np.zeros(n, dtype=bool)
        at = np.flatnonzero(np.isin(anchors(hashed, window, before), hits))
        for k in range(window - length + 1):
            ok[at + k] = True
    else:
        there = np.isin(grams(hashed, before).view(np.int64), hits)
        ok = there[:n] & there[length - before :]
    return np.flatnonzero(ok)


def _map(df: DataFrame, schema: str, work: Callable[[int, list[bytes], list | None], tuple | None]) -> DataFrame:
    """Rows of numbers made from (_ord, words, _hits) of each document."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                hits = part.column("_hits").to_pylist() if "_hits" in part.schema.names else [None] * part.num_rows
                made = [m for o, t, h in zip(part.column("_ord").to_pylist(), text_batches(part, "_text"), hits) if (m := work(o, t.split(), h)) is not None]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)

    return df.mapInArrow(run, schema)


def _first_rows(df: DataFrame, window: int, length: int, skip: np.ndarray) -> DataFrame:
    """(h, ord) of the distinct anchors of each document, without those in ``skip``."""

    def work(o, words, _):
        if len(words) < window:
            return None
        h = np.setdiff1d(anchors(hash_words(words), window, length), skip)
        return h, np.full(len(h), o)

    return _map(df, "h long, ord long", work)


def _level_rows(df: DataFrame, window: int, before: int, length: int, first: bool, always: np.ndarray) -> DataFrame:
    """(h, g, ord) of the distinct candidate windows of each document."""

    def work(o, words, hits):
        if len(words) < window:
            return None
        known = np.array(hits or [], dtype=np.int64)
        hashed = hash_words(words)
        at = candidates(hashed, window, before, length, first, np.concatenate([known, always]) if first else known)
        if not len(at):
            return None
        h, once = np.unique(grams(hashed, length)[at].view(np.int64), return_index=True)
        g = mix(grams(hashed ^ np.uint64(0x5851F42D4C957F2D), length)[at[once]]) >> np.uint64(33)
        return h, g.astype(np.int32), np.full(len(h), o)

    return _map(df, "h long, g int, ord long", work)


def _ord() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULLS) + F.pmod(F.xxhash64("text"), F.lit(_SPREAD)))


def _place(ord_: str) -> Column:
    """What is compared: equal for all rows without a doc_id."""
    return F.least(F.col(ord_), F.lit(_NULLS))


def _dealt(docs: DataFrame) -> DataFrame:
    """_ord, _text and the whole row as _row, dealt by _ord."""
    return docs.select(_ord().alias("_ord"), F.col("text").cast("string").alias("_text"), F.struct("*").alias("_row")).repartition("_ord")


def _often(docs: DataFrame, window: int, length: int) -> np.ndarray:
    """The hot short windows of the sample; fewer than HOT_SHARE."""
    some = docs.select(_ord().alias("_ord"), F.col("text").cast("string").alias("_text"))
    some = some.where(F.pmod(F.xxhash64("_ord", F.length("_text")), F.lit(SAMPLE)) == 0)
    at = stored(_first_rows(some, window, length, np.zeros(0, dtype=np.int64)), "sampled-windows")
    rows = docs.sparkSession.read.schema("h long, ord long").parquet(at)
    least = max(OFTEN, rows.count() / HOT_SHARE)
    hot = np.sort(np.array([r["h"] for r in rows.groupBy("h").count().where(F.col("count") > least).collect()], dtype=np.int64))
    released(docs.sparkSession, at)
    return hot


def _by_ord(df: DataFrame, hits: DataFrame | None) -> DataFrame:
    """``df`` with _hits of its _ord."""
    return df if hits is None else df.join(hits.select(F.col("ord").alias("_ord"), F.col("hits").alias("_hits")), "_ord", "left")


def _search(docs: DataFrame, base: DataFrame, window: int, start: int) -> tuple[DataFrame, DataFrame]:
    """By ord: the hashes of wanted windows that start in a smaller document; the digests of texts that a smaller document has too."""
    spark = docs.sparkSession
    key = lambda text: F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    # a text shorter than so many characters has fewer words than the window
    keyed = docs.where(F.length("text") >= 2 * window - 1).select(_ord().alias("ord"), key(F.col("text")).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min(_place("ord")).alias("first"), F.max(_place("ord")).alias("last")).where("first < last").drop("last")
    copies = keyed.join(firsts, "key").where(F.col("first") < _place("ord")).groupBy("ord").agg(F.collect_set("key").alias("copy_keys"))
    copies = copies.select(F.col("ord").alias("_ord"), F.col("copy_keys").alias("_copies"))

    steps = levels(window, start)
    searched = base.select("_ord", "_text").join(copies, "_ord", "left").where(F.col("_copies").isNull() | ~F.array_contains("_copies", key(F.col("_text")))).drop("_copies")
    always, found = np.zeros(0, dtype=np.int64), None
    if len(steps) > 1:
        always = _often(docs, window, steps[0])
        rows = _first_rows(searched, window, steps[0], always)
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
        found = rows.groupBy("ord").agg(F.collect_list("h").alias("hits"))
    hits_schema = "ord long, hits array<long>"
    for before, length in zip(steps, steps[1:] or steps):
        first = before == steps[0]
        at = stored(_level_rows(_by_ord(searched, found), window, before, length, first, always), f"windows-{length}")
        rows = spark.read.schema("h long, g int, ord long").parquet(at)
        ends = rows.groupBy("h", "g").agg(F.min(_place("ord")).alias("first"), F.max(_place("ord")).alias("last")).where("first < last").drop("last")
        rows = rows.join(ends, ["h", "g"])
        if length == window:
            rows = rows.where(F.col("first") < _place("ord"))
        found = spark.read.schema(hits_schema).parquet(stored(rows.groupBy("ord").agg(F.collect_list("h").alias("hits")), f"hits-{length}"))
        released(spark, at)
        if not found.limit(1).count():
            break
    return found, copies


def cut_words(words: list[bytes], window: int, hits: np.ndarray) -> list[bytes]:
    """The words that no window with a hash in ``hits`` covers."""
    if not len(hits) or len(words) < window:
        return words
    at = np.flatnonzero(np.isin(grams(hash_words(words), window).view(np.int64), hits))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]


def _with_hits(docs: DataFrame, window: int, start: int) -> DataFrame:
    base = _dealt(docs)
    hits, copies = _search(docs, base, window, start)
    return _by_ord(base, hits).join(copies, "_ord", "left")


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    for t, hits, copies in zip(text_batches(batch, "_text"), batch.column("_hits").to_pylist(), batch.column("_copies").to_pylist()):
        words = t.split()
        if copies and len(words) >= window and hashlib.md5(t).digest() in copies:
            yield words, []
        else:
            yield words, cut_words(words, window, np.array(hits or [], dtype=np.int64))


def removals(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word goes if a window of ``window`` words covers it whose words also stand in a document with a smaller doc_id.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for w, k in _kept(batch, window)]
            columns = [[r[i] for r in rows] for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, start).select("_text", "_hits", "_copies", F.col("_row.doc_id").alias("_id")).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """The documents, all columns, with the repeated words cut from text (the rest joined by blanks).

    A text that loses no word stays as it is; a document that loses every word goes.
    """
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            texts, keep = row.field("text").to_pylist(), []
            for i, (w, k) in enumerate(_kept(batch, window)):
                keep.append(bool(k) or not w)
                if len(k) < len(w):
                    texts[i] = b" ".join(k).decode("utf-8", "replace")
            columns = [pa.array(texts, type=f.type) if f.name == "text" else row.field(i) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(keep, pa.bool_()))

    return _with_hits(docs, window, start).mapInArrow(run, docs.schema)
