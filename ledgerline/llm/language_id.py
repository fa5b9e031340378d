"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's largest answer in the
window goes through a softmax layer. A text is cut into all its windows, and its language is the one with
the largest mean probability, weighted by the bytes of each window.

Training takes a bounded sample of labelled rows, which the parameters of ``fit`` state: ``sample`` rows at most for each
language, by a hash of id and text, ``per_row`` windows of each, spread over its whole text, and the ``languages`` most
frequent languages. The windows are cut on the executors; the driver gets nothing else. Prediction covers whole texts and looks at
nothing but the text.

A null text, or one without letters, is ``und`` with score 0. Rows that repeat are predicted alike. With no
labelled rows every text is ``und``. A row without a doc_id is never held out (``held_out`` is false), and may be learned from. Texts are
laid out as windows in groups of about ``GROUP_BYTES``, whatever their number and length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, text_batches

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 12, 8
SAMPLE, PER_ROW, LANGUAGES = 250, 6, 1_000
GROUP_BYTES = 1 << 20
WIDEST = max(WIDTHS)
UNKNOWN = "und"


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 257 x EMBED; row 256 is padding
    filters: np.ndarray  # WIDEST * EMBED x filters; narrow ones are padded with zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each place of each window the embedded bytes under the widest filter, side by side."""
        n, length = windows.shape
        e = self.embed[windows]
        places = length - WIDEST + 1
        return np.concatenate([e[:, k : k + places] for k in range(WIDEST)], axis=2).reshape(n * places, WIDEST * EMBED)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        places = windows.shape[1] - WIDEST + 1
        made = self.columns(windows) @ self.filters
        top = np.maximum(made.reshape(len(windows), places, -1).max(1) + self.bias, 0)
        z = top @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text that each belongs to, and how many bytes of it each holds.

    Windows follow each other without a gap; the last one of a text is padded.
    """
    n = np.array([len(t) for t in texts], dtype=np.int64)
    per = -(-n // WINDOW)
    flat = np.full(int(per.sum()) * WINDOW, 256, dtype=np.int16)
    start = (np.cumsum(per) - per) * WINDOW
    for s, t in zip(start, texts):
        flat[s : s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return flat.reshape(-1, WINDOW), owner, np.minimum(WINDOW, n[owner] - number * WINDOW)


def spread_windows(text: bytes, n: int) -> list[bytes]:
    """At most ``n`` of the windows of a text, spread evenly over it."""
    total = -(-len(text) // WINDOW)
    return [text[WINDOW * k : WINDOW * (k + 1)] for k in sorted({i * total // n for i in range(n)} if total > n else range(total))]


def train(rows: list[tuple[bytes, str]], epochs: int = 6, seed: int = 7) -> ByteNet | None:
    """Fit on (window, language). Null where there is no language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    f, c = FILTERS * len(WIDTHS), len(languages)
    mask = np.concatenate([np.repeat(np.arange(WIDEST) < w, EMBED).astype(np.float32)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = ByteNet(
        languages,
        rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (WIDEST * EMBED, f)) * mask).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, c)).astype(np.float32),
        np.zeros(c, np.float32),
    )
    net.embed[256] = 0
    number = {lang: k for k, lang in enumerate(languages)}
    rows = [(t, lang) for t, lang in rows if t]
    x, y = cut_windows([t for t, _ in rows])[0], np.array([number[lang] for _, lang in rows], dtype=np.int64)
    # short windows too, so that short texts are known
    cutoff = rng.integers(6, 2 * WINDOW, len(x))
    x = np.where(np.arange(WINDOW)[None] < cutoff[:, None], x, 256)
    names = ["embed", "filters", "bias", "out", "out_bias"]
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step, places = 0, WINDOW - WIDEST + 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            w, t, n = x[some], y[some], len(some)
            col = net.columns(w)
            made = (col @ net.filters).reshape(n, places, f)
            at = made.argmax(1)
            pre = np.take_along_axis(made, at[:, None], 1)[:, 0] + net.bias
            top = np.maximum(pre, 0)
            z = top @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), t] -= 1
            p /= n
            d_top = (p @ net.out.T) * (pre > 0)
            rows_at = (np.arange(n)[:, None] * places + at).ravel()
            used = col[rows_at].reshape(n, f, -1)
            d_filters = np.einsum("nfd,nf->df", used, d_top) * mask
            d_used = (d_top[:, :, None] * net.filters.T[None]).reshape(n * f, WIDEST, EMBED)
            bytes_at = np.stack([w[np.repeat(np.arange(n), f), at.ravel() + j] for j in range(WIDEST)], 1)
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, bytes_at.ravel(), d_used.reshape(-1, EMBED))
            d_embed[256] = 0
            step += 1
            for name, g in zip(names, (d_embed, d_filters, d_top.sum(0), top.T @ p, p.sum(0))):
                m, v = state[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                getattr(net, name)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: ByteNet, texts: list[bytes], group: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The number of the likeliest language and its mean probability, by text."""
    x, owner, sizes = cut_windows(texts)
    sums = np.zeros((len(texts), len(net.languages)))
    for k in range(0, len(x), group):
        p = net.probabilities(x[k : k + group]) * sizes[k : k + group, None]
        np.add.at(sums, owner[k : k + group], p)
    sums /= np.maximum(sums.sum(1, keepdims=True), 1e-9)
    return sums.argmax(1), sums.max(1)


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 2 over 4; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, per_row: int = PER_ROW, languages: int = LANGUAGES) -> ByteNet | None:
    """Train on at most ``sample`` rows of each of the ``languages`` most frequent languages, none of them held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = labelled.select(F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    sizes = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()
    if not sizes:
        return None
    # four times the sample by the hash alone, of which the least hashes are taken: few rows are sorted, and the bound is sure
    chance = F.create_map(*(x for r in sizes for x in (F.lit(r["_lang"]), F.lit(min(1.0, 4 * sample / r["count"])))))[F.col("_lang")]
    some = rows.where(F.pmod(F.col("_h"), F.lit(1_000_003)) < chance * 1_000_003)
    least = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_rank") <= sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(w, lang) for t, lang in zip(text_batches(batch), batch.column("_lang").to_pylist()) for w in spread_windows(t, per_row)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in made], pa.binary()), pa.array([x for _, x in made], pa.string())], names=["window", "lang"])

    table = least.select("text", "_lang").mapInArrow(cut, "window binary, lang string").toArrow()
    return train(sorted(zip(table.column("window").to_pylist(), table.column("lang").to_pylist())))


def in_groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[slice]:
    """Slices of a list of texts of about ``most`` bytes each; a longer text is one by itself."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def label_texts(net: ByteNet | None, texts: list[bytes], letters: list[bool]) -> tuple[list[str], list[float]]:
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    best, score = predict(net, [t if ok else b"" for t, ok in zip(texts, letters)])
    return [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], [round(float(s), 6) if ok else 0.0 for s, ok in zip(score, letters)]


def has_letters(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    bound = docs.sparkSession.sparkContext.broadcast(net)

    def work(texts: list[bytes]) -> dict:
        out: dict = {"lang_pred": [], "score": []}
        for some in map(texts.__getitem__, in_groups(texts)):
            langs, scores = label_texts(bound.value, some, [has_letters(t) for t in some])
            out["lang_pred"] += langs
            out["score"] += scores
        return out

    return map_texts(docs, "lang_pred string, score double", work).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
