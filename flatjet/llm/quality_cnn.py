"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textkit import slices, texts_of

CHUNK, STEP, WIDTH, STRIDE, FILTERS, HIDDEN = 256, 224, 12, 4, 32, 16
#: About how many labelled rows the network is fit on, chosen by hash of the text, and most bytes of their texts; both bound the driver's share.
FIT_ROWS, FIT_BYTES = 2500, 64 << 20
#: Chunks that pass through the filters at once.
BLOCK = 64


def _codes() -> np.ndarray:
    """Codes that bytes start from: their class and a few random signs; training moves them. The last row pads."""
    b = np.arange(256)
    text = np.isin(b, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", dtype=np.uint8))
    upper, digit, blank = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), np.isin(b, (32, 9, 10, 13))
    classes = [text, upper, digit, blank, b >= 128, ~(text | upper | digit | blank) & (b < 128)]
    signs = np.random.default_rng(3).choice([-0.5, 0.5], (256, 2))
    return np.vstack([np.column_stack([*classes, signs]), np.zeros(8)]).astype(np.float32)


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; one padded chunk for an empty text."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, 256, dtype=np.uint16)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _windows(part: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codes of each filter position: (chunks, positions, WIDTH * 8)."""
    coded = codes[part].reshape(len(part), -1)
    return np.lib.stride_tricks.sliding_window_view(coded, WIDTH * 8, axis=1)[:, :: STRIDE * 8]


def _features(texts: list[bytes], codes: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Largest activation of each filter in each chunk; then the mean and the largest over the chunks of each text.

    Chunks of all texts go through the filters in blocks; only the activations are kept.
    """
    size, top, wait = [], [], []

    def run() -> None:
        x = np.ascontiguousarray(_windows(np.concatenate(wait), codes))
        top.append(np.maximum((x.reshape(-1, WIDTH * 8) @ filters).reshape(x.shape[0], x.shape[1], -1).max(axis=1) + bias, 0))
        wait.clear()

    for text in texts:
        cut = chunks(text)
        size.append(len(cut))
        for lo in range(0, len(cut), BLOCK):
            wait.append(cut[lo : lo + BLOCK])
            if sum(map(len, wait)) >= BLOCK:
                run()
    if wait:
        run()
    pooled, first = np.concatenate(top), np.cumsum(size) - size
    return np.hstack([np.add.reduceat(pooled, first) / np.array(size)[:, None], np.maximum.reduceat(pooled, first)])


class Network:
    """Byte codes, filters, one hidden layer and a logistic output; all are learned."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.weights = [_codes(), draw(WIDTH * 8, FILTERS), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, 1), np.zeros(1, np.float32)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        codes, f, fb, w, wb, o, ob = self.weights
        hidden = np.maximum(_features(texts, codes, f, fb) @ w + wb, 0)
        return 1 / (1 + np.exp(-(hidden @ o + ob)[:, 0]))

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.004) -> None:
        """Adam on the log loss, in batches of 32 texts; rows are taken in a fixed order."""
        rng = np.random.default_rng(5)
        m, v, step = [np.zeros_like(x) for x in self.weights], [np.zeros_like(x) for x in self.weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), 32):
                step += 1
                for k, g in enumerate(self._gradient([texts[i] for i in order[lo : lo + 32]], labels[order[lo : lo + 32]])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)

    def _gradient(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        codes, f, fb, w, wb, o, ob = self.weights
        cut = [chunks(t) for t in texts]
        size = np.array([len(c) for c in cut])
        doc, first = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - size
        part = np.concatenate(cut)
        where, top, seen = [], [], []
        for lo in range(0, len(part), 256):
            x = np.ascontiguousarray(_windows(part[lo : lo + 256], codes))
            act = (x.reshape(-1, WIDTH * 8) @ f).reshape(x.shape[0], x.shape[1], -1)
            at = act.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0] + fb)
            seen.append(x[np.arange(len(x))[:, None], at])
        raw, inputs = np.concatenate(top), np.concatenate(seen)
        pooled = np.maximum(raw, 0)
        mean, high = np.add.reduceat(pooled, first) / size[:, None], np.maximum.reduceat(pooled, first)
        both = np.hstack([mean, high])
        pre = both @ w + wb
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(hidden @ o + ob)))
        d = ((p[:, 0] - labels) / len(labels))[:, None].astype(np.float32)
        d_hidden = (d @ o.T) * (pre > 0)
        d_both = d_hidden @ w.T
        top_one = (pooled == high[doc]).astype(np.float32)  # chunks that tie share the gradient
        d_pool = (d_both[:, :FILTERS] / size[:, None])[doc] + d_both[doc, FILTERS:] * (top_one / np.add.reduceat(top_one, first)[doc])
        d_pool *= raw > 0
        # The bytes that each filter's largest activation saw get its share.
        spots = (np.concatenate(where) * STRIDE)[:, :, None] + np.arange(WIDTH)
        seen_bytes = part[np.arange(len(part))[:, None, None], spots].reshape(-1)
        shares = (d_pool[:, :, None] * f.T[None]).reshape(-1, 8)
        d_codes = np.column_stack([np.bincount(seen_bytes, weights=shares[:, k], minlength=257) for k in range(8)]).astype(codes.dtype)
        d_codes[256] = 0
        return [d_codes, np.einsum("cf,cfx->xf", d_pool, inputs), d_pool.sum(axis=0), both.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null counts as empty."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Network:
    """Fit on about ``rows`` labelled rows, with the rarer label drawn at up to twice its share; without labels the network stays as drawn.

    Rows are taken whole, in order of the hash of their text, as far as
    ``most_bytes`` go and twice ``rows`` at most (ids may repeat), so what the
    driver holds is bounded.
    """
    small_batches(documents.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Network()
    share = F.lit(0.0)
    for y, n in sizes.items():
        want = rows * (min(0.3, 2 * n / total) if n == min(sizes.values()) else 1.0)
        share = F.when(F.col("y") == y, min(1.0, want / n)).otherwise(share)
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    text = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    # About `rows` ids, whatever the tables hold: small enough to broadcast.
    data = text.join(F.broadcast(chosen), "id").select("t", "y", F.xxhash64("t").alias("h"))
    last, held = None, 0
    for r in data.select("h", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")).orderBy("h").limit(2 * rows).collect():
        held += r["size"]
        if held > most_bytes:
            break
        last = r["h"]
    net = Network()
    if last is None:
        return net
    table = data.where(F.col("h") <= last).orderBy("h", "y").limit(2 * rows).toArrow()
    net.fit(list(texts_of(table["t"])), table["y"].to_numpy().astype(np.float32))
    return net


def score(documents: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The columns of ``documents`` plus score, the probability of label 1 to six digits; it replaces a column of that name.

    Every byte of a text lies in a chunk; null counts as empty, and an empty text
    has the score of a padded chunk. Rows are never dropped; an empty table gives
    no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        parts = [held.value.scores(texts[lo:hi]) for lo, hi in slices(texts)]
        # Six digits: sums of floats depend on how many rows are handled at once.
        return pa.array(np.round(np.concatenate(parts), 6) if parts else [], pa.float64())

    return documents.withColumn("score", scored(F.col(f"`{text_col}`").cast("string")))


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
