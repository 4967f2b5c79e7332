"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes slide over the whole text. The text is cut into chunks of CHUNK window starts;
neighbouring chunks share the WIDTH - 1 bytes that windows at the seam need, so every byte is read. Each chunk is
max-pooled per filter (rectified), the document takes the mean, the largest and the smallest of its chunks'
values, and one logistic unit combines them into a probability.

Scoring looks two bytes up at a time in tables of byte pairs (WIDTH / 2 tables of 65,536 rows), so a window
costs WIDTH / 2 lookups. Training is Adam on the logistic loss, with gradients to the windows that won the
pooling; it sees a bounded sample of labelled rows (SAMPLE), and of each row the whole text, SLAB chunks at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, ids_and_text, ship, utf8

FILTERS, WIDTH, CHUNK = 24, 6, 256
THRESHOLD = 0.3
#: Labelled rows used for training at most (the first by hash of the id).
SAMPLE, EPOCHS, BATCH = 3000, 8, 16
#: Window starts scored at a time, and chunks trained on at a time.
STEP, SLAB = 1 << 16, 64


class Network:
    """tables: WIDTH x 256 x FILTERS weights; bias of the filters; combine: 3 x FILTERS weights of mean, max, min; shift."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.tables[:, 0] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.combine = rng.normal(0, 0.1, (3, FILTERS)).astype(np.float32)
        self.shift = np.float32(0)
        self.pairs: list[np.ndarray] | None = None

    def params(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.combine, np.atleast_1d(self.shift)]

    def windows(self, data: np.ndarray, starts: int) -> np.ndarray:
        """Filter values of the first `starts` windows of data, which is WIDTH - 1 bytes longer at least."""
        if self.pairs is None:
            self.pairs = [np.ascontiguousarray((self.tables[k + 1][:, None, :] + self.tables[k][None, :, :]).reshape(65536, FILTERS)) for k in range(0, WIDTH, 2)]
        pair = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
        out = self.pairs[0][pair[:starts]]
        for k in range(1, WIDTH // 2):
            out += self.pairs[k][pair[2 * k : 2 * k + starts]]
        return out

    def pooled(self, text: bytes) -> np.ndarray:
        """Chunks x FILTERS: largest value of each filter in each chunk, zero at least."""
        n = max(1, -(-len(text) // CHUNK))
        data = np.zeros(n * CHUNK + WIDTH, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        parts = []
        for at in range(0, n * CHUNK, STEP):
            starts = min(STEP, n * CHUNK - at)
            parts.append(self.windows(data[at : at + starts + WIDTH], starts).reshape(-1, CHUNK, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def combined(self, pooled: np.ndarray) -> float:
        return float((self.combine[0] * pooled.mean(axis=0)).sum() + (self.combine[1] * pooled.max(axis=0)).sum() + (self.combine[2] * pooled.min(axis=0)).sum() + self.shift)

    def score(self, text: bytes) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.combined(self.pooled(text)), -40, 40))))


def chunks_of(text: bytes) -> np.ndarray:
    """All chunks of a text, each CHUNK + WIDTH bytes with the seam: a view."""
    n = max(1, -(-len(text) // CHUNK))
    data = np.zeros(n * CHUNK + WIDTH, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK + WIDTH)[::CHUNK]


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 9) -> Network:
    """Trains on (chunks, label) rows."""
    net = Network(seed)
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    net.shift = np.float32(np.log((sum(y for _, y in rows) + 1) / (sum(1 - y for _, y in rows) + 1)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for at in range(0, len(rows), BATCH):
            if at == 0:
                order = rng.permutation(len(rows))
            grads = [np.zeros_like(p) for p in net.params()]
            net.pairs = None
            for i in order[at : at + BATCH]:
                chunks, y = rows[i]
                _backward(net, chunks, y, grads)
            step += 1
            for p, g, (m, v) in zip((net.tables, net.bias, net.combine), grads, moments, strict=False):
                _adam(p, g / BATCH, m, v, rate, step)
            shift = np.atleast_1d(net.shift).copy()
            _adam(shift, grads[3] / BATCH, *moments[3], rate, step)
            net.shift = np.float32(shift[0])
            net.tables[:, 0] = 0
    net.pairs = None
    return net


def _backward(net: Network, chunks: np.ndarray, y: int, grads: list[np.ndarray]) -> None:
    starts, tops, bests = np.arange(CHUNK), [], []
    for at in range(0, len(chunks), SLAB):  # only the winners of a slab are kept
        slab = chunks[at : at + SLAB]
        z = net.tables[0][slab[:, starts]]
        for k in range(1, WIDTH):
            z += net.tables[k][slab[:, starts + k]]
        bests.append(z.argmax(axis=1))
        tops.append(np.take_along_axis(z, bests[-1][:, None, :], axis=1)[:, 0])
    best, top = np.concatenate(bests), np.concatenate(tops) + net.bias
    pooled = np.maximum(top, 0)
    error = 1 / (1 + np.exp(-np.clip(net.combined(pooled), -40, 40))) - y
    n, f = pooled.shape
    most, least = pooled.argmax(axis=0), pooled.argmin(axis=0)
    cols = np.arange(f)
    grads[2] += error * np.stack([pooled.mean(axis=0), pooled[most, cols], pooled[least, cols]])
    grads[3] += error
    d = np.repeat(net.combine[0][None] / n, n, axis=0)
    d[most, cols] += net.combine[1]
    d[least, cols] += net.combine[2]
    d = np.where(top > 0, error * d, 0).astype(np.float32)
    grads[1] += d.sum(axis=0)
    rows = np.repeat(np.arange(n), f).reshape(n, f)
    for k in range(WIDTH):
        np.add.at(grads[0], (k, chunks[rows, best + k], np.broadcast_to(cols, (n, f))), d)


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float, step: int) -> None:
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Network:
    """A network from the labelled documents that are not held out.

    sample bounds the labelled rows used; their texts, whole, are all that reaches the driver.
    Labels that are null, or of no document, are left out; without labels the network is untrained.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text")).join(F.broadcast(picked), "doc_id")
    found = rows.select("doc_id", "text", "quality").collect()
    found.sort(key=lambda r: (r[0], r[2], r[1]))
    return fit([(chunks_of(r[1]), r[2]) for r in found])


SCORES = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score(docs: DataFrame, network: Network, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs, from the texts alone.

    Null texts are empty; an empty text has the score of one chunk of nothing; repeated rows give a row each; a null
    doc_id is not held out; an empty table gives no rows; other columns are not read.
    """
    network.pairs = None
    shipped = ship(docs.sparkSession, network)
    rows = ids_and_text(docs).select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))

    def run(rows):
        net = shipped()
        for doc_id, text, out in rows:
            s = net.score(text)
            yield doc_id, out, s, int(s >= threshold)

    return arrow_map(rows, run, SCORES)


def keep_good(docs: DataFrame, network: Network, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the network does not reject."""
    network.pairs = None
    shipped = ship(docs.sparkSession, network)
    at = docs.columns.index("text")

    def run(rows):
        net = shipped()
        for row in rows:
            if net.score((row[at] or "").encode()) >= threshold:
                yield row

    return arrow_map(docs, run, docs.schema)
