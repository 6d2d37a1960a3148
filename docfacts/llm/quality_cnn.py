"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into cells of CELL bytes; two neighbouring cells make a chunk, so chunks overlap by half
and cover the whole text. Bytes are embedded, with one more channel that tells whether the next bytes stood shortly
before in the same cell; learned filters WIDTH bytes wide run over them every STEP bytes, each filter's response is averaged within a chunk, the largest chunk counts (max-pooling), and a logistic layer combines the
filters into one probability.

Null and empty texts are scored by the bias alone. Equal texts get equal scores; ties between labels of an id go to the
smaller one; further columns are left alone; an empty table gives an empty result; with no labelled rows the network
keeps its first weights and scores every text 0.5. A long text is worked on in runs of BLOCK bytes, all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import labelled_sample, map_arrow

CELL, WIDTH, STEP, EMBED, FILTERS = 256, 8, 4, 6, 24
#: Bytes that numpy works on at once. A longer text is one block of its own, taken in runs of this many bytes.
BLOCK = 1 << 19
#: Bytes back in which the repeat channel looks for the next four bytes.
LAGS = range(2, 25)
_AT = CELL // STEP
_IN = WIDTH * EMBED + WIDTH // STEP


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # _IN x FILTERS
    bias: np.ndarray
    out: np.ndarray  # FILTERS + 1, the last for the constant

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        return cls(
            r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            r.normal(0, _IN**-0.5, (_IN, FILTERS)).astype(np.float32),
            np.full(FILTERS, -0.2, np.float32),
            np.zeros(FILTERS + 1, np.float32),
        )

    def cells(self, raw: np.ndarray, live: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """raw: whole cells of bytes and WIDTH - STEP more; live: bytes in each cell; last: whether a cell is the last
        of its text, so that no filter looks into the next text. The summed responses of each cell, and what the
        backward pass needs."""
        e = self.embed[raw]
        e[raw == 0] = 0
        n = (len(raw) - (WIDTH - STEP)) // STEP
        again = np.append(repeats(raw[: n * STEP]), np.zeros(WIDTH // STEP, np.float32))
        x = np.concatenate(
            [e[k : k + n * STEP].reshape(n, STEP * EMBED) for k in range(0, WIDTH, STEP)]
            + [again[k : k + n, None] for k in range(WIDTH // STEP)],
            1,
        )
        x[beyond(last), STEP * EMBED : WIDTH * EMBED] = 0
        y = np.maximum(x @ self.filters + self.bias, 0)
        mask = np.arange(_AT)[None, :] * STEP < live[:, None]
        y = y.reshape(-1, _AT, FILTERS) * mask[:, :, None]
        return y.sum(1), x, y

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The largest chunk response of each filter, for each text. Memory is bounded by BLOCK whatever the lengths."""
        out = np.zeros((len(texts), FILTERS), np.float32)
        todo, size = [], 0
        for i, t in enumerate(texts):
            todo.append(i)
            size += len(t) + CELL
            if size >= BLOCK:
                self._pool(texts, todo, out)
                todo, size = [], 0
        if todo:
            self._pool(texts, todo, out)
        return out

    def _pool(self, texts: list[bytes], which: list[int], out: np.ndarray) -> None:
        raw, live, first = layout([texts[i] for i in which])
        last = last_cells(first)
        size = len(raw) - WIDTH + STEP
        runs = [(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]
        sums = np.concatenate([self.cells(raw[a : z + WIDTH - STEP], live[a // CELL : z // CELL], last[a // CELL : z // CELL])[0] for a, z in runs])
        means, _ = chunk_means(sums, live, first)
        out[which] = np.maximum.reduceat(means, first[:-1])


def repeats(raw: np.ndarray) -> np.ndarray:
    """1 for each STEP bytes of whole cells if the four bytes there also begin at one of LAGS before, in the cell."""
    b = raw.reshape(-1, CELL).astype(np.uint32)
    four = b[:, :-3] | b[:, 1:-2] << 8 | b[:, 2:-1] << 16 | b[:, 3:] << 24
    here = four[:, ::STEP]
    out = np.zeros(here.shape, bool)
    for lag in LAGS:
        k = -(-lag // STEP)
        out[:, k:] |= here[:, k:] == four[:, k * STEP - lag : CELL - lag : STEP]
    return (out & (here != 0)).astype(np.float32).ravel()


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in whole cells one after another (a text of no bytes has one), live bytes a cell, first cell a text."""
    n = np.array([max(1, -(-len(t) // CELL)) for t in texts])
    first = np.concatenate(([0], np.cumsum(n)))
    joined = b"".join(t.ljust(k * CELL, b"\0") for t, k in zip(texts, n.tolist(), strict=True)) + b"\0" * (WIDTH - STEP)
    length = np.array([len(t) for t in texts])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.frombuffer(joined, np.uint8), np.clip(np.repeat(length, n) - inside * CELL, 0, CELL), first


def last_cells(first: np.ndarray) -> np.ndarray:
    out = np.zeros(first[-1], bool)
    out[first[1:] - 1] = True
    return out


def beyond(last: np.ndarray) -> np.ndarray:
    """Places of the filters whose second half lies behind the end of a text that fills its last cell."""
    return (np.flatnonzero(last) + 1) * _AT - 1


def chunk_means(sums: np.ndarray, live: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean response of the chunk that starts at each cell; a text's last cell joins the chunk before it."""
    count = -(-live // STEP).astype(np.float32)
    both, n = sums.copy(), count.copy()
    joins = np.ones(len(live), bool)
    joins[first[1:] - 1] = False  # the last cell of each text has no next one
    at = np.flatnonzero(joins)
    both[at] += sums[at + 1]
    n[at] += count[at + 1]
    alone = np.zeros(len(live), bool)
    alone[first[:-1]] = True
    tail = ~joins & ~alone  # covered already by the chunk before
    n = np.maximum(n, 1)
    means = both / n[:, None]
    means[tail] = -1
    return means, n


def train(texts: list[bytes], good: np.ndarray, steps: int = 600, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the logistic loss; good: 1 for label 1. The gradient runs through the one chunk that each maximum names."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    params = [net.embed, net.filters, net.bias, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(2, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            raw, live, first = layout([texts[i] for i in own])
            last = last_cells(first)
            sums, x, y = net.cells(raw, live, last)
            means, n = chunk_means(sums, live, first)
            pooled = np.maximum.reduceat(means, first[:-1])
            d = ((net.probability(pooled) - good[own]) / len(own)).astype(np.float32)
            g_out = np.append(d @ pooled, d.sum()).astype(np.float32)
            d_pool = d[:, None] * net.out[None, :-1]
            d_cell = np.zeros_like(sums)
            for k in range(len(own)):
                lo, hi = first[k], first[k + 1]
                c = means[lo:hi].argmax(0) + lo
                w = d_pool[k] / n[c]
                np.add.at(d_cell, (c, np.arange(FILTERS)), w)
                ok = c + 1 < hi
                np.add.at(d_cell, (c[ok] + 1, np.arange(FILTERS)[ok]), w[ok])
            d_y = np.repeat(d_cell, _AT, 0) * (y.reshape(-1, FILTERS) > 0)
            used = np.flatnonzero(np.any(d_y != 0, 1))
            d_y, xs = d_y[used], x[used]
            d_x = (d_y @ net.filters[: WIDTH * EMBED].T).reshape(-1, WIDTH, EMBED)
            d_x[np.isin(used, beyond(last)), STEP:] = 0
            places = used[:, None] * STEP + np.arange(WIDTH)
            at = raw[places]
            g_embed = np.stack([np.bincount(at.ravel(), d_x[:, :, j].ravel(), 256) for j in range(EMBED)], 1).astype(np.float32)
            g_embed[0] = 0
            step += 1
            for i, g in enumerate((g_embed, xs.T @ d_y, d_y.sum(0), g_out)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (0.2 if epoch >= 0.8 * epochs else 1) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def fitting(sizes: list[int], most: int) -> list[int]:
    """Places of the sizes that fit, taken in order: one that would exceed the sum is left out and the next ones follow."""
    out, total = [], 0
    for k, n in enumerate(sizes):
        if total + n <= most:
            out.append(k)
            total += n
    return out


def sample(documents: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """number, text and quality of labelled rows in the order of a hash of their ids: at most most_rows of them, and as
    many as fit into most_bytes of text. A text that does not fit beside those before it is left out, a longer one than
    most_bytes always, and the ones after it still teach. Both bounds hold before a text leaves the tasks."""
    marked = labelled_sample(labels, most_rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    held = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), size.alias("size"), F.xxhash64("text").alias("print"))
    # a repeated row teaches once; ids are few here, and their sizes come to the driver
    few = held.select("doc_id", "print", "size").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "print").agg(F.first("size").alias("size"), F.first("quality").alias("quality"))
    rows = few.orderBy(F.xxhash64("doc_id"), "doc_id", "print").limit(most_rows).collect()
    taken = [(n, rows[k]["doc_id"], rows[k]["print"], rows[k]["quality"]) for n, k in enumerate(fitting([r["size"] for r in rows], most_bytes))]
    kinds = dict(few.dtypes)
    chosen = documents.sparkSession.createDataFrame(taken, f"number int, doc_id {kinds['doc_id']}, print long, quality {kinds['quality']}")
    return held.join(F.broadcast(chosen), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("number", "text", "quality", "doc_id", "print")


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 3000, most_bytes: int = 12_000_000, **options) -> Network:
    """Train on at most `most_rows` labelled rows and `most_bytes` of text, whatever the size of the tables."""
    rows = sample(documents, labels, most_rows, most_bytes).toPandas().sort_values("number", kind="stable")
    return train([t.encode("utf-8", "replace") for t in rows["text"]], rows["quality"].to_numpy(float), **options)


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id and the probability of label 1, from the whole text alone."""
    sent = documents.sparkSession.sparkContext.broadcast(net)  # a few kB

    def run(batches):
        for b in batches:
            p = sent.value.probability(sent.value.pooled([(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")
