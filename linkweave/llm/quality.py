"""A byte-level convolutional classifier of text quality, in numpy.

Learned filters of 16 bytes slide by 8 bytes over the whole text; each byte has a learned
embedding and one fixed channel, which says whether the four bytes from here stood a few bytes earlier as well.
Responses are rectified and averaged over overlapping chunks of 128 bytes, every 64 bytes; the
largest chunk of each filter, and logistic weights, give one probability.

The classifier is fitted on at most ``SAMPLE`` labelled texts and ``SAMPLE_BYTES`` bytes of whole texts, drawn by a
hash of doc_id; a labelled text longer than ``LONGEST`` bytes is no material to learn from (nearly no text is, and one
must not use up the bytes of many). Labels of rows held out are never read. Scoring covers every byte of every text; texts
longer than ``STRETCH`` are read in overlapping stretches, so memory does not grow with a text.

Defined results: null and empty texts, and texts when no label can be learned from, get the score of no
evidence, between 0 and 1; equal texts have equal scores; a label that is null is not learned
from, and of several labels of one document each counts; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrow, tidy
from ._words import blocks

STRIDE, EMBED, FILTERS, CHUNK = 8, 7, 16, 8
SAMPLE, SAMPLE_BYTES, LONGEST, ROUNDS = 3000, 8 << 20, 1 << 20, 8
#: Bytes that are scored at once, of many texts or of a long one: whole half chunks. Each takes some 64 bytes of memory.
STRETCH = 1 << 18
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double, predicted int"
#: Distances at which a repetition of four bytes is looked for.
LAGS = range(3, 25)


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each text padded by zeros to whole strides, two at least; the repetition channel, inside each text; first stride of each text."""
    lengths = np.diff(offsets)
    strides = np.maximum(2, -(-lengths // STRIDE))
    first = np.concatenate([[0], np.cumsum(strides)])
    flat = np.zeros(int(first[-1]) * STRIDE, np.uint8)
    at = np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - offsets[:-1], lengths)
    flat[at] = data
    four = np.zeros(len(flat), np.uint32)
    padded = np.concatenate([flat, np.zeros(3, np.uint8)]).astype(np.uint32)
    begins, ends = first[:-1, None] * STRIDE, first[1:, None] * STRIDE
    for k in range(4):
        part = padded[k : k + len(flat)] << np.uint32(8 * k)
        part[ends - np.arange(1, k + 1)] = 0  # of the next text
        four |= part
    again = np.zeros(len(flat), bool)
    for lag in LAGS:
        hit = np.zeros(len(flat), bool)
        hit[lag:] = four[lag:] == four[:-lag]
        hit[np.minimum(begins + np.arange(lag), ends - 1)] = False  # would look into the text before
        again |= hit
    again &= flat > 0
    return flat, again, first


class Network:
    """Filters, their embedding and the logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = EMBED + 1
        self.p = {
            "embed": (rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32),
            "near": (rng.normal(size=(STRIDE * wide, FILTERS)) / np.sqrt(2 * STRIDE * wide)).astype(np.float32),
            "far": (rng.normal(size=(STRIDE * wide, FILTERS)) / np.sqrt(2 * STRIDE * wide)).astype(np.float32),
            "bias": np.full(FILTERS, 0.05, np.float32),
            "out": (rng.normal(size=FILTERS) * 0.1).astype(np.float32),
            "prior": np.zeros(1, np.float32),
        }

    def channels(self, flat: np.ndarray, again: np.ndarray) -> np.ndarray:
        x = np.empty((len(flat), EMBED + 1), np.float32)
        x[:, :EMBED] = self.p["embed"][flat]
        x[:, EMBED] = again
        return x.reshape(-1, STRIDE * (EMBED + 1))

    def responses(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rectified filter responses at each stride; the last stride of a text stands alone."""
        r = x @ self.p["near"]
        far = x[1:] @ self.p["far"]
        far[ends[:-1] - 1] = 0
        r[:-1] += far
        r += self.p["bias"]
        return np.maximum(r, 0, out=r)

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(half chunk of each stride, half chunks' sizes, first half chunk of each text)."""
        strides = np.diff(first)
        halves = -(-strides // CHUNK)
        begin = np.concatenate([[0], np.cumsum(halves)])
        starts = np.arange(begin[-1]) - np.repeat(begin[:-1], halves)
        starts = starts * CHUNK + np.repeat(first[:-1], halves)
        return starts, np.diff(np.append(starts, first[-1])), begin

    def pooled(self, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        starts, sizes, begin = self.chunks(first)
        half = np.add.reduceat(r, starts, axis=0)
        whole, n = half.copy(), sizes.astype(np.float32)
        joined = np.ones(len(half), bool)  # chunks reach over the next half, if the text goes on
        joined[begin[1:] - 1] = False
        at = np.flatnonzero(joined)
        whole[at] += half[at + 1]
        n[at] += sizes[at + 1]
        mean = whole / n[:, None]
        return np.maximum.reduceat(mean, begin[:-1], axis=0), mean, starts, sizes, begin, joined, n

    def best(self, data: np.ndarray) -> np.ndarray:
        """Each filter's largest chunk of one long text, in stretches.

        A stretch has a half chunk more in front, for the repetition channel, and two behind: the second half of
        its last chunk, and one whose last stride would look beyond. What is incomplete is left out.
        """
        half, best = STRIDE * CHUNK, None
        for at in range(0, len(data), STRETCH):
            begin, end = max(0, at - half), min(len(data), at + STRETCH + 2 * half)
            flat, again, first = layout(data[begin:end], np.array([0, end - begin]))
            mean = self.pooled(self.responses(self.channels(flat, again), first[1:]), first)[1]
            mean = mean[int(at > 0) : (len(mean) if end == len(data) else int(at > 0) + STRETCH // half)]
            best = mean.max(0) if best is None else np.maximum(best, mean.max(0))
            if end == len(data):
                return best
        return best

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        if len(data) > 2 * STRETCH:
            parts = np.flatnonzero(np.diff(offsets) > STRETCH)
            edges = np.unique(np.concatenate([[0], parts, parts + 1, [len(offsets) - 1]]))
            return np.concatenate([self._scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(edges, edges[1:])])
        return self._scores(data, offsets)

    def _scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > STRETCH:
            top = self.best(data)[None]
        else:
            flat, again, first = layout(data, offsets)
            top = self.pooled(self.responses(self.channels(flat, again), first[1:]), first)[0]
        z = (top @ self.p["out"] + self.p["prior"][0]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, flat: np.ndarray, again: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
        x = self.channels(flat, again)
        r = self.responses(x, first[1:])
        top, mean, starts, sizes, begin, joined, n = self.pooled(r, first)
        z = top @ self.p["out"] + self.p["prior"][0]
        error = (1 / (1 + np.exp(-z)) - label).astype(np.float32) / len(label)
        g = {"out": top.T @ error + 1e-4 * self.p["out"], "prior": error.sum(keepdims=True)}
        text = np.repeat(np.arange(len(label)), np.diff(begin))
        hit = mean == top[text]
        once = np.zeros_like(mean)
        rows, columns = np.nonzero(hit)
        last = np.full(top.shape, -1)
        last[text[rows], columns] = rows  # one of equal chunks
        i, j = np.nonzero(last >= 0)
        once[last[i, j], j] = error[i] * self.p["out"][j]
        once /= n[:, None]
        half = once.copy()
        at = np.flatnonzero(joined)
        half[at + 1] += once[at]
        d = np.repeat(half, sizes, axis=0) * (r > 0)
        far = d[:-1].copy()
        far[first[1:-1] - 1] = 0
        g |= {"bias": d.sum(0), "near": x.T @ d, "far": x[1:].T @ far}
        dx = d @ self.p["near"].T
        dx[1:] += far @ self.p["far"].T
        dx = dx.reshape(-1, EMBED + 1)[:, :EMBED]
        g["embed"] = np.stack([np.bincount(flat, dx[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return g


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Adam over small batches of whole texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    labels = np.asarray(labels, np.float32)
    rate = min(max(float(labels.mean()), 0.02), 0.98)
    net.p["prior"][0] = np.log(rate / (1 - rate))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    t = 0
    for epoch in range(rounds):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 64):
            part = order[a : a + 64]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            flat, again, first = layout(np.frombuffer(b"".join(texts[i] for i in part), np.uint8), offsets)
            t += 1
            for k, g in net.gradients(flat, again, first, labels[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                step = 0.02 * (1 - epoch / rounds) + 0.001
                net.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> Network:
    """Fit on a bounded sample of labelled whole texts, in the order of a hash; texts of more than ``longest`` bytes are left out."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # at most `sample` rows: small enough to broadcast
    lengths = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").withColumn("n", F.octet_length(F.coalesce("text", F.lit(""))))
    size, texts, marks = 0, [], []
    for r in lengths.where(F.col("n") <= longest).select("doc_id", "text", "quality").sort(F.xxhash64("doc_id"), "doc_id", "quality", "text").toLocalIterator():
        body = (r["text"] or "").encode()
        if size + len(body) > sample_bytes:
            break
        size += len(body)
        texts.append(body)
        marks.append(int(r["quality"] > 0))
    net = fit(texts, np.array(marks))
    tidy(0.0)  # the driver goes on
    return net


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, most=STRETCH):
            score = net.score(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [net.score(d, o) >= threshold for _, d, o in blocks(iter([batch]), most=STRETCH)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return map_arrow(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return scored(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
