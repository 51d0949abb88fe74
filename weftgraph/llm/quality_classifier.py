"""Quality score of a document by a convolutional network over its bytes.

Filters of ``WIDTH`` bytes slide over the whole text in steps of ``STRIDE``.
Their largest responses in each span of ``SPAN`` bytes are pooled; two
neighbouring spans are a chunk, so chunks overlap by half and cover the text to
its last byte.  A small layer turns a chunk into a vector; the largest and the
mean values over a document's chunks give one logit.  A filter is a table of a
value per offset and byte, so a response is a sum of look-ups.

Training runs on the driver, over at most ``PER_CLASS`` labelled documents of
either class with at most ``LONGEST`` bytes each, taken in the order of a hash
of the id; the shares of the classes among all labelled rows correct the bias.
Scoring is a map over the documents with a model of about 200 KB.

Defined cases: null text counts as empty; an empty text is one span of padding
and has a score; without labels of both classes every score is the share of
label 1, or 0.5 without labels; labels that are null or name no document are
left out; repeated label rows count once per document and label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of

WIDTH, STRIDE, SPAN, FILTERS, HIDDEN = 6, 2, 256, 24, 16
#: Training documents of either class, and their greatest length in bytes.
PER_CLASS, LONGEST = 1500, 12_000
EPOCHS, BATCH, RATE = 16, 32, 0.004
THRESHOLD = 0.3
_STEPS = SPAN // STRIDE


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded to whole spans, WIDTH more at the end; number of the first span of each text, with the total)."""
    spans = np.array([max(1, -(-len(t) // SPAN)) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(spans)))
    buf = np.zeros(first[-1] * SPAN + WIDTH, dtype=np.uint8)
    for t, a in zip(texts, first.tolist()):
        buf[a * SPAN : a * SPAN + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return buf, first


def responses(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """(spans, steps, filters) of filter responses."""
    n = (len(buf) - WIDTH) // STRIDE
    out = np.take(table[0], buf[0 : n * STRIDE : STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += np.take(table[j], buf[j : j + n * STRIDE : STRIDE], axis=0)
    return out.reshape(-1, _STEPS, table.shape[2])


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spans of each chunk as (2, chunks); first chunk of each text, with the total)."""
    n = np.diff(first)
    count = np.maximum(n - 1, 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    left = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    right = left + np.repeat((n > 1).astype(np.int64), count)
    return np.stack((left, right)), begin


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "table": r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
            "b0": np.zeros(FILTERS, dtype=np.float32),
            "w1": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, dtype=np.float32),
            "w2": r.normal(0, HIDDEN**-0.5, 2 * HIDDEN).astype(np.float32),
            "b2": np.zeros(1, dtype=np.float32),
        }

    def _top(self, pooled: np.ndarray, first: np.ndarray):
        p = self.p
        (left, right), begin = chunks_of(first)
        chunk = np.maximum(pooled[left], pooled[right])
        active = np.maximum(chunk + p["b0"], 0)
        hidden = np.tanh(active @ p["w1"] + p["b1"])
        most = np.maximum.reduceat(hidden, begin[:-1], axis=0)
        mean = np.add.reduceat(hidden, begin[:-1], axis=0) / np.diff(begin)[:, None]
        logit = np.concatenate((most, mean), axis=1) @ p["w2"] + p["b2"]
        return logit, (left, right, begin, chunk, active, hidden, most, mean)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Scores of many texts, a bounded number of spans at a time."""
        out, lo = [], 0
        sizes = [max(1, -(-len(t) // SPAN)) for t in texts]
        while lo < len(texts):
            hi, spans = lo + 1, sizes[lo]
            while hi < len(texts) and spans + sizes[hi] <= 128:
                spans += sizes[hi]
                hi += 1
            buf, first = laid_out(texts[lo:hi])
            pooled = []
            for a in range(0, int(first[-1]), 128):  # one long text: part by part
                z = min(a + 128, int(first[-1]))
                pooled.append(responses(self.p["table"], buf[a * SPAN : z * SPAN + WIDTH]).max(axis=1))
            out.append(self._top(np.concatenate(pooled), first)[0])
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)

    def step(self, texts: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch."""
        p = self.p
        buf, first = laid_out(texts)
        r = responses(p["table"], buf)
        at = r.argmax(axis=1)
        pooled = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
        logit, (left, right, begin, chunk, active, hidden, most, mean) = self._top(pooled, first)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"w2": np.concatenate((most, mean), axis=1).T @ d, "b2": d.sum(keepdims=True)}
        n, doc = np.diff(begin), np.repeat(np.arange(len(y)), np.diff(begin))
        d_most, d_mean = np.outer(d, p["w2"][:HIDDEN]), np.outer(d, p["w2"][HIDDEN:]) / n[:, None]
        d_hidden = (hidden == most[doc]) * d_most[doc] + d_mean[doc]
        d_hidden *= 1 - hidden * hidden
        g["w1"], g["b1"] = active.T @ d_hidden, d_hidden.sum(axis=0)
        d_active = (d_hidden @ p["w1"].T) * (active > 0)
        g["b0"] = d_active.sum(axis=0)
        d_pooled = np.zeros_like(pooled)
        from_left = pooled[left] >= pooled[right]
        np.add.at(d_pooled, left, d_active * from_left)
        np.add.at(d_pooled, right, d_active * ~from_left)
        # Only the place of the largest response has a gradient.
        place = (np.arange(len(at))[:, None] * SPAN + at * STRIDE).ravel()
        column = np.tile(np.arange(FILTERS), len(at))
        table = np.empty_like(p["table"])
        for j in range(WIDTH):
            cell = buf[place + j].astype(np.int64) * FILTERS + column
            table[j] = np.bincount(cell, weights=d_pooled.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        g["table"] = table
        return loss, g


def fit(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 5) -> Network:
    """Train by Adam; ``share`` is the share of label 1 that scores should reflect."""
    net, r = Network(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    steps = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            _, g = net.step([texts[i] for i in some], labels[some].astype(np.float32))
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, v in net.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                v -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    trained = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.p["b2"] += np.float32(np.log(share / (1 - share)) - np.log(trained / (1 - trained)))
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """A network, or one score for all texts if there is only one class."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    texts = docs.select(F.col("doc_id").alias("t_id"), binary_of(F.col("text")).alias("t")).where(F.octet_length("t") <= LONGEST)
    # Ids first: a fair share of the labelled rows is enough for the sample.
    chosen = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("l_id"), "l_id").limit(2 * per_class)
        chosen = some if chosen is None else chosen.union(some)
    rows = texts.join(F.broadcast(chosen), F.col("t_id") == F.col("l_id")).select("quality", "l_id", "t").dropDuplicates(["quality", "l_id"])
    sample = []
    for q in (0, 1):
        sample += rows.where(F.col("quality") == q).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class).select("quality", "t").collect()
    if len({r["quality"] for r in sample}) < 2:
        return counts.get(1, 0) / sum(counts.values())
    return fit([bytes(r["t"]) for r in sample], np.array([r["quality"] for r in sample]), counts[1] / sum(counts.values()))


_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.p if isinstance(model, Network) else model)

    def run(batches):
        if isinstance(shared.value, float):
            scores = lambda texts: np.full(len(texts), shared.value)
        else:
            net = Network()
            net.p = shared.value
            scores = lambda texts: 1 / (1 + np.exp(-net.logits(texts).astype(np.float64)))
        for b in batches:
            got = scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint"), out, binary_of(F.col("text"))).mapInArrow(run, _SCORED)
