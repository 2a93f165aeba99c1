"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as the sum of two learned vectors' halves: one of its hashed whole form, one
the mean of its hashed character n-grams. A GRU reads each window forwards, another
backwards; attention pools their states into one logit, and a document's logit is its
largest window's. The network is fitted in numpy on a bounded sample of labelled rows:
labels mark documents, so each epoch trains on the windows that the network itself finds
most telling among all of a document's. All windows of all whole texts are scored inside
the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidewatch.llm.fitting import MAX_BYTES, remainder, sample
from tidewatch.llm.tables import table
from tidewatch.llm.text import Words, chunks, flat, mix

BITS = 14
EMBED = 6
HIDDEN = 8
WINDOW = 32
STRIDE = 24
MAX_TRAIN = 3_000
EPOCHS = 6
THRESHOLD = 0.7
CHUNK = 1 << 19
SLICE = 4_096  # windows that are scored at once
_GRAMS = (3, 4, 5)
_MARK = np.uint64(0x9E3779B97F4A7C15)


def word_inputs(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, gram buckets, gram starts) of distinct words; every word has a gram at least."""
    width = end - start
    buckets, owners = [], []
    for n in _GRAMS:
        many = np.maximum(width - n + 1, 0)
        owner = np.repeat(np.arange(len(start), dtype=np.int32), many)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        gram = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            gram = gram * np.uint64(257) + data[at + k]
        buckets.append((mix(gram * _MARK) >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(owner)
    short = np.flatnonzero(width < _GRAMS[0]).astype(np.int32)
    buckets.append((mix(hashes[short]) >> np.uint64(64 - BITS)).astype(np.int32))
    owners.append(short)
    gram, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(start) + 1))
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), gram[order], starts


class Batch:
    """Distinct words of some texts and the windows over them; -1 is padding."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        ends = words.offsets
        _, once, which = np.unique(words.hash, return_index=True, return_inverse=True)
        start, end, hashes = (x[once] for x in (words.start, words.end, words.hash))
        self.word, self.gram, self.starts = word_inputs(words.data, start, end, hashes)
        self.count = count = np.diff(ends)
        many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        self.first = np.concatenate([[0], np.cumsum(many)])
        row = np.repeat(np.arange(len(count)), many)
        begin = ends[:-1][row] + (np.arange(self.first[-1]) - self.first[row]) * STRIDE
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < ends[1:][row][:, None]
        self.windows = np.where(inside, np.append(which, -1)[np.minimum(at, len(which))], -1).astype(np.int32)


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
        d, h = 2 * EMBED, HIDDEN
        self.p = {"word": draw(1 << BITS, EMBED, s=0.02), "gram": draw(1 << BITS, EMBED, s=0.02), "att_w": draw(2 * h, h, s=0.3), "att_v": draw(h, s=0.3), "out": draw(2 * h, s=0.3), "out_b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"{way}_w": draw(d, 3 * h, s=0.4), f"{way}_u": draw(h, 3 * h, s=0.3), f"{way}_b": np.zeros(3 * h, np.float32)}
        self.slope, self.shift, self.floor = 1.0, 0.0, 0.0

    def inputs(self, word: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(word)
        if not n:
            return np.zeros((0, 2 * EMBED), np.float32)
        out = np.empty((n, 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][word]
        for k in range(0, n, 1 << 15):
            own = starts[k : k + (1 << 15) + 1]
            out[k : k + len(own) - 1, EMBED:] = np.add.reduceat(self.p["gram"][gram[own[0] : own[-1]]], own[:-1] - own[0], axis=0) / np.sqrt(np.diff(own))[:, None]
        return out

    def run(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows over the word vectors x; with keep, also what the backward pass needs."""
        n, t = windows.shape
        h, p = HIDDEN, self.p
        mask = (windows >= 0).T[:, :, None]
        states, saved = np.zeros((t, n, 2 * h), np.float32), {}
        for way, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            gates = np.concatenate([x @ p[f"{way}_w"] + p[f"{way}_b"], np.zeros((1, 3 * h), np.float32)])  # the last is padding's
            at, u = np.zeros((n, h), np.float32), p[f"{way}_u"]
            trail = []
            for k in steps:
                g, r = gates[windows[:, k]], at @ u
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                before = at
                at = new + zr[:, :h] * (before - new)
                if not mask[k].all():
                    at = np.where(mask[k], at, before)
                states[k, :, slice(0, h) if way == "f" else slice(h, 2 * h)] = at
                if keep:
                    trail.append((k, before, zr, new, r[:, 2 * h :]))
            saved[way] = trail
        mid = np.tanh(states.reshape(t * n, -1) @ p["att_w"]).reshape(t, n, h)
        weight = np.where(mask[:, :, 0], mid @ p["att_v"], np.float32(-1e4))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ p["out"] + p["out_b"][0]
        return (logits, (mask, states, saved, mid, weight, pooled)) if keep else logits

    def gradients(self, x: np.ndarray, windows: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        mask, states, saved, mid, weight, pooled = kept
        p, h = self.p, HIDDEN
        t, n, _ = states.shape
        g = {"out": pooled.T @ dlogit, "out_b": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["out"]
        dstates = weight[:, :, None] * dpooled
        dweight = np.einsum("tnh,nh->tn", states, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        dmid = dscore[:, :, None] * p["att_v"] * (1 - mid * mid)
        g["att_v"] = np.einsum("tn,tnh->h", dscore, mid)
        g["att_w"] = states.reshape(t * n, -1).T @ dmid.reshape(t * n, -1)
        dstates = dstates + (dmid.reshape(t * n, -1) @ p["att_w"].T).reshape(t, n, -1)
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for way in "fb":
            own = slice(0, h) if way == "f" else slice(h, 2 * h)
            du, dh = np.zeros_like(p[f"{way}_u"]), np.zeros((n, h), np.float32)
            flat_gate, flat_at = [], []
            for k, before, zr, new, rn in reversed(saved[way]):
                dh = dh + dstates[k][:, own]
                z, r = zr[:, :h], zr[:, h:]
                live = mask[k]
                dnew = np.where(live, dh * (1 - z), 0) * (1 - new * new)
                dz = np.where(live, dh * (before - new), 0) * z * (1 - z)
                dr = dnew * rn * r * (1 - r)
                into = np.concatenate([dz, dr, dnew * r], axis=1)
                du += before.T @ into
                dh = np.where(live, dh * z, dh) + into @ p[f"{way}_u"].T
                flat_gate.append(np.concatenate([dz, dr, dnew], axis=1))
                flat_at.append(windows[:, k])
            gate, at = np.concatenate(flat_gate), np.concatenate(flat_at)
            g[f"{way}_u"], g[f"{way}_b"] = du, gate.sum(axis=0)
            summed = np.zeros((len(x) + 1, 3 * h), np.float32)
            np.add.at(summed, at, gate)
            g[f"{way}_w"] = x.T @ summed[:-1]
            dx[:-1] += summed[:-1] @ p[f"{way}_w"].T
        return g, dx[:-1]

    def logits(self, batch: Batch) -> np.ndarray:
        """Of all windows, SLICE at a time; where there are more, each slice takes the vectors of its own words alone."""
        out, whole, several = np.empty(len(batch.windows), np.float32), batch.windows[:, -1] >= 0, len(batch.windows) > SLICE
        x = None if several else self.inputs(batch.word, batch.gram, batch.starts)
        for rows in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for k in range(0, len(rows), SLICE):
                part = batch.windows[rows[k : k + SLICE]]
                out[rows[k : k + SLICE]] = self.run(*self.own_words(batch, part)) if several else self.run(x, part)
        return out

    def own_words(self, batch: Batch, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the words in windows, and the windows by these words' numbers."""
        used, inverse = np.unique(np.append(-1, windows.ravel()), return_inverse=True)
        used, renamed = used[1:], (inverse[1:] - 1).reshape(windows.shape).astype(np.int32)
        many = np.diff(batch.starts)[used]
        begin = np.concatenate([[0], np.cumsum(many)])
        grams = batch.gram[np.repeat(batch.starts[used] - begin[:-1], many) + np.arange(begin[-1])]
        return self.inputs(batch.word[used], grams, begin), renamed

    def score(self, batch: Batch) -> np.ndarray:
        if len(batch.first) < 2:
            return np.zeros(0)
        most = np.maximum.reduceat(self.logits(batch), batch.first[:-1]).astype(float)
        most[batch.count == 0] = self.floor  # nothing said is as little toxic as anything the sample held
        return 1 / (1 + np.exp(-np.clip(self.slope * most + self.shift, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(-1), out=x)
    np.exp(np.minimum(x, np.float32(60), out=x), out=x)
    np.add(x, np.float32(1), out=x)
    return np.reciprocal(x, out=x)


def _odds(batch: Batch, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the documents that hold a bucket, for words and n-grams: where the embeddings begin."""
    held = np.zeros((2, 2, 1 << BITS))
    for k in range(len(y)):
        words = np.unique(batch.windows[batch.first[k] : batch.first[k + 1]])
        words = words[words >= 0]
        many = np.diff(batch.starts)[words]
        begin = np.concatenate([[0], np.cumsum(many)])
        grams = batch.gram[np.repeat(batch.starts[words] - begin[:-1], many) + np.arange(begin[-1])]
        for kind, buckets in enumerate((batch.word[words], grams)):
            held[kind, int(y[k] > 0), np.unique(buckets)] += 1
    n = y.sum()
    odds = np.log((held[:, 1] + 0.3) / (n + 1)) - np.log((held[:, 0] + 0.8 * max(1.0, (len(y) - n) / max(1, n))) / (len(y) - n + 1))
    return odds[0].astype(np.float32), odds[1].astype(np.float32)


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11, odds: bool = True) -> Network:
    """Adam on the logistic loss of the leading windows, then a scaling of document logits."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.shift, net.slope = (0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)), 0.0
        return net
    batch = Batch(*flat(pa.array(texts, pa.string())))
    if odds:  # embeddings that begin with what single words and n-grams tell
        word, gram = _odds(batch, y)
        net.p["word"][:, 0], net.p["gram"][:, 0] = word / 2, gram / 2
    doc, calm = np.repeat(np.arange(len(y)), np.diff(batch.first)), np.flatnonzero(np.repeat(y == 0, np.diff(batch.first)))
    calm_words = np.unique(batch.windows[calm])
    calm_words = calm_words[calm_words >= 0]
    x = net.inputs(batch.word, batch.gram, batch.starts)
    lead = np.append(x[:, 0] + x[:, EMBED], -1e3)[batch.windows].max(axis=1)  # the first choice of windows, before any training
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        if epoch:
            x = net.inputs(batch.word, batch.gram, batch.starts)
            lead = _run(net, x, batch.windows)
        order = np.lexsort((-lead, doc))
        rank = np.arange(len(order)) - batch.first[doc[order]]
        chosen = order[(rank < 1) | ((rank < 2) & (y[doc[order]] == 0))]
        chosen = np.concatenate([chosen, rng.choice(calm, min(len(y), len(calm)), replace=False)])
        alone = np.repeat(rng.choice(calm_words, len(y) // 2 if len(calm_words) else 0)[:, None], WINDOW, axis=1)  # a calm word stays calm, however often it is said
        seen, wanted = np.concatenate([batch.windows[chosen], alone]), np.concatenate([y[doc[chosen]], np.zeros(len(alone), np.float32)])
        order = rng.permutation(len(seen))
        for k in range(0, len(order), 256):
            rows = order[k : k + 256]
            used, inverse = np.unique(np.append(-1, seen[rows].ravel()), return_inverse=True)
            used, windows = used[1:], (inverse[1:] - 1).reshape(len(rows), WINDOW).astype(np.int32)
            many = np.diff(batch.starts)[used]
            begin = np.concatenate([[0], np.cumsum(many)])
            grams = batch.gram[np.repeat(batch.starts[used] - begin[:-1], many) + np.arange(begin[-1])]
            part = net.inputs(batch.word[used], grams, begin)
            logits, kept = net.run(part, windows, keep=True)
            target = wanted[rows]
            err = ((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - target).astype(np.float32) * np.where(target > 0, 2.0, 1.0).astype(np.float32) / len(rows)
            grads, dx = net.gradients(part, windows, kept, err)
            grads["word"], grads["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grads["word"], batch.word[used], dx[:, :EMBED])
            np.add.at(grads["gram"], grams, np.repeat(dx[:, EMBED:] / np.sqrt(many)[:, None], many, axis=0))
            step += 1
            for name, grad in grads.items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad * grad - second[name])
                rate = 0.01 if name not in ("word", "gram") else 0.003
                net.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7)
    x = net.inputs(batch.word, batch.gram, batch.starts)
    _scale(net, np.maximum.reduceat(_run(net, x, batch.windows), batch.first[:-1]).astype(float), y)
    return net


def _run(net: Network, x: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return np.concatenate([net.run(x, windows[k : k + 4096]) for k in range(0, len(windows), 4096)])


def _scale(net: Network, most: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of document logits by Newton steps on a damped logistic loss."""
    a = np.stack([most, np.ones(len(y))], axis=1)
    w, damp = np.array([1.0, 0.0]), np.diag([0.05, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + damp, a.T @ (p - y) + damp @ (w - [1.0, 0.0]))
    net.slope, net.shift, net.floor = max(float(w[0]), 1e-3), float(w[1]), float(most.min())


def _parts(column: pa.Array) -> Iterator[Batch]:
    data, offsets = flat(column)
    for i, j in chunks(offsets, CHUNK):
        yield Batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> Network:
    """Fits on about most labelled documents for which usable holds, of most_bytes at most."""
    rows = sample(docs, labels, label, usable, most, most_bytes).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, score (0 to 1, higher: more likely toxic) and predicted (1 from threshold on).

    A null text, and one without words, scores as low as the least toxic document of the sample. Rows are scored
    one by one, so repeated rows agree; columns that clash with the results are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted")] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(sent.value.score(x) for x in _parts(batch["text"]))])
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in ("score", "predicted")}
            columns |= {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return score(docs, net).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
