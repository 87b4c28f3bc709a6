"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own hashed embedding beside the mean of the embeddings of its hashed byte trigrams. Forward
and backward gated recurrences read a window of words, attention pools their states, and a logistic unit scores the
window. All windows of a text are scored, each overlapping the next by half; the text has the highest score.

Labels belong to texts, not windows, so training lets each text of its bounded sample speak through the window
that scores highest at the moment. Embeddings learn by Adagrad, the rest by Adam.

Defined results: a null text, and one without a word, score 0. Without labelled rows of both kinds every text
scores 0. Repeated rows score alike; a null label isn't learned from. Columns named like results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import extended, narrow_batches

WINDOW, STRIDE = 48, 24
WORD_BITS, TRI_BITS = 16, 13
DIM, HIDDEN = 8, 8
CACHE = 200_000  # words a Python worker remembers
LEXICAL = 4  # first rounds in which words choose the windows
AT_ONCE = 2048  # windows scored at once
SEGMENT = 1 << 20  # bytes split into words at once

# letters A-Z in lower case; digits, punctuation and control characters as spaces
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around every byte of every word, and where each word's begin."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    hashed = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRI_BITS)).astype(np.int64)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    keep = np.ones(len(hashed), bool)
    keep[starts[1:] - 1] = False
    return hashed[keep], np.cumsum(sizes) - sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights; ``p`` holds the dense ones by name, one set of recurrent ones for each direction."""

    word: np.ndarray
    tri: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        random = np.random.default_rng(seed)
        one = cls(random.normal(0, 0.02, (1 << WORD_BITS, DIM)).astype(np.float32), random.normal(0, 0.1, (1 << TRI_BITS, DIM)).astype(np.float32))
        for side in "fb":
            one.p |= {
                f"W{side}": random.normal(0, 0.4, (2 * DIM, 3 * HIDDEN)),
                f"c{side}": np.zeros(3 * HIDDEN),
                f"Z{side}": random.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)),
                f"N{side}": random.normal(0, 0.3, (HIDDEN, HIDDEN)),
            }
        one.p |= {"A": random.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "v": random.normal(0, 0.3, HIDDEN), "w": random.normal(0, 0.3, 2 * HIDDEN), "b": np.zeros(1)}
        one.p = {k: x.astype(np.float32) for k, x in one.p.items()}
        return one

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input vector of every word, and what its gradient needs."""
        bucket = np.array([zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in words], np.int64)
        tri, starts = trigrams(words)
        sizes = np.array([len(w) for w in words], np.float32)[:, None]
        mean = np.add.reduceat(self.tri[tri], starts, axis=0) / sizes
        return np.hstack([self.word[bucket], mean]), (bucket, tri, sizes)

    def _recur(self, gates: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States of one direction, by time; ``gates`` (time, window, 3 x HIDDEN) come from the inputs."""
        steps, count = gates.shape[:2]
        state, out = np.zeros((count, HIDDEN), gates.dtype), np.zeros((steps, count, HIDDEN), gates.dtype)
        zr_weight, n_weight = self.p[f"Z{side}"], self.p[f"N{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            zr = sigmoid(gates[t, :, : 2 * HIDDEN] + state @ zr_weight)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            q = state @ n_weight
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * q)
            new = np.where(mask[t, :, None], (1 - z) * n + z * state, state)
            if keep is not None:
                keep.append((t, state, z, r, q, n))
            state = out[t] = new
        return out

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. ``mask`` (time, window) says which places hold a word."""
        p = self.p
        states = np.concatenate([self._recur(gates[s], mask, s, None if keep is None else keep.setdefault(s, [])) for s in "fb"], axis=2)
        u = np.tanh(states @ p["A"])
        weight = np.exp(np.clip(u @ p["v"], -30, 30)) * mask
        weight = weight / np.maximum(weight.sum(0), 1e-30)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"states": states, "u": u, "weight": weight, "pooled": pooled}
        return pooled @ p["w"] + p["b"][0]

    def backward(self, error: np.ndarray, mask: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the dense weights and of the gates, from the logits' errors."""
        p, states, u, weight = self.p, keep["states"], keep["u"], keep["weight"]
        grad = {"w": keep["pooled"].T @ error, "b": error.sum(keepdims=True)}
        d_pool = error[:, None] * p["w"]
        share = (d_pool * states).sum(2)
        d_score = weight * (share - (weight * share).sum(0))
        grad["v"] = np.einsum("tn,tnh->h", d_score, u)
        d_u = d_score[:, :, None] * p["v"] * (1 - u * u)
        grad["A"] = np.einsum("tni,tnh->ih", states, d_u)
        d_states = weight[:, :, None] * d_pool + d_u @ p["A"].T
        d_gates = {}
        for k, side in enumerate("fb"):
            d_out, ahead = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN], 0
            zr_weight, n_weight = p[f"Z{side}"], p[f"N{side}"]
            d_zr_w, d_n_w = np.zeros_like(zr_weight), np.zeros_like(n_weight)
            gates = np.zeros((*mask.shape, 3 * HIDDEN), states.dtype)
            for t, state, z, r, q, n in reversed(keep[side]):
                total = d_out[t] + ahead
                live = np.where(mask[t, :, None], total, 0)
                d_n = live * (1 - z) * (1 - n * n)
                d_zr = np.hstack([live * (state - n) * z * (1 - z), d_n * q * r * (1 - r)])
                d_q = d_n * r
                d_zr_w += state.T @ d_zr
                d_n_w += state.T @ d_q
                gates[t] = np.hstack([d_zr, d_n])
                ahead = (total - live) + live * z + d_zr @ zr_weight.T + d_q @ n_weight.T
            d_gates[side] = gates
            grad |= {f"Z{side}": d_zr_w, f"N{side}": d_n_w, f"c{side}": gates.sum((0, 1))}
        return grad, d_gates


def window_starts(count: int) -> list[int]:
    """Windows that cover ``count`` words, each half over the next; the last ends with the text."""
    if count <= WINDOW:
        return [0]
    return [*range(0, count - WINDOW, STRIDE), count - WINDOW]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Word numbers of all windows of a text; -1 where there is no word."""
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)), constant_values=-1)[None]
    return ids[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


def logits(network: Network, projected: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Logits of windows of word numbers; ``projected`` has the gates of every word."""
    out = np.zeros(len(windows), np.float32)
    for at in range(0, len(windows), AT_ONCE):
        part = windows[at : at + AT_ONCE].T
        out[at : at + AT_ONCE] = network.forward({s: projected[s][part] for s in "fb"}, part >= 0)
    return out


def telling(cut: list[np.ndarray], target: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each word is, and by how many deviations more often in toxic ones than by chance."""
    seen, toxic = np.zeros(words), np.zeros(words)
    for windows, y in zip(cut, target, strict=True):
        here = np.unique(windows[windows >= 0])
        seen[here] += 1
        toxic[here] += y
    expected = seen * target.mean()
    return seen, (toxic - expected) / np.sqrt(expected + 1)


def train(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network | None:
    """Fit a network; each text is learned by the window of its highest score.

    In the first rounds the window with the most telling word stands in for it. Words of fewer than three texts
    have no embedding of their own to learn, only that of their trigrams.
    """
    kept = [(words_of(t), y) for t, y in zip(texts, labels, strict=True)]
    kept = [(w, y) for w, y in kept if w]
    if len({y for _, y in kept}) < 2:
        return None
    vocabulary: dict[bytes, int] = {}
    cut = [windows_of(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])) for words, _ in kept]
    words, target = list(vocabulary), np.array([y for _, y in kept], np.float32)
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    every, network, random = np.concatenate(cut), Network.fresh(seed), np.random.default_rng(seed)
    first = np.cumsum([0, *(len(c) for c in cut)])[:-1]
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in network.p.items()}
    grown_word, grown_tri = np.full(network.word.shape, 1e-4, np.float32), np.full(network.tri.shape, 1e-4, np.float32)
    weight = np.where(target == 1, 1 / max(target.mean(), 0.05), 1 / max(1 - target.mean(), 0.05)).astype(np.float32) / 2
    seen, lift = telling(cut, target, len(words))
    tick = 0
    for epoch in range(epochs):
        if epoch < LEXICAL:
            score = np.where(every >= 0, lift[every], -np.inf).max(1)
        else:
            vectors, _ = network.inputs(words)
            score = logits(network, {s: (vectors @ network.p[f"W{s}"] + network.p[f"c{s}"]) for s in "fb"}, every)
        ranked = np.lexsort((-score, owner))
        chosen = ranked[first]
        for part in np.array_split(random.permutation(len(cut)), max(1, len(cut) // batch)):
            windows = every[chosen[part]].T
            mask = windows >= 0
            used, place = np.unique(windows[mask], return_inverse=True)
            x, (bucket, tri, sizes) = network.inputs([words[i] for i in used])
            inside = np.zeros((*windows.shape, 2 * DIM), np.float32)
            inside[mask] = x[place]
            keep: dict = {}
            guess = network.forward({s: inside @ network.p[f"W{s}"] + network.p[f"c{s}"] for s in "fb"}, mask, keep)
            error = ((sigmoid(guess) - target[part]) * weight[part] / len(part)).astype(np.float32)
            grad, d_gates = network.backward(error, mask, keep)
            d_inside = 0
            for s in "fb":
                grad[f"W{s}"] = np.einsum("tni,tnj->ij", inside, d_gates[s])
                d_inside = d_inside + d_gates[s] @ network.p[f"W{s}"].T
            d_x = np.zeros_like(x)
            np.add.at(d_x, place, d_inside[mask])
            tick += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[k] -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)).astype(np.float32)
            d_x[seen[used] < 3, :DIM] = 0
            d_tri = np.repeat(d_x[:, DIM:] / sizes, sizes[:, 0].astype(int), axis=0)
            for table, grown, at, g in ((network.word, grown_word, bucket, d_x[:, :DIM]), (network.tri, grown_tri, tri, d_tri)):
                rows, where = np.unique(at, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, where, g)
                grown[rows] += total * total
                table[rows] -= 0.05 * total / np.sqrt(grown[rows])
    return network


class Scorer:
    """Scores texts; remembers the gates of the words it has met."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.gates = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(words)
            self.gates = {s: g[:0] for s, g in self.gates.items()}
        if new:
            x, _ = self.network.inputs(new)
            for s in "fb":
                self.gates[s] = np.vstack([self.gates[s], (x @ self.network.p[f"W{s}"] + self.network.p[f"c{s}"]).astype(np.float32)])
            self.known |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Texts are taken together up to a segment; a longer text has its windows scored segment by segment.

        Segments start on the grid of windows, so a long text has the windows it would have in one piece.
        """
        scores, group, size = np.zeros(len(texts)), [], 0
        step = max(SEGMENT // 8 // STRIDE, 1) * STRIDE
        for k, text in enumerate(texts):
            words = words_of(text) if text else []
            if not words:
                continue
            for at in range(0, max(len(words) - WINDOW, 1), step):  # segments share a window's words
                part = words[at : at + step + WINDOW]
                group.append((k, part))
                size += len(part)
                if size >= step:
                    self._score(group, scores)
                    group, size = [], 0
        if group:
            self._score(group, scores)
        return scores

    def _score(self, group: list[tuple[int, list[bytes]]], scores: np.ndarray) -> None:
        self._learn({w for _, words in group for w in words})
        cut = [windows_of(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))) for _, words in group]
        found = sigmoid(logits(self.network, self.gates, np.concatenate(cut)).astype(np.float64))
        best = np.maximum.reduceat(found, np.cumsum([0, *(len(c) for c in cut)])[:-1])
        np.maximum.at(scores, [k for k, _ in group], best)


def fit(documents: DataFrame, labels: DataFrame, rows: int = 6000, longest: int = 8000, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Network | None:
    """Train on at most ``rows`` labelled texts of at most ``longest`` characters, half of them toxic if there are so many.

    Three times as many labels are drawn by hash; these few are what is broadcast to the documents, whose texts
    stay where they are.
    """
    part, span = rows // 2, 1 << 31
    order = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span))
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), order.alias("o")).where("y in (0, 1) and k is not null")
    have = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    drawn = []
    for y in (0, 1):
        limit = span if have.get(y, 0) <= 6 * part else span * 6 * part // have[y]
        drawn.append(marked.where((F.col("y") == y) & (F.col("o") < limit)).orderBy("o", "k").limit(3 * part))
    spoken = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "k")
    spoken = spoken.where((F.char_length("t") > 0) & (F.char_length("t") <= longest))
    found = []
    for y in (0, 1):
        found += spoken.where(F.col("y") == y).orderBy("o", "t").limit(part).select("t", "y").collect()
    return train([r["t"] for r in found], [r["y"] for r in found])


def score(documents: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    documents = documents.drop(name)
    if network is None:
        return documents.withColumn(name, F.lit(0.0))
    narrow_batches(documents.sparkSession)
    weights = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value)
        for batch in batches:
            found = scorer(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, extended(documents.schema, f"`{name}` double"))


def decided(name: str = "score", least: float = 0.3) -> Column:
    return (F.col(name) >= least).cast("int")
