"""Document quality by attention-based multiple-instance learning.

*Encoding.* A document is a bag of passages of ``WIDTH`` words, all of it. A passage is encoded
as the square roots of its word shares in ``BUCKETS`` hash buckets, which have unit length, and
of surface shares: punctuation of several kinds, digits, line breaks, blanks, bytes beyond
ASCII, word length, distinct words, words that repeat their neighbour.

*Model* (Ilse, Tomczak and Welling, 2018). With passage vector x: h = tanh(W x + b); attention
a = softmax over the document of w . (tanh(V h) * sigmoid(U h)); the document is sum(a h), and
its logit is linear in that. Labels are of documents only; which passages matter is learned.

*Fit.* On at most ``max_labelled`` labelled documents of either class, those whose ids hash
lowest, and at most ``max_passages`` passages of either class (the documents that hash lowest, as
far as they fit whole), by Adam over whole bags, on the driver: what it holds is bounded by both.
Scoring needs no shuffle and runs over every row.

Null label: not used. A document with several labels is of the better one. Null text, or text
without a word: no passage, score null, and not rejected. Rows that repeat an id are each
scored. Without a label of either class every score is the share of good labels (0.5 without
any label at all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, narrow, tidy
from .text import Tokens, token_chunks

WIDTH, BUCKETS = 64, 256
SCORES = "doc_id bigint, n_passages int, score double, keep boolean, top_passage int, top_attention double"
_KINDS = [b".,;:", b"!?", b"|", b"#*%$&@~^=<>/\\_+", b"0123456789", b"\n", b" \t"]
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _kind in enumerate(_KINDS):
    _CLASS[list(_kind)] = _i
_CLASS[128:] = len(_KINDS) + 1
_SURFACE = len(_KINDS) + 2
FEATURES = BUCKETS + _SURFACE + 3


def passages(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of all passages, where those of each text begin and end)."""
    count = np.diff(t.off)
    bags = -(-count // WIDTH)
    off = np.concatenate([[0], np.cumsum(bags)])
    n = int(off[-1])
    if not n:
        return np.empty((0, FEATURES), np.float32), off
    local = np.arange(len(t.hash)) - np.repeat(t.off[:-1], count)
    bag = np.repeat(off[:-1], count) + local // WIDTH
    begin = np.flatnonzero(np.diff(bag, prepend=-1))
    size = np.diff(np.append(begin, len(bag)))
    x = np.empty((n, FEATURES), np.float32)
    counts = np.bincount(bag * BUCKETS + (t.hash >> np.uint64(56)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    x[:, :BUCKETS] = np.sqrt(counts / size[:, None])
    first = t.start[begin]
    doc = np.searchsorted(off, np.arange(n), "right") - 1
    last = np.append(first[1:], len(t.buf))
    ends = np.append(np.diff(doc) != 0, True)
    last[ends] = t.base[doc[ends] + 1]
    span = np.repeat(np.arange(n), last - first)
    at = np.arange(len(span)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
    surface = np.bincount(span * _SURFACE + _CLASS[t.buf[at]], minlength=n * _SURFACE).reshape(n, _SURFACE)
    x[:, BUCKETS : BUCKETS + _SURFACE] = np.sqrt(surface / (last - first)[:, None])
    key = np.sort(bag.astype(np.uint64) << np.uint64(40) | t.hash >> np.uint64(24))
    x[:, -3] = np.bincount((key[np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0] >> np.uint64(40)).astype(np.int64), minlength=n) / size
    same = np.zeros(len(bag))
    same[1:] = (t.hash[1:] == t.hash[:-1]) & (bag[1:] == bag[:-1])
    x[:, -2] = np.add.reduceat(same, begin) / size
    x[:, -1] = np.log1p(np.add.reduceat(t.end - t.start, begin) / size) - 1.5
    return x, off


@dataclass
class Model:
    w: dict[str, np.ndarray]
    prior: float


def _start(rng: np.random.Generator, hidden: int, gate: int) -> dict[str, np.ndarray]:
    by = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"W": by(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": by(hidden, gate), "U": by(hidden, gate), "w": by(gate, 1)[:, 0], "c": by(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Bags of x start at ``begin``; none is empty."""
    size = np.diff(np.append(begin, len(x)))
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
    a = e / np.repeat(np.add.reduceat(e, begin), size)
    m = np.add.reduceat(a[:, None] * h, begin)
    return {"size": size, "h": h, "v": v, "u": u, "a": a, "m": m, "z": m @ p["c"] + p["d"]}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    """Of the weighted log loss and of decay / 2 times the squared weights."""
    f = forward(p, x, begin)
    dz = (_sigmoid(f["z"]) - y) * weight / weight.sum()
    dm = np.repeat(dz, f["size"])[:, None] * p["c"]
    da = (dm * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin), f["size"]))
    dvu = de[:, None] * p["w"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    dh = (dm * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    g = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["m"].T @ dz, "d": dz.sum(keepdims=True)}
    return {k: v + decay * p[k] if v.ndim == 2 else v for k, v in g.items()}


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 1) -> Model:
    """Classes have equal weight in all. The same input gives the same model."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model({}, share)
    rng = np.random.default_rng(seed)
    p = _start(rng, hidden, gate)
    mean, var, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            x = np.concatenate([bags[i] for i in chosen])
            begin = np.cumsum([0, *(len(bags[i]) for i in chosen[:-1])])
            g, step = gradients(p, x, begin, y[chosen].astype(np.float32), weight[chosen], decay), step + 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                var[k] = 0.999 * var[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(p, share)


@tidy
def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 2_000, max_passages: int = 100_000) -> Model:
    """A model of ``labels.quality`` from at most ``max_labelled`` documents, and ``max_passages``
    passages, of either class."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") > 0).alias("good")).dropna().groupBy("doc_id").agg(F.max("good").alias("good"))
    chosen = [known.filter(F.col("good") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for x in (True, False)]
    sample = narrow(documents).join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").withColumn("th", F.xxhash64("doc_id", "text"))  # at most 2 * max_labelled short rows
    sample = materialise(sample.dropDuplicates(["th"]), "quality-sample")

    def count(batches):
        for batch in batches:
            for lo, hi, t in token_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("th").slice(lo, hi - lo), batch.column("good").slice(lo, hi - lo), pa.array(-(-np.diff(t.off) // WIDTH))], names=["th", "good", "n"])

    held, taken = {True: 0, False: 0}, set()
    for th, good, n in map(tuple, sample.select("text", "good", "th").mapInArrow(count, "th bigint, good boolean, n bigint").orderBy("th").limit(4 * max_labelled).collect()):  # an id can have many texts
        if held[good] + n <= max_passages:
            held[good] += n
            taken.add(th)

    def encode(batches):
        for batch in batches:
            for lo, hi, t in token_chunks(batch.column("text")):
                x, off = passages(t)
                part = batch.slice(lo, hi - lo)
                vectors = [x[a:b].tobytes() if th in taken else b"" for a, b, th in zip(off, off[1:], part.column("th").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array(vectors, pa.binary())], names=["doc_id", "good", "x"])

    rows = sorted(((r[0], r[2], r[1]) for r in sample.mapInArrow(encode, "doc_id bigint, good boolean, x binary").filter("length(x) > 0").collect()), key=lambda r: r[:2])
    return train([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x, _ in rows], np.array([g for _, _, g in rows], bool))


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row for each document: probability of good quality, whether that is at least
    ``threshold``, and the passage with most attention (the first of equal ones)."""

    def run(batches):
        for batch in batches:
            for lo, hi, t in token_chunks(batch.column("text")):
                x, off = passages(t)
                bags = np.diff(off)
                full = np.flatnonzero(bags)
                z, top, most = np.full(hi - lo, np.nan), np.full(hi - lo, -1), np.full(hi - lo, np.nan)
                if len(full) and model.w:
                    f = forward(model.w, x, off[full])
                    z[full] = _sigmoid(f["z"].astype(float))
                    best = np.maximum.reduceat(f["a"], off[full])
                    hit = np.flatnonzero(f["a"] == np.repeat(best, bags[full]))
                    owner = np.repeat(full, bags[full])[hit]
                    one = np.flatnonzero(np.diff(owner, prepend=-1))
                    top[full], most[full] = hit[one] - off[full], best
                elif len(full):
                    z[full], top[full], most[full] = model.prior, 0, 1 / bags[full]
                none = np.isnan(z)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(bags.astype(np.int32)), pa.array(np.round(z, 6), mask=none), pa.array(none | (z >= threshold)), pa.array(top.astype(np.int32), mask=none), pa.array(np.round(most, 6), mask=none)],
                    names=[c.split()[0] for c in SCORES.split(", ")],
                )

    return narrow(documents).mapInArrow(run, SCORES)
