"""Toxic passages by maximum-scoring segments.

1. *Lexicon.* Labelled documents give, for each word, the number of toxic and of clean
   document groups that use it (a group: near copies of one document, which so counts once). Its log-odds carry an informative Dirichlet prior whose
   mean is the word's document frequency over the **whole corpus**. Candidates are the words
   that ``min_groups`` toxic groups use, and toxic groups at least ``ratio`` times as often as
   clean ones; no word below either reaches the next two bounds on the data that this was
   measured on (see the README). Words with a z-score of
   ``z_min`` and ``strength`` times the log-odds that a word of toxic texts alone would have
   enter the lexicon with their log-odds as score; any other word scores
   ``log(1 - density)``, the log-likelihood ratio of a neutral word in a passage of which
   ``density`` is toxic.
2. *Scan.* The Ruzzo-Tompa scan finds every maximal-scoring segment in linear time. Only
   lexicon words can start or end one, so the neutral stretches between them enter as sums.
3. *Calibration.* Chance segments of a clean text of n words reach score S at a Poisson rate
   ``K n exp(-lambda S)`` (Karlin and Altschul): lambda is the root of sum p exp(lambda s) = 1
   over the corpus's frequencies, K matches the segments counted in clean labelled documents
   (plus one). The r best segments of a document are judged together, by the Poisson tail of
   seeing r of at least the r-th score. The document's p-value is the smallest of these, each
   times r (r + 1): the shares 1 / (r (r + 1)) sum to one however many segments there are, so
   the length counts once, in the rate.
4. *Verdict.* A document is toxic if its p-value is small or if one passage alone is
   significant, so that what surrounds a passage cannot hide it.

Null text or no word: no passage. Null label: not used to fit. Rows with equal doc_id each
stand for themselves. Without a toxic or a clean label there is no lexicon and no passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, narrow, place_of, tidy
from .text import Tokens, gram_hashes, mix, signed, token_chunks

PASSAGES = (
    "doc_id bigint, passage int, start_word int, end_word int, score double, e_value double, "
    "n_words int, n_passages int, p_value double"
)


@dataclass(frozen=True)
class ToxicityModel:
    hashes: np.ndarray
    scores: np.ndarray
    neutral: float
    lam: float
    k: float


def sets_from(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted vocabulary and a bitmap over 22 hash bits that most other words miss."""
    vocabulary = np.sort(hashes)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(vocabulary >> np.uint64(42)).astype(np.int64)] = True
    return vocabulary, bitmap


def find(h: np.ndarray, vocabulary: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are in the vocabulary, and their indexes in it."""
    at = np.flatnonzero(bitmap[(h >> np.uint64(42)).astype(np.int64)])
    i = np.searchsorted(vocabulary, h[at])
    hit = (i < len(vocabulary)) & (vocabulary[np.minimum(i, len(vocabulary) - 1)] == h[at]) if len(vocabulary) else np.zeros(len(at), bool)
    return at[hit], i[hit]


def maximal_segments(at: list[int], score: list[float], neutral: float) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's maximal scoring segments of a text in which the words at the ascending
    places ``at`` score ``score`` (each above 0) and all others ``neutral`` (below 0):
    (first word, word after the last, score), in order."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total, last = 0.0, 0
    for p, s in zip(at, score):
        total += (p - last) * neutral
        start, before = p, total
        total += s
        last = p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((start, p + 1, before, total))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - le) for a, b, le, r in stack]


def _poisson_tail(r: int, mean: float) -> float:
    """P(N >= r)."""
    if mean <= 0:
        return 0.0
    if mean > 50 + 10 * r:
        return 1.0
    term = math.exp(-mean + r * math.log(mean) - math.lgamma(r + 1))
    if not term and mean > r:
        return 1.0  # r lies so far below the mean that its own share underflows
    total, k = 0.0, r
    while term > total * 1e-15:
        total += term
        k += 1
        term *= mean / k
    return min(1.0, total)


def document_p_value(scores: list[float], n_words: int, model: ToxicityModel) -> float:
    rate = [model.k * n_words * math.exp(-model.lam * s) for s in sorted(scores, reverse=True)]
    return min(1.0, min(r * (r + 1) * _poisson_tail(r, e) for r, e in enumerate(rate, 1)))


def _segments(t: Tokens, model: ToxicityModel) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(text, its words, its segments) of the texts that have a lexicon word."""
    vocabulary, bitmap = sets_from(model.hashes)
    place, word = find(t.hash, vocabulary, bitmap)
    doc = np.searchsorted(t.off, place, "right") - 1
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        i = int(doc[a])
        yield i, int(t.off[i + 1] - t.off[i]), maximal_segments((place[a:b] - t.off[i]).tolist(), model.scores[word[a:b]].tolist(), model.neutral)


def _lambda(p: np.ndarray, s: np.ndarray, neutral: float) -> float:
    """The positive root of sum p exp(x s) + (1 - sum p) exp(x neutral) = 1, 0 if the mean
    score is not negative."""
    rest = 1 - p.sum()
    if (p * s).sum() + rest * neutral >= 0:
        return 0.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(x * neutral) - 1)
    hi = 1.0
    while f(hi) < 0:
        hi *= 2
    lo = 0.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _copy_groups(sample: DataFrame, bands: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, group of each): documents that agree in one of the bands of two min-hashes over
    their 3-grams, linked on, are one group. The sample is bounded, so this is the driver's."""

    def keys(batches):
        for batch in batches:
            for lo, hi, t in token_chunks(batch.column("text")):
                grams, off = gram_hashes(t, 3)
                full = np.flatnonzero(np.diff(off))
                if not len(full):
                    continue
                least = [np.minimum.reduceat(mix(grams + np.uint64(0xA24BAED4963EE407 * (k + 1) % (1 << 64))), off[full]) for k in range(2 * bands)]
                for b in range(bands):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(full)), pa.array(signed(mix(least[2 * b] * np.uint64(2 * b + 1) + least[2 * b + 1])))], names=["doc_id", "key"])

    keyed = sample.select("doc_id", "text").mapInArrow(keys, "doc_id bigint, key bigint").groupBy("key").agg(F.collect_set("doc_id").alias("ids")).filter(F.size("ids") > 1)
    ids = np.sort(np.array([r[0] for r in sample.select("doc_id").distinct().collect()], np.int64))
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for row in keyed.select("ids").collect():
        first, *rest = np.searchsorted(ids, row[0]).tolist()
        for x in rest:
            a, b = root(first), root(x)
            parent[max(a, b)] = min(a, b)
    return ids, np.array([root(x) for x in range(len(ids))], np.int64)


@tidy
def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    min_groups: int = 3,
    ratio: float = 2.0,
    z_min: float = 3.0,
    strength: float = 0.65,
    density: float = 0.1,
) -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled documents of either class, those whose ids hash
    lowest; the prior counts every document of the corpus."""
    docs = narrow(documents)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("toxic") == x).orderBy(order, "doc_id").limit(max_labelled) for x in (True, False)]
    sample = materialise(docs.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id"), "toxicity-sample")  # at most 2 * max_labelled short rows

    ids, groups = _copy_groups(sample)

    def words_used(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            group = groups[np.searchsorted(ids, batch.column("doc_id").to_numpy(zero_copy_only=False))]
            for lo, hi, t in token_chunks(batch.column("text")):
                doc = t.doc()
                pair = np.unique(np.stack([doc.astype(np.uint64), t.hash]), axis=1) if len(doc) else np.empty((2, 0), np.uint64)
                d = pair[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(pair[1])), pa.array(group[lo:hi][d]), pa.array(toxic[lo:hi][d].astype(bool))], names=["word", "grp", "toxic"])

    used = sample.mapInArrow(words_used, "word bigint, grp bigint, toxic boolean")
    counts = used.groupBy("word").agg(F.count_distinct(F.when(F.col("toxic"), F.col("grp"))).alias("t"), F.count_distinct(F.when(~F.col("toxic"), F.col("grp"))).alias("c"))
    counts = materialise(counts, "toxicity-counts")
    totals = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n_t, n_c = float(totals["t"] or 0), float(totals["c"] or 0)
    empty = ToxicityModel(np.empty(0, np.uint64), np.empty(0), math.log1p(-density), 1.0, 1.0)
    if not n_t or not n_c:
        return empty
    seen = counts.filter((F.col("t") >= min_groups) & (F.col("t") * n_c > ratio * F.col("c") * n_t)).orderBy("word").toPandas()  # bounded by the sample
    if seen.empty:
        return empty
    vocabulary, bitmap = sets_from(seen["word"].to_numpy(np.int64).view(np.uint64))

    def corpus_counts(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, t in token_chunks(batch.column(0)):
                place, word = find(t.hash, vocabulary, bitmap)
                doc = np.searchsorted(t.off, place, "right") - 1
                once = np.unique(doc * len(vocabulary) + word)
                total += np.bincount(once % len(vocabulary), minlength=len(vocabulary))
                n += len(np.unique(t.doc().astype(np.uint64) << np.uint64(44) | t.hash >> np.uint64(20)))  # a chunk has fewer than 2^20 texts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["i", "n"])

    whole = {int(r["i"]): float(r["n"]) for r in docs.select("text").mapInArrow(corpus_counts, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    hashes = seen["word"].to_numpy(np.int64).view(np.uint64)
    index = np.searchsorted(vocabulary, hashes)
    share = np.array([whole.get(int(i), 0.0) for i in index]) / max(whole.get(-1, 1.0), 1.0)
    y_t, y_c, prior = seen["t"].to_numpy(float), seen["c"].to_numpy(float), np.maximum(share * n_t, 1e-9)
    a0 = n_t
    delta = np.log((y_t + prior) / (n_t + a0 - y_t - prior)) - np.log((y_c + prior) / (n_c + a0 - y_c - prior))
    z = delta / np.sqrt(1 / (y_t + prior) + 1 / (y_c + prior))
    toxic_share = n_t / (n_t + n_c)
    most = math.log1p(1 / toxic_share) + math.log((n_c + a0) / (n_t + a0))  # of a word that only toxic texts use
    keep = (z >= z_min) & (delta >= strength * most)
    if not keep.any():
        return empty
    by = np.argsort(hashes[keep])
    lexicon, scores = hashes[keep][by], delta[keep][by]
    neutral = math.log1p(-density)
    p = ((y_c + prior) / (n_c + a0))[keep][by]
    lam = _lambda(p, scores, neutral)
    draft = ToxicityModel(lexicon, scores, neutral, lam or 1e-3, 1.0)
    least = float(scores.min())

    def clean_segments(batches):
        n = above = 0
        for batch in batches:
            for _, _, t in token_chunks(batch.column(0)):
                n += len(t.hash)
                above += sum(s >= least for _, _, found in _segments(t, draft) for _, _, s in found)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([above])], names=["n", "above"])

    r = sample.filter(~F.col("toxic")).select("text").mapInArrow(clean_segments, "n bigint, above bigint").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).first()
    k = ((r["above"] or 0) + 1) / max((r["n"] or 0) * math.exp(-draft.lam * least), 1e-9)
    return ToxicityModel(lexicon, scores, neutral, draft.lam, float(k))


def toxic_passages(documents: DataFrame, model: ToxicityModel, e_max: float = 0.05, p_max: float = 0.01) -> DataFrame:
    """One row for each significant passage: all with an E-value of at most ``e_max``, whatever
    the document's p-value, and of a document with a p-value of at most ``p_max`` and no such
    passage the best one."""

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for lo, _, t in token_chunks(batch.column("text")):
                for i, n, found in _segments(t, model):
                    p = document_p_value([s for _, _, s in found], n, model)
                    rated = [(a, b, s, model.k * n * math.exp(-model.lam * s)) for a, b, s in found]
                    good = [x for x in rated if x[3] <= e_max] or ([max(rated, key=lambda x: x[2])] if p <= p_max else [])
                    rows += [(ids[lo + i], j, a, b, round(s, 6), e, n, len(good), p) for j, (a, b, s, e) in enumerate(good)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            names = [x.split()[0] for x in PASSAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=names)

    return narrow(documents).mapInArrow(scan, PASSAGES)


def drop_toxic(documents: DataFrame, model: ToxicityModel, e_max: float = 0.05, p_max: float = 0.01) -> DataFrame:
    """The rows of ``documents``, all columns as they were, of which ``toxic_passages`` returns
    none. One pass, no join: each batch is scored and filtered where it lies."""
    column = place_of(documents, "text")

    def keep(batches):
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for lo, _, t in token_chunks(batch.column(column).cast(pa.large_string())):
                for i, n, found in _segments(t, model):
                    scores = [s for _, _, s in found]
                    ok[lo + i] = model.k * n * math.exp(-model.lam * max(scores)) > e_max and document_p_value(scores, n, model) > p_max
            yield batch.filter(pa.array(ok))

    return documents.mapInArrow(keep, documents.schema)
