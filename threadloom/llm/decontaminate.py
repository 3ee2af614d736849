"""Benchmark items inside documents: BM25 retrieval by block-max WAND, then verification.

*Index.* The items are the collection. The impact of a term in an item is its BM25 weight over
the item's own full score, so a passage with all words of an item scores 1 for it and one
threshold suits items of any length. Items of like length are neighbours, and each posting
list keeps the largest impact of every block of ``width`` items.

*Queries.* Every passage of every document: windows of twice the longest item, one item
length apart, so that each place an item can take lies whole in a window. First bounds are
taken for many passages at once. The essential terms of an item are its rarest, so many that
the others weigh less than ``reserve``; a passage bounds a block by the block maxima of the
essential terms that it has, plus the most that an item of the block can get from its other
terms. Only (passage, block) with an essential term in common are held, ``_CELLS`` of them at
a time, so memory follows neither the number of blocks nor the length of the texts. Blocks that
can reach the threshold are searched, item by item, by block-max WAND, which retrieves all items
at or above it. Both steps are exact.

*Verification.* Retrieved items must have ``question`` of their question's 3-grams (of a
question of one or two words: these in a row) and ``answer`` of their answer's distinct words
in the passage; a part without a word asks for nothing. The answer is the last sentence,
or of an item of one sentence the last quarter of its words.

Items beyond ``max_items``, or ``max_words`` words, go to further indexes, which are searched one
after the other with term statistics of all items, so what is broadcast at once, and what a task
holds, is bounded. The driver holds the document frequency of each term of the benchmark.

Null or empty text on either side matches nothing; null item_id or doc_id is carried as it
is; several items of one id, and equal items, are each retrieved. No item: no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import id_as_long, narrow, place_of
from .text import Tokens, gram_hashes, token_chunks, tokens

LEAKS = "doc_id bigint, item_id bigint, start_word int, end_word int, score double, question_overlap double, answer_overlap double"
_EPS = 1e-9
_CELLS = 1 << 20


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if len(tokens([p]).hash)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    k = max(1, len(words) // 4)
    return " ".join(words[:-k]) or text, " ".join(words[-k:])


class BlockMaxIndex:
    """Postings of items under global term statistics."""

    def __init__(self, items: list[tuple[int | None, str]], n_items: int, df: dict[int, int], mean_length: float, width: int = 2, k1: float = 1.2, b: float = 0.75, reserve: float = 0.25):
        counted = []
        for item_id, text in items:
            h = tokens([text]).hash
            if len(h):
                u, c = np.unique(h, return_counts=True)
                counted.append((len(h), item_id, text, u, c))
        counted.sort(key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2]))
        self.width, self.ids = width, [x[1] for x in counted]
        self.longest = max((x[0] for x in counted), default=0)
        self.parts = []
        rows: dict[int, list[tuple[int, float]]] = {}
        others = np.zeros(len(counted))
        essential: dict[int, list[tuple[int, float]]] = {}
        for o, (n, _, text, u, c) in enumerate(counted):
            d = np.array([df[x] for x in u.tolist()], float)
            w = np.log1p((n_items - d + 0.5) / (d + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * n / mean_length))
            w /= w.sum()
            for x, y in zip(u.tolist(), w.tolist()):
                rows.setdefault(x, []).append((o, y))
            by = np.lexsort((u, d))
            left = w.sum() - np.cumsum(w[by])
            n_own = int(np.argmax(left < reserve)) + 1
            others[o] = left[n_own - 1]
            for i in by[:n_own].tolist():
                essential.setdefault(int(u[i]), []).append((o, float(w[i])))
            question, answer = split_item(text)
            q, a = tokens([question]), tokens([answer])
            k = min(3, max(1, len(q.hash)))  # a shorter question is one gram of all its words
            self.parts.append((k, np.unique(gram_hashes(q, k)[0]), np.unique(a.hash)))
        self.terms = np.array(sorted(rows), np.uint64)
        self.n_blocks = -(-len(counted) // width)
        self.rest = np.array([others[k * width : (k + 1) * width].max() for k in range(self.n_blocks)])
        self.post = [np.array([o for o, _ in rows[x]]) for x in self.terms.tolist()]
        self.impact = [np.array([y for _, y in rows[x]]) for x in self.terms.tolist()]
        self.top = np.array([i.max() for i in self.impact])
        self.block, self.block_max = [], []
        for p, i in zip(self.post, self.impact):
            at = np.flatnonzero(np.diff(p // width, prepend=-1))
            self.block.append(p[at] // width)
            self.block_max.append(np.maximum.reduceat(i, at))
        blocks, tops, size = [], [], []
        for x in self.terms.tolist():
            own = essential.get(x, [])
            p, i = np.array([o for o, _ in own], np.int64), np.array([y for _, y in own])
            at = np.flatnonzero(np.diff(p // width, prepend=-1))
            blocks.append(p[at] // width)
            tops.append(np.maximum.reduceat(i, at) if len(at) else i)
            size.append(len(at))
        self.csr = np.concatenate([[0], np.cumsum(np.array(size, np.int64))])
        self.csr_block = np.concatenate(blocks or [np.empty(0, np.int64)])
        self.csr_max = np.concatenate(tops or [np.empty(0)])
        self.essential = np.array(size, np.int64) > 0
        self.essential_bits = np.zeros(1 << 22, bool)
        self.essential_bits[(self.terms[self.essential] >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, essential: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms (essential to an item, if asked for), and which."""
        at = np.flatnonzero(self.essential_bits[(h >> np.uint64(42)).astype(np.int64)]) if essential else np.arange(len(h))
        i = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        good = self.terms[i] == h[at]
        if essential:
            good &= self.essential[i]
        return at[good], i[good]

    def candidates(self, window: np.ndarray, term: np.ndarray, n_windows: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(window, blocks) of each window that a block can reach the threshold in; ``window``,
        which ascends, has the essential term ``term``, each pair once."""
        always = np.flatnonzero(self.rest >= threshold - _EPS)  # of items without an essential term in the window, too
        n = self.csr[term + 1] - self.csr[term]
        ends = np.append(np.flatnonzero(np.diff(window)) + 1, len(window)) if len(window) else np.empty(0, np.int64)
        filled = np.cumsum(n)[ends - 1] if len(ends) else ends
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + _CELLS, "right")))
            part = slice(int(ends[lo - 1]) if lo else 0, int(ends[hi - 1]))
            m = n[part]
            flat = np.repeat(self.csr[term[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            key, cell = np.unique(np.repeat(window[part], m) * self.n_blocks + self.csr_block[flat], return_inverse=True)
            good = key[np.bincount(cell, self.csr_max[flat], minlength=len(key)) + self.rest[key % self.n_blocks] >= threshold - _EPS]
            if not len(always):
                w = good // self.n_blocks
                cut = np.flatnonzero(np.diff(w, prepend=-1))
                for a, z in zip(cut, [*cut[1:], len(w)]):
                    yield int(w[a]), good[a:z] % self.n_blocks
            else:
                found: dict[int, list[int]] = {}
                for w, b in zip((good // self.n_blocks).tolist(), (good % self.n_blocks).tolist()):
                    found.setdefault(w, []).append(b)
                first = int(window[part.start - 1]) + 1 if part.start else 0
                for w in range(first, int(window[part.stop - 1]) + 1):
                    yield w, np.union1d(always, found.get(w, []))
            lo = hi
        if len(always):
            for w in range(int(window[-1]) + 1 if len(window) else 0, n_windows):
                yield w, always

    def search(self, terms: list[int], threshold: float, blocks: set[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: all items that score at least ``threshold`` (in ``blocks``, if given)."""
        lists = [[0, t] for t in terms]
        found = []
        wanted = sorted(blocks) if blocks is not None else range(self.n_blocks)
        for k in wanted:
            lo, hi = k * self.width, (k + 1) * self.width
            live = []
            for cursor in lists:
                p = self.post[cursor[1]]
                cursor[0] += int(np.searchsorted(p[cursor[0] :], lo))
                if cursor[0] < len(p) and p[cursor[0]] < hi:
                    b = int(np.searchsorted(self.block[cursor[1]], k))
                    live.append([int(p[cursor[0]]), cursor[0], cursor[1], float(self.block_max[cursor[1]][b])])
            if sum(c[3] for c in live) < threshold - _EPS:
                continue
            while live:
                live.sort(key=lambda c: c[0])
                bound, pivot = 0.0, -1
                for c in live:
                    bound += c[3]
                    if bound >= threshold - _EPS:
                        pivot = c[0]
                        break
                if pivot < 0:
                    break
                hit = live[0][0] == pivot
                if hit:
                    score = 0.0
                    for c in live:
                        if c[0] == pivot:
                            score += float(self.impact[c[2]][c[1]])
                    if score >= threshold - _EPS:
                        found.append((pivot, score))
                for c in live:
                    if c[0] <= pivot:
                        p = self.post[c[2]]
                        c[1] += int(np.searchsorted(p[c[1] :], pivot + hit))
                        c[0] = int(p[c[1]]) if c[1] < len(p) else hi
                live = [c for c in live if c[0] < hi]
        return found


def _share(wanted: np.ndarray, there: np.ndarray) -> float:
    """The part of ``wanted`` that is there; 1 if nothing is wanted."""
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


def leaks_in(index: BlockMaxIndex, t: Tokens, threshold: float, question: float, answer: float) -> Iterator[tuple[int, int, int, int, float, float, float]]:
    """(text, item, first word, word after the last, score, overlaps) of each item found in
    each text, at its best passage, the earliest of equals."""
    if not len(index.terms) or not len(t.hash):
        return
    place, term = index.hits(t.hash, essential=True)
    doc = np.searchsorted(t.off, place, "right") - 1
    stride = max(32, index.longest)
    length = np.diff(t.off)
    windows = np.maximum(1, -(-(length - stride) // stride))
    first = np.concatenate([[0], np.cumsum(windows)])
    w = (place - t.off[doc]) // stride
    in_two = [np.minimum(w, windows[doc] - 1), np.clip(w - 1, 0, windows[doc] - 1)]
    n_terms = len(index.terms)
    pair = np.unique(np.concatenate([(first[doc] + x) * n_terms + term for x in in_two]))
    window, term = pair // n_terms, pair % n_terms
    best: dict[tuple[int, int], tuple] = {}
    for x, blocks in index.candidates(window, term, int(first[-1]), threshold):
        i = int(np.searchsorted(first, x, "right")) - 1
        s = (x - int(first[i])) * stride
        e = min(int(length[i]), s + 2 * stride)
        h = t.hash[t.off[i] + s : t.off[i] + e]
        for o, score in index.search(index.hits(np.unique(h))[1].tolist(), threshold, set(blocks.tolist())):
            k, grams, words = index.parts[o]
            own = gram_hashes(Tokens(h, np.array([0, len(h)]), h, h, h, h), k)[0]
            q, r = _share(grams, own), _share(words, h)
            if q >= question and r >= answer and ((i, o) not in best or score > best[i, o][4] + _EPS):
                best[i, o] = (i, o, s, e, score, q, r)
    yield from (best[k] for k in sorted(best))


def build_indexes(benchmark: DataFrame, max_items: int = 50_000, max_words: int = 2_000_000, width: int = 2) -> Iterator[BlockMaxIndex]:
    """The items, at most ``max_items`` to an index, nor more than ``max_words`` words unless in one item. They pass through the driver one by one,
    twice: once for the term statistics of all, once for the postings."""
    items = benchmark.select(id_as_long(benchmark, "item_id").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text")
    df: dict[int, int] = {}
    n, total = 0, 0
    for row in items.toLocalIterator():
        h = tokens([row[1]]).hash
        if len(h):
            n, total = n + 1, total + len(h)
            for x in np.unique(h).tolist():
                df[x] = df.get(x, 0) + 1
    if not n:
        return
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in items.toLocalIterator():
        more = len(tokens([row[1]]).hash)
        if held and (len(held) == max_items or size + more > max_words):
            yield BlockMaxIndex(held, n, df, total / n, width)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += more
    if held:
        yield BlockMaxIndex(held, n, df, total / n, width)


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, max_items: int = 50_000) -> DataFrame:
    """One row for each benchmark item in each document that holds it."""
    docs = narrow(documents)
    spark = documents.sparkSession
    result = None
    for index in build_indexes(benchmark, max_items):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for lo, _, t in token_chunks(batch.column("text")):
                    rows += [(ids[lo + i], index.ids[o], s, e, round(score, 6), q, a) for i, o, s, e, score, q, a in leaks_in(index, t, threshold, question, answer)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=[x.split()[0] for x in LEAKS.split(", ")])

        found = docs.mapInArrow(search, LEAKS)
        result = found if result is None else result.unionAll(found)
    return result if result is not None else spark.createDataFrame([], LEAKS)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, max_items: int = 50_000) -> DataFrame:
    """The rows of ``documents``, all columns as they were, that hold no benchmark item."""
    column = place_of(documents, "text")
    kept = documents
    for index in build_indexes(benchmark, max_items):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for lo, _, t in token_chunks(batch.column(column).cast(pa.large_string())):
                    for found in leaks_in(shared.value, t, threshold, question, answer):
                        ok[lo + found[0]] = False
                yield batch.filter(pa.array(ok))

        kept = kept.mapInArrow(keep, documents.schema)
    return kept
