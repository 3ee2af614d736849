"""Order-preserving packing of documents into training windows by dynamic programming.

Documents are taken in the order (doc_id, text) and cut into BPE-token sequences; a window
may begin and end at a document boundary or, at a price, between sentences (and inside one
that no window can hold, so that no text is lost for being long). For a shard of
boundaries S_0 < S_1 < ... (in tokens) the least cost f of a cut at j is

    f(j) = cut(j) + min over i < j of f(i) + padding * (C - (S_j - S_i))      if S_j - S_i <= C
                                      f(i) + truncation * (S_j - S_i - C)     otherwise

with cut(j) = ``split`` inside a document and 0 at its end. In the first line the i allowed
move up with j, so a monotone queue of f(i) + padding * S_i gives the minimum; in the second
they only grow, so a running minimum of f(i) - truncation * S_i does. That makes each
transition constant time on average. Only the tokens that a window cannot hold are lost, and
they are reported. The last window of a shard is padded and never truncated, so the end of a
shard loses no text. Of equal choices the earliest cut is taken.

Shards are runs of ``shard`` documents by their rank in the order, so they depend neither on
the ids' spacing nor on how the table is partitioned; a shard costs at most one window of
padding. Null doc_ids come first. Null and empty texts take no place and are in no window.
Rows that repeat an id are packed one after the other.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import DEFAULT_VOCABULARY, encoder
from .runtime import materialise, narrow

_SENTENCE_END = re.compile(rb"[.!?]+[\"')\]]*(?=\s)|\n+")
WINDOWS = (
    "shard bigint, window int, n_tokens int, n_padding int, n_truncated int, "
    "segments array<struct<doc_id: bigint, first_token: int, end_token: int>>"
)


def sentence_ends(text: str, path: str, capacity: int) -> np.ndarray:
    """The number of tokens up to the end of each sentence of a text, ascending; the last is
    the number of all. A sentence longer than a window also ends after each full window."""
    bpe = encoder(path)
    ids = bpe.ids(text)
    ends = np.cumsum(bpe.token_bytes[ids])
    marks = np.array([m.end() for m in _SENTENCE_END.finditer(text.encode())], np.int64)
    bounds = np.union1d(np.searchsorted(ends, marks, "right"), [len(ids)])
    bounds = bounds[bounds > 0]
    before = np.concatenate([[0], bounds[:-1]])
    long = np.flatnonzero(bounds - before > capacity)
    return np.union1d(bounds, np.concatenate([np.arange(before[i] + capacity, bounds[i], capacity) for i in long])) if len(long) else bounds


def best_cuts(bounds: list[int], inside: list[bool], capacity: int, padding: float, truncation: float, split: float, whole_end: bool = False) -> tuple[list[int], float]:
    """The boundaries to cut at, and the cost. ``bounds`` ascends from 0; ``inside[j]`` says
    that j lies within a document; ``whole_end``: the last window is not truncated if it can be so."""
    n = len(bounds)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque()  # (f(i) + padding * S_i, i), ascending in both
    far, far_i, nxt = float("inf"), -1, 0  # the least f(i) - truncation * S_i of those out of reach
    for j in range(1, n):
        s = bounds[j]
        i = j - 1
        v = f[i] + padding * bounds[i]
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, i))
        while s - bounds[nxt] > capacity:
            u = f[nxt] - truncation * bounds[nxt]
            if u < far:
                far, far_i = u, nxt
            nxt += 1
        while queue and queue[0][1] < nxt:
            queue.popleft()
        best, at = float("inf"), -1
        if queue:
            best, at = queue[0][0] + padding * (capacity - s), queue[0][1]
        if far_i >= 0 and not (whole_end and j == n - 1 and queue):
            c = far + truncation * (s - capacity)
            if c < best or (c == best and far_i < at):
                best, at = c, far_i
        f[j], back[j] = best + (split if inside[j] else 0.0), at
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1], f[-1]


def pack_shard(docs: list[tuple[int | None, np.ndarray]], capacity: int, padding: float, truncation: float, split: float) -> Iterator[tuple[int, int, int, list[tuple[int | None, int, int]]]]:
    """(tokens, padding, tokens lost, segments) of each window of documents given by their
    sentence ends."""
    bounds, inside, begin = [0], [False], []
    for _, ends in docs:
        begin.append(bounds[-1])
        base = bounds[-1]
        bounds += [base + int(x) for x in ends]
        inside += [True] * (len(ends) - 1) + [False]
    cuts, _ = best_cuts(bounds, inside, capacity, padding, truncation, split, True)
    d = 0
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = bounds[a], bounds[b]
        stop = min(hi, lo + capacity)
        while d + 1 < len(docs) and begin[d + 1] <= lo:
            d += 1
        segments, k = [], d
        while k < len(docs) and begin[k] < stop:
            end = begin[k] + int(docs[k][1][-1])
            segments.append((docs[k][0], max(lo, begin[k]) - begin[k], min(stop, end) - begin[k]))
            k += 1
        yield stop - lo, capacity - (stop - lo), hi - stop, segments


def pack(
    documents: DataFrame,
    capacity: int = 2048,
    padding: float = 1.0,
    truncation: float = 4.0,
    split: float = 16.0,
    shard: int = 1024,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """One row for each window: what part of which document it holds, in tokens."""
    docs = narrow(documents).filter(F.length("text") > 0)

    def measure(batches):
        for batch in batches:
            ends = [sentence_ends(x.as_py(), vocabulary, capacity).astype("<i4").tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ends, pa.binary())], names=["doc_id", "th", "ends"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    measured = _ranked(materialise(keyed.mapInArrow(measure, "doc_id bigint, th bigint, ends binary"), "sentence-ends")).withColumn("shard", F.expr(f"rank div {int(shard)}L"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("first_token", pa.int32()), ("end_token", pa.int32())]))

    def fill(batches):
        for key, rows in _by_shard(batches):
            found = list(pack_shard([(r[0], np.frombuffer(r[1], "<i4")) for r in rows], capacity, padding, truncation, split))
            segments = [[{"doc_id": d, "first_token": a, "end_token": b} for d, a, b in x[3]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), *(pa.array([x[k] for x in found], pa.int32()) for k in range(3)), pa.array(segments, kind)],
                names=["shard", "window", "n_tokens", "n_padding", "n_truncated", "segments"],
            )

    return measured.repartition("shard").sortWithinPartitions("shard", "rank").mapInArrow(fill, WINDOWS)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``rank`` from 0 in the order (doc_id, th): ranges of the order are
    counted, and the sums before each are added to the places within it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(rows.repartitionByRange(n, "doc_id", "th").withColumn("part", F.spark_partition_id()), "ranges")
    counts = {r["part"]: r["count"] for r in ranges.groupBy("part").count().collect()}
    before, total = [], 0
    for part in range(n):
        before.append(total)
        total += counts.get(part, 0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "th")) - 1
    return ranges.withColumn("rank", place + F.array(*map(F.lit, before))[F.col("part")].cast("bigint")).drop("part")


def _by_shard(batches) -> Iterator[tuple[int, list[tuple]]]:
    key, rows = None, []
    for batch in batches:
        for k, d, e in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ends").to_pylist()):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append((d, e))
    if rows:
        yield key, rows
