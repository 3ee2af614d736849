"""Fuzzy passages that several documents hold, by collinear chaining.

*Seeds.* Word ``k``-grams that are the least hash of one of the windows of ``w`` neighbours
that they lie in: two texts that agree in k + w - 1 words in a row share a seed. A k-gram that
repeats the one before it (a word said over and over) is no seed.

*Join.* All places of a seed are joined with its place in one of its holders, the one whose text
has the least hash, which is called the source. So a seed of a million holders makes a million
matches, and any two holders of it meet in the source. Where seeds of one passage have different
sources, the longer grams (of 3k words, at the same places) are joined in the same way. A source
may share no more than the seed with a holder. So where the 2k words before a place and the 3k from
it on are not those of the source, all grams of 3k words that hold the place are joined too, by
sources of their own: any two texts that agree in 3k words in a row (24) share at least 3k words
with one source, so they are always in one group.

*Chaining.* The matches of a text with a source are chained in one pass in the order of the
text. With overlaps free and a gap cost of ``beta`` for each word of distance on either side,
the best predecessor of a match is a prefix maximum, which a Fenwick tree over the places in
the source gives in logarithmic time. Chains are read off from the best end on, each match used
once, and are cut at gaps of over ``max_gap`` words, and every ``max_span`` words.

*Alignment.* Runs of matches on one diagonal are compared word by word, what lies between two
runs by edit distance, and both ends are extended word by word until the score has dropped by
``drop`` (+1 for an equal, -2 for a different word). Passages of at least ``min_words`` words
and ``identity`` equal words are kept. A chain that is none is tried again up to the first
different words, then cut at its widest gap, and its parts are tried.

*Result.* A row for each document and passage: words start_word to end_word of doc_id repeat
words source_start to source_end of source_id. Documents whose places in one source overlap
hold the same passage; the source's own places have rows too (doc_id = source_id). Texts that
are equal are one text to all steps; each document of it has its rows, and rows for the whole
text under the least id of its documents if it has ``min_words`` words.

*Size.* Rows grow with the places of seeds and never with the square of the holders. Hub texts
are cut into tiles of ``tile`` words, and tiles with many chains are copied to ``block`` chains
at a time, so no task holds all that a hot passage is matched with.

Defined results: null doc_id, null text, or fewer than k words: no row, unless equal texts
reach ``min_words``. Rows that repeat doc_id and text count once; rows with one doc_id and
different texts are different texts, but an id has no row that names itself as the source of
another of its texts. Repeats inside one document are not reported. Texts are taken whole,
whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import distilled, materialise, narrow
from .text import gram_hashes, mix, signed, token_chunks

PASSAGES = "doc_id bigint, start_word int, end_word int, source_id bigint, source_start int, source_end int, identity double"
_NEVER = np.uint64((1 << 64) - 1)


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of x[i : i + w] for each i that has so many, by doubling."""
    f, done, out = (np.minimum if least else np.maximum), 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


def select_seeds(h: np.ndarray, off: np.ndarray, w: int) -> np.ndarray:
    """Indexes of the seeds among the k-grams of texts; text i has h[off[i] : off[i + 1]]. A text
    of fewer than w is one window."""
    if not len(h):
        return np.empty(0, np.int64)
    n = len(h)
    repeats = np.zeros(n, bool)
    repeats[1:] = h[1:] == h[:-1]
    repeats[off[:-1][np.diff(off) > 0]] = False
    h = np.where(repeats, _NEVER, h)
    padded = np.concatenate([h, np.full(w - 1, _NEVER)])
    low = _sliding(padded, w, True)
    place = np.arange(n)
    size = np.diff(off)
    left = np.repeat(off[1:], size) - place
    full = left >= w
    low = np.where(full, low, np.uint64(0))
    short = np.flatnonzero((size > 0) & (size < w))
    least_of_short = np.minimum.reduceat(h, off[:-1][size > 0])[np.searchsorted(np.flatnonzero(size > 0), short)] if len(short) else np.empty(0, np.uint64)
    high = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low]), w, False)
    chosen = (high == h) & (h != _NEVER) & np.repeat(size >= w, size)
    bound = np.zeros(len(size), np.uint64)
    bound[short] = least_of_short
    chosen |= (np.repeat(bound, size) == h) & np.repeat((size > 0) & (size < w), size)
    return np.flatnonzero(chosen)


def chain(pa_: np.ndarray, pb: np.ndarray, k: int, beta: float, max_gap: int) -> list[np.ndarray]:
    """Indexes of the matches of each chain. Matches are ordered by (pb, pa)."""
    n = len(pa_)
    if n == 1:
        return [np.zeros(1, np.int64)]
    d = np.diff(pa_)
    if (d > 0).all() and (d == np.diff(pb)).all() and int(d.max()) <= max_gap and 2 * beta * int(d.max()) <= k:
        return [np.arange(n)]  # one diagonal, each link worth its cost: nothing to choose
    values, rank = np.unique(pa_, return_inverse=True)
    m = len(values)
    best, who = [-1e18] * (m + 1), [-1] * (m + 1)
    a, b, r = pa_.tolist(), pb.tolist(), (rank + 1).tolist()
    f, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and b[j] == b[i]:
            x, top, at = r[j] - 1, -1e18, -1
            while x:
                if best[x] > top:
                    top, at = best[x], who[x]
                x &= x - 1
            gain = top - beta * (a[j] + b[j])
            f[j] = k + (gain if gain > 0 else 0.0)
            back[j] = at if gain > 0 else -1
            j += 1
        for y in range(i, j):
            v, x = f[y] + beta * (a[y] + b[y]), r[y]
            while x <= m:
                if v > best[x]:
                    best[x], who[x] = v, y
                x += x & -x
        i = j
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-f[i], i)):
        now: list[int] = []
        while i >= 0 and not used[i]:
            if now and (a[now[-1]] - a[i] > max_gap or b[now[-1]] - b[i] > max_gap):
                chains.append(np.array(now[::-1]))
                now = []
            used[i] = True
            now.append(i)
            i = back[i]
        if now:
            chains.append(np.array(now[::-1]))
    return chains


def edit_distance(x: np.ndarray, y: np.ndarray) -> int:
    row = list(range(len(y) + 1))
    ys = y.tolist()
    for i, c in enumerate(x.tolist(), 1):
        before, row[0] = row[0], i
        for j, e in enumerate(ys, 1):
            before, row[j] = row[j], min(before + (c != e), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _extend(x: np.ndarray, y: np.ndarray, drop: int) -> tuple[int, int]:
    """(words, equal words) of the best common beginning."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    over = np.flatnonzero(top - score >= drop)
    end = int(over[0]) if len(over) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    n = int(np.argmax(score[:end])) + 1
    return n, int(same[:n].sum())


def align(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, k: int, drop: int) -> tuple[int, int, int, int, float]:
    """(start, end in x; start, end in y; share of equal words) of a chain with matches at ax, ay."""
    cuts = np.flatnonzero(np.diff(ax - ay)) + 1
    equal = columns = 0
    x1 = y1 = -1
    for lo, hi in zip([0, *cuts], [*cuts, len(ax)]):
        x0, y0 = int(ax[lo]), int(ay[lo])
        if x1 >= 0:
            over = max(x1 - x0, y1 - y0, 0)  # the k-grams of two diagonals can overlap
            x0, y0 = x0 + over, y0 + over
            gap_x, gap_y = x[x1:x0], y[y1:y0]
            wide = max(len(gap_x), len(gap_y))
            equal += wide - edit_distance(gap_x, gap_y)
            columns += wide
        x2 = max(int(ax[hi - 1]) + k, x0)
        y2 = y0 + x2 - x0
        equal += int((x[x0:x2] == y[y0:y2]).sum())
        columns += x2 - x0
        x1, y1 = x2, y2
    after, same_after = _extend(x[x1:], y[y1:], drop)
    s, e = int(ax[0]), int(ay[0])
    ahead, same_ahead = _extend(x[:s][::-1], y[:e][::-1], drop)
    return s - ahead, x1 + after, e - ahead, y1 + after, (equal + same_after + same_ahead) / (columns + after + ahead)


def passages(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, k: int, drop: int, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """The alignment of a chain if it is a passage; else those of its parts that are."""
    todo, out = [(0, len(ax))], []
    while todo:
        lo, hi = todo.pop()
        for d in (drop, 2):
            found = align(x, y, ax[lo:hi], ay[lo:hi], k, d)
            if min(found[1] - found[0], found[3] - found[2]) >= min_words and found[4] >= identity:
                out.append(found)
                break
        else:
            gap = np.maximum(np.diff(ax[lo:hi]), np.diff(ay[lo:hi])) + k * (np.diff(ax[lo:hi] - ay[lo:hi]) != 0)
            if len(gap):
                cut = lo + 1 + int(np.argmax(gap))
                todo += [(cut, hi), (lo, cut)]
    return out


def _runs(batches, names: list[str], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, columns) of each run of equal keys, of sorted batches of int columns."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        for lo, hi in zip(cut, [*cut[1:], batch.num_rows]):
            now = tuple(int(c[lo]) for c in cols[:n_keys])
            if now != key and held:
                yield key, [np.concatenate(x) for x in zip(*held)]
                held = []
            key = now
            held.append([c[lo:hi] for c in cols[n_keys:]])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def _long_grams(h: np.ndarray, off: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of 3k words that begin at ``at``, and whether the texts ``doc`` reach so far."""
    a1, a2 = np.minimum(at + k, len(h) - 1), np.minimum(at + 2 * k, len(h) - 1)
    return mix(mix(h[at] * _ODD + h[a1]) * _ODD + h[a2]), at + 2 * k < off[doc + 1]


def _grams_around(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(u, p, long): every gram of 3k words that holds one of the places (u, p), each once."""
    wanted = places.groupBy("u").agg(F.collect_set("p").alias("at"))  # no longer than the text is
    texts = docs.groupBy(F.col("th").alias("u")).agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            u, places = batch.column("u").to_numpy(zero_copy_only=False), batch.column("at").to_pylist()
            for lo, hi, t in token_chunks(batch.column("text")):
                h, off = gram_hashes(t, k)
                near = np.zeros(len(h) + 1, np.int64)
                for i in range(hi - lo):
                    at = np.array(places[lo + i])
                    np.add.at(near, off[i] + np.maximum(at - 2 * k, 0), 1)
                    np.add.at(near, off[i] + at + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                doc = np.searchsorted(off, at, "right") - 1
                long, whole = _long_grams(h, off, at, doc, k)
                yield pa.RecordBatch.from_arrays([pa.array(u[lo + doc[whole]]), pa.array((at - off[doc])[whole].astype(np.int32)), pa.array(signed(long[whole]))], names=["u", "p", "long"])

    return texts.join(wanted, "u").mapInArrow(run, "u bigint, p int, long bigint")


def _seeds(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(seed, u, p, long, around): the places of seeds in text u, the gram of 3k words that begins
    there, and the words from 2k before it to the end of that gram. Of equal texts in a task one is read."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            u = batch.column("th").to_numpy(zero_copy_only=False)
            new = np.zeros(len(u), bool)
            for i, x in enumerate(u.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            u, texts = u[new], batch.column("text").filter(pa.array(new))
            for lo, _, t in token_chunks(texts):
                h, off = gram_hashes(t, k)
                at = select_seeds(h, off, w)
                doc = np.searchsorted(off, at, "right") - 1
                enough = (np.diff(t.off) >= k)[doc]
                at, doc = at[enough], doc[enough]
                long, whole = _long_grams(h, off, at, doc, k)
                before, inside = _long_grams(h, off, np.maximum(at - 2 * k, 0), doc, k)
                inside &= whole & (at - 2 * k >= off[doc])
                around = mix(before * _ODD + long)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(u[lo + doc]), pa.array((at - off[doc]).astype(np.int32)), pa.array(signed(long), mask=~whole), pa.array(signed(around), mask=~inside)], names=["seed", "u", "p", "long", "around"])

    return docs.select("th", "text").mapInArrow(run, "seed bigint, u bigint, p int, long bigint, around bigint")


def _matches(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(b, a, pb, pa): each place of a seed or longer gram, with that in its source. The tables of
    sources are written, so that AQE sees plain shuffles on both sides and can split a hot gram."""
    held = found.groupBy("seed").agg(F.min(F.struct("u", "p", "around")).alias("s"), F.max("u").alias("z"), F.count("*").alias("places"))
    held = materialise(held.filter("s.u < z").selectExpr("seed", "s.u AS a", "s.p AS pa", "s.around AS there", "places"), "seed-sources")
    alone = F.expr("places > 2 AND NOT (u = a AND p = pa) AND (around IS NULL OR there IS NULL OR around <> there)")
    placed = materialise(found.join(held, "seed").select("u", "p", "long", "a", "pa", alone.alias("alone")), "seed-places")
    longs = placed.filter("long IS NOT NULL").select("u", "p", "long")
    longs = materialise(longs.unionAll(_grams_around(docs, placed.filter("alone").select("u", "p"), k)), "long-grams")
    sources = longs.groupBy("long").agg(F.min(F.struct("u", "p")).alias("s"), F.max("u").alias("z")).filter("s.u < z")
    sources = materialise(sources.selectExpr("long", "s.u AS a", "s.p AS pa"), "gram-sources")
    far = longs.join(sources, "long").withColumn("d", F.explode(F.array(F.lit(0), F.lit(2 * k))))
    short = placed.filter("u <> a").selectExpr("u AS b", "a", "p AS pb", "pa")
    return short.unionAll(far.filter("u <> a").selectExpr("u AS b", "a", "p + d AS pb", "pa + d AS pa"))


def _chains(matches: DataFrame, k: int, beta: float, max_gap: int, max_span: int) -> DataFrame:
    def run(batches):
        out: list[tuple] = []
        for (b, a), (pb, pa_) in _runs(batches, ["b", "a", "pb", "pa"], 2):
            new = np.ones(len(pb), bool)
            new[1:] = (np.diff(pb) != 0) | (np.diff(pa_) != 0)
            pb, pa_ = pb[new], pa_[new]
            for whole in chain(pa_, pb, k, beta, max_gap):
                for i in np.split(whole, np.flatnonzero(np.diff((pb[whole] - pb[whole[0]]) // max_span)) + 1):
                    out.append((b, a, int(pb[i[0]]), int(pb[i[-1]]) + k, int(pa_[i[0]]), int(pa_[i[-1]]) + k, np.stack([pa_[i], pb[i]]).astype("<i4").tobytes()))
            if len(out) >= 4096:
                yield _batch(out, _CHAIN)
                out = []
        yield _batch(out, _CHAIN)

    return matches.repartition("b", "a").sortWithinPartitions("b", "a", "pb", "pa").mapInArrow(run, _CHAIN)


def _words(docs: DataFrame, chained: DataFrame, pad: int, tile: int, block: int) -> DataFrame:
    """The words that each chain is compared on: a row with side 0 for each tile of a source and
    salt, and one with side 1 for each chain, under the (a, tile, salt) of the tile that it needs."""
    chained = chained.withColumn("tile", F.expr(f"a0 div {tile}").cast("int"))
    tiles = chained.groupBy("a", "tile").agg(F.min("a0").alias("lo"), F.max("a1").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("salts"))
    tiles = materialise(tiles, "source-tiles")
    salted = chained.join(tiles.select("a", "tile", "salts"), ["a", "tile"]).withColumn("salt", F.expr("CAST(pmod(xxhash64(b, b0), salts) AS INT)"))
    own = salted.selectExpr("b AS u", "struct(a, tile, salt, b0, b1, anchors) AS r", "CAST(NULL AS STRUCT<tile: INT, lo: INT, hi: INT, salts: INT>) AS s")
    hub = tiles.selectExpr("a AS u", f"CAST(NULL AS {own.schema['r'].dataType.simpleString()}) AS r", "struct(tile, lo, hi, salts) AS s")
    wanted = own.unionAll(hub).groupBy("u").agg(F.collect_list("r").alias("r"), F.collect_list("s").alias("s"))  # no longer than the text is
    texts = docs.groupBy(F.col("th").alias("u")).agg(F.first("text").alias("text"))

    def cut(batches):
        for batch in batches:
            us, regions, sources = batch.column("u").to_pylist(), batch.column("r"), batch.column("s")
            for lo, hi, t in token_chunks(batch.column("text")):
                out = []
                for i in range(hi - lo):
                    u, words = us[lo + i], (t.hash[t.off[i] : t.off[i + 1]] >> np.uint64(32)).astype("<u4")
                    for x in sources[lo + i].as_py():
                        s = max(0, x["lo"] - pad)
                        part = words[s : x["hi"] + pad].tobytes()
                        out += [(u, x["tile"], salt, 0, None, s, part, None) for salt in range(x["salts"])]
                    for x in regions[lo + i].as_py():
                        s = max(0, x["b0"] - pad)
                        out.append((x["a"], x["tile"], x["salt"], 1, u, s, words[s : x["b1"] + pad].tobytes(), x["anchors"]))
                    if len(out) >= 1024:
                        yield _batch(out, _PART)
                        out = []
                yield _batch(out, _PART)

    return texts.join(wanted, "u").mapInArrow(cut, _PART)


def _aligned(parts: DataFrame, k: int, drop: int, min_words: int, identity: float) -> DataFrame:
    """(b, b0, b1, a, a0, a1, identity) of each chain that is a passage."""

    def run(batches):
        source: tuple = ()
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] == 0:
                    source = (row[:3], row[5], np.frombuffer(row[6], "<u4"))
                    continue
                if not source or source[0] != row[:3]:
                    raise ValueError(f"no words of source {row[:3]}")
                at_a, at_b = np.frombuffer(row[7], "<i4").reshape(2, -1)
                sa, sb = source[1], row[5]
                words = np.frombuffer(row[6], "<u4")
                for a0, a1, b0, b1, share in passages(source[2], words, at_a - sa, at_b - sb, k, drop, min_words, identity):
                    out.append((row[4], b0 + sb, b1 + sb, row[0], a0 + sa, a1 + sa, round(share, 6)))
            yield _batch(out, _ALIGNED)

    return parts.repartition("a", "tile", "salt").sortWithinPartitions("a", "tile", "salt", "side").mapInArrow(run, _ALIGNED)


def _merged(aligned: DataFrame) -> DataFrame:
    """(a, lo, hi): the words of each source that any passage covers, as intervals."""

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for a, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("a", "a0", "a1"))):
                if now and now[0] == a and lo < now[2]:
                    now = (a, now[1], max(hi, now[2]))
                else:
                    out += [now] if now else []
                    now = (a, lo, hi)
            yield _batch(out, "a bigint, lo int, hi int")
        yield _batch([now] if now else [], "a bigint, lo int, hi int")

    return aligned.select("a", "a0", "a1").distinct().repartition("a").sortWithinPartitions("a", "a0", "a1").mapInArrow(run, "a bigint, lo int, hi int")


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n): each document of each text, and the text's words."""

    def run(batches):
        for batch in batches:
            for lo, hi, t in token_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array(np.diff(t.off).astype(np.int32))], names=["doc_id", "th", "n"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, n int").distinct()


def fuzzy_passages(
    documents: DataFrame,
    k: int = 8,
    w: int = 12,
    beta: float = 0.2,
    max_gap: int = 32,
    drop: int = 8,
    min_words: int = 24,
    identity: float = 0.8,
    max_span: int = 4096,
    tile: int = 1024,
    block: int = 512,
) -> DataFrame:
    """(doc_id, start_word, end_word, source_id, source_start, source_end, identity): a row for
    each document and passage that it shares with another document."""
    docs = narrow(documents).dropna().withColumn("th", F.xxhash64("text"))
    members = materialise(_members(docs), "documents-of-texts")
    reps = materialise(members.groupBy("th").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("copies"), F.max("n").alias("n")), "texts")
    spark = documents.sparkSession

    def chained():
        return _chains(_matches(docs, materialise(_seeds(docs, k, w), "seeds"), k), k, beta, max_gap, max_span)

    def found():
        return _aligned(_words(docs, distilled(spark, "chains", chained), k + w, tile, block), k, drop, min_words, identity)

    aligned = distilled(spark, "passages", found)
    rows = aligned.selectExpr("b AS u", "b0", "b1", "a", "a0", "a1", "identity")
    rows = rows.unionAll(_merged(aligned).selectExpr("a AS u", "lo", "hi", "a", "lo", "hi", "1D"))
    rows = rows.unionAll(reps.filter(f"copies > 1 AND n >= {int(min_words)}").selectExpr("th AS u", "0", "n", "th", "0", "n", "1D"))
    rows = rows.join(reps.select(F.col("th").alias("a"), "source_id"), "a").join(members.select(F.col("th").alias("u"), "doc_id"), "u")
    return rows.filter("u = a OR doc_id <> source_id").selectExpr("doc_id", "b0 AS start_word", "b1 AS end_word", "source_id", "a0 AS source_start", "a1 AS source_end", "identity")


_ODD = np.uint64(0x2545F4914F6CDD1D)
_CHAIN = "b bigint, a bigint, b0 int, b1 int, a0 int, a1 int, anchors binary"
_PART = "a bigint, tile int, salt int, side int, b bigint, s int, words binary, anchors binary"
_ALIGNED = "b bigint, b0 int, b1 int, a bigint, a0 int, a1 int, identity double"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[x]) for c, x in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)
