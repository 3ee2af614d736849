"""Documents whose word n-gram sets have a Jaccard similarity of at least t, all of them.

*Classes.* Documents with equal sets are one class, represented by its least (doc_id, text hash).

*Candidates.* N-grams are ordered by the number of classes that hold them, the rarest first. Two
sets of similarity t share at least t of either, so the n-grams that they share begin before the
last ``ceil(t * n) - 1`` of each: in its prefix. A class of which fewer than ``ceil(t * n)``
n-grams have another holder has no partner and goes no further. The others are connected where
their prefixes share an n-gram; similar classes are always in one such component. Counts and
prefixes pass between tasks as packed arrays, by ranges of the n-gram's hash and by class. The
order needs no exact counts: they are rounded, and n-grams are told apart by their range and 32
bits. Two that this merges are one for every class, which adds candidates; a class that holds both
counts one less, so as many as it may have lost are taken from what it must share.

*Units.* A component is joined in one task. One of more than ``block`` classes or ``_GRAMS``
n-grams is cut into blocks, by a frequent n-gram of the prefix first, and every two blocks whose
prefixes share an n-gram are joined in a task of their own, so no task grows with the largest group,
and no candidate is dropped.

*Join.* In small units the sorted sets form a trie (a radix tree over the n-grams that
at least two members have). It is walked once; at each node the overlaps of the path with
all other members are held, so sets with a common prefix share that work, and a subtree is
left as soon as no member can still reach the overlap that ``J >= t`` asks for with what
remains of either side. In large ones the overlaps of all pairs are counted at once, by matrix
products over the frequent n-grams and by posting lists over the others.

*Result.* ``similar_documents`` has a row for each document with a link, its class of linked
documents and its number of links, so copies cost a row each: links are summed inside the
units, with the classes' sizes, and pairs are never written. ``similar_pairs`` expands them.

Null doc_id, null text or no word: in no pair. A text of fewer than n words has one n-gram,
all its words. Rows that repeat doc_id and text count once. Several texts of one doc_id: each is
compared and counted as a document of its own; in ``similar_documents`` the id has the least of
their classes, the sum of their links and the largest similarity; in ``similar_pairs`` an id is
not paired with itself, and a pair reported for several texts has their largest similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import connected_components

from .runtime import distilled, free_name, materialise, narrow
from .text import gram_hashes, mix, signed, token_chunks

_CHECK_EVERY = 64
_ENTRIES = 1 << 21  # n-grams in a range, and n-grams that a task packs at once
_GRAMS = 1 << 22  # n-grams in a block
_SMALL = 64  # members of a unit that is joined by its trie
_FREQUENT = 32  # holders of an n-gram that is counted by matrix product
_WIDTH = 1024  # n-grams in a matrix
_STRIP = 256  # rows of pairs told at once
_EXACT = 1 << 24  # to here single precision counts
_PACKED = "part int, span int, classes binary, grams binary, counts binary"


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, n, merged, f1, f2): the size of each set, how many of it 32 bits may merge, and two
    sums over it that tell it from others."""

    def run(batches):
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th")
            for lo, full, off, flat in _sets(batch.column("text"), n):
                f1 = np.add.reduceat(mix(flat), off[:-1])
                f2 = np.bitwise_xor.reduceat(mix(flat * np.uint64(0xD6E8FEB86659FD93)), off[:-1])
                at = pa.array(full + lo)
                yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), pa.array(np.diff(off).astype(np.int32)), pa.array(_merged(off, flat)), pa.array(signed(f1)), pa.array(signed(f2))], names=["doc_id", "th", "n", "merged", "f1", "f2"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, n int, merged int, f1 bigint, f2 bigint").dropDuplicates(["doc_id", "th"])


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk that begins at text lo: (lo, which of its texts have a word, off, flat). The ascending n-grams of the i-th of these are flat[off[i] : off[i + 1]]."""
    for lo, _, t in token_chunks(texts):
        grams, off = gram_hashes(t, n)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            sets = [np.unique(grams[off[i] : off[i + 1]]) for i in full]
            yield lo, full, np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)


def _merged(off: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """By how much the n-grams of each set outnumber their low 32 bits, and so, at most, what they are told apart by."""
    own = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off)) << np.uint64(32)
    key = np.sort(own | flat & np.uint64(0xFFFFFFFF))
    return np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(off) - 1).astype(np.int32)


def _pack(part: np.ndarray, span: int, classes: np.ndarray, grams: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each part, of the entries that go there."""
    by = np.argsort(part, kind="stable")
    part = part[by]
    cut = np.flatnonzero(np.diff(part, prepend=-2))
    ends = [*cut[1:], len(part)]
    split = lambda x: pa.array([None] * len(cut) if x is None else [y[i:j].tobytes() for y in [x[by]] for i, j in zip(cut, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), span, np.int32)), split(classes), split(grams), split(counts)], names=["part", "span", "classes", "grams", "counts"])


def _parts(packed: DataFrame, number: int, build) -> DataFrame:
    """``packed`` by part, each in a task of its own; ``build`` is given the part's rows and gives batches."""

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part:
                    if rows:
                        yield from build(part, rows)
                    part, rows = row[0], []
                rows.append(row)
        if rows:
            yield from build(part, rows)

    return packed.repartitionById(number, F.col("part")).sortWithinPartitions("part").mapInArrow(run, _PACKED)


def _column(rows: list[tuple], at: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), kind)


def _holders(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """Each n-gram of each class, packed by range of its hash; of equal sets in a task one is read."""

    def run(batches):
        seen: set[int] = set()
        held, many = [], 0
        for batch in batches:
            for _, _, off, flat in _sets(batch.column("text"), n):
                key = np.add.reduceat(mix(flat), off[:-1])
                new = np.array([not (k in seen or seen.add(k)) for k in key.tolist()])
                size = np.diff(off)
                flat = flat[np.repeat(new, size)]
                held.append((flat, np.repeat(key[new], size[new])))
                many += len(flat)
                if many >= _ENTRIES:
                    yield from packed(held)
                    held, many = [], 0
        yield from packed(held)

    def packed(held):
        if held:
            grams, classes = (np.concatenate(x) for x in zip(*held))
            part = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            yield _pack(part, 0, classes, grams.astype("<u4"))

    return docs.select("text").mapInArrow(run, _PACKED)


def _shared(holders: DataFrame, parts: int, ranges: int) -> DataFrame:
    """Those n-grams that several classes hold, with their rounded number, packed by class."""

    def build(span, rows):
        grams, classes = _column(rows, 3, "<u4"), _column(rows, 2, "<u8")
        by = np.argsort(grams)
        grams, classes = grams[by], classes[by]
        same = grams[1:] == grams[:-1]
        several = np.zeros(len(grams), bool)
        several[1:] |= same
        several[:-1] |= same
        grams, classes = grams[several], classes[several]
        by = np.lexsort((classes, grams))
        grams, classes = grams[by], classes[by]
        new = np.ones(len(grams), bool)  # of a class
        new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
        grams, classes = grams[new], classes[new]
        first = np.flatnonzero(np.diff(grams.astype(np.int64), prepend=-1))
        count = np.diff(np.append(first, len(grams)))
        count = np.repeat(count, count)
        more = count > 1
        grams, classes, count = grams[more], classes[more], count[more]
        if len(grams):
            yield _pack((classes % np.uint64(parts)).astype(np.int32), span, classes, grams, np.minimum(8 * np.log2(count), 255).astype(np.uint8))

    return _parts(holders, ranges, build)


def _prefixes(shared: DataFrame, classes: DataFrame, t: float, parts: int, ranges: int) -> DataFrame:
    """The n-grams in the prefix of each class that can have a partner, packed by range, and for each
    such class, in part -1, the one that it is put in a block by: the first of the most frequent."""

    def needs(batches):
        for batch in batches:
            key, n, merged = (batch.column(c).to_numpy() for c in ("f1", "n", "merged"))
            key = key.view(np.uint64)
            need = np.maximum(np.ceil(t * n - 1e-9), 1) - merged
            yield _pack((key % np.uint64(parts)).astype(np.int32), -1, key, need.astype("<i4"))

    def build(part, rows):
        own, held = [r for r in rows if r[1] < 0], [r for r in rows if r[1] >= 0]
        if not held:
            return
        known, at = np.unique(_column(own, 2, "<u8"), return_index=True)
        need = _column(own, 3, "<i4")[at].astype(np.int64)
        who = np.searchsorted(known, _column(held, 2, "<u8"))
        rank = _column(held, 4, "u1")
        gram = _column(held, 3, "<u4").astype(np.uint64) | np.repeat(np.array([r[1] for r in held], np.uint64) << np.uint64(32), [len(r[4]) for r in held])
        over = np.bincount(who, minlength=len(known)) - need
        able = over[who] >= 0
        who, rank, gram = who[able], rank[able], gram[able]
        if not len(who):
            return
        by = np.lexsort((gram, rank, who))
        who, rank, gram = who[by], rank[by], gram[by]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        length = np.diff(np.append(first, len(who)))
        inside = np.arange(len(who)) - np.repeat(first, length) <= over[who]
        who, rank, gram = who[inside], rank[inside], gram[inside]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        length = np.diff(np.append(first, len(who)))
        top = np.flatnonzero(rank == np.repeat(rank[first + length - 1], length))
        most = top[np.flatnonzero(np.diff(who[top], prepend=-1))]
        yield _pack((gram >> np.uint64(32)).astype(np.int32), 0, known[who], gram)
        yield _pack(np.full(len(most), -1, np.int32), 0, known[who[most]], gram[most])

    return _parts(shared.unionAll(classes.select("f1", "n", "merged").mapInArrow(needs, _PACKED)), parts, build)


def _unpacked(packed: DataFrame) -> DataFrame:
    """(f1, gram) of each entry."""

    def run(batches):
        for batch in batches:
            for classes, grams in zip(batch.column("classes").to_pylist(), batch.column("grams").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (classes, grams)], names=["f1", "gram"])

    return packed.select("classes", "grams").mapInArrow(run, "f1 bigint, gram bigint")


def _meetings(prefixes: DataFrame, ranges: int) -> DataFrame:
    """(a, b): each class with the least of those that an n-gram of its prefix is in the prefix of."""

    def run(batches):
        part, rows = None, []

        def edges():
            gram, key = _column(rows, 3, "<u8"), _column(rows, 2, "<i8")
            by = np.lexsort((key, gram))
            gram, key = gram[by], key[by]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            least = np.repeat(key[first], np.diff(np.append(first, len(gram))))
            pairs = np.unique(np.stack([key, least])[:, key != least], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part:
                    if rows:
                        yield edges()
                    part, rows = row[0], []
                rows.append(row)
        if rows:
            yield edges()

    return prefixes.filter("part >= 0").repartitionById(ranges, F.col("part")).sortWithinPartitions("part").mapInArrow(run, "a bigint, b bigint").distinct()


def _ranges(classes: DataFrame) -> int:
    """The number of ranges of n-grams, which grows with the table, so that tasks don't."""
    return max(16, -(-(classes.agg(F.sum("n")).first()[0] or 0) // _ENTRIES))


def _units(docs: DataFrame, classes: DataFrame, n: int, t: float, block: int) -> DataFrame:
    """(doc_id, th, units): the units of each class that can have a partner, each as (unit, side).
    Pairs of a unit are those of different sides, or all if it has one side."""
    ranges = _ranges(classes)
    parts = max(8, ranges // 2)
    spark = docs.sparkSession
    prefixes = distilled(spark, "ngram-prefixes", lambda: _prefixes(_shared(_holders(docs, n, ranges), parts, ranges), classes, t, parts, ranges))
    group = distilled(spark, "ngram-groups", lambda: connected_components(_meetings(prefixes, ranges)))
    placed = classes.join(group.withColumnRenamed("node", "f1"), "f1").select("f1", "doc_id", "th", "n", "component")
    size = placed.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    placed = materialise(placed.join(size, "component"), "ngram-candidates")
    whole = f"m <= {int(block)} AND grams <= {_GRAMS}"
    small = placed.filter(whole).select("doc_id", "th", F.array(F.struct(F.xxhash64("component").alias("unit"), F.lit(0).alias("side"))).alias("units"))
    large = placed.filter(f"NOT ({whole})")
    if large.isEmpty():
        return small
    # blocks: families of more than a block's worth are cut by hash, the others are gathered by hash
    frequent = _unpacked(prefixes.filter("part < 0")).withColumnRenamed("gram", "family")
    large = materialise(large.join(frequent, "f1"), "ngram-families")
    worth = f"CAST(ceil(greatest(count(*) / {int(block)}, sum(n) / {_GRAMS})) AS INT)"
    families = large.groupBy("component", "family").agg(F.expr(worth).alias("own"))
    large = large.join(materialise(families, "ngram-family-sizes"), ["component", "family"])
    rest = large.filter("own = 1").groupBy("component").agg(F.expr(worth).alias("rest"))
    number = F.expr("CASE WHEN own > 1 THEN xxhash64(component, family, pmod(xxhash64(doc_id, th), own)) ELSE xxhash64(component, pmod(xxhash64(family), rest)) END")
    large = materialise(large.join(rest, "component", "left").select("f1", "doc_id", "th", number.alias("block")), "ngram-blocks")
    near = _unpacked(prefixes.filter("part >= 0")).join(large.select("f1", "block"), "f1").select("gram", "block").distinct()
    near = near.groupBy("gram").agg(F.array_sort(F.collect_list("block")).alias("x")).select("x").distinct()
    two = near.select("x", F.posexplode("x").alias("i", "b1")).select("b1", F.explode(F.expr("slice(x, i + 1, size(x) - i)")).alias("b2")).distinct()
    side = lambda x, i: F.struct(F.xxhash64("b1", "b2").alias("unit"), F.lit(i).alias("side"))
    sides = two.select(F.col("b1").alias("block"), side("b1", 0).alias("u")).unionAll(two.filter("b1 <> b2").select(F.col("b2").alias("block"), side("b2", 1).alias("u")))
    sides = sides.groupBy("block").agg(F.collect_list("u").alias("units"))
    return small.unionAll(large.join(sides, "block").select("doc_id", "th", "units"))


def trie_join(sets: list[np.ndarray], t: float) -> Iterator[tuple[int, int, int]]:
    """(i, j, overlap) of all pairs with Jaccard similarity of at least t, each once. The sets
    are ascending arrays without repeats."""
    for i, found, overlaps in _trie_leaves(sets, t):
        for j, o in zip(found.tolist(), overlaps.tolist()):
            yield i, j, o


def _trie_leaves(sets: list[np.ndarray], t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, overlaps) of each leaf that has partners to the right of it."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    new = np.flatnonzero(np.diff(flat, prepend=flat[:1] ^ flat.dtype.type(1)))
    run = np.diff(np.append(new, len(flat)))
    shared = np.repeat(run > 1, run)
    if not shared.any():
        return
    owner = owner[shared]
    run = run[run > 1]
    token = np.repeat(np.arange(len(run)), run)
    starts = np.concatenate([[0], np.cumsum(run)])
    order = np.argsort(owner, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
    seqs = [token[order[cut[i] : cut[i + 1]]] for i in range(len(sets))]
    rank = sorted(range(len(sets)), key=lambda i: seqs[i].astype(">u4").tobytes())  # the leaves of the trie, in order
    rank = np.array(rank)
    place = np.empty(len(sets), np.int64)
    place[rank] = np.arange(len(sets))
    posting = place[owner]  # the members of token x, by rank: posting[starts[x]:starts[x + 1]]
    seqs, sizes = [seqs[i] for i in rank], sizes[rank]
    long = np.array([len(s) for s in seqs])
    m, share = len(seqs), t / (1 + t)
    stack = [(0, m, 0, np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = seqs[lo], seqs[hi - 1]
        k = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:k] != last[depth:k])
        end = depth + int(differ[0]) if len(differ) else k
        deepest, least = int(long[lo:hi].max()), sizes[lo:hi].min()
        need = np.ceil(share * (least + sizes) - 1e-9)
        need[: lo + (hi - lo == 1)] = np.iinfo(np.int64).max  # pairs with earlier leaves are found from there
        need[(sizes < t * least - 1e-9) | (sizes * t > sizes[lo:hi].max() + 1e-9)] = np.iinfo(np.int64).max
        alive = True
        used = overlap
        while depth < end:
            to = min(end, depth + _CHECK_EVERY)
            members = np.concatenate([posting[starts[x] : starts[x + 1]] for x in first[depth:to]])
            used = used + np.bincount(members, minlength=m)
            depth = to
            if not (used + np.minimum(deepest - depth, long - used) >= need).any():
                alive = False
                break
        if not alive:
            continue
        nxt = lo
        while nxt < hi and len(seqs[nxt]) == depth:  # leaves here
            need = np.ceil(share * (sizes[nxt] + sizes[nxt + 1 :]) - 1e-9)
            j = np.flatnonzero(used[nxt + 1 :] >= need) + nxt + 1
            if len(j):
                yield int(rank[nxt]), rank[j], used[j]
            nxt += 1
        children = []
        while nxt < hi:
            x, a = seqs[nxt][depth], nxt
            while nxt < hi and seqs[nxt][depth] == x:
                nxt += 1
            children.append((a, nxt, depth, used))
        stack.extend(reversed(children))


def counted_join(sets: list[np.ndarray], t: float, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap), in arrays, of the same pairs, by the overlaps of all. With two sides: of pairs across them."""
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    one = len(left) == len(side)
    sizes = np.array([len(x) for x in sets])
    place = np.empty(len(sets), np.int64)
    place[right] = np.arange(len(right))
    place[left] = np.arange(len(left))
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    df = np.bincount(token)
    total = np.zeros((len(left), len(right)), np.float32 if sizes.max() <= _EXACT else np.float64)

    number = np.full(len(df), -1)
    frequent = np.flatnonzero(df >= _FREQUENT)
    number[frequent] = np.arange(len(frequent))
    dense = number[token] >= 0
    column, row, leftish = number[token[dense]], place[owner[dense]], (side == side.min())[owner[dense]]
    for lo in range(0, len(frequent), _WIDTH):
        now = (column >= lo) & (column < lo + _WIDTH)
        width = min(_WIDTH, len(frequent) - lo)
        a = np.zeros((len(left), width), np.float32)
        a[row[now & leftish], column[now & leftish] - lo] = 1
        b = a
        if not one:
            b = np.zeros((len(right), width), np.float32)
            b[row[now & ~leftish], column[now & ~leftish] - lo] = 1
        total += a @ b.T

    sparse = (df[token] > 1) & (df[token] < _FREQUENT)
    token, owner = token[sparse], owner[sparse]
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    is_left = (side == side.min())[owner]
    la, lt = place[owner[is_left]], token[is_left]
    rb, rt = (la, lt) if one else (place[owner[~is_left]], token[~is_left])
    begin, end = np.searchsorted(lt, rt, "left"), np.searchsorted(lt, rt, "right")
    step = max(1, (1 << 22) // _FREQUENT)
    for lo in range(0, len(rt), step):
        many = (end - begin)[lo : lo + step]
        at = np.repeat(begin[lo : lo + step] - np.cumsum(many) + many, many) + np.arange(many.sum())
        np.add.at(total.reshape(-1), la[at] * len(right) + np.repeat(rb[lo : lo + step], many), total.dtype.type(1))

    share = t / (1 + t)
    for lo in range(0, len(left), _STRIP):
        strip = total[lo : lo + _STRIP]
        good = strip >= np.ceil(share * (sizes[left[lo : lo + _STRIP]][:, None] + sizes[right][None, :]) - 1e-9)
        if one:
            good &= np.arange(lo, lo + len(strip))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(good)
        if len(i):
            yield left[lo + i], right[j], strip[i, j].astype(np.int64)


def _pairs_of_unit(sets: list[np.ndarray], side: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, jaccard), in arrays, of the pairs of a unit."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) > _SMALL or side.min() != side.max():
        found = counted_join(sets, t, side)
    else:
        found = ((np.full(len(j), i), j, o) for i, j, o in _trie_leaves(sets, t))
    for i, j, o in found:
        yield i, j, o / (sizes[i] + sizes[j] - o)


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` of each member, after the pairs (i, j) are joined."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != (up := root[root])).any():
            root = up


def _classes(documents: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, members, classes): ``members`` has (rep_id, rep_th, doc_id, th) of every document that
    has a word, ``classes`` has (f1, f2, n, merged, doc_id, th, size)."""
    docs = narrow(documents).dropna().withColumn("th", F.xxhash64("text"))
    sketch = materialise(_sketches(docs, n), "ngram-sketch")
    classes = sketch.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.max("merged").alias("merged"), F.count("*").alias("size"))
    classes = materialise(classes.select("f1", "f2", "n", "merged", "r.*", "size"), "ngram-classes")
    members = sketch.join(classes.select("f1", "f2", "n", F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th")), ["f1", "f2", "n"]).select("rep_id", "rep_th", "doc_id", "th")
    return docs, members, classes


def _over_units(docs: DataFrame, classes: DataFrame, n: int, t: float, block: int, result, schema: str) -> DataFrame:
    """What ``result`` gives of each unit's (ids, ths, sizes, sets, sides)."""
    wanted = _units(docs, classes, n, t, block).join(classes.select("doc_id", "th", "size"), ["doc_id", "th"])

    def sets(batches):
        for batch in batches:
            for lo, full, off, flat in _sets(batch.column("text"), n):
                at = pa.array(full + lo)
                found = pa.array([flat[i:j].tobytes() for i, j in zip(off, off[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "th", "size")), found, batch.column("units").take(at)], names=["doc_id", "th", "size", "grams", "units"])

    full = docs.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "size", "text", "units")
    sent = full.mapInArrow(sets, "doc_id bigint, th bigint, size bigint, grams binary, units array<struct<unit: bigint, side: int>>").select("doc_id", "th", "size", "grams", F.explode("units").alias("u"))

    def run(batches):
        for rows in _by_unit(batches):
            ids, ths, size, grams, side = zip(*{(r[0], r[1], r[4]): r[:5] for r in rows}.values())
            if len(ids) > 1:
                yield from result(np.array(ids), np.array(ths), np.array(size), [np.frombuffer(g, np.uint64) for g in grams], np.array(side))

    return sent.select("doc_id", "th", "size", "grams", "u.side", "u.unit").repartition(_ranges(classes), "unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def class_pairs(documents: DataFrame, n: int = 3, t: float = 0.5, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` has (rep_id, rep_th, doc_id, th) of every document that has a
    word; ``pairs`` has (id_a, th_a, id_b, th_b, jaccard) of every two similar classes."""
    docs, members, classes = _classes(documents, n)

    def pairs(ids, ths, size, sets, side):
        for i, j, jaccard in _pairs_of_unit(sets, side, t):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ths[i], ids[j], ths[j], jaccard)], names=["id_a", "th_a", "id_b", "th_b", "jaccard"])

    return members, _over_units(docs, classes, n, t, block, pairs, "id_a bigint, th_a bigint, id_b bigint, th_b bigint, jaccard double")


def class_links(documents: DataFrame, n: int = 3, t: float = 0.5, block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): of each class and unit in which it is similar to others, ``links`` has
    (id_a, th_a, id_b, th_b, links, most): the least class that it is connected with there, the
    number of documents that it is similar to, and the largest similarity."""
    docs, members, classes = _classes(documents, n)

    def links(ids, ths, size, sets, side):
        order = np.lexsort((ths, ids))  # so that the least index is the least class
        ids, ths, size, side, sets = ids[order], ths[order], size[order], side[order], [sets[i] for i in order]
        m = len(ids)
        root, many, most = np.arange(m), np.zeros(m, np.int64), np.zeros(m)
        for i, j, jaccard in _pairs_of_unit(sets, side, t):
            np.add.at(many, i, size[j])
            np.add.at(many, j, size[i])
            np.maximum.at(most, i, jaccard)
            np.maximum.at(most, j, jaccard)
            root = _hook(root, i, j)
        at = np.flatnonzero(many)
        up = root[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], ths[at], ids[up], ths[up], many[at], most[at])], names=["id_a", "th_a", "id_b", "th_b", "links", "most"])

    return members, classes, _over_units(docs, classes, n, t, block, links, "id_a bigint, th_a bigint, id_b bigint, th_b bigint, links bigint, most double")


def _by_unit(batches) -> Iterator[list[tuple]]:
    """The rows of each unit, of batches that are sorted by it."""
    unit, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[5] != unit:
                if rows:
                    yield rows
                unit, rows = row[5], []
            rows.append(row)
    if rows:
        yield rows


def similar_pairs(documents: DataFrame, n: int = 3, t: float = 0.5) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b, every similar pair once."""
    members, pairs = class_pairs(documents, n, t)
    ids = members.select("rep_id", "rep_th", "doc_id")
    same = ids.join(ids.withColumnRenamed("doc_id", "doc_b"), ["rep_id", "rep_th"]).select(F.col("doc_id").alias("doc_a"), "doc_b", F.lit(1.0).alias("jaccard"))
    a = ids.select(F.col("rep_id").alias("id_a"), F.col("rep_th").alias("th_a"), F.col("doc_id").alias("x"))
    b = ids.select(F.col("rep_id").alias("id_b"), F.col("rep_th").alias("th_b"), F.col("doc_id").alias("y"))
    across = pairs.join(a, ["id_a", "th_a"]).join(b, ["id_b", "th_b"]).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return same.unionAll(across).filter("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _components(pairs: DataFrame) -> DataFrame:
    node = lambda x: F.struct(F.col(f"id_{x}").alias("id"), F.col(f"th_{x}").alias("th")).alias(x)
    return connected_components(pairs.select(node("a"), node("b")))


def similar_documents(documents: DataFrame, n: int = 3, t: float = 0.5) -> DataFrame:
    """(doc_id, class_id, n_links, max_jaccard) of each document that is similar to another:
    class_id is the least id that a chain of links leads to, n_links the number of documents
    that this one is similar to, max_jaccard the largest of their similarities."""
    members, sizes, pairs = class_links(documents, n, t)
    members, pairs = materialise(members, "ngram-members"), materialise(pairs, "ngram-links")
    rep = ["rep_id", "rep_th"]
    sizes = sizes.select(F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"), "size")
    links = pairs.groupBy(F.col("id_a").alias("rep_id"), F.col("th_a").alias("rep_th")).agg(F.sum("links").alias("links"), F.max("most").alias("most"))
    groups = _components(pairs).select(F.col("node.id").alias("rep_id"), F.col("node.th").alias("rep_th"), F.col("component.id").alias("least"))
    classes = sizes.join(links, rep, "left").join(groups, rep, "left").filter("size > 1 OR links > 0").selectExpr(*rep, "coalesce(least, rep_id) AS least", "size - 1 + coalesce(links, 0) AS links", "CASE WHEN size > 1 THEN 1D ELSE most END AS most")
    classes = materialise(classes, "ngram-linked")  # a plain scan, so that AQE can split a class of many copies
    return members.join(classes, rep).groupBy("doc_id").agg(F.min("least").alias("class_id"), F.sum("links").alias("n_links"), F.max("most").alias("max_jaccard"))


def keep_one_of_each(documents: DataFrame, n: int = 3, t: float = 0.5) -> DataFrame:
    """``documents`` without those that a chain of similar pairs links to a document of lower
    (doc_id, text hash). Rows without an id or a word stay, as do all columns."""
    members, _, links = class_links(documents, n, t)
    groups = _components(links)
    lost = groups.filter("node <> component").select(F.col("node.id").alias("rep_id"), F.col("node.th").alias("rep_th"))
    copies = members.filter("doc_id <> rep_id OR th <> rep_th").select("doc_id", "th")
    gone = copies.unionAll(members.join(lost, ["rep_id", "rep_th"], "left_semi").select("doc_id", "th")).distinct().select(F.struct("doc_id", "th").alias(name := free_name(documents, "__gone")))
    th = F.xxhash64(F.col("text").cast("string"))
    return documents.join(gone, (F.col("doc_id").cast("bigint") == F.col(f"{name}.doc_id")) & (th == F.col(f"{name}.th")), "left_anti")


def one_of_equal_rows(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each (doc_id, text), which ``keep_one_of_each`` cannot tell
    apart. Rows without an id are compared by text; rows without a text all stay."""
    return one_of_equal_texts(documents.filter("text IS NOT NULL")).unionAll(documents.filter("text IS NULL"))


def one_of_equal_texts(documents: DataFrame) -> DataFrame:
    """The same for rows that all have a text; ``documents`` is read once."""
    th = free_name(documents, "__th")
    return documents.withColumn(th, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", th]).drop(th)


DOCUMENTS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      ELSE [array_to_string(ws, ' ')] END) AS gram FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT doc_a, doc_b, CAST(o AS DOUBLE) / (x.n + y.n - o) AS j
      FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE o >= 0.5 * (x.n + y.n - o)),
b AS (SELECT doc_a AS x, doc_b AS y, j FROM e UNION ALL SELECT doc_b, doc_a, j FROM e),
r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT x AS doc_id, class_id, count(*) AS n_links, max(j) AS max_jaccard FROM b JOIN c USING (x) GROUP BY x, class_id
"""
