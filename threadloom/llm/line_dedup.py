"""Deletion of repeated runs of lines, by winnowing.

A document is the sequence of its non-blank lines, compared after stripping blanks, with a
mark before the first and after the last, so that a header or footer of one line is a run of
two. Of each window of ``window`` neighbours the smallest line hash (the rightmost of equal
ones) is a fingerprint; two equal runs of that many neighbours share one by construction.

Fingerprints found at one place only need no more work. The positions of the others are
joined, and extended both ways by the windows that the fingerprint stands for: those windows,
compared hash by hash, are exactly the places where a match of the guaranteed length goes on,
so runs of any length are the unions of neighbouring equal windows. Every window but its
first place in the order (doc_id, text hash, line) is deleted. Each distinct line survives
at its first place.

A line of ``alone`` characters or more is a run by itself: it is deleted wherever it comes again,
whatever its neighbours. With a ``window`` of one this holds for every line; with two, as the
registered query and its SQL have it, a shorter line goes only if a neighbour repeats with it.

Positions are joined through an aggregate (the first place of a window) and never with each
other, so a line that a million documents share costs a million rows, not their square.

Null or empty text: no line, returned as it is. Null doc_id: comes first in the order. Rows
that repeat both doc_id and text are one document and get the same treatment. A document
whose every line is deleted keeps its row, with text ``''``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .runtime import free_name, materialise, narrow

_BEFORE, _AFTER = (1 << 63) - 1, (1 << 63) - 2  # above any line hash, so never a fingerprint
_BLANKS = " \t\r\f\x0b"
_BLANKS_SQL = r"' \t\r\f\u000b'"


def _windows(docs: DataFrame, window: int, alone: int) -> DataFrame:
    """(doc_id, th, fp, new, h, at): hashes and line numbers of each window, its fingerprint,
    and whether it is the first window that this position was chosen in. Lines of ``alone``
    characters are windows of one as well."""
    names = ["doc_id", "th", "fp", "new", "h", "at"]

    def run(batches):
        for batch in batches:
            hashes, numbers, size, long, owner = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                n = len(hashes)
                for i, line in enumerate(text.as_py().split("\n")):
                    line = line.strip(_BLANKS)
                    if line:
                        if len(line) >= alone:
                            long.append(len(hashes))
                            owner.append(k)
                        hashes.append(xxh64_intdigest(line) >> 1)
                        numbers.append(i)
                size.append(len(hashes) - n)
            if long and window > 1:
                h, at, row = np.array(hashes, np.int64)[long], np.array(numbers, np.int32)[long], pa.array(owner)
                one = pa.array(np.arange(len(long) + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(h), pa.array(np.ones(len(long), bool)), pa.ListArray.from_arrays(one, pa.array(h)), pa.ListArray.from_arrays(one, pa.array(at))], names=names)
            size = np.array(size, np.int64)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            size = size[full]
            marked = np.maximum(size + 2, window)
            off = np.cumsum(marked) - marked
            h, at = np.full(marked.sum(), _AFTER, np.int64), np.full(marked.sum(), -1, np.int32)
            h[off] = _BEFORE
            place = np.repeat(off + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
            h[place], at[place] = hashes, numbers
            count = marked - window + 1
            doc = np.repeat(np.arange(len(full)), count)
            first = np.repeat(off - (np.cumsum(count) - count), count) + np.arange(count.sum())
            wins = sliding_window_view(h, window)[first]
            pos = first + window - 1 - np.argmin(wins[:, ::-1], axis=1)
            lists = pa.array(np.arange(0, wins.size + 1, window, dtype=np.int32))
            row = pa.array(full[doc])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row),
                    batch.column("th").take(row),
                    pa.array(wins.min(axis=1)),
                    pa.array(np.diff(pos, prepend=-1) != 0),
                    pa.ListArray.from_arrays(lists, pa.array(wins.ravel())),
                    pa.ListArray.from_arrays(lists, pa.array(sliding_window_view(at, window)[first].ravel())),
                ],
                names=names,
            )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, fp bigint, new boolean, h array<bigint>, at array<int>")


def repeated_lines(documents: DataFrame, window: int = 2, alone: int = 160) -> DataFrame:
    """(doc_id, th, gone): the numbers of the lines to delete from each document that has any."""
    if window < 1:
        raise ValueError("window must be at least 1")
    docs = narrow(documents).filter(F.length("text") > 0).select("doc_id", "text")
    found = materialise(_windows(docs, window, alone).filter(F.col("fp") < _AFTER), "line-windows")  # a mark alone is no line
    # aggregates are written before they are joined, so that AQE sees plain shuffles and can split a hot line's
    repeated = materialise(found.groupBy("fp").agg(F.count_if("new").alias("n")).filter("n > 1").select("fp"), "line-fingerprints")
    matched = materialise(found.join(repeated, "fp", "left_semi").select("h", F.struct("doc_id", "th", F.col("at").alias("k")).alias("place")), "line-matches")
    first = matched.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last").select("h", "first")
    first = materialise(first, "first-lines")
    later = matched.join(first, "h").filter("place <> first")
    return later.select("place.doc_id", "place.th", F.explode("place.k").alias("i")).filter("i >= 0").groupBy("doc_id", "th").agg(F.collect_set("i").alias("gone"))


def dedup_lines(documents: DataFrame, window: int = 2, alone: int = 160) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), one row for each input row; n_lines counts the
    non-blank lines, and the text is joined again from the lines that stay."""
    gone = repeated_lines(documents, window, alone).withColumnsRenamed({"doc_id": "g_id", "th": "g_th"})
    docs = narrow(documents).withColumn("th", F.xxhash64("text"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left")
    return joined.selectExpr(
        "doc_id",
        f"coalesce(size(filter(split(text, '\\n'), x -> btrim(x, {_BLANKS_SQL}) <> '')), 0) AS n_lines",
        "coalesce(size(gone), 0) AS n_removed",
        "CASE WHEN gone IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(gone, i)), '\\n') END AS text",
    )


def without_repeats(documents: DataFrame, window: int = 2, alone: int = 160) -> DataFrame:
    """``documents`` with the repeated lines out of ``text``, other columns as they were, and
    without the documents of which nothing is left. A document that loses no line stays."""
    names, x = documents.columns, free_name(documents, "__gone")
    gone = repeated_lines(documents, window, alone).select(F.struct("doc_id", "th", "gone").alias(x))
    kept = documents.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{x}.th")), "left")
    text = f"CASE WHEN {x} IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (line, i) -> NOT array_contains({x}.gone, i)), '\\n') END"
    return kept.withColumn("text", F.expr(text)).filter(F.col(x).isNull() | F.expr(f"btrim(text, {_BLANKS_SQL.replace(' ', ' \\n', 1)}) <> ''")).select(*[F.col(f"`{c}`") for c in names])


DEDUP_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text <> ''),
n AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM l),
s AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM n WHERE t <> ''),
m AS (SELECT doc_id, i, t, p FROM s
      UNION ALL SELECT doc_id, -1, chr(10) || 'before', 0 FROM s GROUP BY doc_id
      UNION ALL SELECT doc_id, -1, chr(10) || 'after', max(p) + 1 FROM s GROUP BY doc_id),
w AS (SELECT doc_id, p, i, lead(i) OVER q AS i2, t AS a, lead(t) OVER q AS b FROM m WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, i, i2, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS k FROM w WHERE b IS NOT NULL),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM s WHERE length(t) >= 160),
g AS (SELECT doc_id, i FROM r WHERE k > 1 AND i > 0 UNION SELECT doc_id, i2 FROM r WHERE k > 1 AND i2 > 0 UNION SELECT doc_id, i FROM q WHERE k > 1),
x AS (SELECT n.doc_id, count(*) FILTER (WHERE t <> '') AS n_lines, count(g.i) AS n_removed,
      coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM l JOIN n USING (doc_id, i) LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE kept END AS text
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id
"""
