"""Discussion threads: building, matching, sampling, counting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as X
from threadloom.operators.graph import connected_components
from threadloom.storage import by_merge, materialise

REQUIRED = ("message_id", "subject", "date", "in_reply_to", "references")


def require(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}; there are: {', '.join(df.columns)}")
    return df


def node(df: DataFrame, row: str = "_row_order") -> Column:
    """The message's own id, or one made from its row."""
    return F.coalesce(F.nullif(X.message_id(X.as_list(df, "message_id")), F.lit("")), F.concat(F.lit("__row_"), F.col(row).cast("string"), F.lit("__")))


def message_edges(df: DataFrame, row: str = "_row_order", join_empty: bool = True, scope: Column | None = None) -> DataFrame:
    """(row, scope, node, other, position) for each id that a message refers to, its parent first. The text ``nan`` is no id; the empty id of ``<>`` is one
    only with ``join_empty``, which glues all such messages together."""
    parent = F.array(X.message_id(X.as_list(df, "in_reply_to")))
    others = F.concat(parent, X.message_ids(X.as_list(df, "references")))
    edges = df.select(F.col(row).alias("row"), (F.lit("") if scope is None else scope).alias("scope"), node(df, row).alias("node"), F.posexplode(others).alias("position", "other"))
    edges = edges.filter(F.col("other").isNotNull() & (F.col("other") != "nan") & (F.col("node") != "nan"))
    return edges if join_empty else edges.filter("other <> ''")


def thread_ids(df: DataFrame, row: str = "_row_order", scope: str | None = None, join_empty: bool = True) -> DataFrame:
    """(row, thread): the thread of each message, named by the least row in it. Ids that no message has still connect those that refer to them.

    ``scope``: a column within whose values threads stay (the list), or None. The graph has hashed ids of eight bytes and never the message texts."""
    inside = F.col(f"`{scope}`").cast("string") if scope else F.lit("")
    nodes = df.select(F.col(row).alias("row"), F.xxhash64(inside, node(df, row)).alias("id"))
    edges = message_edges(df, row, join_empty, inside).select(F.xxhash64("scope", "node").alias("a"), F.xxhash64("scope", "other").alias("b"))
    parts = connected_components(edges)
    placed = nodes.join(by_merge(parts), F.col("id") == F.col("node"), "left").select("row", F.coalesce("component", "id").alias("c"))
    least = placed.groupBy("c").agg(F.min("row").alias("thread"))
    return materialise(placed.join(by_merge(least), "c").select("row", "thread"), "threads")


def replay_labels(df: DataFrame, threads: DataFrame, row: str = "_row_order") -> DataFrame:
    """(row, label): each thread named by the id that merging its messages in row order leaves at the root, the last merging message's root absorbing
    the other; for results that must carry that very name. One task a thread."""
    links = message_edges(df, row).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "other"))), lambda x: x["other"]).alias("others"))
    rows = df.select(F.col(row).alias("row"), node(df, row).alias("node")).join(by_merge(threads), "row").join(by_merge(links), "row", "left")

    def replay(part):
        import pandas as pd

        up: dict[str, str] = {}

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        part = part.sort_values("row")
        for n in part["node"]:
            root(n)
        for n, others in zip(part["node"], part["others"]):
            for o in others if others is not None else []:
                a, b = root(n), root(o)
                if a != b:
                    up[b] = a
        return pd.DataFrame({"row": part["row"], "label": [root(n) for n in part["node"]]})

    return rows.select("thread", "row", "node", "others").groupBy("thread").applyInPandas(replay, "row bigint, label string")


def match_flags(df: DataFrame, pattern_mode: str = "as_written") -> DataFrame:
    """Adds _dup_subject_match, _dup_content_match and _dup_match."""
    rx = X.PATTERNS[pattern_mode]
    subject, content = X.joined_text(df, ["subject", "untagged_subject"]), X.joined_text(df, ["raw_body", "code"])
    return df.withColumns({"_dup_subject_match": X.matches(subject, rx), "_dup_content_match": X.matches(content, rx)}).withColumn("_dup_match", F.col("_dup_subject_match") | F.col("_dup_content_match"))


def matching_threads(flags: DataFrame, thread: str = "_thread_id") -> DataFrame:
    """The threads with a match, each once."""
    return flags.groupBy(thread).agg(F.bool_or("_dup_match").alias("any_match")).filter("any_match").select(thread)


def keep_threads(df: DataFrame, threads: DataFrame, thread: str = "_thread_id") -> DataFrame:
    return df.join(by_merge(threads), thread, "left_semi")


def sample_threads(threads: DataFrame, fraction: float = 0.1, seed: int = 0, thread: str = "_thread_id") -> DataFrame:
    """A seeded sample of the share ``fraction`` of the threads, rounded up, one at least; none if the share is 0. Ordered by md5, so it is the same in
    every run and engine."""
    fraction = min(max(fraction, 0.0), 1.0)
    n = threads.count()
    k = max(1, math.ceil(fraction * n)) if fraction and n else 0
    return threads.orderBy(F.md5(F.concat(F.col(thread).cast("string"), F.lit(f":{seed}"))), thread).limit(k)


def mark(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the flag ``name``: whether the row's key is among ``keys``."""
    there = keys.select(F.col(key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    return df.join(by_merge(there), F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__key", "__there")


def first_messages(df: DataFrame, thread: str = "_thread_id", row: str = "_row_order") -> DataFrame:
    order = Window.partitionBy(thread).orderBy(F.col("date").asc_nulls_last(), row)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def numbered(df: DataFrame, order: list[Column], thread: str = "_thread_id") -> DataFrame:
    """Adds ``position`` and ``total``: i of N in the thread."""
    by = Window.partitionBy(thread)
    return df.withColumn("position", F.row_number().over(by.orderBy(*order))).withColumn("total", F.count("*").over(by))


def in_order(df: DataFrame, thread: str = "_thread_id", row: str = "_row_order") -> DataFrame:
    return df.orderBy(F.col(thread).asc_nulls_last(), F.col("date").asc_nulls_last(), row)


def first_threads(df: DataFrame, n: int = 5, thread: str = "_thread_id", row: str = "_row_order") -> DataFrame:
    """The n threads that come first in row order, with ``first_row``."""
    return df.groupBy(thread).agg(F.min(row).alias("first_row")).orderBy("first_row").limit(max(n, 0))


def filter_stats(flags: DataFrame, sample: DataFrame, thread: str = "_thread_id") -> DataFrame:
    """One row: messages and threads before, after and removed, the shares in percent (null without a thread), and the size of the sample."""
    each = flags.groupBy(thread).agg(F.count("*").alias("n"), F.bool_or("_dup_match").alias("kept"))
    each = mark(each, sample, thread, "picked")
    kept_share = lambda c: F.round(F.try_divide(F.lit(100.0) * c, F.count(F.col(thread))), 2)
    threads, good = F.count(F.col(thread)), F.count_if(F.col("kept") & F.col(thread).isNotNull())
    after = F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("emails_before"),
        after.alias("emails_after"),
        (F.coalesce(F.sum("n"), F.lit(0)) - after).alias("emails_removed"),
        threads.alias("threads_before"),
        good.alias("threads_after"),
        (threads - good).alias("threads_removed"),
        kept_share(good).alias("kept_pct"),
        kept_share(threads - good).alias("removed_pct"),
        F.count_if("picked").alias("threads_flagged"),
    )
