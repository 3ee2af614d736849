"""The six analyses, each a plan over a table of messages with ``_row_order``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import enrich, patches
from threadloom.operators import threads as T
from threadloom.storage import by_merge, materialise

FLAGS = ("_dup_subject_match", "_dup_content_match", "_dup_match")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"_msg_id": T.node(df), "__date": X.to_time(df, "date")}).drop("date").withColumnRenamed("__date", "date")


def with_threads(df: DataFrame, scope: str | None = None) -> DataFrame:
    """Adds _msg_id and _thread_id (the row that names the thread), dates as timestamps. The graph is built on ids alone; wide rows meet its result in one join."""
    T.require(df, T.REQUIRED)
    found = T.thread_ids(df, scope=scope).withColumnsRenamed({"row": "__row", "thread": "_thread_id"})
    return _dated(df).join(by_merge(found), F.col("_row_order") == F.col("__row"), "left").drop("__row")


@dataclass
class Filtered:
    flags: DataFrame
    kept: DataFrame
    stats: DataFrame


def filter_threads(df: DataFrame, fraction: float = 0.1, seed: int = 0, pattern_mode: str = "as_written", scope: str | None = None) -> Filtered:
    """Whole threads with a match, a sample of them marked, versions linked. Versions are linked after the others are gone, so among the kept rows only.

    The patterns run once: threads and flags of each row are written as a narrow table, from which threads are chosen, sampled and counted; wide rows meet
    it in one join."""
    marks = row_marks(df, pattern_mode, scope)
    good = materialise(T.matching_threads(marks), "matching-threads")
    sample = T.sample_threads(good, fraction, seed)
    chosen = T.mark(T.keep_threads(marks, good), sample, "_thread_id", "manual_verification")
    return Filtered(_with_marks(df, marks), patches.version_links(_with_marks(df, chosen)), T.filter_stats(marks, sample))


def row_marks(df: DataFrame, pattern_mode: str = "as_written", scope: str | None = None) -> DataFrame:
    """(_row_order, _thread_id, the three flags) of each row, written once."""
    T.require(df, T.REQUIRED)
    found = T.thread_ids(df, scope=scope).withColumnsRenamed({"row": "_row_order", "thread": "_thread_id"})
    return materialise(T.match_flags(df, pattern_mode).select("_row_order", *FLAGS).join(by_merge(found), "_row_order"), "match-flags")


def _with_marks(df: DataFrame, marks: DataFrame) -> DataFrame:
    lost = [c for c in marks.columns if c != "_row_order"]
    return _dated(df.drop(*lost)).join(by_merge(marks), "_row_order")


def matching_rows(df: DataFrame, pattern_mode: str = "as_written") -> DataFrame:
    """The rows of the threads with a match, with threads and flags."""
    marks = row_marks(df, pattern_mode)
    return _with_marks(df, T.keep_threads(marks, T.matching_threads(marks)))


def link_stats(kept: DataFrame) -> DataFrame:
    linked = F.length("first_version_message_id") > 0
    return kept.agg(F.count_if(linked).alias("rows_linked"), F.count_distinct(F.when(linked, F.col("first_version_message_id"))).alias("version_groups"))


def status_keys(df: DataFrame, subsystem: str) -> DataFrame:
    """(subsystem, msgid) of each last patch that has an id, once."""
    last = patches.last_patches(df).filter("is_last_patch")
    return last.select(F.lit(subsystem).alias("subsystem"), X.plain_id(F.col("message_id")).alias("msgid")).filter("msgid <> ''").distinct()


def status(df: DataFrame, subsystem: str, cache: DataFrame, resolver: Callable | None = None, workers: int = 8, pause: float = 1.0, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``accepted``, cache with what was asked). Without a resolver only the cache answers. Each miss is asked for once, when this is called;
    with a ``journal`` (the cache's folder) answers are saved as they come."""
    known = cache
    if resolver is not None:
        _, misses = enrich.lookup(status_keys(df, subsystem), cache)
        known = cache.unionByName(materialise(enrich.resolve(misses, resolver, workers, pause, journal), "states"))
    return enrich.accepted(patches.last_patches(df), known, subsystem).drop("is_last_patch"), known


def classify(df: DataFrame, classifier: Callable[[str], str], cache: DataFrame | None = None, workers: int = 8, pause: float = 0.2, journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``duplication_classification``, labels of all threads). Threads that the cache has are not asked again, others once, when this is called;
    with a ``journal`` (the cache's folder) labels are saved as they come."""
    T.require(df, ("_thread_id",))
    todo = df if cache is None else df.join(by_merge(cache), "_thread_id", "left_anti")
    labels = materialise(enrich.classify(enrich.prompts(todo), classifier, "_thread_id", workers, pause, journal), "labels")
    labels = labels if cache is None else cache.unionByName(labels)
    return enrich.label_rows(df, labels), labels


def classification_summary(df: DataFrame) -> DataFrame:
    has = F.col("duplication_classification").isNotNull()
    return df.agg(F.count_distinct(F.when(has, F.col("_thread_id"))).alias("labelled_threads"), F.count_if(has).alias("labelled_messages"), F.count("*").alias("messages"))


def threads_with_sender(df: DataFrame, domain: str) -> DataFrame:
    """All messages of each thread in which someone at the domain writes; position and total in the thread, by date."""
    T.require(df, ("_thread_id", "from"))
    hit = df.filter(X.sender_in(domain, F.array_join(X.as_list(df, "from"), " "))).select("_thread_id").distinct()
    return T.numbered(T.keep_threads(df, hit), [F.col("date").asc_nulls_last(), F.col("_row_order")])


def inspect(df: DataFrame, n_threads: int = 5, flag: str = "manual_verification") -> DataFrame:
    """All messages of the first n threads that have a flagged one, in order."""
    T.require(df, (flag, "_thread_id"))
    first = T.first_threads(df.filter(X.truthy(df, flag, X.MEDIUM)), n_threads)
    return T.numbered(df.join(first, "_thread_id", "left_semi"), [F.col("date").asc_nulls_last(), F.col("_row_order")])
