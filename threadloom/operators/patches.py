"""Versions of a patch, and the last patch of a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as X


def version_links(df: DataFrame, row: str = "_row_order") -> DataFrame:
    """Adds first_version_message_id: for a submission, the message_id of the first of those with its author and base subject, if that is version 1 and has
    an id, else empty. Threads don't matter. First: by version, date (none last), row."""
    names = df.columns
    untagged = F.col("untagged_subject") if "untagged_subject" in names else F.lit(None).cast("string")
    keyed = df.withColumns({
        "__author": X.author_key(X.as_list(df, "from")),
        "__subject": X.subject_key(untagged, F.col("subject")),
        "__version": X.patch_version(F.col("patch_version")) if "patch_version" in names else F.lit(1),
        "__sub": X.is_submission(df),
    }).withColumn("__in", F.col("__sub") & (F.col("__author") != "") & (F.col("__subject") != ""))
    # other rows take a group each, so that no group is made of all of them
    group = Window.partitionBy(F.when(F.col("__in"), F.col("__author")), F.when(F.col("__in"), F.col("__subject")), F.when(~F.col("__in"), F.col(row)))
    root = F.first(F.struct(F.col("__version").alias("v"), F.col("message_id").alias("id"))).over(group.orderBy("__version", F.col("date").asc_nulls_last(), row))
    linked = keyed.withColumn("__root", root).withColumn("first_version_message_id", F.when(F.col("__in") & (F.col("__root.v") == 1), F.coalesce(F.when(X.strip(F.col("__root.id")) != "", F.col("__root.id")), F.lit(""))).otherwise(F.lit("")))
    return linked.select(*[F.col(f"`{n}`") for n in names], "first_version_message_id")


def last_patches(df: DataFrame, row: str = "_row_order", thread: str = "_thread_id") -> DataFrame:
    """Adds is_last_patch: of the submissions of one thread and version (as text, so none and 1 differ) the one of the highest number in its series
    (1 if it has none), of these the last row."""
    version = F.coalesce(F.col("patch_version").cast("string"), F.lit("")) if "patch_version" in df.columns else F.lit("")
    number = F.coalesce(X.sequence_number(F.col("patchset_sequence_number")), F.lit(1)) if "patchset_sequence_number" in df.columns else F.lit(1)
    marked = df.withColumn("__sub", X.is_status_submission(df))
    group = Window.partitionBy(thread, F.when(F.col("__sub"), version), F.when(~F.col("__sub"), F.col(row))).orderBy(number.desc(), F.col(row).desc())
    return marked.withColumn("is_last_patch", F.col("__sub") & (F.row_number().over(group) == 1)).drop("__sub")
