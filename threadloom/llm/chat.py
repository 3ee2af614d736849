"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and
only that reply is trained on. A turn is written ``<|role|>``, line break, text, line break;
``<|`` inside a text or role becomes ``< |``, and in a role ``|>`` becomes ``| >`` and a line
break a blank, so nothing inside a turn can pose as another. The characters
``train_start`` to ``train_end`` of ``prompt || completion`` are the trainable ones; with
separate encoding of the two, :func:`token_examples` gives the same in tokens.

The turns of a conversation meet by one shuffle on ``conv_id``; a running window then gives
each reply its context, so rows stream and spill, and no task holds all examples of a long
conversation at once.

Defined results: null conv_id or turn: the row has no place and is left out. Null or blank
role: shown as ``unknown``. Roles are compared trimmed and in lower case. Null text: as empty. An assistant
turn without text (nothing but blanks) is no example, but stays in later contexts. Rows that
repeat (conv_id, turn, role, text) count once. Of turns with one number the assistant's come
last, then by role and text. A reply without any turn before it has an empty context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import DEFAULT_VOCABULARY, encoder
from .runtime import id_as_long

_CUE = "<|assistant|>\n"


def _shown_role(role: Column) -> Column:
    plain = F.lower(F.trim(F.translate(role, "\n\r\t", "   ")))
    return F.coalesce(F.nullif(F.replace(F.replace(plain, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("")), F.lit("unknown"))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, prompt, completion, train_start, train_end)."""
    rows = conversations.select(
        id_as_long(conversations, "conv_id").alias("conv_id"),
        id_as_long(conversations, "turn").alias("turn"),
        _shown_role(F.col("role").cast("string")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).dropna(subset=["conv_id", "turn"])
    # by conv_id first: this also clusters the four columns, so that there is one shuffle
    rows = rows.repartition("conv_id").dropDuplicates(["conv_id", "turn", "role", "text"])
    shown = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    before = Window.partitionBy("conv_id").orderBy("turn", F.col("role") == "assistant", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    context = F.collect_list(shown).over(before)
    return (
        rows.withColumn("context", context)
        .filter((F.col("role") == "assistant") & (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
        .select("conv_id", "turn", F.size("context").cast("int").alias("n_context"), F.concat(F.array_join("context", ""), F.lit(_CUE)).alias("prompt"), F.concat("text", F.lit("\n")).alias("completion"))
        .select("*", F.length("prompt").cast("int").alias("train_start"), (F.length("prompt") + F.length("completion")).cast("int").alias("train_end"))
    )


def token_examples(conversations: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(conv_id, turn, input_ids, n_masked): the ids of prompt, completion and end of text; the
    first ``n_masked`` of them, the prompt's, have no loss."""

    def encode(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            ids, masked = [], []
            for a, b in zip(batch.column("prompt").to_pylist(), batch.column("completion").to_pylist()):
                head = bpe.ids(a)
                ids.append([*head, *bpe.ids(b), bpe.end_of_text])
                masked.append(len(head))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(ids, pa.list_(pa.int32())), pa.array(np.array(masked, np.int32))], names=["conv_id", "turn", "input_ids", "n_masked"])

    return prefix_examples(conversations).select("conv_id", "turn", "prompt", "completion").mapInArrow(encode, "conv_id bigint, turn bigint, input_ids array<int>, n_masked int")


EXAMPLES_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(nullif(replace(replace(lower(trim(translate(role, chr(10) || chr(13) || chr(9), '   '))), '<|', '< |'), '|>', '| >'), ''), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT *, count(*) OVER w AS n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER w AS context FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role = 'assistant', role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT conv_id, turn, CAST(n AS INT) AS n_context, coalesce(context, '') || '<|assistant|>' || chr(10) AS prompt, text || chr(10) AS completion
      FROM c WHERE role = 'assistant' AND trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> '')
SELECT *, CAST(length(prompt) AS INT) AS train_start, CAST(length(prompt) + length(completion) AS INT) AS train_end FROM e
"""
