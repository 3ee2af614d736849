"""A table of messages made from ``conversations``, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COMMON = """
  c * 1000 + t AS _row_order, concat('list', c % 3) AS list,
  CASE WHEN NOT (c % 29 = 7 AND t = 1) THEN concat('<m', c, '.', t, '@l>') END AS message_id,
  CASE WHEN t = 0 AND c % 13 = 5 THEN concat('<phantom.', c % 3, '@x>') WHEN t > 0 AND c % 4 = 0 THEN concat('<m', c, '.0@l>') WHEN t > 0 THEN concat('<m', c, '.', t - 1, '@l>') END AS in_reply_to,
  CASE WHEN t >= 2 AND c % 2 = 0 THEN concat('<m', c, '.0@l> <m', c, '.', t - 1, '@l>') END AS ref_item,
  c % 4 <> 3 AS has_patch_tag,
  CASE WHEN c % 3 <> 0 THEN 1 + c % 3 END AS patch_version,
  CASE WHEN c % 4 = 0 AND t <= 3 THEN concat(t, '/3') WHEN c % 4 = 1 AND t = 0 THEN '1/1' END AS patchset_sequence_number,
  (c % 4 = 0 AND t <= 3) OR (c % 4 IN (1, 2) AND t = 0) AS is_patch,
  concat('topic', c % 7, ': rework') AS untagged_subject,
  CASE WHEN (c % 4 = 0 AND t <= 3) OR (c % 4 IN (1, 2) AND t = 0) THEN concat('[PATCH v', CASE WHEN c % 3 <> 0 THEN 1 + c % 3 ELSE 1 END, '] topic', c % 7, ': rework')
       ELSE concat(CASE WHEN t % 5 = 4 THEN '  Re: ' ELSE 'Re: ' END, 'topic', c % 7, ': rework') END AS subject,
  concat('Dev <dev', CASE WHEN (c % 4 = 0 AND t <= 3) OR (c % 4 IN (1, 2) AND t = 0) OR t = 0 THEN c % 5 ELSE 5 + (c + 3 * t) % 6 END, '@',
         CASE (7 * c + t) % 9 WHEN 0 THEN 'usp.br' WHEN 1 THEN 'ime.usp.br' WHEN 2 THEN 'notusp.br' WHEN 3 THEN 'usp.br.example.com' WHEN 4 THEN 'USP.BR' ELSE 'kernel.example.org' END, '>') AS sender,
  CASE WHEN (c + t) % 23 = 0 THEN 'not a date' ELSE concat('2024-01-', lpad(concat(1 + c % 28, ''), 2, '0'), ' ', lpad(concat((2 * t + 1) % 24, ''), 2, '0'), ':00:00') END AS date_text,
  concat(coalesce(text, ''), CASE (8 * c + t) % 17 WHEN 0 THEN ' duplicate code here' WHEN 1 THEN concat(' identical', {lf}, 'function') WHEN 2 THEN ' code duplication' WHEN 3 THEN ' copy-paste'
         WHEN 4 THEN ' DEDUPLICATED Macro' WHEN 5 THEN ' duplicate' WHEN 6 THEN ' cloned block' WHEN 7 THEN ' same checks' ELSE '' END) AS raw_body,
  CASE (8 * c + t) % 17 WHEN 5 THEN 'code: x = 1' WHEN 8 THEN 'int a;' END AS code_item, c, t
  FROM (SELECT conv_id AS c, turn AS t, text FROM {table} WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
"""

#: A CTE ``m`` for DuckDB; ``date`` is a timestamp, ``node`` the message's own id.
SQL_MESSAGES = f"""m AS (SELECT *, try_cast(date_text AS TIMESTAMP) AS date, coalesce(trim(message_id, '<>'), concat('__row_', _row_order, '__')) AS node FROM (SELECT {_COMMON.format(lf='chr(10)', table='conversations')}))"""

#: Adds ``thr`` (_row_order, thread): the least row of each component, by closure.
SQL_THREADS = f"""WITH RECURSIVE {SQL_MESSAGES},
links AS (SELECT _row_order, node, trim(in_reply_to, '<>') AS other FROM m WHERE in_reply_to IS NOT NULL
          UNION ALL SELECT _row_order, node, unnest(regexp_extract_all(ref_item, '<([^<> ]+)>', 1)) FROM m WHERE ref_item IS NOT NULL),
e AS (SELECT node AS a, other AS b FROM links UNION SELECT other, node FROM links),
reach AS (SELECT node AS x, node AS y FROM m UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
thr AS (SELECT p._row_order, min(q._row_order) AS thread FROM m p JOIN reach ON reach.x = p.node JOIN m q ON q.node = reach.y GROUP BY p._row_order)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the columns of a mailing-list table; ``date`` is text and may be none."""
    source = "{source}"
    made = spark.sql(f"SELECT {_COMMON.format(lf='char(10)', table=source)}", source=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return made.selectExpr(
        "_row_order", "list", "message_id", "in_reply_to", "CASE WHEN ref_item IS NOT NULL THEN array(ref_item) END AS `references`", "has_patch_tag", "CAST(patch_version AS INT) AS patch_version", "patchset_sequence_number",
        "untagged_subject", "subject", "sender AS `from`", "date_text AS date", "raw_body", "CASE WHEN code_item IS NOT NULL THEN array(code_item) END AS code", "c", "t",
    )
