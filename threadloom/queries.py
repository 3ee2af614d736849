"""The registered queries over the generated tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.fixtures import SQL_MESSAGES, SQL_THREADS, messages
from threadloom.functions import text as X
from threadloom.operators import enrich, patches
from threadloom.operators import threads as T
from threadloom.plans import analyses
from threadloom.shipping import ship
from threadloom.sources import tables
from threadloom.storage import by_merge, fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
M = f"WITH {SQL_MESSAGES}"
_RX = {k: "(?i)" + v for k, v in X.PATTERNS.items()}


def query(sql: str):
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return run

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.with_threads(messages(spark, sf_dir))


def _hit(mode: str = "as_written") -> str:
    rx = _RX[mode]
    return f"regexp_matches(concat_ws(chr(10), subject, untagged_subject), '{rx}') AS s, regexp_matches(concat_ws(chr(10), raw_body, code_item), '{rx}') AS b"


_FLAGS = f"f AS (SELECT *, s OR b AS hit FROM (SELECT m.*, thr.thread, {_hit()} FROM m JOIN thr USING (_row_order))), good AS (SELECT thread FROM f GROUP BY thread HAVING bool_or(hit))"
TF = f"{SQL_THREADS}, {_FLAGS}"


# --- threads -----------------------------------------------------------------


@query(f"{SQL_THREADS} SELECT _row_order, thread FROM thr")
def thread_components(spark, sf_dir):
    return T.thread_ids(messages(spark, sf_dir)).withColumnRenamed("row", "_row_order")


_SPLIT = """m2 AS (SELECT *, CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM m),
links2 AS (SELECT side, node, trim(in_reply_to, '<>') AS other FROM m2 WHERE in_reply_to IS NOT NULL
           UNION ALL SELECT side, node, unnest(regexp_extract_all(ref_item, '<([^<> ]+)>', 1)) FROM m2 WHERE ref_item IS NOT NULL),
e2 AS (SELECT side, node AS a, other AS b FROM links2 UNION SELECT side, other, node FROM links2),
reach2 AS (SELECT side, node AS x, node AS y FROM m2 UNION SELECT reach2.side, reach2.x, e2.b FROM reach2 JOIN e2 ON reach2.y = e2.a AND reach2.side = e2.side)"""


@query(f"{SQL_THREADS}, {_SPLIT} SELECT p._row_order, min(q._row_order) AS thread FROM m2 p JOIN reach2 ON reach2.x = p.node AND reach2.side = p.side JOIN m2 q ON q.node = reach2.y AND q.side = reach2.side GROUP BY p._row_order")
def thread_components_by_list(spark, sf_dir):
    """All messages, those of one conversation in two lists: ids that both lists name don't join them."""
    df = messages(spark, sf_dir).withColumn("list", F.expr("CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END"))
    return T.thread_ids(df, scope="list").withColumnRenamed("row", "_row_order")


_TWICE = 1_000_000_000_000  # rows of the second list that holds each message


@query(f"{SQL_THREADS} SELECT CAST(_row_order AS BIGINT) AS _row_order, CAST(thread AS BIGINT) AS thread FROM thr UNION ALL SELECT {_TWICE} + _row_order, {_TWICE} + thread FROM thr")
def thread_components_each_list(spark, sf_dir):
    """All messages, each in a second list too: lists with equal ids stay apart."""
    df = messages(spark, sf_dir).withColumn("_row_order", F.col("_row_order").cast("bigint"))
    twice = df.unionAll(df.withColumn("_row_order", F.col("_row_order") + _TWICE).withColumn("list", F.concat("list", F.lit("-copy"))))
    return T.thread_ids(twice, scope="list").withColumnRenamed("row", "_row_order")


@query(f"""{SQL_THREADS} SELECT thread, count(*) AS n_messages, count(DISTINCT c) AS n_conversations FROM thr JOIN m USING (_row_order) GROUP BY thread HAVING count(DISTINCT c) > 1""")
def thread_components_phantom(spark, sf_dir):
    """Threads that only an id without a message holds together."""
    return _threaded(spark, sf_dir).groupBy(F.col("_thread_id").alias("thread")).agg(F.count("*").alias("n_messages"), F.count_distinct("c").alias("n_conversations")).filter("n_conversations > 1")


@query(f"{M} SELECT _row_order, s AS subject_match, b AS content_match, s OR b AS any_match FROM (SELECT *, {_hit()} FROM m)")
def dup_match_flags(spark, sf_dir):
    return T.match_flags(messages(spark, sf_dir)).select("_row_order", F.col("_dup_subject_match").alias("subject_match"), F.col("_dup_content_match").alias("content_match"), F.col("_dup_match").alias("any_match"))


@query(f"{M} SELECT _row_order, s OR b AS any_match FROM (SELECT *, {_hit('intended')} FROM m)")
def dup_match_intended(spark, sf_dir):
    return T.match_flags(messages(spark, sf_dir), "intended").select("_row_order", F.col("_dup_match").alias("any_match"))


@query(f"{TF} SELECT _row_order, thread, message_id, subject, hit FROM f WHERE thread IN (SELECT thread FROM good)")
def matching_threads_rows(spark, sf_dir):
    """The flagship: every message of the threads with a match."""
    return analyses.matching_rows(messages(spark, sf_dir)).select("_row_order", F.col("_thread_id").alias("thread"), "message_id", "subject", F.col("_dup_match").alias("hit"))


@query(f"{TF} SELECT _row_order, thread, hit FROM f WHERE thread IN (SELECT thread FROM good)")
def matching_threads_of_many_files(spark, sf_dir):
    """The same over a table of several files, of which rows are numbered across all."""
    where = fresh_dir(spark, "files")
    df = messages(spark, sf_dir)
    df.withColumnRenamed("_row_order", "was").repartitionByRange(5, "was").sortWithinPartitions("was").write.parquet(where)
    read = tables.with_row_order(tables.read_table(spark, where))
    kept = analyses.matching_rows(read)
    first = read.select(F.col("_row_order").alias("_thread_id"), F.col("was").alias("thread"))
    return kept.join(by_merge(first), "_thread_id").select(F.col("was").alias("_row_order"), "thread", F.col("_dup_match").alias("hit"))


_SAMPLE = "n AS (SELECT count(*) AS n FROM good), pick AS (SELECT thread FROM (SELECT thread, row_number() OVER (ORDER BY md5(concat(thread, ':0')), thread) AS r FROM good), n WHERE r <= greatest(1, ceil(0.1 * n.n)))"


@query(f"""{TF}, {_SAMPLE} SELECT count(*) AS emails_before, count(*) FILTER (WHERE thread IN (SELECT thread FROM good)) AS emails_after,
count(*) FILTER (WHERE thread NOT IN (SELECT thread FROM good)) AS emails_removed, count(DISTINCT thread) AS threads_before, (SELECT count(*) FROM good) AS threads_after,
count(DISTINCT thread) - (SELECT count(*) FROM good) AS threads_removed, round(100.0 * (SELECT count(*) FROM good) / count(DISTINCT thread), 2) AS kept_pct,
round(100.0 * (count(DISTINCT thread) - (SELECT count(*) FROM good)) / count(DISTINCT thread), 2) AS removed_pct, (SELECT count(*) FROM pick) AS threads_flagged FROM f""")
def filter_stats(spark, sf_dir):
    return analyses.filter_threads(messages(spark, sf_dir)).stats


@query(f"{TF} SELECT thread, _row_order, subject FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY date NULLS LAST, _row_order) AS r FROM f WHERE thread IN (SELECT thread FROM good)) WHERE r = 1")
def first_email_per_thread(spark, sf_dir):
    return T.first_messages(analyses.matching_rows(messages(spark, sf_dir))).select(F.col("_thread_id").alias("thread"), "_row_order", "subject")


@query(f"{TF}, {_SAMPLE} SELECT _row_order, thread IN (SELECT thread FROM pick) AS manual_verification FROM f")
def manual_sample(spark, sf_dir):
    flags = analyses.row_marks(messages(spark, sf_dir))
    return T.mark(flags, T.sample_threads(T.matching_threads(flags)), "_thread_id", "manual_verification").select("_row_order", "manual_verification")


# --- patches -----------------------------------------------------------------

_SUB = "has_patch_tag AND NOT starts_with(lower(trim(subject)), 're:')"
_SUB_STATUS = "has_patch_tag AND NOT starts_with(lower(subject), 're:')"


@query(f"{M} SELECT _row_order, {_SUB} AS submission, {_SUB_STATUS} AS status_submission FROM m")
def submissions(spark, sf_dir):
    df = messages(spark, sf_dir)
    return df.select("_row_order", X.is_submission(df).alias("submission"), X.is_status_submission(df).alias("status_submission"))


_AUTHOR, _SUBJECT = r"lower(regexp_extract(sender, '([\w.+-]+@[\w.-]+\.\w+)', 1))", r"lower(trim(regexp_replace(untagged_subject, '\s+', ' ', 'g')))"


@query(f"{M} SELECT _row_order, {_AUTHOR} AS author, {_SUBJECT} AS base_subject FROM m")
def author_subject_keys(spark, sf_dir):
    df = messages(spark, sf_dir)
    return df.select("_row_order", X.author_key(X.as_list(df, "from")).alias("author"), X.subject_key(F.col("untagged_subject"), F.col("subject")).alias("base_subject"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.collapse(F.col("text")), F.lit(None)).alias("collapsed"))


@query(f"{M} SELECT _row_order, coalesce(patch_version, 1) AS version, try_cast(nullif(regexp_extract(patchset_sequence_number, '^\\s*(\\d+)\\s*/\\s*\\d+', 1), '') AS INT) AS seq FROM m")
def patch_version_seq(spark, sf_dir):
    return messages(spark, sf_dir).select("_row_order", X.patch_version(F.col("patch_version")).cast("int").alias("version"), X.sequence_number(F.col("patchset_sequence_number")).alias("seq"))


@query(f"{M} SELECT _row_order, node, trim(in_reply_to, '<>') AS parent, len(regexp_extract_all(coalesce(ref_item, ''), '<([^<> ]+)>', 1)) AS n_references FROM m")
def clean_ids(spark, sf_dir):
    df = messages(spark, sf_dir)
    return df.select("_row_order", T.node(df).alias("node"), X.message_id(X.as_list(df, "in_reply_to")).alias("parent"), F.size(X.message_ids(X.as_list(df, "references"))).cast("bigint").alias("n_references"))


@query(f"""{TF}, k AS (SELECT *, {_AUTHOR} AS au, {_SUBJECT} AS su, {_SUB} AS sub FROM f WHERE thread IN (SELECT thread FROM good)),
r AS (SELECT _row_order, sub, first_value(coalesce(patch_version, 1)) OVER w AS v, first_value(message_id) OVER w AS id FROM k WHERE sub WINDOW w AS (PARTITION BY au, su ORDER BY coalesce(patch_version, 1), date NULLS LAST, _row_order))
SELECT k._row_order, CASE WHEN r.v = 1 THEN coalesce(r.id, '') ELSE '' END AS first_version_message_id FROM k LEFT JOIN r ON r._row_order = k._row_order""")
def version_links(spark, sf_dir):
    return analyses.filter_threads(messages(spark, sf_dir)).kept.select("_row_order", "first_version_message_id")


_LAST = f"""l AS (SELECT m.*, thr.thread, {_SUB_STATUS} AS sub, coalesce(try_cast(nullif(split_part(patchset_sequence_number, '/', 1), '') AS INT), 1) AS seq FROM m JOIN thr USING (_row_order)),
lp AS (SELECT *, sub AND row_number() OVER (PARTITION BY thread, sub, coalesce(CAST(patch_version AS VARCHAR), '') ORDER BY seq DESC, _row_order DESC) = 1 AS last FROM l)"""


@query(f"{SQL_THREADS}, {_LAST} SELECT _row_order, last AS is_last_patch FROM lp")
def last_patch(spark, sf_dir):
    return patches.last_patches(_threaded(spark, sf_dir)).select("_row_order", "is_last_patch")


def _state_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table: of every fourth message there is none, of another fourth it is null."""
    df = messages(spark, sf_dir).filter("(c + t) % 4 <> 3 AND message_id IS NOT NULL")
    return df.select(F.lit("iio").alias("subsystem"), X.plain_id(F.col("message_id")).alias("msgid"), F.when(F.expr("(c + t) % 4 <> 2"), enrich.state_name(F.expr("(c + t) % 11"))).alias("state"))


_STATE = "CASE (c + t) % 11 WHEN 1 THEN 'new' WHEN 3 THEN 'accepted' WHEN 4 THEN 'rejected' WHEN 9 THEN 'superseded' ELSE CAST((c + t) % 11 AS VARCHAR) END"
_ACCEPTED = f"CASE WHEN last AND message_id IS NOT NULL AND (c + t) % 4 < 2 THEN {_STATE} WHEN last AND message_id IS NOT NULL AND (c + t) % 4 = 3 THEN 'asked' ELSE '' END"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.status(_threaded(spark, sf_dir), "iio", _state_cache(spark, sf_dir), lambda subsystem, msgid: "asked", pause=0)[0]


@query(f"{SQL_THREADS}, {_LAST} SELECT _row_order, {_ACCEPTED} AS accepted FROM lp")
def accepted_status(spark, sf_dir):
    return _status(spark, sf_dir).select("_row_order", "accepted")


@query(f"""{SQL_THREADS}, {_LAST}, k AS (SELECT DISTINCT node, (c + t) % 4 <> 3 AS known FROM lp WHERE last AND message_id IS NOT NULL)
SELECT 'iio' AS subsystem, count(*) AS n_keys, count(*) FILTER (WHERE known) AS n_cached, count(*) FILTER (WHERE NOT known) AS n_asked FROM k HAVING count(*) > 0""")
def lookup_counts(spark, sf_dir):
    return enrich.lookup_counts(analyses.status_keys(_threaded(spark, sf_dir), "iio"), _state_cache(spark, sf_dir))


@query(f"{SQL_THREADS}, {_LAST} SELECT CASE WHEN a = '' THEN '(not found)' ELSE a END AS accepted, count(*) AS n FROM (SELECT {_ACCEPTED} AS a FROM lp) GROUP BY 1")
def status_histogram(spark, sf_dir):
    return enrich.histogram(_status(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, CASE WHEN k % 3 = 0 THEN NULL ELSE concat('s', k) END AS state FROM e""")
def json_state_pick(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    answer = F.concat(F.lit('[{"state":"no","project":{"list_id":"other"}},{"state":"s'), k.cast("string"), F.lit('","project":{"list_id":"'), F.when(k % 3 == 0, "none").otherwise("ours"), F.lit('"}}]'))
    return _read(spark, sf_dir, "events").select("event_id", k.alias("k"), enrich.state_of_list(answer, "ours").alias("state"))


@query(f"""{M}, u AS (SELECT _row_order, concat('/patch/', c * 8 + t, CASE WHEN t % 2 = 0 THEN '/' ELSE '' END, CASE WHEN t % 3 = 0 THEN 'mbox' ELSE '' END) AS there, concat('/patch/msgid/', url_encode(node), '/') AS path FROM m)
SELECT _row_order, path, nullif(regexp_extract(CASE WHEN _row_order % 5 = 0 THEN '/nowhere' ELSE there END, '/patch/(\\d+)/?', 1), '') AS patch FROM u""")
def tracker_paths(spark, sf_dir):
    """The address of a message in a tracker, and the patch number in the address that it points to."""
    df = messages(spark, sf_dir)
    there = F.expr("CASE WHEN _row_order % 5 = 0 THEN '/nowhere' ELSE concat('/patch/', c * 8 + t, CASE WHEN t % 2 = 0 THEN '/' ELSE '' END, CASE WHEN t % 3 = 0 THEN 'mbox' ELSE '' END) END")
    return df.select("_row_order", F.concat(F.lit("/patch/msgid/"), X.url_path(T.node(df)), F.lit("/")).alias("path"), X.patch_id_of_url(there).alias("patch"))


# --- labels ------------------------------------------------------------------

_CUT = lambda c: f"CASE WHEN length({c}) > 4000 THEN concat(left({c}, 4000), chr(10), '[...truncated...]') ELSE coalesce({c}, '') END"
_PROMPT = f"""p AS (SELECT m.*, thread, row_number() OVER (PARTITION BY thread ORDER BY _row_order) AS i, count(*) OVER (PARTITION BY thread) AS n FROM m JOIN thr USING (_row_order)),
pr AS (SELECT thread, max(n) AS n_messages, concat('THREAD with ', max(n), ' message(s).', chr(10), CASE WHEN max(n) > 60 THEN concat('(Showing only the first 60 messages.)', chr(10)) ELSE '' END,
string_agg(concat(chr(10), repeat('=', 48), chr(10), 'MESSAGE ', i, ' of ', n, chr(10), repeat('=', 48), chr(10), chr(10), 'Subject:', chr(10), {_CUT('subject')}, chr(10), chr(10), 'Email body:', chr(10), {_CUT('raw_body')}, chr(10), chr(10),
'Patch/code:', chr(10), {_CUT('code_item')}, chr(10)), '' ORDER BY i)) AS prompt FROM p WHERE i <= 60 GROUP BY thread)"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.prompts(_threaded(spark, sf_dir)).withColumnRenamed("_thread_id", "thread")


@query(f"{SQL_THREADS}, {_PROMPT} SELECT thread, n_messages, length(prompt) AS n_chars, md5(prompt) AS digest FROM pr")
def thread_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).select("thread", "n_messages", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


_LABEL = """lb AS (SELECT thread, CASE WHEN contains(lower(prompt), 'duplicate code') OR contains(lower(prompt), 'cloned block') THEN 'CODE_DUPLICATION' WHEN contains(lower(prompt), 'deduplicated') THEN 'REDUNDANCY_REMOVAL'
WHEN contains(replace(lower(prompt), 'patch/code:', ''), 'code') THEN 'NOT_CODE_DUPLICATION' ELSE 'INSUFFICIENT_INFORMATION' END AS label FROM pr)"""


@query(f"{SQL_THREADS}, {_PROMPT}, {_LABEL} SELECT _row_order, label AS duplication_classification FROM thr JOIN lb USING (thread)")
def thread_labels(spark, sf_dir):
    return analyses.classify(_threaded(spark, sf_dir), enrich.rule_classifier, pause=0)[0].select("_row_order", "duplication_classification")


@query(f"{SQL_THREADS}, {_PROMPT}, {_LABEL} SELECT count(DISTINCT thread) AS labelled_threads, count(label) AS labelled_messages, count(*) AS messages FROM thr JOIN lb USING (thread)")
def classification_summary(spark, sf_dir):
    return analyses.classification_summary(analyses.classify(_threaded(spark, sf_dir), enrich.rule_classifier, pause=0)[0])


@query(f"""{SQL_THREADS}, h AS (SELECT DISTINCT thread FROM m JOIN thr USING (_row_order) WHERE regexp_matches(sender, '(?i)[\\w.+-]+@(?:[\\w.-]+\\.)?usp[.]br\\b'))
SELECT thread, _row_order, row_number() OVER w AS position, count(*) OVER (PARTITION BY thread) AS total FROM m JOIN thr USING (_row_order) WHERE thread IN (SELECT thread FROM h) WINDOW w AS (PARTITION BY thread ORDER BY date NULLS LAST, _row_order)""")
def sender_domain_threads(spark, sf_dir):
    return analyses.threads_with_sender(_threaded(spark, sf_dir), "usp.br").select(F.col("_thread_id").alias("thread"), "_row_order", "position", "total")


@query(f"""{SQL_THREADS}, a AS (SELECT thread FROM m JOIN thr USING (_row_order) WHERE c % 3 = 1 AND t = 1 GROUP BY thread ORDER BY min(_row_order) LIMIT 5)
SELECT thread, _row_order, row_number() OVER w AS position, replace(trim(raw_body), chr(13), chr(10)) AS body FROM m JOIN thr USING (_row_order) WHERE thread IN (SELECT thread FROM a) WINDOW w AS (PARTITION BY thread ORDER BY date NULLS LAST, _row_order)""")
def inspect_first_n_threads(spark, sf_dir):
    df = _threaded(spark, sf_dir).withColumn("flag", F.when(F.expr("c % 3 = 1 AND t = 1"), " Yes ").otherwise("t"))
    return analyses.inspect(df, 5, "flag").select(F.col("_thread_id").alias("thread"), "_row_order", "position", X.clean_text(F.col("raw_body")).alias("body"))


_RULE = "repeat('-', 40)"


@query(f"""{M} SELECT _row_order, concat_ws(chr(10), concat('Date: ', coalesce(date_text, '')), concat('From: ', sender), concat('Subject: ', trim(subject)),
CASE WHEN trim(untagged_subject) <> '' AND trim(untagged_subject) <> trim(subject) THEN concat('Without tags: ', trim(untagged_subject)) END, concat('Subject match: ', s), concat('Content match: ', b), concat('Any match: ', s OR b),
CASE WHEN trim(raw_body) <> '' THEN concat(chr(10), 'Body', chr(10), {_RULE}, chr(10), trim(raw_body)) END, CASE WHEN code_item IS NOT NULL THEN concat(chr(10), 'Code', chr(10), {_RULE}, chr(10), code_item) END,
CASE WHEN trim(raw_body) = '' AND code_item IS NULL THEN concat(chr(10), '(neither body nor code)') END) AS shown FROM (SELECT *, {_hit()} FROM m)""")
def message_listing(spark, sf_dir):
    df = T.match_flags(messages(spark, sf_dir))
    return df.select("_row_order", X.listing(df).alias("shown"))


# --- tables ------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM documents) AS n_rows, 5 AS n_columns, 'doc_id,text,lang,source,n_chars' AS columns")
def footer_metadata(spark, sf_dir):
    return tables.table_info(_read(spark, sf_dir, "documents"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents ORDER BY documents.doc_id LIMIT 10")
def view_head(spark, sf_dir):
    return tables.head(_read(spark, sf_dir, "documents").orderBy("doc_id"), 10, "doc_id, lang,")


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(left(text, 120), '... [+', length(text) - 120, ' chars]') ELSE text END AS shown FROM documents")
def view_truncated(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.cell(F.col("text")).alias("shown"))


_TRUTH = "CASE event_id % 7 WHEN 0 THEN ' True ' WHEN 1 THEN '1' WHEN 2 THEN 'YES' WHEN 3 THEN 'y' WHEN 4 THEN 't' WHEN 5 THEN 'no' END"


@query(f"WITH e AS (SELECT event_id, lower(trim({_TRUTH})) AS x FROM events) SELECT event_id, coalesce(x IN ('true', '1', 'yes', 'y', 't'), false) AS wide, coalesce(x IN ('true', '1', 'yes', 'y'), false) AS medium, coalesce(x = 'true', false) AS narrow FROM e")
def truthy_variants(spark, sf_dir):
    df = _read(spark, sf_dir, "events").selectExpr("event_id", f"{_TRUTH} AS x")
    return df.select("event_id", X.truthy(df, "x", X.WIDE).alias("wide"), X.truthy(df, "x", X.MEDIUM).alias("medium"), X.truthy(df, "x", X.NARROW).alias("narrow"))


@query(f"{M} SELECT _row_order, CAST(row_number() OVER (PARTITION BY list ORDER BY date NULLS LAST, _row_order) AS INT) AS place, strftime(date, '%Y-%m-%d %H:%M:%S') AS at FROM m")
def date_coerce_sort(spark, sf_dir):
    df = messages(spark, sf_dir)
    return df.withColumn("d", X.to_time(df, "date")).select("_row_order", F.row_number().over(Window.partitionBy("list").orderBy(F.col("d").asc_nulls_last(), "_row_order")).alias("place"), F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def distinct_first_seen(spark, sf_dir):
    return T.first_threads(_read(spark, sf_dir, "events"), 2**31 - 1, "user_id", "event_id").withColumnRenamed("first_row", "first_event")


@query("SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 35 + 1 AS INT) AS part FROM supplier")
def shard_assignment(spark, sf_dir):
    return tables.shard_of(_read(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", "part")


@query(f"{M} SELECT _row_order, subject FROM m WHERE list = 'list2'")
def partition_prune_scan(spark, sf_dir):
    where = fresh_dir(spark, "lists")
    tables.write_table(messages(spark, sf_dir), where, partition_by="list")
    return tables.read_list(spark, where, "list2").select("_row_order", "subject")


@query(f"{M} SELECT _row_order, message_id, subject, raw_body, CASE WHEN code_item IS NOT NULL THEN concat('[\"', code_item, '\"]') END AS code FROM m")
def csv_roundtrip(spark, sf_dir):
    where = fresh_dir(spark, "messages") + ".csv"
    tables.write_table(messages(spark, sf_dir).select("_row_order", "message_id", "subject", "raw_body", "code"), where)
    return tables.read_table(spark, where, "_row_order bigint, message_id string, subject string, raw_body string, code string")


@query(f"{M} SELECT CAST(row_number() OVER (ORDER BY _row_order) - 1 AS BIGINT) AS place, _row_order AS was FROM m")
def row_order_of_many_files(spark, sf_dir):
    """Rows of several files are numbered through, in the order of the files."""
    where = fresh_dir(spark, "files")
    messages(spark, sf_dir).select(F.col("_row_order").alias("was"), "subject").repartitionByRange(7, "was").sortWithinPartitions("was").write.parquet(where)
    return tables.with_row_order(tables.read_table(spark, where), "place").select("place", "was")


@query(f"{M} SELECT _row_order, message_id, raw_body FROM m")
def parquet_roundtrip(spark, sf_dir):
    where = fresh_dir(spark, "messages")
    tables.write_table(messages(spark, sf_dir), where)
    return tables.read_table(spark, where).select("_row_order", "message_id", "raw_body")


@query(f"{M} SELECT 'iio' AS subsystem, node AS msgid, CASE WHEN (c + t) % 4 <> 2 THEN {_STATE} END AS state FROM m WHERE message_id IS NOT NULL AND (c + t) % 4 <> 3")
def cache_roundtrip(spark, sf_dir):
    where = fresh_dir(spark, "cache")
    half = tables.load_cache(spark, where).unionByName(_state_cache(spark, sf_dir))
    tables.save_cache(half.filter("state IS NULL"), where)
    tables.save_cache(half, where)
    return tables.load_cache(spark, where)


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY user_id")
def event_user_any_error(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("SELECT l_orderkey, arg_min(l_partkey, row(l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS first_part FROM lineitem GROUP BY l_orderkey")
def order_argmin_ship(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("first_part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def lineitem_last_per_order(spark, sf_dir):
    last = F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x")
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(last).select("l_orderkey", "x.*")
