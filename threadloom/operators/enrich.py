"""Values from outside for keys and threads: statuses and labels, kept in tables so that nothing is asked twice.

A *resolver* gives a state for each id of a pandas Series; a *classifier* gives a label for a thread's text. Both run in ``mapInPandas`` over one row for each
key or thread that the cache table lacks, so what is asked is spread over executors, and ``workers`` bounds how many ask at once. With a ``journal``, a
folder that all executors share, each task writes its answers there every ``SAVE_EVERY`` of them and when it fails, and :func:`sources.tables.load_cache`
reads them, so an interrupted run asks again for little.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.threads import numbered
from threadloom.storage import by_merge

LABELS = ("CODE_DUPLICATION", "INSUFFICIENT_INFORMATION", "NOT_CODE_DUPLICATION", "REDUNDANCY_REMOVAL")
STATE_NAMES = {1: "new", 3: "accepted", 4: "rejected", 9: "superseded"}


def with_retries(call: Callable, attempts: int = 4, base: float = 1.0, sleep: Callable = time.sleep) -> Callable:
    """``call`` again after 1, 2, 4, ... times ``base`` seconds; the last failure is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except (OSError, TimeoutError):
                if k + 1 == attempts:
                    raise
                sleep(base * 2**k)

    return run


def state_name(c: Column) -> Column:
    """The name of a numeric state; one without a name is its number as text."""
    names = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c.cast("int")), c.cast("string"))


def state_of_list(json: Column, list_id: str) -> Column:
    """The state of the first element of a JSON array whose project has that list id; null for other text."""
    items = F.from_json(json, "array<struct<state: string, project: struct<list_id: string>>>")
    return F.get(F.filter(items, lambda p: p["project"]["list_id"] == list_id), F.lit(0))["state"]


#: Answers that a task holds before it writes them to the journal.
SAVE_EVERY = 50


def lookup_counts(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(subsystem, n_keys, n_cached, n_asked): how many distinct keys the cache answers, and how many must be asked for."""
    known = keys.distinct().join(by_merge(cache.select("subsystem", "msgid").distinct().withColumn("__known", F.lit(True))), ["subsystem", "msgid"], "left")
    return known.groupBy("subsystem").agg(F.count("*").alias("n_keys"), F.count("__known").alias("n_cached"), F.count_if(F.col("__known").isNull()).alias("n_asked"))


def by_subsystem(resolvers: dict[str, Callable[[str], str | None]]) -> Callable[[str, str], str | None]:
    """One resolver of several, chosen by the key's subsystem; one without a resolver raises."""

    def run(subsystem, msgid):
        if subsystem not in resolvers:
            raise ValueError(f"no resolver for {subsystem}; there are: {', '.join(sorted(resolvers))}")
        return resolvers[subsystem](msgid)

    return run


def _answers(part, ask: Callable, names: list[str], pause: float, journal: str | None) -> list:
    """``ask`` of each row of a pandas part. What was answered is in the journal even if a later row raises."""
    from threadloom.sources.tables import journal_write

    answers, saved = [], 0
    rows = list(part.itertuples(index=False))

    def save():
        nonlocal saved
        if journal and len(answers) > saved:
            journal_write(journal, [dict(zip(names, (*key, a))) for key, a in zip(part[names[:-1]].itertuples(index=False, name=None), answers)][saved:])
        saved = len(answers)

    try:
        for row in rows:
            answers.append(ask(row))
            if len(answers) - saved >= SAVE_EVERY:
                save()
            if pause:
                time.sleep(pause)
    finally:
        save()
    return answers


def lookup(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (subsystem, msgid). A cached null is a hit."""
    cache = by_merge(cache)
    return keys.join(cache, ["subsystem", "msgid"]), keys.join(cache, ["subsystem", "msgid"], "left_anti")


def resolve(misses: DataFrame, resolver: Callable, workers: int = 8, pause: float = 0.0, journal: str | None = None) -> DataFrame:
    """(subsystem, msgid, state) by ``resolver(subsystem, msgid)``, None for not found; a failure after its retries is raised."""

    def run(parts):
        for part in parts:
            states = _answers(part, lambda r: resolver(r[0], r[1]), ["subsystem", "msgid", "state"], pause, journal)
            yield part.assign(state=states).astype({"state": object})

    return misses.select("subsystem", "msgid").repartition(workers).mapInPandas(run, "subsystem string, msgid string, state string")


def accepted(df: DataFrame, states: DataFrame, subsystem: str) -> DataFrame:
    """Adds ``accepted``: the state of each last patch that has an id and a known state; empty for every other row."""
    known = states.filter(F.col("subsystem") == subsystem).select(F.col("msgid").alias("__id"), F.col("state").alias("__state"))
    # other rows keep their ids and fail the condition: as nulls they would be one key, and that one task's
    asked = F.nullif(X.plain_id(F.col("message_id")), F.lit(""))
    return df.withColumn("__asked", asked).join(by_merge(known), F.col("is_last_patch") & (F.col("__asked") == F.col("__id")), "left").withColumn("accepted", F.coalesce("__state", F.lit(""))).drop("__asked", "__id", "__state")


def histogram(df: DataFrame, name: str = "accepted") -> DataFrame:
    return df.groupBy(F.when(F.col(name) == "", "(not found)").otherwise(F.col(name)).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def prompts(df: DataFrame, thread: str = "_thread_id", row: str = "_row_order", most: int = 60, limit: int = 4000) -> DataFrame:
    """(thread, n_messages, prompt): the first ``most`` messages of each thread as one text, each field cut at ``limit``."""
    field = lambda n: X.cut_text(F.array_join(X.as_list(df, n), "\n"), limit)
    shown = df.withColumns({"__s": field("subject"), "__b": field("raw_body"), "__c": field("code")})
    placed = numbered(shown, [F.col(row)], thread)
    bar = "=" * 48
    head = F.concat(F.lit(f"\n{bar}\nMESSAGE "), F.col("position").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(f"\n{bar}\n"))
    text = F.concat(head, F.lit("\nSubject:\n"), "__s", F.lit("\n\nEmail body:\n"), "__b", F.lit("\n\nPatch/code:\n"), "__c", F.lit("\n"))
    parts = placed.filter(F.col("position") <= most).groupBy(thread).agg(F.max("total").alias("n_messages"), F.array_sort(F.collect_list(F.struct("position", text.alias("t")))).alias("parts"))
    note = F.when(F.col("n_messages") > most, f"(Showing only the first {most} messages.)\n").otherwise("")
    return parts.select(thread, "n_messages", F.concat(F.lit("THREAD with "), F.col("n_messages").cast("string"), F.lit(" message(s).\n"), note, F.array_join(F.transform("parts", lambda p: p["t"]), "")).alias("prompt"))


def allowed(c: Column) -> Column:
    """The label, if it is one of the four; else that there was not enough to tell."""
    return F.when(X.strip(c).isin(*LABELS, "ERROR"), X.strip(c)).otherwise("INSUFFICIENT_INFORMATION")


def classify(texts: DataFrame, classifier: Callable[[str], str], thread: str = "_thread_id", workers: int = 8, pause: float = 0.0, journal: str | None = None) -> DataFrame:
    """(thread, label) of (thread, prompt); a classifier that raises gives ERROR."""
    kind = dict(texts.dtypes)[thread]

    def ask(row):
        try:
            found = str(classifier(row[1])).strip()
        except Exception:  # any failure of the outside service is a value
            return "ERROR"
        return found if found in LABELS else "INSUFFICIENT_INFORMATION"

    def run(parts):
        for part in parts:
            yield part[[thread]].assign(label=_answers(part[[thread, "prompt"]], ask, [thread, "label"], pause, journal))

    raw = texts.select(thread, "prompt").repartition(workers).mapInPandas(run, f"`{thread}` {kind}, label string")
    return raw.select(thread, allowed(F.col("label")).alias("label"))


TAXONOMY = """You are given one discussion of a software patch. Say what it has to do with duplicated code.

CODE_DUPLICATION: the discussion is about code that repeats other code: it is pointed out, added, or argued over.
REDUNDANCY_REMOVAL: the patch takes repeated code away, by sharing, moving or deleting it.
NOT_CODE_DUPLICATION: words like "duplicate" occur, but of data, messages, files or names, not of code.
INSUFFICIENT_INFORMATION: the discussion is too short or too unclear to tell.

Answer with one of the four names and nothing else.

"""


def with_taxonomy(model: Callable[[str], str]) -> Callable[[str], str]:
    """A classifier out of a model that answers a prompt: the labels are explained before each thread."""
    return lambda thread: model(TAXONOMY + thread)


def rule_classifier(prompt: str) -> str:
    """An offline stand-in for an outside model."""
    low = prompt.lower()
    if "duplicate code" in low or "cloned block" in low:
        return "CODE_DUPLICATION"
    if "deduplicated" in low:
        return "REDUNDANCY_REMOVAL"
    return "NOT_CODE_DUPLICATION" if "code" in low.replace("patch/code:", "") else "unsure"


def label_rows(df: DataFrame, labels: DataFrame, thread: str = "_thread_id") -> DataFrame:
    """Adds duplication_classification; null for threads without a label."""
    named = labels.select(F.col(thread).alias("__thread"), F.col("label").alias("duplication_classification"))
    return df.join(by_merge(named), F.col(thread) == F.col("__thread"), "left").drop("__thread")
