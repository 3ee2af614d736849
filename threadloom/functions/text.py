"""Column builders for messages. Every one takes and gives columns, so all stays in the JVM.

Where Python's ``str.strip``, ``\\w`` and ``\\s`` set the semantics, the patterns are Unicode aware (``(?U)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ID = r"<?([^<>\s]+@[^<>\s]+)>?"
_ADDRESS = r"(?U)([\w.+-]+@[\w.-]+\.\w+)"

_WHAT = ("cloned?", r"de[-_]?duplicat\w*", r"dedup\w*", r"duplicat\w*", "identical", "redundant", "repeated", "same")
_UNIT = ("block", "code", "function", "logic", "macro", "routine", "snippet")
_NAMED = rf"(?:{'|'.join(_WHAT)})\s+(?:{'|'.join(sorted((*_UNIT, 'check', 'implementation')))})"
_DONE = rf"(?:{'|'.join(_UNIT)})\s+(?:deduplication|dedup\b|duplication)"
_PASTE = r"copy\s*[-_]?\s*past(?:ed|e|ing)"
#: ``as_written``: the second and third alternatives run on into each other; ``intended``: they are alternatives.
PATTERNS = {
    "as_written": rf"\b(?:{_NAMED}|{_DONE}{_PASTE})\b",
    "intended": rf"\b(?:{_NAMED}|{_DONE}|{_PASTE})\b",
}


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number; a container is never missing unless it is null."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(kind_of(df, name), (T.FloatType, T.DoubleType)) else c.isNull()


def as_list(df: DataFrame, name: str) -> Column:
    """A column of text or of lists of text as a list without nulls; an absent one is empty. Decided when the plan is built."""
    empty = F.array().cast("array<string>")
    if name not in df.columns:
        return empty
    c = F.col(f"`{name}`")
    if isinstance(kind_of(df, name), T.ArrayType):
        return F.coalesce(F.filter(c.cast("array<string>"), lambda x: x.isNotNull()), empty)
    return F.when(missing(df, name), empty).otherwise(F.array(c.cast("string")))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends, in lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def message_id(items: Column) -> Column:
    """The id in the first item: the part that looks like an address, else all of it without angle brackets. Blank: null; ``<>``: empty."""
    first = blank_to_null(F.get(items, F.lit(0)))
    return F.when(first.rlike(_ID), F.regexp_extract(first, _ID, 1)).otherwise(F.btrim(first, F.lit("<>")))


def message_ids(items: Column) -> Column:
    """All ids of all items; an item in which nothing looks like an id counts as a whole."""
    some = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.flatten(F.transform(some, lambda x: F.when(x.rlike(_ID), F.regexp_extract_all(x, F.lit(_ID), F.lit(1))).otherwise(F.array(F.btrim(x, F.lit("<>"))))))


def plain_id(c: Column) -> Column:
    """Without blanks and angle brackets at the ends; null: empty."""
    return F.coalesce(strip(F.btrim(strip(c), F.lit("<>"))), F.lit(""))


def author_key(items: Column) -> Column:
    text = F.array_join(items, " ")
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(text, _ADDRESS, 1)), F.lit("")), collapse(text))


def subject_key(untagged: Column, subject: Column) -> Column:
    return F.coalesce(collapse(F.coalesce(F.when(strip(untagged) != "", untagged), subject)), F.lit(""))


def joined_text(df: DataFrame, names: list[str]) -> Column:
    """The values of those columns that exist, lists included, one to a line; so a match may run over two of them."""
    there = [F.col(f"`{n}`") if isinstance(kind_of(df, n), T.ArrayType) else F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.concat_ws("\n", *there) if there else F.lit("")


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + pattern)


def sender_in(domain: str, text: Column) -> Column:
    """Has an address at the domain or below it. A longer domain that continues after it counts too."""
    return F.coalesce(text.rlike(rf"(?iU)[\w.+-]+@(?:[\w.-]+\.)?{domain.replace('.', '[.]')}\b"), F.lit(False))


def truthy(df: DataFrame, name: str, words: tuple[str, ...] = ("true", "1", "yes", "y", "t")) -> Column:
    """As a flag: booleans as they are, text by ``words``, missing false."""
    if name not in df.columns:
        return F.lit(False)
    c = F.col(f"`{name}`")
    if isinstance(kind_of(df, name), T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*words), F.lit(False))


#: The three readings of a flag: of the filter, of the inspector, of the status step.
WIDE, MEDIUM, NARROW = ("true", "1", "yes", "y", "t"), ("true", "1", "yes", "y"), ("true",)


def is_submission(df: DataFrame) -> Column:
    """A patch that is no reply, for the filter: the subject is stripped first."""
    return truthy(df, "has_patch_tag", WIDE) & ~F.startswith(F.lower(strip(F.coalesce(F.col("subject"), F.lit("")))), F.lit("re:"))


def is_status_submission(df: DataFrame) -> Column:
    """The same for the status step: a narrower flag, and the subject is taken as it is."""
    return truthy(df, "has_patch_tag", NARROW) & ~F.startswith(F.lower(F.coalesce(F.col("subject"), F.lit(""))), F.lit("re:"))


def sequence_number(c: Column) -> Column:
    """n of ``n/m``, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+)\s*/\s*\d+", 1), F.lit("")).try_cast("int")


def patch_version(c: Column) -> Column:
    """The first number in it; 1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def clean_text(c: Column) -> Column:
    """Null as empty, line ends as line feeds, stripped."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))


def cut_text(c: Column, limit: int = 4000) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n[...truncated...]"))).otherwise(c)


def cell(c: Column, width: int = 120) -> Column:
    """For display: cut, with the number of characters left out."""
    c = c.cast("string")
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("... [+"), (F.length(c) - width).cast("string"), F.lit(" chars]"))).otherwise(c)


def listing(df: DataFrame) -> Column:
    """A message as text: heads, flags, body and code, as far as the table has such columns. The subject without tags only where it differs."""
    field = lambda n: clean_text(F.array_join(as_list(df, n), "\n"))
    there = lambda n: n in df.columns
    rule = "-" * 40
    subject, untagged, body, code = map(field, ("subject", "untagged_subject", "raw_body", "code"))
    heads = [F.concat(F.lit(f"{label}: "), F.coalesce(F.array_join(as_list(df, n), ", ") if n != "date" else F.col(n).cast("string"), F.lit(""))) for n, label in (("date", "Date"), ("from", "From"), ("to", "To"), ("cc", "Cc")) if there(n)]
    tags = F.when((untagged != "") & (untagged != subject), F.concat(F.lit("Without tags: "), untagged))
    flags = [F.concat(F.lit(f"{label} match: "), F.coalesce(F.col(n).cast("string"), F.lit("unknown"))) for n, label in (("_dup_subject_match", "Subject"), ("_dup_content_match", "Content"), ("_dup_match", "Any")) if there(n)]
    parts = [F.when(text != "", F.concat(F.lit(f"\n{name}\n{rule}\n"), text)) for name, text in (("Body", body), ("Code", code))]
    none = F.when((body == "") & (code == ""), F.lit("\n(neither body nor code)"))
    return F.concat_ws("\n", *heads, F.concat(F.lit("Subject: "), subject), tags, *flags, *parts, none)


def to_time(df: DataFrame, name: str) -> Column:
    """A timestamp; null where the text is none."""
    c = F.col(f"`{name}`")
    return c if isinstance(kind_of(df, name), (T.TimestampType, T.TimestampNTZType)) else F.expr(f"try_cast(`{name}` AS timestamp_ntz)")


def url_path(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def patch_id_of_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/patch/(\d+)/?", 1), F.lit(""))
