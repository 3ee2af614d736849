"""What every operator here starts from."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.shipping import ship
from threadloom.storage import discard, distilled, fresh_dir, materialise, scratch, shared_dir

__all__ = ["discard", "distilled", "free_name", "fresh_dir", "materialise", "shared_dir", "scratch", "ship", "id_as_long", "narrow", "place_of", "tidy"]


def id_as_long(df: DataFrame, column: str) -> Column:
    """Integer ids of any width as bigint; anything else is refused when the plan is built."""
    kind = dict(df.dtypes)[column]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{column} must be an integer column, not {kind}")
    return F.col(column).cast("bigint")


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: whatever other columns the input
    has, and whatever they are called, they cannot clash with an operator's own names."""
    ship(df.sparkSession)
    return df.select(id_as_long(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def place_of(df: DataFrame, column: str) -> int:
    """Where ``column`` is among the columns; as Spark does, in any case if it isn't there as written."""
    names = df.columns if column in df.columns else [c.lower() for c in df.columns]
    return names.index(column)


def tidy(fit: Callable) -> Callable:
    """For functions of a DataFrame that return no DataFrame: what they write on the way is deleted."""

    @wraps(fit)
    def run(documents: DataFrame, *args, **more):
        with scratch(documents.sparkSession):
            return fit(documents, *args, **more)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
