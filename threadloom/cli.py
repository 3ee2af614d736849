"""Command line: ``python -m threadloom.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import enrich, threads
from threadloom.plans import analyses
from threadloom.shipping import ship
from threadloom.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("filter", help="whole threads with a match")
    c.add_argument("path")
    c.add_argument("--output")
    c.add_argument("--show", type=int, default=20)
    c.add_argument("--manual-frac", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--pattern", choices=["as_written", "intended"], default="as_written")
    c = sub.add_parser("classify", help="a label for each thread")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-w", "--workers", type=int, default=8)
    c.add_argument("--cache")
    c.add_argument("--classifier", help="module:name of a function of a thread's text; the built-in rules without it")
    c.add_argument("--model", help="module:name of a function of a prompt, which gets the meaning of the labels before each thread")
    c.add_argument("--pause", type=float, default=0.2, help="seconds that a worker waits after each call of an own classifier")
    c = sub.add_parser("status", help="the status of each last patch, from a cache table and, if one is given, a resolver")
    c.add_argument("--input", nargs="+", default=[])
    c.add_argument("--output", nargs="+", default=[])
    c.add_argument("--subsystem", default="iio")
    c.add_argument("--job", nargs=3, action="append", default=[], metavar=("INPUT", "OUTPUT", "SUBSYSTEM"))
    c.add_argument("--cache", required=True)
    c.add_argument("--resolver", help="module:name of a function of (subsystem, msgid); nothing is asked without it")
    c.add_argument("-w", "--workers", type=int, default=8)
    c.add_argument("--pause", type=float, default=1.0)
    c = sub.add_parser("sender", help="threads with a sender at a domain")
    c.add_argument("--files", nargs="+", required=True)
    c.add_argument("--domain", required=True)
    c = sub.add_parser("inspect", help="the first flagged threads")
    c.add_argument("--files", nargs="+", required=True)
    c.add_argument("--n-threads", type=int, default=5)
    c = sub.add_parser("view", help="the head of a table")
    c.add_argument("path")
    c.add_argument("-n", "--rows", type=int, default=10)
    c.add_argument("-c", "--columns")
    c.add_argument("--full", action="store_true")
    return p


def load(name: str):
    """What ``module:name`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def classifier_of(a: argparse.Namespace):
    """(classifier, pause)."""
    if a.classifier and a.model:
        raise SystemExit("either --classifier or --model")
    if a.model:
        return enrich.with_taxonomy(load(a.model)), a.pause
    return (load(a.classifier), a.pause) if a.classifier else (enrich.rule_classifier, 0)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    ship(spark)
    if a.command == "filter":
        df = tables.with_row_order(tables.read_table(spark, a.path))
        done = analyses.filter_threads(df, a.manual_frac, a.seed, a.pattern)
        for k, v in {**done.stats.first().asDict(), **analyses.link_stats(done.kept).first().asDict()}.items():
            print(f"{k}: {v}")
        for row in threads.first_messages(done.kept).orderBy("_thread_id").select("subject").limit(max(a.show, 0)).collect():
            print(f"- {row[0]}")
        tables.write_table(threads.in_order(done.kept), a.output)
    elif a.command == "classify":
        if a.workers < 1:
            raise SystemExit("--workers must be at least 1")
        df = tables.read_table(spark, a.input)
        kind = dict(df.dtypes)["_thread_id"]
        cache = tables.load_cache(spark, a.cache, f"_thread_id {kind}, label string") if a.cache else None
        ask, pause = classifier_of(a)
        rows, labels = analyses.classify(df, ask, cache, a.workers, pause, a.cache)
        tables.write_table(rows, a.output)
        if a.cache:
            tables.save_cache(labels, a.cache)
        print(analyses.classification_summary(rows).first().asDict())
    elif a.command == "status":
        if len(a.input) != len(a.output) or not (a.input or a.job):
            raise SystemExit("as many outputs as inputs, or jobs")
        if a.workers < 1:
            raise SystemExit("--workers must be at least 1")
        resolver = load(a.resolver) if a.resolver else None
        for path, out, subsystem in [*((i, o, a.subsystem) for i, o in zip(a.input, a.output)), *a.job]:
            if not tables.exists(spark, path):
                print(f"skipped: {path} does not exist")
                continue
            df, cache = tables.read_table(spark, path), tables.load_cache(spark, a.cache)
            for n in enrich.lookup_counts(analyses.status_keys(df, subsystem), cache).collect():
                print(f"{path}: {n['n_keys']} last patches, {n['n_cached']} in the cache, {n['n_asked']} {'asked for' if resolver else 'unknown'}")
            rows, known = analyses.status(df, subsystem, cache, resolver, a.workers, a.pause, a.cache)
            tables.write_table(rows, out)
            if resolver:
                tables.save_cache(known, a.cache)
            for row in enrich.histogram(rows).collect():
                print(f"{row['accepted']}: {row['n']}")
    elif a.command in ("sender", "inspect"):
        for path, df in tables.per_file(spark, a.files):
            if df is None:
                print(f"skipped: {path} does not exist")
                continue
            df = df.withColumns({"_row_order": F.col("_row_order").cast("bigint"), "date": F.col("date").try_cast("timestamp")})
            found = analyses.threads_with_sender(df, a.domain) if a.command == "sender" else analyses.inspect(df, a.n_threads)
            print(f"{path}: {found.select('_thread_id').distinct().count()} threads")
            shown = found.select("_thread_id", "position", "total", X.listing(found).alias("shown"))
            for row in shown.orderBy("_thread_id", "position").toLocalIterator():
                print(f"\n[{row['_thread_id']}] {row['position']} of {row['total']}\n{row['shown']}")
    else:
        try:
            df = tables.read_table(spark, a.path)
        except AnalysisException as e:
            print(f"cannot open {a.path}: {e}", file=sys.stderr)
            raise SystemExit(1) from None
        info = tables.table_info(df).first()
        print(f"{info['n_rows']} rows, columns: {info['columns']}")
        for row in tables.head(df, a.rows, a.columns, a.full).collect():
            print("\n".join(f"{k}: {v}" for k, v in row.asDict().items()), end="\n\n")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("threadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
