"""Readers and writers: Parquet, CSV, lookup tables, archives."""

from __future__ import annotations

import json
import re
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.functions.text import cell
from threadloom.storage import materialise

_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_JOURNAL = "journal"
CACHE = "subsystem string, msgid string, state string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet if the path ends so or is a folder that isn't called ``.csv``, else CSV with a header, in which texts may have line breaks. Without a schema
    the types of CSV columns are inferred, at the price of a pass over it."""
    if path.endswith(".parquet") or not path.endswith(".csv") and is_folder(spark, path):
        return spark.read.parquet(path)
    reader = spark.read.options(header=True, multiLine=True, **_CSV)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def with_row_order(df: DataFrame, name: str = "_row_order") -> DataFrame:
    """Adds each row's number from 0 in the order of (file, row), whatever the number of files: the rows of each file are counted, and the sums over the
    files before it are added. A file of CSV is read by one task (its texts may have line breaks), so its rows come in order there."""
    parquet = "row_index" in df.select("_metadata").schema["_metadata"].dataType.names
    at = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    placed = df.drop(name).select("*", F.col("_metadata.file_path").alias("__file"), at.alias("__at"))
    if not parquet:
        placed = materialise(placed, "csv-rows")
    files = placed.groupBy("__file").agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    bases = files.select("__file", (before - (F.lit(0) if parquet else F.col("__least"))).alias("__base"))
    return placed.join(bases, "__file").withColumn(name, F.col("__at") + F.col("__base")).drop("__file", "__at", "__base")


def read_list(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """A dataset of folders ``list=<name>``, or one list of it: the others are not read."""
    df = spark.read.parquet(root)
    return df.filter(F.col("list") == name) if name is not None else df


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Lists and structures as JSON text, since CSV has no form for them."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_table(df: DataFrame, path: str | None, partition_by: str | None = None) -> None:
    """CSV if the path ends so, else Parquet; no path, no write."""
    if path is None:
        return
    if path.endswith(".csv"):
        flat_for_csv(df).write.mode("overwrite").options(header=True, **_CSV).csv(path)
    else:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def table_info(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, columns): counted without reading a column."""
    return df.select().agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns"))


def head(df: DataFrame, n: int = 10, columns: str | None = None, full: bool = False) -> DataFrame:
    """The first n rows (none for n below 0) of the columns named, as text that is cut at 120 characters unless ``full``. Unknown names raise ValueError."""
    names = [c.strip() for c in columns.split(",") if c.strip()] if columns else df.columns
    lost = [c for c in names if c not in df.columns]
    if lost:
        raise ValueError(f"no such column: {', '.join(lost)}; there are: {', '.join(df.columns)}")
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in names]
    return df.select(*[(c if full else cell(c)).alias(n_) for c, n_ in zip(shown, names)]).limit(max(n, 0))


def load_cache(spark: SparkSession, path: str, schema: str = CACHE) -> DataFrame:
    """The newest complete version of a lookup table; an empty one if there is none. Answers that an interrupted run left in the journal belong to it."""
    versions = _versions(spark, path)
    saved = spark.read.schema(schema).parquet(f"{path}/{versions[-1]}") if versions else spark.createDataFrame([], schema)
    if not exists(spark, f"{path}/{_JOURNAL}"):
        return saved
    late = spark.read.schema(saved.schema).json(f"{path}/{_JOURNAL}").dropDuplicates(saved.columns[:-1])
    return saved.unionByName(late.join(saved, saved.columns[:-1], "left_anti"))


def save_cache(df: DataFrame, path: str) -> None:
    """Write a new version beside the old ones; it counts once it is complete, so a reader or a failure never meets half a table. What the journal had
    is in it, so the journal goes."""
    spark = df.sparkSession
    versions = _versions(spark, path)
    df.write.parquet(f"{path}/v{int(versions[-1][1:]) + 1 if versions else 0:08d}")
    journal = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_JOURNAL}")
    journal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(journal, True)


def journal_write(path: str, rows: list[dict]) -> None:
    """Add answers to the journal of the lookup table at ``path``, from any task: a file of its own, moved into place when it is whole."""
    local = not re.match(r"\w+:/", path)
    system, root = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    system.create_dir(f"{root}/{_JOURNAL}", recursive=True)
    draft = f"{root}/{_JOURNAL}/_{uuid.uuid4().hex}"  # readers pass over names that begin so
    with system.open_output_stream(draft, compression=None) as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    system.move(draft, f"{root}/{_JOURNAL}/{uuid.uuid4().hex}.json")


def _versions(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where)]
    return sorted(p.getName() for p in found if p.getName().startswith("v") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def json_cache(spark: SparkSession, path: str, thread_type: str | None = None) -> DataFrame:
    """A cache of the older JSON form, one object: of ``subsystem|msgid`` and states, or with a ``thread_type`` of threads and labels. No file: empty."""
    found = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    if thread_type is None:
        return spark.createDataFrame([(*k.split("|", 1), v) for k, v in found.items()], CACHE)
    return spark.createDataFrame([(k, v) for k, v in found.items()], "k string, label string").select(F.col("k").try_cast(thread_type).alias("_thread_id"), "label")


def per_file(spark: SparkSession, paths: Iterable[str]) -> Iterator[tuple[str, DataFrame | None]]:
    """(path, table) of each, None if it doesn't exist."""
    for p in paths:
        yield p, read_table(spark, p) if exists(spark, p) else None


def shard_of(df: DataFrame, key: str, size: int = 35) -> DataFrame:
    """Adds ``part``: 1 for the first ``size`` distinct keys in order, 2 for the next, and so on. Keys are few (one a folder), so one task numbers them."""
    parts = df.select(key).distinct().select(key, (F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size) + 1).cast("int").alias("part"))
    return df.join(parts, key)


def pack_folders(source: str, target: str, prefix: str, size: int = 35) -> list[str]:
    """The folders of ``source`` in archives of ``size`` each, best compression. A source that is none, or has no folder, raises."""
    folders = sorted(p for p in Path(source).iterdir() if p.is_dir()) if Path(source).is_dir() else None
    if not folders:
        raise ValueError(f"{source} is no folder" if folders is None else f"{source} has no folders")
    made = []
    for i in range(0, len(folders), size):
        made.append(f"{target}/{prefix}_{i // size + 1}.dataset.tar.gz")
        with tarfile.open(made[-1], "w:gz", compresslevel=9) as t:
            for f in folders[i : i + size]:
                t.add(f, arcname=f.name)
    return made


def pack_lineage(folder: str, target: str, prefix: str) -> str:
    """A folder of lineage in one archive, under its own name, best compression. One that is none raises."""
    if not Path(folder).is_dir():
        raise ValueError(f"{folder} is no folder")
    made = f"{target}/{prefix}.data-lineage.tar.gz"
    with tarfile.open(made, "w:gz", compresslevel=9) as t:
        t.add(folder, arcname=Path(folder).name)
    return made


def unpack_archives(source: str, target: str) -> list[str]:
    """All data and lineage archives of ``source``, into ``target``."""
    found = sorted([*Path(source).glob("*dataset.tar.gz"), *Path(source).glob("*data-lineage.tar.gz")])
    for p in found:
        with tarfile.open(p) as t:
            t.extractall(target, filter="data")
    return [p.name for p in found]
