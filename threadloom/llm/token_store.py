"""Flat token files: ids as unsigned integers, and 64-bit document offsets, to be memory-mapped.

Layout of a store (a folder in the shared file system):

* ``shard-PPPPP.bin``: the ids of partition P's documents one after the other, little-endian,
  ``uint16`` if the vocabulary fits and else ``uint32``; every document ends with the
  end-of-text id.
* ``shard-PPPPP.idx``: n + 1 little-endian ``uint64``: where in the **whole store** each of
  the shard's n documents begins, and where the last one ends.
* ``shard-PPPPP.ids``: n little-endian ``int64`` doc_ids (null: the least int64).

Pass 1 tokenises: each task writes its shard under a name of its own and moves it into place
when it is complete, so a task that is run twice, or dies, leaves no half file, and returns
its counts. The base of each shard is the prefix sum of the token counts before it. Pass 2
turns local lengths into offsets of the whole store. Text is read once and shuffled never; a
document's place is that of its row in the table. Only one row for each shard reaches the
driver.

Null and empty texts are documents of the end-of-text id alone. Rows that repeat an id are
documents of their own. An empty table gives a store of no tokens.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import DEFAULT_VOCABULARY, encoded, encoder
from .runtime import fresh_dir, materialise, narrow

ROWS = "doc_id bigint, shard int, position bigint, token_start bigint, n_tokens int, crc32 bigint"
NO_ID = -(1 << 63)
_FLUSH = 1 << 22


def _open(where: str) -> tuple[fs.FileSystem, str]:
    if where.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + where[5:].lstrip("/")
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def _put(system: fs.FileSystem, path: str, write) -> None:
    """Write under another name, then move: the file is there whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft, compression=None) as out:
        write(out)
    system.move(draft, path)


def _name(root: str, shard: int, kind: str) -> str:
    return f"{root}/shard-{shard:05d}.{kind}"


def write_store(documents: DataFrame, where: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Write the store at ``where``, which is complete when this returns. Gives (doc_id, shard,
    position in the shard, token_start in the store, n_tokens, crc32 of the ids' bytes), a row
    for each document."""
    spark = documents.sparkSession
    end = encoder(vocabulary).end_of_text
    kind = "<u2" if end < 1 << 16 else "<u4"
    system, root = _open(where)
    system.create_dir(root, recursive=True)

    def tokenise(batches):
        shard = TaskContext.get().partitionId()
        system, root = _open(where)
        lengths, ids, sums = [], [], []
        stop = np.array([end], kind)

        def body(out):
            held, size = [], 0
            for batch in batches:
                ids.extend(NO_ID if x is None else x for x in batch.column("doc_id").to_pylist())
                for x in encoded(batch.column("text"), vocabulary):
                    data = x.astype(kind).tobytes() + stop.tobytes()
                    held.append(data)
                    size += len(data)
                    lengths.append(len(x) + 1)
                    sums.append(zlib.crc32(data))
                    if size >= _FLUSH:
                        out.write(b"".join(held))
                        held, size = [], 0
            out.write(b"".join(held))

        _put(system, _name(root, shard, "bin"), body)
        _put(system, _name(root, shard, "ids"), lambda out: out.write(np.array(ids, "<i8").tobytes()))
        _put(system, _name(root, shard, "len"), lambda out: out.write(np.array([lengths, sums], "<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    counts = narrow(documents).mapInArrow(tokenise, "shard int, n_docs bigint, n_tokens bigint").collect()
    base, shards = 0, []
    for shard, n, m in sorted(map(tuple, counts)):
        shards.append((shard, n, base))
        base += m

    def offsets(batches):
        for batch in batches:
            for shard, n, base in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = _open(where)
                lengths, sums = np.frombuffer(system.open_input_stream(_name(root, shard, "len")).read(), "<u4").reshape(2, n)
                ids = np.frombuffer(system.open_input_stream(_name(root, shard, "ids")).read(), "<i8")
                start = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8") + np.uint64(base)
                _put(system, _name(root, shard, "idx"), lambda out, start=start: out.write(start.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n)), pa.array(start[:-1].astype(np.int64)), pa.array(lengths.astype(np.int32)), pa.array(sums.astype(np.int64))],
                    names=[x.split()[0] for x in ROWS.split(", ")],
                )

    table = spark.createDataFrame(shards, "shard int, n_docs bigint, base bigint")
    return materialise(table.repartition(max(1, len(shards)), "shard").mapInArrow(offsets, ROWS), "token-rows")


def write_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """:func:`write_store` into a fresh folder of the shared one."""
    return write_store(documents, fresh_dir(documents.sparkSession, "tokens"), vocabulary)


@dataclass
class TokenStore:
    """A store opened for reading: nothing is loaded but what is asked for."""

    where: str
    vocabulary: str = DEFAULT_VOCABULARY

    def __post_init__(self):
        _, root = _open(self.where)
        kind = "<u2" if encoder(self.vocabulary).end_of_text < 1 << 16 else "<u4"
        shards = sorted((f[6:-4] for f in os.listdir(root) if f.endswith(".idx")), key=int)  # names are longer from 100,000 on
        self._idx = [np.memmap(f"{root}/shard-{s}.idx", "<u8", "r") for s in shards]
        self._bin = [np.memmap(p, kind, "r") if os.path.getsize(p) else np.empty(0, kind) for p in (f"{root}/shard-{s}.bin" for s in shards)]
        self._docs = np.cumsum([0, *(len(x) - 1 for x in self._idx)])

    def __len__(self) -> int:
        return int(self._docs[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the store, the end-of-text id included."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self._docs, i, "right")) - 1
        idx = self._idx[k]
        j = i - int(self._docs[k])
        return self._bin[k][int(idx[j] - idx[0]) : int(idx[j + 1] - idx[0])]

    def text(self, i: int) -> str:
        return encoder(self.vocabulary).bpe.decode(self[i][:-1].tolist())
