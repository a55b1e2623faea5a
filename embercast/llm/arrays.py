"""Shared helpers: bounded slices of Arrow batches and word arithmetic in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embercast.session import ensure_checkpoint_dir

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
#: 1 for the bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's tables, inside the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and the
    work before it is never repeated when an executor is lost later."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a string column, and the rows' offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and stand beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work):
    """``work`` on one group, with its memory given back afterwards."""
    def one(table):
        try:
            return work(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return work(left, right)
        finally:
            give_back()

    return two if work.__code__.co_argcount == 2 else one


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes (a longer text stands alone)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", BASE_INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with which ``span_hash`` gives the hash of any span of ``data``."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=c[1:], casting="unsafe")
    c[1:] *= powers(len(data))[0]
    return np.cumsum(c, out=c)


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(np.uint64))


def run_hash(c: np.ndarray, run: int) -> np.ndarray:
    """``span_hash`` of every span of ``run`` places."""
    n = max(0, len(c) - run)
    h = c[run:] - c[:n]
    h *= powers(len(c))[1][:n]
    h += np.uint64(run)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of the bytes marked in ``of``), and for each row its first word's number (one more at the end)."""
    n = len(data)
    inside = of[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added; one of the same name is replaced in place."""
    names = [*batch.schema.names, *(c for c in columns if c not in batch.schema.names)]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c) for c in names], names=names)


def schema_with(df: DataFrame, added: dict[str, str]) -> str:
    """DDL of ``df`` with columns added, in the order of ``with_columns``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | added
    return ", ".join(f"`{c.replace('`', '``')}` {kind}" for c, kind in kinds.items())
