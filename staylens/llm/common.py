"""Helpers shared by the operators: table access, stored intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from staylens.session import scratch_path, ship_package

#: Rows handled at a time inside one Arrow batch, so that a batch of very long texts is never
#: turned into Python objects as a whole.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables stored in each of the open ``scratch`` blocks, the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored in this block are deleted at its end.

    What is needed afterwards is stored with ``keep``: written in full, it depends on none of the
    others, so executors lost later can still make it again from files.  Kept tables belong to the
    enclosing block, if any.
    """
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        conf = spark._jsc.hadoopConfiguration()
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage of a table that several jobs read; the files survive lost executors.  Inside a
    ``scratch`` block they are deleted at its end, unless ``keep``.
    """
    path = scratch_path(df.sparkSession, name)
    blocks = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def release_memory() -> None:
    """Give unused memory of Arrow and of the C library (where it can) back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the executors; a worker gives back its unused
    memory at the end of a task, as it lives on for the next one."""
    ship_package(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


_MEMOS: dict = {}


def drop_memos() -> None:
    """For operators without a memo: those of earlier ones leave the worker."""
    if _MEMOS:
        _MEMOS.clear()
        release_memory()


def worker_memo(name, make):
    """The worker's memo of that name.  A worker holds one memo at a time: those that earlier
    operators left in it are dropped."""
    if name not in _MEMOS:
        drop_memos()
        _MEMOS[name] = make()
    return _MEMOS[name]


class Generations(dict):
    """A bounded memo: when the young generation is full it becomes the old one, whose entries come
    back as they are asked for.  So what is used often stays, and memory is twice ``size`` entries."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def value_of(self, key):
        raise NotImplementedError

    def kept(self, key) -> bool:
        return True

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.value_of(key)
        if self.kept(key):
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
