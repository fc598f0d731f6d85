"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.shared import shared_folder, ship

__all__ = ["Scratch", "lean", "lower_ascii", "ship", "table", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Return memory that this process holds but does not use to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, with unused memory returned when it begins and ends: a Python worker goes on to the tasks of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Only a local session, which has no other machines, gets a
    temporary one where that is unset; elsewhere that is an error. A table written here cuts the lineage, and outlives
    the executor that made it. Tables are removed by drop() and remove(), and what is left when Python ends.
    """

    _collectors: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        for collector in self._collectors:
            collector.append(self)
        atexit.register(self._at_exit)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the frame, and read it back."""
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        self._delete(f"{self.root}/{name}")

    def remove(self) -> None:
        """Remove all tables; nothing made of them can be read any more."""
        self._delete(self.root)
        atexit.unregister(self._at_exit)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)

    @classmethod
    @contextlib.contextmanager
    def collected(cls) -> Iterator[list[Scratch]]:
        """All that are made inside, so that a caller who has written the result can remove them."""
        made: list[Scratch] = []
        cls._collectors.append(made)
        try:
            yield made
        finally:
            cls._collectors.pop()
