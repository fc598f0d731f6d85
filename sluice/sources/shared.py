"""The folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session, which has no other machines, gets a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own in the shared one, removed when Python ends."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage and outlives executors."""
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle inside is removed when each of them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove shuffles of plans that nobody holds any more, such as those of a stream that has ended; it learns of them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once; they may run where it is not installed."""
    context = spark.sparkContext
    if not getattr(context, "_sluice_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='spark-ship-')}/sluice.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
        context._sluice_shipped = True


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


_MADE: dict[tuple[str, ...], tuple[str, object]] = {}


def files_seen(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a folder, two levels deep, which tell whether it has changed."""
    found = []
    with contextlib.suppress(Exception):  # a store that lists nothing is taken as unchanged
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for one in system.listStatus(at):
            for file in system.listStatus(one.getPath()) if one.isDirectory() else [one]:
                found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return "\n".join(sorted(found))


def once(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], T]) -> T:
    """What `make` writes into the folder that it is given, made when it is first asked for in the session, and again if the folder is gone or the data set has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, files_seen(spark, sf_dir))
    folder, made = _MADE.get(key, ("", None))
    if not folder or not exists(spark, folder):
        folder = new_folder(spark, kind)
        made = make(folder)
        _MADE[key] = folder, made
    return made


class Steps:
    """Tables of an iteration, written to one shared folder, which is removed when the iteration ends."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.made = spark, purpose, 0

    def __enter__(self) -> Steps:
        self.folder = new_folder(self.spark, self.purpose)
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.folder)

    def keep(self, frame: DataFrame) -> DataFrame:
        """The frame as a table of the iteration."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def result(self, frame: DataFrame) -> DataFrame:
        """The frame as a table that stays."""
        return written(frame, self.purpose)


class BucketedTables:
    """Tables of an iteration in the shared folder, bucketed by keys, so that joins on them don't shuffle what is stored.

    The catalog knows them, under names of their own, until the iteration ends; their files stay as long as Python runs.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose = spark, purpose
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> BucketedTables:
        self.folder = new_folder(self.spark, self.purpose)
        self.prefix = f"sluice_{self.purpose}_{uuid.uuid4().hex}"
        self.names: set[str] = set()
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def dealt(self, frame: DataFrame, by: Sequence[str]) -> DataFrame:
        """The frame in as many partitions as the tables have buckets, by the same keys."""
        return frame.repartition(self.buckets, *by)

    def append(self, name: str, frame: DataFrame, by: Sequence[str], distinct: bool = False) -> DataFrame:
        """Add rows to a table, which is made if it isn't there, and read all of it."""
        rows = self.dealt(frame, by)
        rows = rows.distinct() if distinct else rows
        rows.write.mode("append").bucketBy(self.buckets, by[0], *by[1:]).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(f"{self.prefix}_{name}")
        self.names.add(name)
        return self.spark.table(f"{self.prefix}_{name}")

    def rows(self, name: str, columns: Sequence[str]) -> DataFrame:
        """A table's rows, which can be read after the iteration."""
        schema = self.spark.table(f"{self.prefix}_{name}").schema
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*columns)
