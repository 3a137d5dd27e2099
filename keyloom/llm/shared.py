"""What the operators need from the session: inputs and a folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of a record batch of texts, above which it is handed to Python.
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lets a query that was planned under it give back its shuffle files when it ends, not when the driver happens to collect garbage.
_FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on one machine (tests), a temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.get("dir")
        if not found:
            found = _own["dir"] = tempfile.mkdtemp(prefix="keyloom-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
    return found


_own: dict[str, str] = {}


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the checkpoint folder, for a table or files that all executors read."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    system, local = filesystem(path)
    system.create_dir(local, recursive=True)
    return path


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(_FREE_KEY, None)
    spark.conf.set(_FREE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_KEY)
        else:
            spark.conf.set(_FREE_KEY, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint, so that no later step depends on executors' disks; their shuffle files go at once."""
    checkpoint_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, under the setting


def written(df: DataFrame, kind: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read from there; their shuffle files go at once."""
    path = f"{new_folder(df.sparkSession, kind)}/rows"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``rows.mapInArrow(run, schema)``, whose record batches end at about ``BATCH`` bytes unless the session sets a bound of its own."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, BATCH)
    return rows.mapInArrow(run, schema)


def with_fields(df: DataFrame, columns: list[str], added: str) -> StructType:
    """The schema of some columns of a table and of added ones ("name type, ...")."""
    return StructType([*df.select(*(df[f"`{c}`"] for c in columns)).schema, *StructType.fromDDL(added)])
