"""Session helpers: table reading, Arrow maps and reliable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mnemolith-"), "mnemolith_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("mnemolith", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where none is set (tests, local runs) one beside the warehouse is chosen."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(os.path.abspath("spark-warehouse"), "checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mnemolith-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: The folders of the tables that materialize wrote, by the id of the frame that reads each.
_folders: dict[int, str] = {}


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors.

    A narrow table (numbers, keys) is written without compression and dictionaries: its files then have about the size
    of its rows, which is what Spark goes by when it decides whether a side may be broadcast. ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    # what the write shuffled is not needed once its table stands
    known = spark.conf.get(_CLEANUP, None)
    options = {"compression": "none", "parquet.enable.dictionary": "false"} if narrow else {"compression": "zstd"}
    try:
        if known is not None:
            spark.conf.set(_CLEANUP, "true")
        df.write.options(**options).parquet(path)
    finally:
        if known is not None:
            spark.conf.set(_CLEANUP, known)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    weakref.finalize(out, _folders.pop, id(out), None)
    return out


def remove(spark: SparkSession, path: str) -> None:
    where, files = _folder(spark, path)
    files.delete(where, True)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where it does not exist."""
    where, files = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def file_state(spark: SparkSession, path: str) -> int:
    """A number that changes when a file under the path does."""
    where, files = _folder(spark, path)
    found = files.listFiles(where, True)
    state = 0
    while found.hasNext():
        f = found.next()
        state ^= hash((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return state


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file."""
    where, files = _folder(spark, path)
    files.create(where, False).close()


def discard(*frames: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for df in frames:
        path = _folders.pop(id(df), None)
        if path:
            remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give work to less than a third of them; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 3 * df.rdd.getNumPartitions() < cores else df


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
