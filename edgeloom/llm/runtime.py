"""Where the training-data jobs keep intermediate results.

Only the folder named by ``spark.checkpoint.dir`` is assumed to be visible to
the driver and to all executors, or the one that the context was given.  Where neither
is set, a folder below the warehouse is used on a local master (unit tests, a laptop);
anywhere else that folder could be one machine's own, so it is refused.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the batches that Python workers get, where the session sets no number: a worker holds
#: a batch and its result, and the default of 10,000 documents is tens of MB of each.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: ASCII white space, as the contracts of the operators state it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The folders written by ``stored`` inside the innermost ``intermediates`` that is open.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every task can read; set as checkpoint folder once."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if not where and given.isDefined():
        where = given.get()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if given.isEmpty():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per Spark context, and make Python's batches small.

    The archive lies in the shared folder, like all intermediates; the folder's owner
    clears it when no job runs."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING, "0") == "0":  # not set in this session
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    if getattr(context, "_edgeloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    path = f"{shared_dir(spark)}/edgeloom-{uuid.uuid4().hex}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    context.addPyFile(path)
    context._edgeloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read from there.

    Columnar and compressed, so it is the form for wide intermediates; the
    folder's name is new on each call.  It stays until its owner clears the shared
    folder, or until the end of ``intermediates``, inside which it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if _FOLDERS.get() is not None:
        _FOLDERS.get().append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end, failed or not, what ``stored`` writes inside.

    Results that read it must be written inside too; a folder taken from the list
    that is given stays.  Nested uses each delete their own."""
    folders: list[str] = []
    token = _FOLDERS.set(folders)
    try:
        yield folders
    finally:
        _FOLDERS.reset(token)
        for folder in folders:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; all other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over the session's number of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
