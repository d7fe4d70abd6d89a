"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace

#: Java pattern of what separates words: ASCII white space only.
WORD_GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Make the package importable for Spark's Python workers.

    They find it by themselves when it is on PYTHONPATH or in the folder that
    the driver was started from; else the driver hands it out as a zip file.
    """
    root = Path(__file__).resolve().parents[2]
    paths = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root in paths | {Path.cwd()} or spark.conf.get("ridgeline.shipped", None):
        return
    name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/ridgeline", "zip", root, "ridgeline")
    spark.sparkContext.addPyFile(name)
    spark.conf.set("ridgeline.shipped", "true")


#: Bytes after which a batch of rows goes to Python.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of BATCH_BYTES or one row, from here on in
    the session, unless it has a bound of its own.

    Else a batch is 10,000 rows, of texts some 30 MB. Spark holds it outside the heap in
    buffers that double, what is freed there is hardly given back, and so executors grow
    over a long session.
    """
    if spark.conf.getAll.get(_BATCH) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns whose names equal one of ``names`` in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def words_of(text: Column) -> Column:
    """Array of words of a text (null: none), without empty entries."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


#: Spark then removes a statement's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there,
    and the shuffle files behind it aren't needed any longer."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return workspace.stored(df)
    finally:
        spark.conf.set(_CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Delete tables from ``stored`` that nothing will read again."""
    for t in tables:
        workspace.drop(t.sparkSession, t.stored_at)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000):
    """Arrow batches in pieces of at most ``rows`` rows, which bounds what Python holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column with one numpy array for each row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, which must be cheap to count, with a broadcast hint if it has at most ``most_rows`` rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


_kept: dict[str, dict] = {}


def kept(group: str, name, make):
    """What ``make`` gives, kept in this worker for later tasks of the same
    operator ``group``. Spark lends one worker to all operators in turn, so
    what other groups have kept is dropped."""
    for other in [g for g in _kept if g != group]:
        del _kept[other]
    own = _kept.setdefault(group, {})
    if name not in own:
        own[name] = make()
    return own[name]


def keep_nothing() -> None:
    """Drop what earlier tasks of other operators have kept in this worker."""
    _kept.clear()
