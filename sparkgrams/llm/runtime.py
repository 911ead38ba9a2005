"""What the operators share: intermediate tables, shipping this package to the
executors, and iterating over Arrow batches in memory-bounded slices."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

PACKAGE_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SLICE_BYTES = 4 << 20
#: Paths of intermediate tables, by what they were made for.
_scratch: dict[str, list[str]] = {}
_purpose = [""]
_held: list[Callable[[], None]] = []
#: Rows that go to a Python worker at once; texts are long.
BATCH_ROWS = 2000


def session_of(df: DataFrame) -> SparkSession:
    """The session of a frame, with this package importable on its executors."""
    ship(df.sparkSession)
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark application, and bound
    the session's Arrow batches: a setting of the session that stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_sparkgrams_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="sparkgrams-"))  # the driver's own; Spark serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "sparkgrams_pkg.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for at, _, names in os.walk(PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE_DIR)))
    context.addPyFile(path)
    context._sparkgrams_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a table in the shared folder and read it back: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkgrams/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.setdefault(_purpose[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a sieve: 2^24 bits.
SIEVE_WORDS = 1 << 18


def _sieved(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with a flag ``sieve_met``: true for all rows whose long ``key`` is
    among ``keys`` and, while the keys are fewer than the sieve's bits, few
    others. The sieve has a fixed number of bits, so it may be broadcast whatever
    the number of keys."""
    h = F.xxhash64(F.col(key).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.shiftright(h, 6), F.lit(SIEVE_WORDS))
    bits = keys.select(word.alias("sieve_word"), bit.alias("sieve_bit")).groupBy("sieve_word").agg(F.bit_or("sieve_bit").alias("sieve_bits"))
    met = F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))
    return df.withColumn("sieve_word", word).join(F.broadcast(bits), "sieve_word", "left").withColumn("sieve_met", met).drop("sieve_word", "sieve_bits")


def sieve(df: DataFrame, keys: DataFrame, key: str, *, split: bool = False) -> DataFrame:
    """Rows of ``df`` that may have a partner among ``keys``: it spares the
    others the shuffle before a join. With ``split`` all rows, told apart by
    ``sieve_met``."""
    marked = _sieved(df, keys, key)
    return marked if split else marked.filter("sieve_met").drop("sieve_met")


def without(df: DataFrame, keys: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows whose long ``key`` (and ``more`` columns) are not among ``keys``;
    null keys stay. Only rows that the sieve can't tell apart are shuffled."""
    names = [key, *more]
    held = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(names)])
    gone = keys.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(names)])
    marked = _sieved(held, gone, "k0")
    left = marked.filter("sieve_met").join(gone, [f"k{n}" for n in range(len(names))], "left_anti")
    return marked.filter("not sieve_met").select("row.*").unionByName(left.select("row.*"))


@contextmanager
def tables_for(purpose: str) -> Iterator[None]:
    """Tables that are written inside can be released alone."""
    _purpose.append(purpose)
    try:
        yield
    finally:
        _purpose.pop()


def release(spark: SparkSession, purpose: str = "") -> None:
    """Delete the intermediate tables written so far (for a purpose). Call it
    only when every frame that was made from them has been written elsewhere."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _scratch.pop(purpose, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def hold(drop: Callable[[], None]) -> None:
    """Tell how to drop what a worker remembers between tasks."""
    _held.append(drop)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, *, remembers: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of text (one
    row at least). Workers serve one operator after another: unless this one
    ``remembers``, what others have left in the worker is dropped first."""
    while _held and not remembers:
        _held.pop()()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(n)
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads: others, whatever their names, can't
    clash with the ones it adds."""
    return df.select(*[df[n] for n in names])
