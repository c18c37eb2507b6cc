"""What several operators need: the shared folder, lineage cuts, bounded Arrow batches, word tables."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.session import ship

#: Most bytes and rows of one Arrow batch that is handed to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side of a join with at most so many short rows (ids, hashes, counts) is broadcast.
BROADCAST_ROWS = 20_000

#: A-Z to a-z; every ASCII byte that is no digit or letter becomes a space; bytes from 0x80 stay.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A-Z to a-z; tab, line feed, vertical tab, form feed and carriage return become a space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all run in one process."""
    context = spark.sparkContext
    set_by_cluster = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not set_by_cluster:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="stemmata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        set_by_cluster = f"file://{own}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(set_by_cluster)
    return set_by_cluster.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files: what they gave is kept elsewhere, so nothing reads these again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with own_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan reads the option when it is made


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once and kept as Parquet in the shared folder, and the folder's name for :func:`delete`."""
    folder = new_folder(df.sparkSession, "part")
    with own_shuffles(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder that :func:`written` made, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sieve(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` places (a power of two, from 2 ** 15) in which the places of a table's one column of 64-bit hashes are set."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(bits)) + 1
    rows = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for bucket, held in rows.toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(held, np.uint8)
    return out


def sifted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their place set; all that were given to :func:`sieve` have."""
    place = hashes.astype(np.int64).view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds (texts are long, so rows alone are no bound), and let workers import this library."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What this Python worker keeps from task to task, for one operator at a time.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps for ``operator``; what it kept for any other is dropped, as workers outlive a stage.

    A function that is sent to workers must get it by this call: module variables that it names are sent as copies.
    """
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
        give_back()
    return _kept[operator]


def lean(operator: str, run: Callable) -> Callable:
    """``run`` over batches, in a worker that keeps nothing of other operators and, once idle, nothing that it has freed."""

    def leant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return leant


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(ALNUM).split()
