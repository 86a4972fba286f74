"""What the operators of this subpackage share: readers, staging, text primitives."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white-space characters, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"
#: ASCII characters that are neither letters nor digits.
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

#: Bytes up to which a table is broadcast, after they are measured.
BROADCAST_BYTES = 4 << 20

#: Bits of a sieve for each hash it holds, and at most (4 MB).
SIEVE_BITS, SIEVE_MOST = 64, 1 << 25

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, pruned to the given columns."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may leave it unset, as tests do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: staged tables need a folder that all executors share")
        folder = "/tmp/checkpoints/lexiquarry"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write the frame into the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor, and the plans
    that follow see the true size of the data. The files go when the
    application ends, or with ``settled`` or ``clear_staged``.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/staged/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(frame.schema).parquet(path)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, staged; what was staged on the way to it is deleted."""
    mark = len(_staged)
    kept = staged(build(), label)
    for _, path in _staged[mark:-1]:
        _delete(spark, path)
    del _staged[mark:-1]
    release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_staged() -> None:
    """Delete every staged table; frames that still read them become unusable."""
    while _staged:
        spark, path = _staged.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone at exit
            return


atexit.register(clear_staged)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty runs of characters outside the given class; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def two_hashes(*columns: Column) -> list[Column]:
    """128 bits of hash as two longs, never null."""
    return [F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)]


def _width(frame: DataFrame) -> Column:
    """A row's bytes, roughly: eight for each plain column, the length of what is longer."""
    sizes = F.lit(8 * len(frame.columns))
    for name, kind in frame.dtypes:
        own = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes = sizes + F.coalesce(F.octet_length(own), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            sizes = sizes + F.coalesce(F.octet_length(F.to_json(F.struct(own))), F.lit(0))
    return sizes.cast("long")


def small(frame: DataFrame, most: int = BROADCAST_BYTES, within: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """The frame with a broadcast hint if its rows, as measured, take at most ``most`` bytes.

    Otherwise the frame as it is: the join then shuffles both sides. ``within``: a staged table of no
    fewer bytes, measured instead, as to measure a frame that isn't staged is to make it twice.
    """
    measured = frame if within is None else within
    fits = (measured.agg(F.sum(_width(measured))).first()[0] or 0) <= most
    return (F.broadcast(frame) if fits else frame), fits


def sieve(hashes: DataFrame, of: Column, *more: Column) -> Column | list[Column]:
    """Whether the hash ``of`` may be one of ``hashes``, a frame of one long column: true for all that are, and for few others. With ``more`` hashes: a list, for each of them.

    A table of bits, made by Spark and sent with the tasks; for more hashes than it has room for it lets more pass, so a join has to follow.
    """
    h = F.col(hashes.columns[0])
    bits = 1 << 10
    wanted = hashes.count() * SIEVE_BITS
    while bits < min(wanted, SIEVE_MOST):
        bits <<= 1
    slot = lambda x: F.shiftright(x.bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    words = hashes.groupBy(slot(h).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    every = hashes.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("slot")).join(words, "slot", "left")
    packed = staged(every.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).getField("word").alias("words")), "sieve")
    found = [F.call_function("bit_get", F.get(packed.scalar(), slot(x)), x.bitwiseAND(F.lit(63)).cast("int")) == 1 for x in (of, *more)]
    return found if more else found[0]
