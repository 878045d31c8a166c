"""What the operators share: tables, word splitting, the shared work folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SMALL = {ord("A") + i: ord("a") + i for i in range(26)}
#: Bytes to bytes: A-Z small; all but digits, letters and bytes over 0x7F to a space.
ALNUM = bytes(
    _SMALL.get(c, c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; None has none."""
    return raw.translate(ALNUM).split() if raw else []


def space_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; None has none."""
    return raw.lower().split() if raw else []


#: What operators keep in this Python worker from task to task: a name, and how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def entered(name: str, drop: Callable[[], None] | None = None) -> None:
    """For the start of an operator's tasks: drops what other operators keep in this Python worker, which Spark
    uses again for later stages; ``drop`` is for what this one keeps."""
    others = [k for k in _KEPT if k != name]
    for k in others:
        _KEPT.pop(k)()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # else freed memory stays with the process
        if trim:
            trim(0)
    if drop:
        _KEPT[name] = drop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_mod_py(value: object, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder that the session names.

    Without such a setting a local session gets a temporary folder of its own; on a cluster that
    is an error, since executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    folder = f"{base.rstrip('/')}/newsloom-{purpose}-{uuid.uuid4().hex[:12]}"
    if re.match("file:|/", folder):  # results may read it until the session ends
        atexit.register(shutil.rmtree, re.sub("^file:/*", "/", folder), True)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a work folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
