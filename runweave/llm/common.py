"""What the corpus operators share: tables in the shared folder, literal tables, word and text helpers."""

from __future__ import annotations

import ctypes
import json
import sys
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.shipping import shared_folder, ship


def keep_freed_memory() -> None:
    """Lets this process keep up to 32 MB that it has freed.  numpy's arrays come and go by the megabyte; by default glibc gives
    each back to the system and takes new pages, which takes as long as the arithmetic on them (measured: half of the time
    of training)."""
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD


keep_freed_memory()  # in every process that imports this, workers above all

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def _shuffles_end_with_job(spark: SparkSession):
    """While it lasts, a finished write gives its shuffle files back at once rather than at some later collection of garbage."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_job(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    for made in _SCOPES[-1:]:
        made.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def staged_tables():
    """A list of all tables that stage_table() writes while it lasts: whoever has written down what was made of them can drop
    those that operators couldn't drop themselves, because their results are lazy."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def drop_table(df: DataFrame) -> None:
    """Remove a table that stage_table() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table out of driver-side values, without RDDs: JSON parsed in the plan."""
    ship(spark)
    names = [c.strip().split(" ")[0] for c in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(":".join(c.strip().split(" ")) for c in ddl.split(",")) + ">>"
    return spark.sql("SELECT :rows AS j", args={"rows": text}).select(F.inline(F.from_json("j", kind)))


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, all else stays.  Pure ASCII goes through the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: what bytes.split() splits on."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """words() with A-Z in lower case; bytes.lower() leaves bytes above 0x7F alone."""
    return text.encode().lower().split() if text else []
