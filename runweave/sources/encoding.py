"""Masks as arrays of gaps and lengths, and as bytes.

Wire format: version 1, type of lengths 0, type of gaps 0 (unsigned 64 bits), then x, y, width and height as unsigned 32-bit
and (gap, length) pairs as unsigned 64-bit little-endian integers; a length of 0 or the end of the data ends it.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions.columns import FITS
from runweave.operators.normalize import normalize_ranges
from runweave.operators.reshape import into_ranges
from runweave.shipping import ship

HEADER = 19


def to_offsets(ranges: DataFrame, extra: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """mask_id, start, gap, len (and extra columns) per range; strict: empty, overlapping and touching ranges are errors."""
    before = F.lag("end").over(Window.partitionBy("mask_id").orderBy("start", "end"))
    out = ranges.select("mask_id", "start", "end", *extra, before.alias("_before"))
    if strict:
        bad = F.when(F.col("end") <= F.col("start"), F.lit("range is empty")).when(F.col("_before") >= F.col("start"), F.lit("ranges overlap or touch")).when(F.col("start") < 0, F.lit("range starts below 0"))
        out = out.withColumn("_bad", bad).filter(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True)))
    return out.select("mask_id", "start", (F.col("start") - F.coalesce("_before", F.lit(0))).alias("gap"), (F.col("end") - F.col("start")).alias("len"), *extra)


def encode_gaps(ranges: DataFrame, bounds: DataFrame | None = None, kind: str = "u64", extra: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """mask_id, included, excluded (lengths and gaps in order), extra columns as arrays, and bounds if given.

    A value that doesn't fit `kind` is an error; a mask without ranges has no row."""
    fits = lambda c: F.when(F.col(c) > FITS[kind], F.raise_error(F.lit(f"{c} does not fit {kind}")).cast("long")).otherwise(F.col(c))
    offsets = to_offsets(ranges, extra, strict).withColumns({"gap": fits("gap"), "len": fits("len")})
    listed = offsets.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("start", "gap", "len", *extra))).alias("_r"))
    out = listed.select("mask_id", F.col("_r.len").alias("included"), F.col("_r.gap").alias("excluded"), *(F.col(f"_r.{c}").alias(c) for c in extra))
    return out if bounds is None else out.join(bounds, "mask_id")


def encode_spans(spans: DataFrame, bounds: DataFrame, kind: str = "u64", strict: bool = True) -> DataFrame:
    """Global spans, local and merged where they touch; with strict, spans that overlap or leave their bounds are errors."""
    from runweave.operators.normalize import validate

    return encode_gaps(into_ranges(validate(spans, bounds, canonical=False) if strict else spans, bounds), bounds, kind)


def decode_gaps(encoded: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Ranges out of the arrays."""
    zipped = F.posexplode(F.arrays_zip("excluded", "included", *extra))
    rows = encoded.select("mask_id", zipped.alias("_i", "_r"))
    w = Window.partitionBy("mask_id").orderBy("_i")
    end = F.sum(F.col("_r.excluded") + F.col("_r.included")).over(w)
    return rows.select("mask_id", (end - F.col("_r.included")).alias("start"), end.alias("end"), *(F.col(f"_r.{c}").alias(c) for c in extra))


def _le(value: str, size: int) -> str:
    """Hexadecimal digits of an unsigned integer's little-endian bytes."""
    return _turned(f"lpad(hex({value}), {2 * size}, '0')", size)


def _turned(digits: str, size: int) -> str:
    """Pairs of digits in reverse order.  (reverse() would take bytes that happen to be UTF-8 as characters.)"""
    return "concat(" + ", ".join(f"substring({digits}, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")"


def wire_encode(ranges: DataFrame, bounds: DataFrame, terminator: bool = True) -> DataFrame:
    """mask_id, payload."""
    e = encode_gaps(ranges, bounds)
    head = " || ".join(["'010000'", *(_le(c, 4) for c in ("bx", "by", "bw", "bh"))])
    pairs = f"array_join(transform(arrays_zip(excluded, included), p -> {_le('p.excluded', 8)} || {_le('p.included', 8)}), '')"
    tail = f"'{'0' * 32}'" if terminator else "''"
    return e.select("mask_id", F.expr(f"unhex({head} || {pairs} || {tail})").alias("payload"))


def _number(at: str, size: int) -> str:
    return f"cast(conv({_turned(f'hex(substring(payload, {at}, {size}))', size)}, 16, 10) AS BIGINT)"


def wire_header(payloads: DataFrame) -> DataFrame:
    """mask_id, bx, by, bw, bh; a header that is short, of another version or type, or without area is an error."""
    n = F.octet_length("payload")
    bad = F.when(n < HEADER, F.lit("header is cut short")).when(F.expr("substring(payload, 1, 1) != X'01'"), F.lit("unknown version")).when(F.expr("substring(payload, 2, 2) != X'0000'"), F.lit("unknown type"))
    good = payloads.withColumn("_bad", bad).filter(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True)))
    out = good.select("mask_id", *(F.expr(_number(str(at), 4)).alias(c) for c, at in (("bx", 4), ("by", 8), ("bw", 12), ("bh", 16))))
    return out.filter(F.when((F.col("bw") == 0) | (F.col("bh") == 0), F.raise_error(F.lit("bounds without area")).cast("boolean")).otherwise(F.lit(True)))


def _pairs(raw: bytes | None, cut_short: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a payload's ranges as unsigned 64-bit integers."""
    if raw is None or len(raw) < HEADER:
        raise ValueError("header is cut short")
    if raw[0] != 1:
        raise ValueError("unknown version")
    if raw[1] or raw[2]:
        raise ValueError("unknown type")
    if not int.from_bytes(raw[11:15], "little") or not int.from_bytes(raw[15:19], "little"):
        raise ValueError("bounds without area")
    n = (len(raw) - HEADER) // 16
    if cut_short == "error" and (len(raw) - HEADER) % 16:
        raise ValueError("a pair is cut short")
    pairs = np.frombuffer(raw, "<u8", 2 * n, HEADER).reshape(-1, 2)
    over = np.flatnonzero(pairs[:, 1] == 0)
    pairs = pairs[: over[0]] if len(over) else pairs
    if not len(pairs):
        return (np.zeros(0, np.uint64),) * 2
    steps = np.cumsum(pairs.ravel(), dtype=np.uint64)
    if (steps[1:] < steps[:-1]).any():
        raise ValueError("range does not fit 64 bits")
    return steps[0::2], steps[1::2]


def wire_decode(payloads: DataFrame, cut_short: str = "ignore", wide: bool = False, errors: str = "raise") -> DataFrame:
    """Local ranges, of a table or a stream of payloads: one pass over the rows, without an exchange.

    cut_short: what to do with bytes after the last whole pair ("ignore" or "error").  wide: starts and ends as DECIMAL(20, 0),
    which holds all unsigned 64-bit integers; without, one over 2**63 - 1 is an error.  errors: "skip" leaves out payloads
    that can't be decoded instead of raising."""
    ship(payloads.sparkSession)
    kind = pa.decimal128(20, 0) if wide else pa.int64()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                try:
                    start, end = _pairs(batch.column(1)[row].as_py(), cut_short)
                    if not wide and len(end) and int(end[-1]) >> 63:
                        raise ValueError("range does not fit a signed 64-bit integer")
                except ValueError:
                    if errors == "raise":
                        raise
                    continue
                for at in range(0, len(start), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    cols = [pa.array(list(map(Decimal, x[some].tolist())), kind) if wide else pa.array(x[some].astype(np.int64)) for x in (start, end)]
                    mask = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(cols[0]), np.int32)), batch.column(0).slice(row, 1)).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([mask, *cols], names=["mask_id", "start", "end"])

    out = "decimal(20,0)" if wide else "long"
    rows = payloads.select("mask_id", "payload")
    return rows.mapInArrow(run, f"mask_id {rows.schema['mask_id'].dataType.simpleString()}, start {out}, end {out}")


def build_masks(ranges: DataFrame, seq: str, kind: str = "u64") -> DataFrame:
    """mask_id, included, excluded, error of ranges added one by one in the order of `seq`.

    A mask's first error (an empty range, one that starts before the end of what was added, a value that doesn't fit) stays
    with it: its arrays are null then, whatever comes after.  A range that begins where the one before ends is joined to it."""
    before = F.max("end").over(Window.partitionBy("mask_id").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    bad = F.when(F.col("end") <= F.col("start"), F.lit("range is empty")).when(F.col("start") < 0, F.lit("range starts below 0"))
    bad = bad.when(F.col("start") < F.coalesce("_before", F.lit(0)), F.lit("range starts before the end of the one before")).when(F.col("end") > FITS[kind], F.lit(f"end does not fit {kind}"))
    marked = ranges.select("mask_id", "start", "end", F.col(seq).alias("_seq"), before.alias("_before")).withColumn("_bad", bad)
    errors = marked.groupBy("mask_id").agg(F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_seq"))).alias("error"))
    good = marked.join(errors.filter("error IS NULL").select("mask_id"), "mask_id", "left_semi").select("mask_id", "start", "end")
    return errors.join(encode_gaps(normalize_ranges(good), kind=kind), "mask_id", "left").select("mask_id", "included", "excluded", "error")


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of files in any store that Spark reads: mask_id is a hash of the file's path, which comes with it."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("mask_id"), F.col("content").alias("payload"), "path")


def read_wire_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select(F.xxhash64("path").alias("mask_id"), F.col("content").alias("payload"), "path")


def write_wire_files(payloads: DataFrame, folder: str, suffix: str = ".mask") -> None:
    """A file `<mask_id><suffix>` per row of `folder`, which may be in any store that pyarrow's file systems reach.

    Each task writes under a name of its own and moves its files when it is done, so a task that is run again leaves the same
    files, and no reader sees half of one."""
    ship(payloads.sparkSession)

    def run(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder) if "://" in folder else (pa_fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        written = 0
        for batch in batches:
            for mask, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{root}/.{mask}-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(raw)
                fs.move(own, f"{root}/{mask}{suffix}")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    payloads.select("mask_id", "payload").mapInArrow(run, "written long").agg(F.sum("written")).collect()


def write_wire_stream(payloads: DataFrame, folder: str, suffix: str = ".mask"):
    """A stream writer that puts each micro-batch's payloads into files, as write_wire_files() does."""
    return payloads.writeStream.foreachBatch(lambda batch, _: write_wire_files(batch, folder, suffix))
