"""Token ids in files: frequency-ranked ids, byte-aligned variable lengths, control bytes apart from data bytes.

Layout of a block (little-endian): magic "RWT1", u32 documents, u64 ids, u64 ids before it in its range, u32 end id;
then i64 key, u8 key-is-null and u32 ids per document; then all control bytes (2 bits an id: its length less one, four
ids a byte, each document from a new byte on); then all data bytes (1 to 4 a rank).  Blocks are the rows of a table,
so that any store that Spark can reach holds them.  Ranks belong to a table of their own: the ids by falling frequency
over the whole corpus, so that frequent ids take one byte.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import documents, drop_table, literal_table, stage_table
from runweave.llm.token_ids import encoder, key_bounds, parts_of, slices, tokenise, vocabulary_path

HEAD = struct.Struct("<4sIQQI")
BLOCK_IDS = 1 << 20


@cache
def _lengths() -> np.ndarray:
    """Row c: the lengths of the four values that control byte c describes."""
    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack_many(values: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control bytes, data bytes) of several documents' unsigned 32-bit values; each has `counts` of them."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8)
    code += values > 0xFFFF
    code += values > 0xFFFFFF
    per = -(-counts // 4)
    codes = np.zeros(4 * int(per.sum()), np.uint8)
    codes[np.arange(len(values)) + np.repeat(4 * (np.cumsum(per) - per) - (np.cumsum(counts) - counts), counts)] = code
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    sizes = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(values) + 1)])
    c_end, d_end = np.cumsum(per), sizes[np.cumsum(counts)]
    cut = lambda raw, ends: [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]
    return cut(control, c_end), cut(data, d_end)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    control, data = pack_many(values, np.array([len(values)]))
    return control[0], data[0]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of several documents, whose numbers of values are `counts`, by lookup of control bytes in a table."""
    per = -(-counts // 4)
    length = _lengths()[control].ravel()
    if (counts % 4).any():  # the last control byte of a document may describe fewer than four
        first = np.repeat(4 * (np.cumsum(per) - per) - (np.cumsum(counts) - counts), counts)
        length = length[np.arange(counts.sum()) + first]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(keys: list, packed: list[tuple[int, bytes, bytes]], before: int, end_id: int) -> bytes:
    counts = np.array([n for n, _, _ in packed], "<u4")
    null = np.array([k is None for k in keys], np.uint8)
    return b"".join([
        HEAD.pack(b"RWT1", len(keys), int(counts.sum()), before, end_id), np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), counts.tobytes(),
        *(c for _, c, _ in packed), *(d for _, _, d in packed),
    ])


def read_block(raw: bytes, by_rank: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(keys, ids per document, all ids, ids before the block in its range)."""
    magic, n, total, before, _ = HEAD.unpack_from(raw)
    if magic != b"RWT1":
        raise ValueError("not a token block")
    buf, at = np.frombuffer(raw, np.uint8), HEAD.size
    keys = buf[at : at + 8 * n].view("<i8") if (at % 8) == 0 else np.frombuffer(raw, "<i8", n, at)
    null = buf[at + 8 * n : at + 9 * n]
    counts = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    controls = int((-(-counts // 4)).sum())
    ids = by_rank[unpack(buf[at : at + controls], buf[at + controls :], counts)]
    assert len(ids) == total
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts, ids, before


def frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, out of the tasks' own counts; at most one row per id of the vocabulary reaches the driver."""

    def split(batches):
        for batch in batches:
            for x in batch.column(0):
                met = np.frombuffer(x.as_buffer(), np.int64)
                some = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(met[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.select("ids").mapInArrow(split, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class TokenFiles:
    """What write_token_files() wrote: the blocks' table, the ids by rank, and the ids before each key range."""

    def __init__(self, blocks: DataFrame, by_rank: np.ndarray, key: str):
        self.blocks, self.by_rank, self.key = blocks, by_rank, key
        totals = blocks.groupBy("pid").agg(F.sum("n_ids").alias("n")).orderBy("pid").collect()  # a row for each range
        self.base, before = [], 0
        for r in totals:
            self.base.append((r["pid"], before))
            before += r["n"]

    def digest(self) -> DataFrame:
        """key, start, n_tokens, ids_crc32 per document, decoded from the blocks."""
        by_rank, key = self.by_rank, self.key

        def run(batches):
            for batch in batches:
                for pid, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    keys, counts, ids, before = read_block(raw.as_py(), by_rank)
                    ends = np.cumsum(counts)
                    view, start = memoryview(ids.astype("<u4").tobytes()), ends - counts
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist())]
                    cols = [pa.array([pid] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(start + before), pa.array(counts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["pid", key, "local", "n_tokens", "ids_crc32"])

        rows = self.blocks.select("pid", "block").mapInArrow(run, f"pid int, `{key}` long, local long, n_tokens long, ids_crc32 long")
        base = literal_table(self.blocks.sparkSession, self.base, "range int, base bigint")
        return rows.join(F.broadcast(base), rows["pid"] == base["range"]).select(key, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every whole text (null: empty), append `end_id`, and write blocks in ascending order of the key.

    Null keys come first; rows with one key keep any order among themselves, and the blocks hold it; an empty table gives
    no blocks.  Other columns are not looked at.  Texts are encoded once; the plain ids wait in the shared folder until
    their frequencies are known.  Only packed ids are shuffled, never text."""
    spark = df.sparkSession
    staged = stage_table(tokenise(df, path, end_id, key, text, bounds=key_bounds(df, key, parts_of(spark)), count=True), "ids")
    plain = staged.filter("pid >= 0")
    tool = encoder(path)
    dtype, size = tool.dtype, max(tool.size, end_id + 1)
    count = frequencies(staged.filter("pid < 0"), size)
    by_rank = np.lexsort((np.arange(size), -count)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)

    def packed(batches):
        for batch in batches:
            for part in slices(batch, 512):
                control, data = pack_many(rank[np.frombuffer(b"".join(part.column(3).to_pylist()), dtype)], np.asarray(part.column(2)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["pid", key, "n", "control", "data"])

    def blocks(batches):
        pid, before, total, keys, docs = None, 0, 0, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([total], pa.int64()), pa.array([block(keys, docs, before, end_id)], pa.binary())], names=["pid", "n_ids", "block"])

        for batch in batches:
            for part in slices(batch):
                for p, k, n, c, d in zip(*(col.to_pylist() for col in part.columns)):
                    if keys and (p != pid or total + n > BLOCK_IDS):
                        yield out()
                        before, total, keys, docs = before + total if p == pid else 0, 0, [], []
                    pid, total = p, total + n
                    keys.append(k)
                    docs.append((n, c, d))
        if keys:
            yield out()

    rows = plain.mapInArrow(packed, f"pid int, `{key}` long, n long, control binary, data binary")
    # range k in file k: files in the order of their names have the keys in ascending order
    ordered = rows.repartitionById(parts_of(spark), "pid").sortWithinPartitions("pid", key)
    written = stage_table(ordered.mapInArrow(blocks, "pid int, n_ids long, block binary"), "token-blocks")
    drop_table(staged)
    return TokenFiles(written, by_rank, key)


def op2_tokens(spark, sf_dir):
    """All documents' ids through files and back."""
    return write_token_files(documents(spark, sf_dir), vocabulary_path(), 0).digest()
