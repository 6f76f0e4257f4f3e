"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, resampled PCM out.

Companded bytes are expanded by lookup tables built from the codecs' rule; ADPCM is decoded sample by sample with numpy
running across all blocks of a file at once; PCM is resampled by a polyphase windowed sinc.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runweave.llm.common import documents, drop_table, stage_table
from runweave.llm.token_ids import slices

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000

# Fixed values of the IMA ADPCM standard: index changes per code, and step sizes.
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
IMA_STEP = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749,
    3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
)


@cache
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment = (code & 0x70) >> 4
    value = ((code & 0x0F) << 4) + 8 + np.where(segment > 0, 0x100, 0) << np.maximum(segment - 1, 0)
    return np.where(code & 0x80, value, -value).astype(np.int16)


@cache
def _encode_table(kind: int) -> np.ndarray:
    """Companded code for each of the 65536 sample values: the nearest that the decoding table holds."""
    table = (mulaw_table() if kind == MULAW else alaw_table()).astype(np.int64)
    order = np.argsort(table, kind="stable")
    middle = (table[order][1:] + table[order][:-1]) / 2
    return order[np.searchsorted(middle, np.arange(-32768, 32768))].astype(np.uint8)


def compand(pcm: np.ndarray, kind: int) -> bytes:
    return _encode_table(kind)[pcm.astype(np.int64) + 32768].tobytes()


def expand(data: bytes, kind: int) -> np.ndarray:
    return (mulaw_table() if kind == MULAW else alaw_table())[np.frombuffer(data, np.uint8)]


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of `block` bytes (a shorter last one is padded and cut), 4 bytes of state each, then two codes a byte."""
    if not data:
        return np.zeros(0, np.int16)
    short = -len(data) % block
    blocks = np.frombuffer(data + bytes(short), np.uint8).reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((len(blocks), 2 * (block - 4)), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    steps, moves = np.array(IMA_STEP, np.int32), np.array(IMA_INDEX, np.int32)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k].astype(np.int32), steps[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, k + 1] = value
    flat = out.ravel()
    return flat[: len(flat) - min(2 * short, 2 * (block - 4))] if short else flat


def encode_ima(pcm: np.ndarray, block: int) -> bytes:
    """The inverse, up to the codec's loss; numpy across blocks likewise.  The last block is filled with its last sample."""
    per = 2 * (block - 4) + 1
    pcm = np.concatenate([pcm, np.full(-len(pcm) % per, pcm[-1] if len(pcm) else 0)]).reshape(-1, per).astype(np.int32)
    out = np.zeros((len(pcm), block), np.uint8)
    out[:, :2] = pcm[:, :1].astype("<i2").view(np.uint8)
    steps, moves = np.array(IMA_STEP, np.int32), np.array(IMA_INDEX, np.int32)
    value, index = pcm[:, 0].copy(), np.zeros(len(pcm), np.int32)
    for k in range(1, per):
        step, diff = steps[index], pcm[:, k] - value
        size = np.abs(diff)
        code = np.minimum(size * 4 // step, 7) | np.where(diff < 0, 8, 0)
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def to_wav(data: bytes, kind: int, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file around coded bytes."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}[kind]
    align = {PCM: 2, IMA: block}.get(kind, 1)
    samples = len(data) // align * (2 * (block - 4) + 1 if kind == IMA else 1)
    speed = rate * align if kind != IMA else rate * block // (2 * (block - 4) + 1)
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def from_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(kind, rate, block size, coded bytes); None if it isn't a WAVE file that holds both chunks."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, head, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None if head is None or data is None else (head[0], head[2], head[4], data)


def to_pcm(kind: int, data: bytes, block: int = 1) -> np.ndarray:
    if kind in (MULAW, ALAW):
        return expand(data, kind)
    if kind == IMA:
        return decode_ima(data, block)
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


@cache
def _taps(up: int, down: int, half: int) -> np.ndarray:
    """A windowed sinc for each of `up` phases, over 2 * half samples."""
    cut = min(1.0, up / down)
    x = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * x) * np.cos(np.pi * x / (2 * half + 1)) ** 2
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate: int, to: int, half: int = 3) -> np.ndarray:
    """16-bit PCM at another rate: ceil(n * to / rate) samples."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    common = np.gcd(rate, to)
    up, down = int(to // common), int(rate // common)
    half = -(-half * max(up, down) // up)
    n, taps = -(-len(pcm) * up // down), _taps(up, down, half)
    padded = np.concatenate([np.full(half, pcm[0]), pcm, np.full(half + 1, pcm[-1])]).astype(np.float32)
    out = np.empty(n, np.float32)
    for first in range(up):  # outputs first, first + up, ... share a phase and read every `down`-th sample
        count, at, phase = -(-(n - first) // up), first * down // up, first * down % up
        if count > 0:
            out[first::up] = sum(taps[phase, j] * padded[at + j + 1 :: down][:count] for j in range(2 * half))
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def _bytes_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


KINDS = (MULAW, ALAW, IMA)
IMA_DATA = 64  # bytes of codes in an ADPCM block, after its 4 bytes of state
STORED_RATE = 1000


def from_payload(payload: bytes) -> bytes:
    """A WAVE file whose coded samples are the payload's bytes: mu-law or A-law codes, or pairs of ADPCM codes in blocks that
    begin at silence.  The payload's checksum chooses the codec, so equal payloads give equal files."""
    kind = KINDS[zlib.crc32(payload) % len(KINDS)]
    if kind != IMA:
        return to_wav(payload, kind)
    blocks = np.zeros((len(payload) // IMA_DATA, 4 + IMA_DATA), np.uint8)
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, IMA_DATA)
    return to_wav(blocks.tobytes(), IMA, block=4 + IMA_DATA)


def payload_of(kind: int, data: bytes, block: int) -> bytes:
    """The coded samples alone, without the state of ADPCM blocks."""
    if kind != IMA:
        return data
    whole = np.frombuffer(data[: len(data) // block * block], np.uint8).reshape(-1, block)[:, 4:].tobytes()
    return whole + data[len(whole) // (block - 4) * block :][4:]


def decode_all(files: list[bytes | None], to_rate: int | None) -> list[np.ndarray | None]:
    """16-bit PCM of each file at `to_rate` (None: the file's own), or None where it can't be read.  ADPCM blocks of one size are
    decoded at once, whichever files they are from."""
    found = [from_wav(x) for x in files]
    found = [f if f and f[0] in (PCM, ALAW, MULAW, IMA) and (f[0] != IMA or f[2] > 4) and f[1] > 0 else None for f in found]
    out: list[np.ndarray | None] = [None] * len(files)
    together: dict[int, list[int]] = {}
    for i, f in enumerate(found):
        if f and f[0] == IMA and f[3] and len(f[3]) % f[2] == 0:
            together.setdefault(f[2], []).append(i)
        elif f:
            out[i] = to_pcm(f[0], f[3], f[2])
    for block, some in together.items():
        pcm, at = decode_ima(b"".join(found[i][3] for i in some), block), 0
        for i in some:
            n = len(found[i][3]) // block * (2 * (block - 4) + 1)
            out[i], at = pcm[at : at + n], at + n
    return [None if pcm is None else resample(pcm, f[1], to_rate or f[1]) for pcm, f in zip(out, found, strict=True)]


def store_text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: the UTF-8 bytes of each whole text as coded samples in a WAVE file, written to the shared folder and
    read again.  Bytes 0 fill it up to a positive multiple of 64; a null text counts as empty; null keys and repeated rows stay
    as they are; an empty table gives an empty one; other columns are not looked at."""

    def write(batches):
        for batch in batches:
            for part in slices(batch, 512):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([from_payload(_bytes_of(t)) for t in texts], pa.binary())],
                    names=[key, "n_bytes", "media"],
                )

    rows = df.select(df[key].cast("long").alias(key), text)
    return stage_table(rows.mapInArrow(write, f"`{key}` long, n_bytes long, media binary"), "media")


def decode_media(df: DataFrame, media: str = "media", to_rate: int = 16000) -> DataFrame:
    """df's rows with pcm (16-bit little-endian, at `to_rate`), n_samples and peak; all three null where the file is null or
    can't be read.  Columns of df with these names give way."""
    rows = df.drop("pcm", "n_samples", "peak")

    def read(batches):
        for batch in batches:
            for part in slices(batch, 64):
                found = decode_all(part.column(part.schema.get_field_index(media)).to_pylist(), to_rate)
                out = [(None, None, None) if pcm is None else (pcm.astype("<i2").tobytes(), len(pcm), int(np.abs(pcm.astype(np.int32)).max(initial=0))) for pcm in found]
                new = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "pcm", "n_samples", "peak"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(read, f"{kinds + ', ' if kinds else ''}pcm binary, n_samples long, peak long")


def features(pcm: np.ndarray) -> str:
    """Samples, mean square, peak, sign changes, and a checksum."""
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1]))) if len(pcm) else 0
    return f"{len(pcm)}|{int(wide @ wide) // max(1, len(pcm))}|{int(np.abs(wide).max(initial=0))}|{turns}|{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def media_digest(df: DataFrame, key: str = "doc_id", to_rate: int = STORED_RATE) -> DataFrame:
    """The stored files' digests: sizes, checksums of the payload read back and of the file, and features of its sound, taken from
    PCM at `to_rate` that is written to the shared folder and read again.

    A null file, or one that can't be read, has nulls in what is taken from its payload and sound, and a null file in all."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, 128):
                rows, files = [], part.column(2).to_pylist()
                for media, pcm in zip(files, decode_all(files, to_rate), strict=True):
                    about = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                    if pcm is None:
                        rows.append((None, None, None, *about, None))
                        continue
                    kind, _, block, data = from_wav(media)
                    data = payload_of(kind, data, block)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), *about, pcm.astype("<i2").tobytes()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, 512):
                made = [None if x is None else features(np.frombuffer(x, "<i2")) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.string())], names=[*part.schema.names[:-1], "feature"])

    kinds = f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    stored = stage_table(df.select(key, "n_bytes", "media").mapInArrow(read, kinds + "pcm binary"), "pcm")
    return stored.mapInArrow(measure, kinds + "feature string")


def op6_media(spark, sf_dir):
    """Every whole text stored as telephony samples (mu-law, A-law or ADPCM), decoded, resampled, stored again and measured."""
    media = store_text_media(documents(spark, sf_dir))
    out = media_digest(media)
    drop_table(media)
    return out
