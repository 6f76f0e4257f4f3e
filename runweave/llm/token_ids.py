"""Ids of whole texts by the tokenizers library, with words that recur looked up rather than encoded again.

A byte-level BPE tokenizer never joins what stands before a space with the space, unless white space surrounds it.  So a
text splits at its spaces into units that can be encoded one by one, and most units have been seen before.  Texts in
which that doesn't hold (runs of white space, added tokens, other kinds of tokenizer) are split more carefully or encoded
whole; the ids are those of Tokenizer.encode(text, add_special_tokens=False) without truncation and padding in any case.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20  # of text whose units are looked up together
GATHER = 1 << 20  # units whose ids are put in place at a time
SEEN = 600_000  # units in each of the two generations that a worker remembers
ODD_SPACES = r"[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
ODD_SPACE = re.compile(ODD_SPACES)
PLAIN = re.compile("[ -~\n\tÀ-ÖØ-öø-ÿ]*")
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where printable, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def units_of(text: str, added: tuple[str, ...]) -> list[str] | None:
    """What stands between the spaces that begin a unit; every unit but the first is to be read with a space before it.
    None: the text must be encoded as one."""
    if any(a in text for a in added):
        return None
    if "  " in text or "\n " in text or "\t " in text or "\r " in text or ODD_SPACE.search(text):
        return INNER_SPACE.split(text)
    return text.split(" ")


class Seen(dict):
    """Values made once for a key, in two generations: what a full one held comes back from the older as it recurs."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < 64:
            self[key] = found
        return found

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class SeenWords(Seen):
    """Units after a space: mostly a word, or a word and a mark after it."""

    marks = frozenset(",.")

    def __init__(self, encoder: UnitEncoder):
        super().__init__(None)
        self.bpe, self.unit, self.parts, self.letters = encoder._bpe, encoder._unit, encoder.parts, encoder.letters

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isalpha() and word.isascii():
                found = self.bpe(f"Ġ{word}")
            elif word[-1:] in self.marks and word[:-1].isalpha() and PLAIN.fullmatch(word):
                found = self[word[:-1]] + self.parts[word[-1]]
            elif word.isalpha() and PLAIN.fullmatch(word):
                found = self.bpe("Ġ" + "".join([self.letters[b] for b in word.encode()]))
            else:
                found = self.unit(f" {word}")
        if len(word) < 64:
            self[word] = found
        return found


class UnitEncoder:
    """Text to ids as little-endian bytes of `dtype`; units seen before are looked up.  Subclasses encode what is new."""

    by_unit = True

    def __init__(self, size: int, added: tuple[str, ...], seen: int):
        import regex
        from public_tokenizers import PATTERN

        self.size, self.added, self.seen = size, added, seen
        self.batch_bytes = max(1 << 20, min(BATCH_BYTES, BATCH_BYTES * seen // SEEN))
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.each = [np.array([k], self.dtype).tobytes() for k in range(size)]
        self.letters = [byte_letters()[b] for b in range(256)]
        self.pieces_of = regex.compile(PATTERN).findall
        self.first, self.parts = Seen(self._unit), Seen(self._part)
        self.rest = SeenWords(self)
        self.uneven = "|".join(["  ", "[\n\t\r] ", ODD_SPACES, *map(re.escape, added)])

    def _bpe(self, letters: str) -> bytes:
        """Ids of a pre-split part, given in byte-level letters."""
        raise NotImplementedError

    def _whole(self, text: str) -> bytes:
        """Ids of a text that doesn't split into units."""
        raise NotImplementedError

    def _odd(self, unit: str) -> bytes:
        """Ids of a unit that holds rare characters."""
        raise NotImplementedError

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        return self._bpe("".join([self.letters[b] for b in part.encode()]))

    def _unit(self, unit: str) -> bytes:
        if not PLAIN.fullmatch(unit):
            return self._odd(unit)
        return b"".join(map(self.parts.__getitem__, self.pieces_of(unit)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        units = units_of(text, self.added) if self.by_unit else None
        if units is None:
            return self._whole(text)
        return self._units(units)

    def _units(self, units: list[str]) -> bytes:
        for seen in (self.first, self.rest, self.parts):
            if len(seen) > self.seen:
                seen.turn()
        begin = self.first[units[0]]
        return begin + b"".join(map(self.rest.__getitem__, units[1:])) if len(units) > 1 else begin


    def encode_many(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has), with the id `end` after each text.

        Units are found and numbered by Arrow; only those that differ are looked up, each once."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.uneven) if self.by_unit else pa.array(np.ones(n, bool))
        listed = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        coded = pc.list_flatten(listed).dictionary_encode()
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        for seen in (self.first, self.rest, self.parts):
            if len(seen) > self.seen:
                seen.turn()
        firsts = pc.list_element(listed, 0).to_pylist()
        begin = [self.encode(t) if w else self.first[f] for t, w, f in zip((x.as_py() if w else None for x, w in zip(texts, whole.to_pylist())), whole.to_pylist(), firsts)]
        met = [*map(self.rest.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), *begin]
        if end is not None:
            met.append(np.array([end], self.dtype).tobytes())
        codes = np.asarray(coded.indices).astype(np.int32)
        counts = np.asarray(pc.list_value_length(listed)).astype(np.int64)
        starts = np.cumsum(counts) - counts
        codes[starts] = len(coded.dictionary) + np.arange(n, dtype=np.int32)
        if end is not None:
            codes, counts = np.insert(codes, starts + counts, len(met) - 1), counts + 1
            starts = np.cumsum(counts) - counts
        ids, sizes = self._placed(met, codes)
        return ids, np.add.reduceat(sizes, starts)

    def begins(self) -> np.ndarray:
        """Which ids begin with a space, as every word's first id does."""
        out = np.zeros(self.size, bool)
        out[[i for token, i in self.tool.get_vocab().items() if token.startswith("Ġ")]] = True
        return out

    def encode_words(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has), each word read with a space before it."""
        for seen in (self.rest, self.parts):
            if len(seen) > self.seen:
                seen.turn()
        met = [*map(self.rest.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist())]
        return self._placed(met, np.asarray(words.indices))

    def _placed(self, met: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that codes number, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, met), np.int64, len(met)) // self.dtype.itemsize
        at, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(met), self.dtype)
        out = [np.zeros(0, self.dtype)]
        for k in range(0, len(codes), GATHER):
            own = codes[k : k + GATHER]
            size = sizes[own]
            out.append(ids[np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
        return np.concatenate(out), sizes[codes]


class IdEncoder(UnitEncoder):
    """New units go through the tokenizers library: plain parts through its model, all else through its whole pipeline."""

    def __init__(self, path: str, seen: int = SEEN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        conf = json.loads(self.tool.to_str())
        super().__init__(self.tool.get_vocab_size(), tuple(a["content"] for a in conf["added_tokens"]), seen)
        pre, model = conf["pre_tokenizer"] or {}, conf["model"]
        self.by_unit = conf["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
        self.model = self.tool.model

    def _bpe(self, letters: str) -> bytes:
        each = self.each
        return b"".join([each[t.id] for t in self.model.tokenize(letters)])

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tool.encode(text, add_special_tokens=False).ids)

    _odd = _whole


_ENCODERS: dict[tuple[str, int], IdEncoder] = {}


def encoder(path: str, seen: int = SEEN) -> IdEncoder:
    """One per worker process.  seen: units that it remembers in each generation, at about 200 bytes; ids don't depend on it."""
    if (path, seen) not in _ENCODERS:
        _ENCODERS.clear()
        release_memory()
        _ENCODERS[path, seen] = IdEncoder(path, seen)
    return _ENCODERS[path, seen]


def release_memory() -> None:
    """Gives pages that this process no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def forget_encoders() -> None:
    """Drops this worker's encoder with the units it has seen, about 200 MB, and gives the pages back to the system.  Spark goes on
    using a worker for whatever comes next, where that memory would stand beside the next operator's."""
    if _ENCODERS:
        _ENCODERS.clear()
        release_memory()


def slices(batch: pa.RecordBatch, rows: int = 256):
    """A batch in small parts, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """A batch in parts of about `most` bytes of text, or of one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column out of values that stand one after the other, of which each row takes some."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def tokenise(df: DataFrame, path: str, end_id: int, key: str, text: str, others: tuple[str, ...] = (), bounds: list[int] | None = None, count: bool = False, seen: int = SEEN) -> DataFrame:
    """pid, key, others..., n, ids: ids of each whole text (null: empty) with `end_id` after them, as little-endian bytes of
    the encoder's dtype; pid is the key's range among `bounds` (null keys come first).  count: each task's last row has pid -1
    and, as ids, how often it has met each id, as 64-bit integers.  seen: see encoder()."""
    cut = np.array(bounds or [], np.int64)

    def run(batches):
        tool = encoder(path, seen)
        met = np.zeros(max(tool.size, end_id + 1), np.int64)
        for batch in batches:
            for part in text_slices(batch, 1, tool.batch_bytes):
                ids, sizes = tool.encode_many(part.column(1), end_id)
                keys = part.column(0)
                pid = np.where(np.asarray(keys.is_valid()), np.searchsorted(cut, np.asarray(keys.fill_null(0)), side="right"), 0)
                if count:
                    met += np.bincount(ids, minlength=len(met))
                for row in range(0, part.num_rows, 256):  # the worker's consumer gets small batches
                    some, begin = sizes[row : row + 256], int(sizes[:row].sum())
                    own = part.slice(row, 256)
                    cols = [pa.array(pid[row : row + 256], pa.int32()), *own.columns[:1], *own.columns[2:], pa.array(some, pa.int64()), binaries(ids[begin : begin + int(some.sum())], some)]
                    yield pa.RecordBatch.from_arrays(cols, names=["pid", key, *others, "n", "ids"])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([met.tobytes()], pa.binary())], names=["pid", key, "n", "ids"])

    if count and others:
        raise ValueError("counts come without other columns")
    rows = df.select(F.col(key).cast("long").alias(key), text, *others)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, f"pid int, `{key}` long, {kinds}n long, ids binary")


def key_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 keys that cut the rows into ranges of about equal numbers; only the key column is read."""
    share = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), F.lit(share) if len(share) != 1 else F.array(F.lit(share[0])), 10_000).alias("q")).first()["q"] if share else []
    return sorted(set(found or []))


def parts_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
