"""Substring deduplication by suffix automata of reference shards.

A word that a window of `window` words covers is removed where the window's words also start in a document with a smaller
key.  The corpus is cut into reference shards by content: the anchor of a window is the smallest hash among the k-word
grams inside it, so windows with equal words have equal anchors, and a stretch of words around an anchor (a segment)
needs to meet only segments with the same anchor.  A shard is the set of distinct segments under one anchor.  For each
shard a suffix automaton over words is built in the order of keys, and each segment is streamed through the automaton of
those before it for its matching statistics: the length of the longest match that ends at each word.  Where that
reaches `window`, the window is a repeat; repeats join into maximal spans, which go.

Every automaton meets only the segments that can match it: sending the automata of the whole corpus to every document
would cost the square of the corpus.  Hashes only choose what meets; matches compare words.

Anchors that a single document has are dropped after a count; equal segments are one segment with the smallest key
before they are shuffled; segments under an anchor with more than HOT occurrences are dealt by single windows instead, so
that a passage which a third of all documents hold spreads over as many tasks as its surroundings have words.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import documents, drop_table, stage_table
from runweave.llm.token_ids import parts_of, slices

WINDOW = 13
HOT = 20_000
FIRST = -(1 << 63)
HASHED = 1 << 20  # bytes that are hashed at a time, or a longer word
SPACES = re.compile(rb"[\x20\x09-\x0D]")
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int, cache={}) -> tuple[np.ndarray, np.ndarray]:
    have = cache.get("p")
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = cache["p"] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_POWER, inverse))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text's bytes, by numpy, in blocks that end between words."""
    out, at = [], 0
    while at < len(raw):
        gap = SPACES.search(raw, at + HASHED) if at + HASHED < len(raw) else None
        end = gap.start() if gap else len(raw)
        out.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(raw: bytes) -> np.ndarray:
    """Differences of prefix sums of a polynomial, which don't depend on where in a block a word stands."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n]
        return mix(out)


def gram_size(window: int) -> int:
    """Words in an anchor's gram: five, or what leaves at most 32 grams in a window."""
    return min(window, max(5, window - 31))


def anchor_runs(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run of consecutive windows with the same gram as anchor."""
    grams = gram_hashes(word_hashes(raw), gram_size(window))
    wide = window - gram_size(window) + 1
    if len(grams) < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(grams) - wide + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]].view(np.int64), first.astype(np.int32), np.diff(np.append(first, len(at))).astype(np.int32)


class SuffixAutomaton:
    """Of several word sequences; states hold the longest length, the suffix link and the arcs."""

    def __init__(self):
        self.length, self.link, self.arcs = [0], [-1], [{}]

    def _clone(self, p: int, q: int, word) -> int:
        length, link, arcs = self.length, self.link, self.arcs
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        arcs.append(dict(arcs[q]))
        link[q] = clone
        while p >= 0 and arcs[p].get(word) == q:
            arcs[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list) -> None:
        length, link, arcs = self.length, self.link, self.arcs
        last = 0
        for word in words:
            q = arcs[last].get(word)
            if q is not None:  # another sequence has been here
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                continue
            new, p = len(length), last
            length.append(length[last] + 1)
            link.append(0)
            arcs.append({})
            while p >= 0 and word not in arcs[p]:
                arcs[p][word] = new
                p = link[p]
            if p >= 0:
                q = arcs[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = new

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest stretch that ends there and occurs in what was added."""
        length, link, arcs = self.length, self.link, self.arcs
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in arcs[state]:
                state = link[state]
                size = length[state]
            q = arcs[state].get(word)
            state, size = (0, 0) if q is None else (q, size + 1)
            out.append(size)
        return out


def shard_masks(segments: list[tuple[int, bytes]], window: int) -> list[int]:
    """For each (smallest key, words), in the order of keys: a bit for each window that a smaller key's segment holds."""
    if len(segments) == 1:
        return [0]
    automaton, masks, waiting, key = SuffixAutomaton(), [], [], None
    for first, text in segments:
        if first != key:
            for words in waiting:
                automaton.add(words)
            waiting, key = [], first
        words = text.split()
        mask = 0
        for i, size in enumerate(automaton.statistics(words)[window - 1 :] if len(automaton.length) > 1 else ()):
            if size >= window:
                mask |= 1 << i
        masks.append(mask)
        waiting.append(words)
    return masks


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """k (the key; null before all), th (hash of the text, to tell rows with one key apart) and the text."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))


def repeated_windows(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """k, th, hits: for each row with repeats, a list of (first window, windows, bits of those that are repeats)."""
    docs, spark = _keyed(df, key, text), df.sparkSession
    parts = parts_of(spark)

    def runs(batches):
        for batch in batches:
            for part in slices(batch):
                got = [anchor_runs((t or "").encode(), window) for t in part.column(2).to_pylist()]
                n = np.array([len(g[0]) for g in got])
                keys = [pa.array(np.repeat(np.asarray(part.column(c)), n)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([g[c] for g in got])) for c in range(3)), *keys], names=["a", "at", "n", "k", "th"])

    found = stage_table(docs.mapInArrow(runs, "a long, at int, n int, k long, th long"), "anchor-runs")
    shared = found.groupBy("a").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n")).filter("least < most")
    shared = stage_table(shared.select("a", (F.col("n") > hot).alias("hot")), "shared-anchors")
    lists = found.join(shared, "a").groupBy("k", "th").agg(F.collect_list(F.struct("a", "at", "n", "hot")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 64):
                out = []
                for k, th, t, listed in zip(*(c.to_pylist() for c in part.columns)):
                    raw = t.encode()
                    words, windows = raw.split(), None
                    for r in listed:
                        at, n = r["at"], r["n"]
                        if not r["hot"]:
                            out.append((r["a"], b" ".join(words[at : at + n + window - 1]), k, th, at, n))
                            continue
                        if windows is None:
                            windows = gram_hashes(word_hashes(raw), window).view(np.int64)
                        out += [(int(windows[i]), b" ".join(words[i : i + window]), k, th, i, 1) for i in range(at, at + n)]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["a", "words", "k", "th", "at", "n"])

    joined = docs.join(lists.withColumnsRenamed({"k": "k2", "th": "th2"}), (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2"))).select("k", "th", "t", "runs")
    segments = joined.mapInArrow(cut, "a long, words binary, k long, th long, at int, n int").withColumn("h", F.xxhash64("words"))
    segments = stage_table(segments, "segments")
    drop_table(found)
    drop_table(shared)

    def shards(batches):
        group, rows = None, []

        def close():
            return [(group, h, first, mask) for (first, _, h), mask in zip(rows, shard_masks([r[:2] for r in rows], window), strict=True)]

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], pa.int64()) for c in range(4)], names=["a", "h", "first", "bits"])

        done = []
        for batch in batches:
            for a, words, h, first in zip(*(c.to_pylist() for c in batch.columns)):
                if a != group and rows:
                    done += close()
                    rows = []
                    if len(done) > 10_000:
                        yield out(done)
                        done = []
                group = a
                rows.append((first, words, h))
        if rows:
            done += close()
        yield out(done)

    distinct = segments.groupBy("a", "words", "h").agg(F.min("k").alias("first")).select("a", "words", "h", "first")
    verdicts = distinct.repartition(parts, "a").sortWithinPartitions("a", "first", "words").mapInArrow(shards, "a long, h long, first long, bits long")
    verdicts = stage_table(verdicts, "shard-verdicts").withColumnsRenamed({"a": "a2", "h": "h2"})
    hits = segments.drop("words").join(verdicts, (F.col("a") == F.col("a2")) & (F.col("h") == F.col("h2")))
    hits = hits.withColumn("bits", F.when(F.col("k") > F.col("first"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("bits"))).filter("bits != 0")
    return stage_table(hits.groupBy("k", "th").agg(F.collect_list(F.struct("at", "n", "bits")).alias("hits")), "repeats")


def removed_words(n_words: int, hits: list | None, window: int) -> np.ndarray:
    """Which words the repeated windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for hit in hits or ():
        for i in range(hit["n"]):
            if hit["bits"] >> i & 1:
                change[hit["at"] + i] += 1
                change[hit["at"] + i + window] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_hits(df: DataFrame, window: int, key: str, text: str, hot: int) -> DataFrame:
    """df's rows with a column _rw_hits."""
    hits = repeated_windows(df.select(key, text), window, key, text, hot)
    hits = hits.withColumnsRenamed({"k": "_rw_k", "th": "_rw_th", "hits": "_rw_hits"})
    same = (F.coalesce(F.col(key).cast("long"), F.lit(FIRST)) == F.col("_rw_k")) & (F.xxhash64(text) == F.col("_rw_th"))
    return df.join(hits, same, "left").drop("_rw_k", "_rw_th")


def strip_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """df's rows and columns; a text with repeats becomes its kept words joined by one space, others stay byte for byte.

    Words are what stands between bytes 0x20 and 0x09-0x0D.  Null and short texts have no windows and stay; a null key
    counts as smaller than all others; rows with one key don't repeat each other."""

    def keep(batches):
        for batch in batches:
            for part in slices(batch):
                at, own = part.schema.get_field_index(text), part.schema.get_field_index("_rw_hits")
                texts = part.column(at).to_pylist()
                for i, hits in enumerate(part.column(own).to_pylist()):
                    if hits:
                        words = texts[i].encode().split()
                        gone = removed_words(len(words), hits, window)
                        texts[i] = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()
                cols = [pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(part.num_columns) if c != own]
                yield pa.RecordBatch.from_arrays(cols, names=[n for c, n in enumerate(part.schema.names) if c != own])

    return _with_hits(df, window, key, text, hot).mapInArrow(keep, df.schema)


def repeat_digest(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 for every row; see strip_repeats() for what nulls and ties do."""

    def digest(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t, hits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (t or "").encode().split()
                    kept = words
                    if hits:
                        gone = removed_words(len(words), hits, window).tolist()
                        kept = [w for w, g in zip(words, gone, strict=True) if not g]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[key, "n_words", "n_removed", "kept_sha256"])

    rows = df.select(F.col(key).cast("long").alias(key), text)
    return _with_hits(rows, window, key, text, hot).select(key, text, "_rw_hits").mapInArrow(digest, f"`{key}` long, n_words long, n_removed long, kept_sha256 string")


def op5_substring(spark, sf_dir):
    """Words of every document under 13-word windows that a document with a smaller doc_id has too."""
    return repeat_digest(documents(spark, sf_dir))


SQL = {
    "op5_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM p),
f AS (SELECT x, min(doc_id) AS first FROM g GROUP BY x),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS pos FROM g JOIN f USING (x) WHERE f.first < g.doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w FROM d),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(w[a.pos], ' ' ORDER BY a.pos) AS kept FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
}
