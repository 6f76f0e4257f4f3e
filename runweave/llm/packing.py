"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens by ascending key.  Every window of `length` tokens is filled from the
queues in proportion to their weights: a window adds each queue's quantum (its share of the window) to its deficit, the
queue gives the whole tokens that it is owed, and what is left of the deficit goes on into the next window, and across
documents, key ranges and tasks.  With one token as the unit of service, tokens are served in the order of
(position + 1/2) / weight, so the state after any number of windows has a closed form (`Mixture.given`, `Mixture.deficits`).
That is how a task takes over the deficits of all windows before its own, without running them: a task can fill its part of any
window without knowing what others do.  A source that has run dry leaves its share to the others.  Only the last window
can be short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import documents, stage_table
from runweave.llm.token_ids import SEEN, encoder, forget_encoders, key_bounds, parts_of, slices, tokenise, vocabulary_path

LENGTH = 2048
MOST_SOURCES = 100_000


class Mixture:
    """Sources in a fixed order, with tokens held and integer weights (both positive)."""

    def __init__(self, held: list[int], weights: list[int], length: int = LENGTH):
        self.held, self.weights, self.length, self.total = held, weights, length, sum(held)
        # phases: sources run dry in the order of held / weight
        order = sorted(range(len(held)), key=lambda s: (Fraction(held[s], weights[s]), s))
        self.phases, self.dry, spent, active = [], [], 0, sum(weights)
        for s in order:  # (tokens served when the phase begins at the latest, tokens of dry sources, weight of the others)
            served = spent + active * held[s] // weights[s]
            self.phases.append((served, spent, active))
            self.dry.append((spent + Fraction(active * held[s], weights[s]), spent, active))
            spent, active = spent + held[s], active - weights[s]
        self.ends = [p[0] for p in self.phases]
        self.windows: dict[int, tuple[list[int], list[int]]] = {}

    def given(self, tokens: int) -> list[int]:
        """How many of the first `tokens` tokens come from each source."""
        if tokens >= self.total:
            return list(self.held)
        _, spent, active = self.phases[min(bisect_right(self.ends, tokens), len(self.phases) - 1)]
        got = [min(h, (2 * (tokens - spent) * w + active) // (2 * active)) for h, w in zip(self.held, self.weights, strict=True)]
        off = sum(got) - tokens
        while off:  # rounding leaves fewer tokens than there are sources to give back or to add, in the order of service
            best = None
            for s, w in enumerate(self.weights):
                if off > 0 and got[s] > 0:
                    at = (2 * got[s] - 1, w, s)
                    if best is None or at[0] * best[1] > best[0] * at[1] or at[0] * best[1] == best[0] * at[1] and s > best[2]:
                        best = at
                elif off < 0 and got[s] < self.held[s]:
                    at = (2 * got[s] + 1, w, s)
                    if best is None or at[0] * best[1] < best[0] * at[1]:
                        best = at
            got[best[2]] += -1 if off > 0 else 1
            off += -1 if off > 0 else 1
        return got

    def owed(self, tokens: int) -> list[Fraction]:
        """What is due to each source once `tokens` tokens have been served, whole or not."""
        if tokens >= self.total:
            return [Fraction(h) for h in self.held]
        spent, active = next((spent, active) for end, spent, active in self.dry if end >= tokens)
        return [min(Fraction(h), Fraction((tokens - spent) * w, active)) for h, w in zip(self.held, self.weights, strict=True)]

    def quanta(self, w: int) -> list[Fraction]:
        """What window w adds to each source's deficit."""
        a, b = self.owed(w * self.length), self.owed((w + 1) * self.length)
        return [y - x for x, y in zip(a, b, strict=True)]

    def deficits(self, w: int) -> list[Fraction]:
        """What each source carries into window w: what it is owed from the windows before, less what it has given.  Below 0
        where rounding let it give a token early."""
        return [x - y for x, y in zip(self.owed(w * self.length), self.given(w * self.length), strict=True)]

    def window(self, w: int) -> tuple[list[int], list[int]]:
        """(tokens of each source before window w, place in the window where each source's tokens begin)."""
        found = self.windows.get(w)
        if found is None:
            if len(self.windows) > 20_000:
                self.windows.clear()
            a, b = self.given(w * self.length), self.given((w + 1) * self.length)
            place = [0]
            for x, y in zip(a, b, strict=True):
                place.append(place[-1] + y - x)
            found = self.windows[w] = (a, place)
        return found

    def first_window(self, s: int, at: int) -> int:
        """The window that holds token `at` of source s."""
        low, high = 0, max(0, (self.total - 1) // self.length)
        guess = min(high, sum(min(h, (2 * at + 1) * w // (2 * self.weights[s])) for h, w in zip(self.held, self.weights, strict=True)) // self.length)
        step = 1
        while guess > low and self.window(guess)[0][s] > at:
            high, guess, step = guess - 1, max(low, guess - step), step * 2
        low, guess, step = guess, min(high, guess + 1), 1
        while low < high and self.window(guess)[0][s] <= at:
            low, guess, step = guess, min(high, guess + step), step * 2
            if low == guess:
                break
        high = max(low, guess)
        while low < high:
            mid = (low + high + 1) // 2
            if self.window(mid)[0][s] <= at:
                low = mid
            else:
                high = mid - 1
        return low

    def pieces(self, s: int, at: int, n: int):
        """(offset among the n tokens, length, window, place in the window) of tokens at .. at + n of source s."""
        done, w = 0, self.first_window(s, at) if n else 0
        while done < n:
            before, place = self.window(w)
            end = before[s] + place[s + 1] - place[s]
            take = min(n - done, end - at - done)
            if take > 0:
                yield done, take, w, place[s] + at + done - before[s]
                done += take
            w += 1


def pack_documents(df: DataFrame, path: str, end_id: int, length: int = LENGTH, weights: dict | None = None, key: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = False, seen: int = SEEN) -> DataFrame:
    """One row per piece: key, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as little-endian
    unsigned 32-bit integers, with_ids).

    weights: integer target per source; without, each source's share of all tokens, so that all run dry together.  A
    source that weights doesn't name gets weight 1.  A null source is a source of its own; null texts count as empty and
    give one piece, the end id; null keys come first; rows that share a key keep any order among themselves, which is
    written down before it is used.  An empty table gives an empty result; other columns are not looked at.  A row for each
    source reaches the driver.

    The text is encoded once and never shuffled; its ids are shuffled once, by key range.  seen: units that a worker remembers,
    see encoder()."""
    spark = df.sparkSession
    rows = tokenise(df.withColumn("_source", F.col(source).cast("string")), path, end_id, key, text, ("_source",), key_bounds(df, key, parts_of(spark)), seen=seen)
    dtype = encoder(path).dtype

    def place(batches):
        if seen < SEEN:  # memory is scarce; otherwise the encoder stays for later runs
            forget_encoders()
        here, at = None, 0
        for batch in batches:
            for part in slices(batch, 4096):
                local = []
                for group in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if group[:2] != here:
                        here, at = group[:2], 0
                    local.append(at)
                    at += group[2]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(local, pa.int64())], names=["pid", key, "_source", "n", "ids", "local"])

    ordered = rows.repartitionById(parts_of(spark), "pid").sortWithinPartitions("pid", "_source", key)
    held = stage_table(ordered.mapInArrow(place, f"pid int, `{key}` long, _source string, n long, ids binary, local long"), "queues")
    sums = held.groupBy("_source", "pid").agg(F.sum("n").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = sorted(((r["_source"], r["n"]) for r in sums.groupBy("_source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"{len(totals)} sources: every task holds them all, so MOST_SOURCES is the limit; group them by another column")
    names = [s for s, _ in totals]
    tokens = [n for _, n in totals]
    share = tokens if weights is None else [max(1, int(weights.get(s, 1))) for s in names]
    # a row for each key range and source at most; whether that is small enough for a broadcast is left to the planner
    base = stage_table(base.drop("n").withColumnsRenamed({"pid": "p2", "_source": "s2"}), "queue-starts")
    joined = held.join(base, (F.col("pid") == F.col("p2")) & F.col("_source").eqNullSafe(F.col("s2")))

    def cut(batches):
        mix, index = Mixture(tokens, share, length), {s: k for k, s in enumerate(names)}
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, src, n, ids, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), part.column(4).to_pylist()):
                    wide = np.frombuffer(ids.as_buffer(), dtype).astype("<u4").tobytes()
                    for first, size, w, offset in mix.pieces(index[src], at, n):
                        own = wide[4 * first : 4 * (first + size)]
                        out.append((doc, src, first, size, zlib.crc32(own), n, w, offset, own if with_ids else None))
                kinds = (pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary())
                cols = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, source, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kinds = f"`{key}` long, `{source}` string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    out = joined.select(key, "_source", "n", "ids", (F.col("base") + F.col("local")).alias("at")).mapInArrow(cut, kinds)
    return out if with_ids else out.drop("ids")


def op3_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens, each with the corpus's own mixture of sources."""
    return pack_documents(documents(spark, sf_dir), vocabulary_path(), 1)
