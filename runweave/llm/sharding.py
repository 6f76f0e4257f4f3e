"""Consistent-hash ring with virtual nodes and bounded loads.

Keys hash onto a ring on which each shard owns `vnodes` points.  A key goes to the next point clockwise; if the shard
there is full, it continues to the next point whose shard has room.  Only counts per arc (at most n_shards * vnodes
rows) reach the driver, which walks the ring once and returns rank intervals; documents learn their shard from a
broadcast of these intervals, whose number is bounded by the ring and not by the data.

Everything that touches documents is DataFrame code.  The text itself is never shuffled: only its size and checksum are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import documents, literal_table

RING_BITS = 63
SLOT_BITS = 12


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order; positions are below 2**63 and distinct."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") >> 1
            while at in taken:
                at = (at + 1) % (1 << RING_BITS)
            taken[at] = shard
    return sorted(taken.items())


def arc_slices(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(slot, lo, hi, arc): arc i holds hashes in (position i-1, position i], cut at multiples of the slot width."""
    width, end, out = 1 << (RING_BITS - SLOT_BITS), (1 << RING_BITS) - 1, []
    low = 0
    for arc, (at, _) in [*enumerate(points), (0, (end, 0))]:
        for slot in range(low // width, at // width + 1) if low <= at else ():
            out.append((slot, max(low, slot * width), min(at, (slot + 1) * width - 1), arc))
        low = at + 1
    return out


def capacities(n_rows: int, n_shards: int, load_factor: float, demand: list[int]) -> list[int]:
    """Rows that each shard may hold.  At load factor 1 they add up to n_rows: the shards in most demand get the odd rows."""
    if load_factor > 1:
        return [-int(-load_factor * n_rows // n_shards)] * n_shards
    least, odd = divmod(n_rows, n_shards)
    first = sorted(range(n_shards), key=lambda s: (-demand[s], s))[:odd]
    return [least + (s in set(first)) for s in range(n_shards)]


def walk_ring(points: list[tuple[int, int]], counts: dict[int, int], n_shards: int, load_factor: float | None) -> list[tuple[int, int, int, int, int]]:
    """(arc, rank from, rank to, shard, first slot): which ranks of an arc's keys go to which shard.

    Keys first fill the shard at the end of their arc; what overflows there continues clockwise to shards with room.
    load_factor None: no bound."""
    demand = [0] * n_shards
    for arc, (_, shard) in enumerate(points):
        demand[shard] += counts.get(arc, 0)
    room = list(demand) if load_factor is None else capacities(sum(demand), n_shards, load_factor, demand)
    used, plan, over = [0] * n_shards, [], defaultdict(list)

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        hi = min(hi, lo + room[shard] - used[shard])
        if hi > lo:
            plan.append((arc, lo, hi, shard, used[shard]))
            used[shard] += hi - lo
        return max(lo, hi)

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        left = put(arc, 0, n, shard)
        if left < n:
            over[arc].append((left, n))
    carried: list[tuple[int, int, int]] = []
    for step in range(2 * len(points)):
        at = step % len(points)
        if step < len(points):
            carried += [(at, lo, hi) for lo, hi in over[at]]
        kept = []
        for arc, lo, hi in carried:
            left = put(arc, lo, hi, points[at][1])
            if left < hi:
                kept.append((arc, left, hi))
        carried = kept
    if carried:
        raise ValueError("the shards have less room than there are keys")
    return plan


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", vnodes: int = 128, load_factor: float | None = 1.0) -> DataFrame:
    """One row per row of `df`: key, size, text_crc32, shard, slot (gapless from 0 in each shard).

    load_factor None is the plain ring (a key's shard depends on the key and on n_shards alone); 1.0 makes shard counts
    differ by one at most; above 1, no shard holds more than ceil(load_factor * rows / n_shards).
    A null key is a key like any other; a null text has size 16 and checksum 0; repeated rows are counted before they are
    shuffled and get slots of their own; an empty table gives an empty result.  Other columns are not looked at."""
    spark = df.sparkSession
    points = ring_points(n_shards, vnodes)
    hashed = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << RING_BITS) - 1))
    arcs = F.broadcast(literal_table(spark, arc_slices(points), "slot bigint, lo bigint, hi bigint, arc int"))

    def on_ring(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("h", hashed)
        slot = F.shiftrightunsigned("h", RING_BITS - SLOT_BITS)
        return rows.join(arcs, (slot == arcs["slot"]) & F.col("h").between(arcs["lo"], arcs["hi"])).drop("slot", "lo", "hi")

    counts = {r["arc"]: r["n"] for r in on_ring(df.select(key)).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    plan = walk_ring(points, counts, n_shards, load_factor)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    same = on_ring(rows).groupBy("arc", "h", key, "size", "text_crc32").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("arc").orderBy("h", key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    steps = literal_table(spark, plan, "arc int, lo bigint, hi bigint, shard int, base bigint").withColumnRenamed("arc", "plan_arc")
    placed = ranked.join(F.broadcast(steps), (F.col("arc") == F.col("plan_arc")) & (F.col("lo") < F.col("rank") + F.col("copies")) & (F.col("hi") > F.col("rank")))
    own = placed.withColumn("own", F.explode(F.sequence(F.greatest("lo", "rank"), F.least("hi", F.col("rank") + F.col("copies")) - 1)))
    return own.select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("own") - F.col("lo")).alias("slot"))


def op1_shard(spark, sf_dir):
    """All documents in 40 shards whose counts differ by one at most (law `rows`)."""
    out = assign_shards(documents(spark, sf_dir), 40, load_factor=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
