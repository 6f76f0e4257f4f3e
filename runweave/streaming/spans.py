"""Spans that arrive as a stream, each mask's in the order of rows.

State per mask is what a sweep over rows has to keep: the row that is still open, or the components that the next row can
still reach.  A span of a row that has been passed is an error, like an unsorted input.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runweave.operators.cluster import label_runs
from runweave.shipping import shared_folder, ship

SPANS = "mask_id long, y long, x_start long, x_end long"


def _sorted_rows(frames, last: int | None) -> tuple[list[tuple[int, int, int]], bool]:
    """The rows that came, in order, and whether their mask ends with them: a row whose y is null says so."""
    found, ends = set(), False
    for f in frames:
        ends |= bool(f["y"].isna().any())
        f = f[f["y"].notna()].astype({"y": "int64", "x_start": "int64", "x_end": "int64"})
        found.update(zip(f["y"].tolist(), f["x_start"].tolist(), f["x_end"].tolist()))
    rows = sorted(found)
    if rows and last is not None and rows[0][0] < last:
        raise ValueError(f"row {rows[0][0]} came after row {last}")
    return rows, ends


def _merge(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for y, s, e in sorted(rows):
        if out and out[-1][0] == y and s <= out[-1][2]:
            out[-1] = (y, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((y, s, e))
    return out


def _frame(mask: int, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names).astype("int64")
    out.insert(0, "mask_id", mask)
    return out.astype("int64")


def _keep(state: GroupState, rows: list[tuple], ends: bool) -> None:
    if ends or not rows:
        if state.exists:
            state.remove()
    else:
        state.update(tuple([list(c) for c in zip(*rows)]))


def with_ends(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """A stream of spans and of masks (mask_id) that end: a row of nulls ends a mask once its last spans have come."""
    return spans.unionByName(ends.select("mask_id"), allowMissingColumns=True)


def normalize_stream(spans: DataFrame) -> DataFrame:
    """Canonical spans of the rows that a mask's stream has passed; the last row stays open until the mask ends (a row whose y
    is null), when all that is open comes out and nothing of the mask is kept."""
    ship(spans.sparkSession)

    def step(key, frames, state: GroupState):
        held = [tuple(r) for r in zip(*state.get)] if state.exists else []
        new, ends = _sorted_rows(frames, held[-1][0] if held else None)
        rows = _merge(held + new)
        last = rows[-1][0] if rows else 0
        _keep(state, [r for r in rows if r[0] == last], ends)
        yield _frame(key[0], [r for r in rows if ends or r[0] < last], ["y", "x_start", "x_end"])

    kept = "y array<long>, s array<long>, e array<long>"
    return spans.groupBy("mask_id").applyInPandasWithState(step, SPANS, kept, "append", GroupStateTimeout.NoTimeout)


def cluster_stream(spans: DataFrame, width: int) -> DataFrame:
    """mask_id, cluster_id, y, x_start, x_end of components that no further row can reach: those whose last row is at least
    two rows behind the stream's, and all of a mask that ends (a row whose y is null)."""
    ship(spans.sparkSession)

    def step(key, frames, state: GroupState):
        held = [tuple(r) for r in zip(*state.get)] if state.exists else []
        new, ends = _sorted_rows(frames, max(r[0] for r in held) if held else None)
        rows = _merge(held + new)
        roots, last = label_runs(rows) if rows else [], rows[-1][0] if rows else 0
        lowest: dict[int, int] = {}
        for root, row in zip(roots, rows, strict=True):
            lowest[root] = max(lowest.get(root, row[0]), row[0])
        over = [ends or lowest[root] < last - 1 for root in roots]
        done = [(rows[root][0] * width + rows[root][1], *row) for root, row, o in zip(roots, rows, over, strict=True) if o]
        _keep(state, [row for row, o in zip(rows, over, strict=True) if not o], ends)
        yield _frame(key[0], done, ["cluster_id", "y", "x_start", "x_end"])

    kept = "y array<long>, s array<long>, e array<long>"
    return spans.groupBy("mask_id").applyInPandasWithState(step, "mask_id long, cluster_id long, y long, x_start long, x_end long", kept, "append", GroupStateTimeout.NoTimeout)


def _offsets(frames, last: int | None) -> tuple[list[tuple[int, int]], int | None, bool]:
    """(gap, length) of the ranges that came, the last end, and whether the mask ends: a row whose start is null says so."""
    out, came, ends = [], [], False
    for f in frames:
        ends |= bool(f["start"].isna().any())
        f = f[f["start"].notna()].astype({"start": "int64", "end": "int64"})
        came += zip(f["start"].tolist(), f["end"].tolist())
    for s, e in sorted(came):
        if e <= s or last is not None and s <= last:
            raise ValueError(f"range {s}..{e} is empty, overlaps or touches one before it")
        out.append((s - (last or 0), e - s))
        last = e
    return out, last, ends


def encode_stream(ranges: DataFrame) -> DataFrame:
    """mask_id, gap, len of ranges that arrive in the order of starts; one that overlaps or touches what came before is an
    error.  What stays is each mask's last end, until the mask ends (a row whose start is null)."""
    ship(ranges.sparkSession)

    def step(key, frames, state: GroupState):
        out, last, ends = _offsets(frames, state.get[0] if state.exists else None)
        if ends and state.exists:
            state.remove()
        elif not ends:
            state.update((last,))
        yield _frame(key[0], out, ["gap", "len"])

    return ranges.groupBy("mask_id").applyInPandasWithState(step, "mask_id long, gap long, len long", "last long", "append", GroupStateTimeout.NoTimeout)


def mask_stream(ranges: DataFrame) -> DataFrame:
    """mask_id, included, excluded: a mask once its ordered ranges have all come, that is, with a row whose start is null."""
    ship(ranges.sparkSession)

    def step(key, frames, state: GroupState):
        gaps, lens, last = state.get if state.exists else ([], [], None)
        out, last, ends = _offsets(frames, last)
        gaps, lens = [*gaps, *(g for g, _ in out)], [*lens, *(n for _, n in out)]
        if not ends:
            state.update((gaps, lens, last))
            yield pd.DataFrame({"mask_id": [], "included": [], "excluded": []})
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"mask_id": [key[0]], "included": [lens], "excluded": [gaps]})

    kept = "gaps array<long>, lens array<long>, last long"
    return ranges.groupBy("mask_id").applyInPandasWithState(step, "mask_id long, included array<long>, excluded array<long>", kept, "append", GroupStateTimeout.NoTimeout)


def encode_batches(ranges: DataFrame, bounds: DataFrame, path: str):
    """A writer that encodes each micro-batch's masks, which hold all of their ranges, into payloads: use with foreachBatch."""
    from runweave.sources.encoding import wire_encode

    def write(batch: DataFrame, epoch: int) -> None:
        wire_encode(batch, bounds).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return ranges.writeStream.foreachBatch(write)


def run_to_end(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Runs a stream over all that its source holds now, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True)
    writer.start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
