import time

import pytest

from runweave.sources import masks
from runweave.streaming import spans as streaming

SPANS = "mask_id long, y long, x_start long, x_end long"


def play(spark, folder, batches, schema, build):
    """Feeds the batches one by one and returns all rows that came out."""
    name = f"out_{abs(hash(str(folder)))}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = None
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            if query is None:
                query = build(source).writeStream.format("memory").queryName(name).outputMode("append").start()
            query.processAllAvailable()
            time.sleep(0.01 * k)
        return sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        if query is not None:
            query.stop()


def test_normalize_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = play(spark, tmp_path / "in", [[(0, 0, 0, 5), (0, 1, 0, 3)], [(0, 1, 3, 6), (0, 2, 0, 1)]], SPANS, streaming.normalize_stream)
    assert out == [(0, 0, 0, 5), (0, 1, 0, 6)]


def test_cluster_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = play(spark, tmp_path / "in", [[(0, 0, 0, 2), (0, 0, 5, 6)], [(0, 1, 2, 3), (0, 1, 9, 10)], [(0, 3, 0, 1)]], SPANS, lambda s: streaming.cluster_stream(s, 100))
    assert out == [(0, 0, 0, 0, 2), (0, 0, 1, 2, 3), (0, 5, 0, 5, 6), (0, 109, 1, 9, 10)]


def test_encode_stream_and_late_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    ranges = "mask_id long, start long, end long"
    assert play(spark, tmp_path / "a", [[(0, 10, 30), (0, 45, 50)], [(0, 205, 210)]], ranges, streaming.encode_stream) == [(0, 10, 20), (0, 15, 5), (0, 155, 5)]
    with pytest.raises(Exception, match="came after row"):
        play(spark, tmp_path / "b", [[(0, 5, 0, 2)], [(0, 4, 0, 2)]], SPANS, streaming.normalize_stream)


def test_wire_files(spark, tmp_path):
    from runweave.sources import encoding

    mask = masks.from_ranges(spark, [(0, 10, 30)])
    raw = bytes(encoding.wire_encode(mask, masks.from_bounds(spark, [(0, 0, 0, 100, 10)])).first()["payload"])
    (tmp_path / "one.bin").write_bytes(raw)
    found = encoding.read_wire(spark, str(tmp_path))
    assert [(r["start"], r["end"]) for r in encoding.wire_decode(found).collect()] == [(10, 30)]


def test_ends_of_streams(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).mkdir()
    end = (0, None, None, None)
    assert play(spark, tmp_path / "a", [[(0, 0, 0, 5), (0, 1, 0, 3)], [(0, 1, 3, 6), end], [(0, 0, 2, 4), (1, 7, 1, 2), end]], SPANS, streaming.normalize_stream) == [(0, 0, 0, 5), (0, 0, 2, 4), (0, 1, 0, 6)]
    out = play(spark, tmp_path / "b", [[(0, 0, 0, 2), (0, 0, 5, 6)], [(0, 1, 2, 3), end]], SPANS, lambda s: streaming.cluster_stream(s, 100))
    assert out == [(0, 0, 0, 0, 2), (0, 0, 1, 2, 3), (0, 5, 0, 5, 6)]
    ranges = "mask_id long, start long, end long"
    out = play(spark, tmp_path / "c", [[(0, 10, 30), (0, 45, 50)], [(0, 205, 210), (0, None, None), (1, 3, 4)]], ranges, streaming.mask_stream)
    assert out == [(0, [20, 5, 5], [10, 15, 155])]


def test_wire_stream_and_sink(spark, tmp_path):
    from runweave.sources import encoding

    made = encoding.wire_encode(masks.from_ranges(spark, [(3, 10, 30), (4, 0, 7), (4, 9, 11)]), masks.from_bounds(spark, [(3, 0, 0, 100, 10), (4, 0, 0, 5, 5)]), terminator=False)
    folder = str(tmp_path / "masks")
    encoding.write_wire_files(made, folder)
    encoding.write_wire_files(made, folder)  # again, as a task that is run twice would
    assert sorted(p.name for p in (tmp_path / "masks").iterdir()) == ["3.mask", "4.mask"]
    found = streaming.run_to_end(encoding.wire_decode(encoding.read_wire_stream(spark, folder)))
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(0, 7), (9, 11), (10, 30)]
    made.write.parquet(str(tmp_path / "rows"))
    again = spark.readStream.schema(made.schema).parquet(str(tmp_path / "rows"))
    encoding.write_wire_stream(again, str(tmp_path / "more")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(p.name for p in (tmp_path / "more").iterdir()) == ["3.mask", "4.mask"]
