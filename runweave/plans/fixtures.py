"""Masks derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.shipping import ship


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir: str, odd: int) -> DataFrame:
    """A span per line item, masks by supplier: even (0) or odd (1) line numbers."""
    return line_spans(_table(spark, sf_dir, "lineitem"), odd)


def line_spans(t: DataFrame, odd: int) -> DataFrame:
    return t.filter(F.col("l_linenumber") % 2 == odd).selectExpr("CAST(l_suppkey AS BIGINT) AS mask_id", "CAST(l_orderkey % 256 AS BIGINT) AS y", "CAST(l_partkey % 200 AS BIGINT) AS x_start", "CAST(l_partkey % 200 + CAST(l_quantity AS BIGINT) AS BIGINT) AS x_end")


def orders(spark, sf_dir: str) -> DataFrame:
    """A rectangle per order, masks by customer."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS BIGINT) AS mask_id", "CAST(o_custkey % 200 + o_orderkey % 13 AS BIGINT) AS x", "CAST(o_orderkey % 200 AS BIGINT) AS y", "CAST(1 + o_orderkey % 17 AS BIGINT) AS w", "CAST(1 + o_custkey % 11 AS BIGINT) AS h"
    )


def events(spark, sf_dir: str) -> DataFrame:
    """A range of minutes of a month per event, masks by user, with the event's type as metadata."""
    t = _table(spark, sf_dir, "events").withColumn("start", F.expr("CAST((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT)"))
    return t.selectExpr("CAST(user_id AS BIGINT) AS mask_id", "start", "start + 1 + CAST(floor(value) AS BIGINT) AS end", "event_type AS meta", "CAST(event_id AS BIGINT) AS priority")


def vectors(spark, sf_dir: str) -> DataFrame:
    """An 8x8 bitmap per embedding: the signs of its 64 numbers."""
    return vector_bitmaps(_table(spark, sf_dir, "embeddings"))


def vector_bitmaps(t: DataFrame) -> DataFrame:
    return t.selectExpr("CAST(vec_id AS BIGINT) AS mask_id", "8L AS width", "transform(slice(embedding, 1, 64), v -> v > 0) AS pixels")


def stream(spark, sf_dir: str, name: str) -> DataFrame:
    """The same table as it would arrive."""
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parq*")


def canvas(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The same bounds for every mask of df."""
    return df.select("mask_id").distinct().selectExpr("mask_id", f"{x}L AS bx", f"{y}L AS by", f"{w}L AS bw", f"{h}L AS bh")


A = "(SELECT CAST(l_suppkey AS BIGINT) AS mask_id, CAST(l_orderkey % 256 AS BIGINT) AS y, CAST(l_partkey % 200 AS BIGINT) AS x_start, CAST(l_partkey % 200 + CAST(l_quantity AS BIGINT) AS BIGINT) AS x_end FROM lineitem WHERE l_linenumber % 2 = 0)"
B = A.replace("% 2 = 0", "% 2 = 1")
R = "(SELECT CAST(o_custkey AS BIGINT) AS mask_id, CAST(o_custkey % 200 + o_orderkey % 13 AS BIGINT) AS x, CAST(o_orderkey % 200 AS BIGINT) AS y, CAST(1 + o_orderkey % 17 AS BIGINT) AS w, CAST(1 + o_custkey % 11 AS BIGINT) AS h FROM orders)"
R_SPANS = f"(SELECT mask_id, unnest(range(y, y + h)) AS y, x AS x_start, x + w AS x_end FROM {R})"
E = """(SELECT CAST(user_id AS BIGINT) AS mask_id, CAST((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS "start",
  CAST((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) + 1 + CAST(floor(value) AS BIGINT) AS BIGINT) AS "end", event_type AS meta, CAST(event_id AS BIGINT) AS priority FROM events)"""
V_PIXELS = "(SELECT mask_id, i // 8 AS y, i % 8 AS x FROM (SELECT CAST(vec_id AS BIGINT) AS mask_id, unnest(range(0, 64)) AS i, embedding FROM embeddings) WHERE embedding[i + 1] > 0)"
