"""A set of masks: spans in canonical form, and the bounds that each mask is declared to lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import affine as _affine
from runweave.operators import cluster as _cluster
from runweave.operators import meta as _meta
from runweave.operators import morph, normalize, reshape, setops, stats
from runweave.sources import encoding, masks


@dataclass(frozen=True)
class MaskFrame:
    """All methods are lazy.  A mask without spans is the empty mask; it may still have bounds."""

    spans: DataFrame
    bounds: DataFrame

    @classmethod
    def of_spans(cls, spans: DataFrame, bounds: DataFrame | None = None) -> MaskFrame:
        spans = normalize.normalize(spans)
        return cls(spans, stats.inspect_bounds(spans) if bounds is None else bounds)

    @classmethod
    def of_ranges(cls, ranges: DataFrame, bounds: DataFrame) -> MaskFrame:
        return cls(normalize.normalize(reshape.ranges_to_spans(ranges, bounds)), bounds)

    @classmethod
    def of_bitmaps(cls, bitmaps: DataFrame, kind: str = "array") -> MaskFrame:
        return cls(masks.bitmap_spans(bitmaps, kind), masks.bitmap_bounds(bitmaps, kind))

    @classmethod
    def of_payloads(cls, payloads: DataFrame) -> MaskFrame:
        return cls.of_ranges(encoding.wire_decode(payloads), encoding.wire_header(payloads))

    def union(self, *others: MaskFrame) -> MaskFrame:
        bounds = self.bounds
        for o in others:
            bounds = setops.union_bounds(bounds, o.bounds)
        return MaskFrame(setops.union_all([self.spans, *(o.spans for o in others)]), bounds)

    def intersect(self, other: MaskFrame) -> MaskFrame:
        return MaskFrame(setops.intersect(self.spans, other.spans), setops.intersect_bounds(self.bounds, other.bounds))

    def subtract(self, other: MaskFrame) -> MaskFrame:
        return MaskFrame(setops.subtract(self.spans, other.spans), self.bounds)

    def xor(self, other: MaskFrame) -> MaskFrame:
        return MaskFrame(setops.xor(self.spans, other.spans), setops.union_bounds(self.bounds, other.bounds))

    def complement(self) -> MaskFrame:
        return MaskFrame(setops.complement(self.spans, self.bounds), self.bounds)

    def clip(self, x: int, y: int, width: int, height: int) -> MaskFrame:
        return MaskFrame(reshape.clip(self.spans, x, y, width, height), reshape.clip_bounds(self.bounds, x, y, width, height))

    def with_roi(self, x: int, y: int, width: int, height: int) -> MaskFrame:
        return MaskFrame(self.spans, reshape.with_bounds(self.bounds, x, y, width, height))

    def with_bounds(self, width: int, height: int) -> MaskFrame:
        return self.with_roi(0, 0, width, height)

    def dilate(self, r: int, strategy=morph.in_place) -> MaskFrame:
        """Bounds grow by 2r: once before the dilation, once by it."""
        return MaskFrame(morph.dilate(self.spans, r, strategy), morph.dilate_bounds(self.bounds, r, 2))

    def dilate_within(self, r: int, x: int, y: int, width: int, height: int) -> MaskFrame:
        roi = self.with_roi(x, y, width, height)
        return MaskFrame(morph.dilate(self.spans, r), morph.dilate_bounds(roi.bounds, r))

    def erode(self, r: int) -> MaskFrame:
        return MaskFrame(morph.erode(self.spans, self.bounds, r), self.bounds)

    def affine(self, matrix) -> MaskFrame:
        return MaskFrame(_affine.affine(self.spans, matrix), _affine.affine_bounds(self.bounds, matrix))

    def clusters(self, width: int, strip: int = _cluster.STRIP) -> DataFrame:
        return _cluster.cluster(self.spans, width, strip)

    def ranges(self, output: str = "half_open") -> DataFrame:
        return reshape.into_ranges(self.spans, self.bounds, output)

    def rows(self, output: str = "half_open") -> DataFrame:
        return reshape.represent(self.spans, output, "x_start", "x_end")

    def typed(self, kind: str) -> DataFrame:
        return reshape.typed_spans(self.ranges(), self.bounds, kind)

    def split(self) -> DataFrame:
        """Local ranges cut at row ends."""
        return reshape.split_rows(self.ranges().join(self.bounds.select("mask_id", "bw"), "mask_id"), "bw").drop("bw")

    def transform_ranges(self, change) -> MaskFrame:
        """A DataFrame function applied to local ranges; bounds stay."""
        return MaskFrame.of_ranges(reshape.transform_ranges(self.ranges(), change), self.bounds)

    def range_algebra(self, other: MaskFrame, how: str) -> DataFrame:
        """Local ranges of both: "union", "intersection", "difference" or "symmetric_difference", whatever their bounds are."""
        return getattr(setops, f"range_{how}")(self.ranges(), other.ranges())

    def layers(self, group) -> MaskFrame:
        """The union of the masks that share a group (a column of mask_id)."""
        spans = self.spans.withColumn("_group", group)
        bounds = self.bounds.withColumn("mask_id", group)
        box = bounds.groupBy("mask_id").agg(F.min("bx").alias("bx"), F.min("by").alias("by"), F.max(F.expr("bx + bw")).alias("_ex"), F.max(F.expr("by + bh")).alias("_ey"))
        box = box.select("mask_id", "bx", "by", F.expr("_ex - bx").alias("bw"), F.expr("_ey - by").alias("bh"))
        return MaskFrame(normalize.normalize(spans.drop("mask_id").withColumnRenamed("_group", "mask_id")), box)

    def area(self) -> DataFrame:
        return stats.area(self.spans)

    def run_count(self) -> DataFrame:
        return stats.run_count(self.spans)

    def tight(self) -> DataFrame:
        return stats.inspect_bounds(self.spans)

    def inspect(self, name: str = "bounds"):
        """The same frame, and what will hold the bounds of all that passes once an action has run."""
        spans, seen = stats.inspect(self.spans, name)
        return MaskFrame(spans, self.bounds), seen

    def fold(self, order, zero, step, finish=None) -> DataFrame:
        return stats.fold_ordered(self.spans, order, zero, step, finish)

    def with_meta(self, value) -> MapFrame:
        """Local ranges that all carry `value` as meta."""
        return MapFrame(self.ranges().withColumn("meta", value), self.bounds)

    def preview(self, n: int = 10) -> str:
        return stats.preview(self.spans, n)

    def reproject(self, width: int) -> DataFrame:
        return reshape.reproject(self.spans, width)

    def encode(self, kind: str = "u64") -> DataFrame:
        return encoding.encode_spans(self.spans, self.bounds, kind)

    def payloads(self, terminator: bool = True) -> DataFrame:
        return encoding.wire_encode(self.ranges(), self.bounds, terminator)

    def transform(self, change) -> MaskFrame:
        return MaskFrame(normalize.normalize(change(self.spans)), self.bounds)

    def validate(self, errors: str = "raise") -> MaskFrame:
        return MaskFrame(normalize.validate(self.spans, self.bounds, errors=errors), self.bounds)

    def sanitize(self) -> MaskFrame:
        """Canonical spans inside the bounds: what is empty, negative or outside goes, the rest is merged."""
        inside = normalize.validate(normalize.normalize(self.spans.filter("x_start < x_end")), self.bounds, errors="skip")
        return MaskFrame(inside, self.bounds)

    def require_nonempty(self) -> MaskFrame:
        """An error for a mask that has bounds and no spans."""
        filled = self.bounds.join(self.spans.select("mask_id", F.lit(True).alias("_some")).distinct(), "mask_id", "left")
        ok = F.when(F.col("_some").isNull(), F.raise_error(F.lit("mask is empty")).cast("boolean")).otherwise(F.lit(True))
        return MaskFrame(self.spans, filled.filter(ok).drop("_some"))


@dataclass(frozen=True)
class MapFrame:
    """Ranges with metadata (mask_id, start, end, meta), disjoint and local to their masks' bounds."""

    items: DataFrame
    bounds: DataFrame

    @classmethod
    def of_ranges(cls, ranges: DataFrame, bounds: DataFrame) -> MapFrame:
        """Strict: an empty range or two that overlap or touch are errors."""
        return cls(_meta.check_map(ranges), bounds)

    @classmethod
    def of_layers(cls, ranges: DataFrame, bounds: DataFrame) -> MapFrame:
        """Ranges with a priority, the highest of which holds."""
        return cls(_meta.priority_union(ranges), bounds)

    def ranges(self) -> DataFrame:
        return _meta.drop_meta(self.items)

    def spans(self) -> DataFrame:
        """Global spans with their meta."""
        return _meta.meta_spans(self.items, self.bounds)

    def mask(self) -> MaskFrame:
        return MaskFrame.of_ranges(self.ranges(), self.bounds)

    def count(self) -> DataFrame:
        """mask_id, runs."""
        return stats.run_count(self.items)

    def with_roi(self, x: int, y: int, width: int, height: int) -> MapFrame:
        return MapFrame(self.items, reshape.with_bounds(self.bounds, x, y, width, height))

    def over(self, other: MapFrame) -> MapFrame:
        """Other's ranges where it has some, these elsewhere."""
        return MapFrame(_meta.union_over(self.items, other.items), setops.union_bounds(self.bounds, other.bounds))

    def transform(self, change) -> MapFrame:
        return MapFrame(_meta.transform_meta(self.items, change), self.bounds)

    def encode(self, kind: str = "u64") -> DataFrame:
        return encoding.encode_gaps(self.items, self.bounds, kind, ("meta",))

    @classmethod
    def decode(cls, encoded: DataFrame) -> MapFrame:
        return cls(encoding.decode_gaps(encoded, ("meta",)), encoded.select("mask_id", "bx", "by", "bw", "bh"))

    def preview(self, n: int = 10) -> str:
        return stats.preview(self.items, n)
