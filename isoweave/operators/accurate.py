"""The gradient that follows integral lines: combinatorial where paths agree, integrated where they do not, and split along the borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import advect, gradient, regions
from isoweave.runtime import cut


def region_labels(field: DataFrame, meta: GridMeta, up: bool = False, **how) -> DataFrame:
    """(vid, label): certain regions of the extrema, the other samples by their integral lines, islands merged."""
    sure = cut(regions.certain_regions(field, meta, up))
    every = cut(advect.integration_labels(field, sure, meta, up, **how))
    return regions.merge_islands(every, field, meta, up)


def accurate_gradient(field: DataFrame, meta: GridMeta, up: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """(gradient, labels): the lower stars split by whether a cell is on a border of the regions, so that no path crosses one."""
    field = cut(field)
    labels = cut(region_labels(field, meta, up, **how))
    border = regions.boundary_map(labels, G.cells(field.sparkSession, meta), meta).select("cid", F.col("is_boundary").cast("int").alias("label"))
    return gradient.by_labels(field, cut(border), meta), labels
