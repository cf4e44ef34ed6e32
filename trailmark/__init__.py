"""trailmark: trajectory-point analytics on the Spark DataFrame API."""

from trailmark.schema import BLOCK_BYTES, GRID, POINTS_PER_BLOCK, SEGMENTS_PER_BLOCK

__all__ = ["BLOCK_BYTES", "GRID", "POINTS_PER_BLOCK", "SEGMENTS_PER_BLOCK"]
