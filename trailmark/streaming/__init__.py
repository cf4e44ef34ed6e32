from trailmark.streaming.ingest import append_points, grid_stream

__all__ = ["append_points", "grid_stream"]
