from trailmark.operators.filters import Box, in_box, block_ranges, id_temporal, id_temporal_batch, id_temporal_indexed, prune_blocks, st_range, st_range_batch
from trailmark.operators.grid import grid_cells, grid_count, grid_total
from trailmark.operators.joins import closest_pairs, knn_join
from trailmark.operators.knn import knn, knn_batch, knn_in_matching_blocks, knn_pruned
from trailmark.operators.layout import block_index, layout_sorted, layout_str, layout_time_oid, layout_zorder, segment_meta, split_by_size, time_oid_key
from trailmark.operators.statistics import (
    adaptive_id_route, adaptive_route, block_count, block_runs, cost_model, estimate_id_bytes, estimate_range_bytes, mbr_shape,
    pruning_ratio, selectivity,
)
from trailmark.operators.store import TrailStore

__all__ = [
    "Box", "in_box", "id_temporal", "id_temporal_batch", "prune_blocks", "st_range", "st_range_batch", "grid_cells",
    "grid_count", "grid_total", "closest_pairs", "knn_join", "knn", "knn_batch", "knn_in_matching_blocks", "knn_pruned",
    "block_index", "layout_str", "layout_time_oid", "layout_zorder", "segment_meta", "adaptive_route", "block_count",
    "block_runs", "cost_model", "estimate_id_bytes", "estimate_range_bytes", "mbr_shape", "pruning_ratio", "selectivity",
    "TrailStore", "block_ranges", "id_temporal_indexed", "layout_sorted", "split_by_size", "time_oid_key", "adaptive_id_route",
]
