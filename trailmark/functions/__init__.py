from trailmark.functions.spatial import (
    bloom_bits, bloom_may_contain, dist2, max_dist2, min_dist2, minmax_dist2, norm_lat, norm_lon, to_epoch, z2, z3,
)

__all__ = [
    "bloom_bits", "bloom_may_contain", "dist2", "max_dist2", "min_dist2", "minmax_dist2", "norm_lat", "norm_lon",
    "to_epoch", "z2", "z3",
]
