from trailmark.sources.events import event_points
from trailmark.sources.points_csv import read_geolife, read_nyc, read_osm, read_porto, row_window
from trailmark.sources.synthetic import random_points, sequential_points
from trailmark.sources.workload import id_queries, knn_queries, read_id_queries, read_knn_queries, read_st_queries, st_queries

__all__ = [
    "event_points", "read_geolife", "read_nyc", "read_osm", "read_porto", "row_window", "random_points",
    "sequential_points", "id_queries", "knn_queries", "read_id_queries", "read_knn_queries", "read_st_queries", "st_queries",
]
