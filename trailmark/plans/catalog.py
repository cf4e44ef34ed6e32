"""The engine's queries over the `events` points, and for each the same rows as ANSI SQL."""

from pyspark.sql import functions as F

from trailmark import functions as fn
from trailmark import operators as op
from trailmark.schema import POINTS_PER_BLOCK as P, SEGMENTS_PER_BLOCK as S
from trailmark.operators.rounds import new_path
from trailmark.sources import (
    event_points, id_queries, knn_queries, random_points, read_geolife, read_id_queries, read_knn_queries, read_nyc, read_osm,
    read_porto, read_st_queries, row_window, sequential_points, st_queries,
)

# The box and cell sizes of the workload, on the 24-bit grid; one month of 2024.
LON0, LAT0 = 7978498, 12210074
WIDTH, HEIGHT = 466, 932
DAY = 86400
T0 = 1704067200
Q = op.Box(T0 + 5 * DAY, T0 + 15 * DAY, 7980000, 7986000, 12212000, 12226000)
OID, ID_T = 17, (T0 + 2 * DAY, T0 + 20 * DAY)
KNN_AT = (7985000, 12224000)
ST_BATCH = [(i, T0 + i * DAY, T0 + (i + 7) * DAY, LON0 + 900 * i, LON0 + 900 * i + 4660, LAT0 + 1500 * i, LAT0 + 1500 * i + 9320) for i in range(11)]
ID_BATCH = [(i, 1 + 13 * i, T0 + i * DAY, T0 + (i + 15) * DAY) for i in range(11)]
KNN_BATCH = [(i, LON0 + 1300 * i, LAT0 + 2500 * i, 5 + 5 * i) for i in range(10)]
MODEL_BLOCKS = 131072


def _p(spark, d):
    return event_points(spark, d)


def _laid(spark, d):
    return op.layout_time_oid(_p(spark, d))


def _z(option):
    return lambda s, d: op.layout_zorder(_p(s, d), option).select("pid", "block_id", "seg_id")


def _count(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


def _segments(s, d):
    return op.segment_meta(_laid(s, d))


def _index(s, d):
    return op.block_index(_laid(s, d))


def _boxes(s, d):
    return _segments(s, d).select("block_id", "seg_id", "lon_min", "lon_max", "lat_min", "lat_max")


_BOX = {n: n for n in ("lon_min", "lon_max", "lat_min", "lat_max")}


def _at():
    return F.lit(KNN_AT[0]), F.lit(KNN_AT[1])


def _bloom(s, d):
    lo, hi = fn.bloom_bits("oid")
    return _p(s, d).select("oid").distinct().select("oid", lo.alias("bloom_lo"), hi.alias("bloom_hi"))


def _store_range(s, d):
    return op.TrailStore.of(_laid(s, d)).range(Q)


def _store_id(s, d):
    return op.TrailStore.of(_laid(s, d)).id_temporal(OID, *ID_T)


def _stored(s, d):
    """A store that is written, and opened again."""
    path = new_path(s, "store")
    op.TrailStore.of(_laid(s, d)).write(path)
    return op.TrailStore.open(s, path)


def _csv(s, d, *columns):
    """The path of a CSV file with some columns of the points, in degrees and as they come."""
    e = s.read.parquet(f"{d}/events.parquet")
    path = new_path(s, "csv")
    e.select(*(F.expr(c) for c in columns)).write.csv(path)
    return path


_LON = "(-88000 + (event_id * 7919 + user_id * 104729) % 3001) / 10000.0D AS x"
_LAT = "(410000 + (event_id * 6101 + user_id * 15485863) % 3001) / 10000.0D AS y"
_SEC = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS t"
_MOMENT = "date_format(CAST(ts AS TIMESTAMP_NTZ), 'yyyy-MM-dd HH:mm:ss') AS t"


def _porto(s, d):
    return read_porto(s, _csv(s, d, "event_id", "'A' AS c", "user_id", _SEC, "'A' AS k", "0 AS m", _LON, _LAT))


def _workload(s, rows):
    path = new_path(s, "queries")
    s.createDataFrame(rows).coalesce(1).write.csv(path)
    return path


# Rows of query files, boxes and points in degrees.
ID_FILE = [(r[1], r[2], r[3]) for r in ID_BATCH]
ST_FILE = [(T0 + i * DAY, T0 + (i + 7) * DAY, -8.8 + i / 100, -8.7 + i / 100, 41.0 + i / 50, 41.1 + i / 50) for i in range(11)]
KNN_FILE = [(-8.8 + i / 100, 41.0 + i / 50, 5 + i) for i in range(11)]


def _matching(s, d):
    from trailmark.operators.filters import box_overlaps

    return _index(s, d).where(box_overlaps(Q))


QUERIES = {
    "norm_points": lambda s, d: _p(s, d),
    "z2_keys": lambda s, d: _p(s, d).select("pid", fn.z2("lon", "lat").alias("z")),
    "z3_keys": lambda s, d: _p(s, d).select("pid", fn.z3("lon", "lat", "timestamp_sec").alias("z")),
    "dist_point": lambda s, d: _p(s, d).select("pid", fn.dist2("lon", "lat", *_at()).alias("d")),
    "dist_min": lambda s, d: _boxes(s, d).select("block_id", "seg_id", fn.min_dist2(*_at(), _BOX).alias("d")),
    "dist_minmax": lambda s, d: _boxes(s, d).select("block_id", "seg_id", fn.minmax_dist2(*_at(), _BOX).alias("d")),
    "bloom_bits": _bloom,
    "synthetic_sequential": lambda s, d: sequential_points(s, 100, 1000),
    "synthetic_random": lambda s, d: random_points(s, 0, 1000, 1 << 20),
    "read_porto": lambda s, d: _porto(s, d).drop("pid"),
    "read_porto_window": lambda s, d: row_window(_porto(s, d), 100, 50).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"), F.max("pid").alias("last")),
    "read_nyc": lambda s, d: read_nyc(s, _csv(s, d, "user_id", _MOMENT, _LON, _LAT), row_id=False),
    "read_osm": lambda s, d: read_osm(s, _csv(s, d, "event_id", _LON, _LAT, _SEC), row_id=False),
    "read_geolife": lambda s, d: read_geolife(s, _csv(s, d, _SEC, _LON, _LAT), row_id=False).drop("oid"),
    "read_id_queries": lambda s, d: read_id_queries(s, _workload(s, ID_FILE)),
    "read_st_queries": lambda s, d: read_st_queries(s, _workload(s, ST_FILE)),
    "read_knn_queries": lambda s, d: read_knn_queries(s, _workload(s, KNN_FILE)),
    "store_points": lambda s, d: _stored(s, d).points,
    "store_index": lambda s, d: _stored(s, d).index.withColumn("oids", F.concat_ws(",", F.col("oids").cast("array<string>"))),
    "store_segments": lambda s, d: _stored(s, d).segments,
    "store_range": lambda s, d: _stored(s, d).range(Q),
    "store_id_temporal": lambda s, d: _stored(s, d).id_temporal(OID, *ID_T),
    "id_temporal_indexed": lambda s, d: op.id_temporal_indexed(_laid(s, d), _index(s, d), OID, *ID_T),
    "adaptive_id_route": lambda s, d: op.adaptive_id_route(_segments(s, d), _index(s, d), OID, *ID_T),
    "layout_synthetic": lambda s, d: op.layout_time_oid(sequential_points(s, 0, 5000), per_block=True).select("pid", "block_id", "seg_id"),
    "layout_space_time": _z("space_time"),
    "layout_by_lon": lambda s, d: op.layout_sorted(_p(s, d), "lon").select("pid", "block_id", "seg_id"),
    "layout_by_lat": lambda s, d: op.layout_sorted(_p(s, d), "lat").select("pid", "block_id", "seg_id"),
    "layout_by_time": lambda s, d: op.layout_sorted(_p(s, d), "timestamp_sec").select("pid", "block_id", "seg_id"),
    "split_by_size": lambda s, d: op.split_by_size(_laid(s, d), 50, op.time_oid_key()).select("pid", "block_id", "seg_id"),
    "st_range_points": lambda s, d: op.st_range(_p(s, d), Q),
    "st_range_count": lambda s, d: _count(op.st_range(_p(s, d), Q)),
    "st_range_pruned": _store_range,
    "st_range_batch": lambda s, d: op.st_range_batch(_p(s, d), st_queries(s, ST_BATCH)),
    "id_temporal_points": lambda s, d: op.id_temporal(_p(s, d), OID, *ID_T),
    "id_temporal_count": lambda s, d: _count(op.id_temporal(_p(s, d), OID, *ID_T)),
    "id_temporal_pruned": _store_id,
    "id_temporal_batch": lambda s, d: op.id_temporal_batch(_p(s, d), id_queries(s, ID_BATCH)),
    "block_scan": lambda s, d: op.TrailStore.of(_laid(s, d)).blocks(3, 5),
    "total_points": lambda s, d: _count(_p(s, d)),
    "grid_count": lambda s, d: op.grid_count(_p(s, d), LON0, LAT0, WIDTH, HEIGHT),
    "grid_cells": lambda s, d: op.grid_cells(_p(s, d), LON0 + 3000, LAT0 + 3000, WIDTH, HEIGHT),
    "grid_total": lambda s, d: op.grid_total(_p(s, d), LON0, LAT0, WIDTH, HEIGHT),
    "distinct_oids": lambda s, d: _p(s, d).select("oid").distinct(),
    "knn_k50": lambda s, d: op.knn(_p(s, d), *KNN_AT, 50),
    "knn_k500": lambda s, d: op.knn(_p(s, d), *KNN_AT, 500),
    "knn_pruned": lambda s, d: op.knn_pruned(_laid(s, d), _segments(s, d), *KNN_AT, 50).drop("block_id", "seg_id"),
    "knn_batch": lambda s, d: op.knn_batch(_p(s, d), knn_queries(s, KNN_BATCH)),
    "knn_mbr_contains": lambda s, d: op.knn_in_matching_blocks(op.layout_zorder(_p(s, d)), op.block_index(op.layout_zorder(_p(s, d))), *KNN_AT, 50).drop("block_id", "seg_id"),
    "knn_matching_blocks": lambda s, d: op.block_count(op.block_index(op.layout_zorder(_p(s, d))), op.Box(0, 2**31 - 1, KNN_AT[0], KNN_AT[0], KNN_AT[1], KNN_AT[1])),
    "closest_pairs": lambda s, d: op.closest_pairs(_p(s, d), 90),
    "knn_join_per_point": lambda s, d: op.knn_join(_p(s, d), 3),
    "knn_join_timegap": lambda s, d: op.knn_join(_p(s, d), 2, min_gap_sec=3600),
    "layout_time_oid": lambda s, d: _laid(s, d).select("pid", "block_id", "seg_id"),
    "layout_time_per_block": lambda s, d: op.layout_time_oid(_p(s, d), per_block=True, block_offset=1000).select("pid", "block_id", "seg_id"),
    "layout_z2": _z("space"),
    "layout_time_pref": _z("time_preferred"),
    "layout_space_pref": _z("space_preferred"),
    "layout_no_pref": _z("no_preference"),
    "layout_str": lambda s, d: op.layout_str(_p(s, d)).select("pid", "block_id", "seg_id"),
    "block_index": lambda s, d: _index(s, d).withColumn("oids", F.concat_ws(",", F.col("oids").cast("array<string>"))),
    "seg_meta": _segments,
    "est_size_range": lambda s, d: op.estimate_range_bytes(_segments(s, d), Q),
    "est_size_range_blocks": lambda s, d: op.estimate_range_bytes(_segments(s, d), Q, _matching(s, d)),
    "est_size_id": lambda s, d: op.estimate_id_bytes(_segments(s, d), OID, *ID_T, use_bloom=False),
    "est_size_id_bloom": lambda s, d: op.estimate_id_bytes(_segments(s, d), OID, *ID_T, blocks=_matching(s, d)),
    "block_count": lambda s, d: op.block_count(_index(s, d), Q),
    "selectivity": lambda s, d: op.selectivity(_p(s, d), _index(s, d), Q),
    "pruning_ratio": lambda s, d: op.pruning_ratio(_segments(s, d), _index(s, d), Q),
    "adaptive_route": lambda s, d: op.adaptive_route(_segments(s, d), _index(s, d), Q),
    "block_runs": lambda s, d: op.block_runs(_matching(s, d)),
    "mbr_shape": lambda s, d: op.mbr_shape(_index(s, d)),
    "cost_model": lambda s, d: op.cost_model(s, MODEL_BLOCKS),
}

# ---- the same in SQL ----

_NORM = "CASE WHEN {d} >= {h} THEN 16777215 WHEN {d} <= -{h} THEN 0 ELSE CAST(floor(({d} + {h}::DOUBLE) * (16777216 / {w}::DOUBLE)) AS INTEGER) END"
_POINTS = f"""raw AS (SELECT CAST(user_id AS INTEGER) AS oid, CAST(floor(epoch(ts)) AS INTEGER) AS timestamp_sec,
  (-88000 + (event_id * 7919 + user_id * 104729) % 3001) / 10000.0::DOUBLE AS x,
  (410000 + (event_id * 6101 + user_id * 15485863) % 3001) / 10000.0::DOUBLE AS y, event_id AS pid FROM events),
points AS (SELECT oid, timestamp_sec, {_NORM.format(d='x', h=180, w=360)} AS lon, {_NORM.format(d='y', h=90, w=180)} AS lat, pid FROM raw)"""


def _spread_sql(c: str, bits: int, gap: int, shift: int) -> str:
    return "(" + " + ".join(f"((({c}::BIGINT >> {i}) & 1) << {gap * i + shift})" for i in range(bits)) + ")"


_Z2 = f"({_spread_sql('lon', 24, 2, 0)} + {_spread_sql('lat', 24, 2, 1)})"


def _z3_sql(t: str) -> str:
    return f"({_spread_sql(t, 21, 3, 0)} + {_spread_sql('lat', 21, 3, 1)} + {_spread_sql('lon', 21, 3, 2)})"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([_POINTS, *ctes]) + " " + body


def _layout_sql(order: str, chunk_blocks: int = 8192, offset: int = 0) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY pid // {chunk_blocks * P} ORDER BY {order}) AS rn FROM points),
laid AS (SELECT oid, timestamp_sec, lon, lat, pid, CAST(pid // {chunk_blocks * P} * {chunk_blocks} + {offset} + (rn - 1) // {P} AS BIGINT) AS block_id,
  CAST(least(((rn - 1) % {P}) // {P // S}, {S - 1}) AS INTEGER) AS seg_id FROM ranked)"""


_TIME = _layout_sql("oid, timestamp_sec DESC, pid")


def _bit_sql(half: int) -> str:
    def position(start: int, base: int) -> str:
        h = str(start % 128)
        for i in range(4):
            h = f"(({h} * {base % 128} + ((oid >> {8 * i}) & 255)) % 128)"
        return h

    bits = []
    for start, base in ((5381, 33), (0, 65599)):
        p = position(start, base)
        lo = 64 * half
        at = f"CAST(greatest(0, least({p} - {lo}, 62)) AS INTEGER)"
        bits.append(f"(CASE WHEN {p} = {lo + 63} THEN -9223372036854775808 WHEN {p} BETWEEN {lo} AND {lo + 62} THEN (1::BIGINT << {at}) ELSE 0 END)")
    return f"({bits[0]} | {bits[1]})"


_BOUNDS = "min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max, min(timestamp_sec) AS time_min, max(timestamp_sec) AS time_max"
_SEG = f"""seg AS (SELECT block_id, seg_id, {_BOUNDS}, count(*) AS n, bit_or({_bit_sql(0)}) AS bloom_lo, bit_or({_bit_sql(1)}) AS bloom_hi, count(*) * 16 AS seg_size
FROM laid GROUP BY block_id, seg_id)"""
_IDX = f"idx AS (SELECT block_id, {_BOUNDS}, array_to_string(list_sort(list_distinct(list(oid))), ',') AS oids FROM laid GROUP BY block_id)"
_IN = f"lon BETWEEN {Q.lon_min} AND {Q.lon_max} AND lat BETWEEN {Q.lat_min} AND {Q.lat_max} AND timestamp_sec BETWEEN {Q.time_min} AND {Q.time_max}"
_OVER = f"lon_min <= {Q.lon_max} AND lon_max >= {Q.lon_min} AND lat_min <= {Q.lat_max} AND lat_max >= {Q.lat_min} AND time_min <= {Q.time_max} AND time_max >= {Q.time_min}"
_ID = f"oid = {OID} AND timestamp_sec BETWEEN {ID_T[0]} AND {ID_T[1]}"
_D = f"((lon - {KNN_AT[0]})::BIGINT * (lon - {KNN_AT[0]}) + (lat - {KNN_AT[1]})::BIGINT * (lat - {KNN_AT[1]}))"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


def _pairs_sql(where: str, k: int) -> str:
    d = "((a.lon - b.lon)::BIGINT * (a.lon - b.lon) + (a.lat - b.lat)::BIGINT * (a.lat - b.lat))"
    best = f"""best AS (SELECT a.pid AS pid, min({d} * 1000000 + b.pid, {k}) AS keys FROM points a, points b WHERE a.pid <> b.pid {where} GROUP BY a.pid),
flat AS (SELECT pid, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS rank FROM best)"""
    return _sql("SELECT pid, CAST(rank AS INTEGER) AS rank, key % 1000000 AS near_pid, key // 1000000 AS distance FROM flat", best)


def _bloom_test_sql() -> str:
    one = lambda h: _bit_sql(h).replace("oid", str(OID))
    return f"(bloom_lo & {one(0)}) = {one(0)} AND (bloom_hi & {one(1)}) = {one(1)}"


def _grid_sql(lon0: int, lat0: int) -> str:
    return f"cells AS (SELECT (lon - {lon0}) // {WIDTH} AS x, (lat - {lat0}) // {HEIGHT} AS y FROM points)"


def _model_sql() -> str:
    b = MODEL_BLOCKS
    host = lambda c, m, t: f"round({b}*4096.0::DOUBLE/(1024.0*1024.0)/767.42::DOUBLE + ({b}*{c}::DOUBLE + {b * 10}*{m}::DOUBLE + {b * 225}*{t}::DOUBLE*s)/14400000000.0::DOUBLE, 9)"
    dev = lambda t: f"round({b}*4096.0::DOUBLE/(1024.0*1024.0)*s/767.42::DOUBLE + ({b}*301.0::DOUBLE + {b * 225}*{t}::DOUBLE*s)/1200000000.0::DOUBLE + 0.230631::DOUBLE, 9)"
    return (f"SELECT step, {host(3196.0, 64.0, 59.0)} AS host_range, {dev(25.0)} AS device_range, {host(3312.0, 401.0, 40.0)} AS host_id, {dev(31.0)} AS device_id "
            "FROM (SELECT range AS step, range / 10.0::DOUBLE AS s FROM range(11))")


_MID = "floor((lon_min + lon_max)::DOUBLE / 2)", "floor((lat_min + lat_max)::DOUBLE / 2)"


def _minmax_sql() -> str:
    x, y = KNN_AT
    near = lambda v, m, a: f"pow({v} - CASE WHEN {v} <= {m} THEN {a}_min ELSE {a}_max END, 2)"
    far = lambda v, m, a: f"pow({v} - CASE WHEN {v} >= {m} THEN {a}_min ELSE {a}_max END, 2)"
    return f"CAST(least({near(x, _MID[0], 'lon')} + {far(y, _MID[1], 'lat')}, {near(y, _MID[1], 'lat')} + {far(x, _MID[0], 'lon')}) AS BIGINT)"


_STR = f"""w AS (SELECT *, timestamp_sec // 604800 AS week FROM points),
wn AS (SELECT week, count(*) AS n, CAST(ceil(sqrt(ceil(count(*) / {P}::DOUBLE))) AS BIGINT) AS s FROM w GROUP BY week),
r1 AS (SELECT w.*, n, s, (row_number() OVER (PARTITION BY w.week ORDER BY lon, pid) - 1) // (s * {P}) AS tile FROM w JOIN wn USING (week)),
r2 AS (SELECT *, (row_number() OVER (PARTITION BY week, tile ORDER BY lat, pid) - 1) // {P} AS b FROM r1),
r3 AS (SELECT *, dense_rank() OVER (ORDER BY week, tile, b) - 1 AS block_id FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY {_z3_sql('timestamp_sec')}, pid) AS rn FROM r3)"""

_LAID = "SELECT pid, block_id, seg_id FROM laid"
_ZL = _layout_sql(f"{_Z2}, pid")
_KNN_COLS = f"oid, timestamp_sec, lon, lat, pid, {_D} AS distance"
_MIND = f"pow(greatest(lon_min - {KNN_AT[0]}, 0, {KNN_AT[0]} - lon_max), 2) + pow(greatest(lat_min - {KNN_AT[1]}, 0, {KNN_AT[1]} - lat_max), 2)"
_ZIDX = f"zidx AS (SELECT block_id, {_BOUNDS} FROM laid GROUP BY block_id)"
_HOLDS = f"lon_min <= {KNN_AT[0]} AND lon_max >= {KNN_AT[0]} AND lat_min <= {KNN_AT[1]} AND lat_max >= {KNN_AT[1]}"
_MATCH = f"WHERE block_id IN (SELECT block_id FROM idx WHERE {_OVER})"
_COMMON = (f"(least({Q.lon_max}, lon_max) - greatest({Q.lon_min}, lon_min))::BIGINT * (least({Q.lat_max}, lat_max) - greatest({Q.lat_min}, lat_min))")

ORACLES = {
    "norm_points": _sql("SELECT * FROM points"),
    "z2_keys": _sql(f"SELECT pid, {_Z2} AS z FROM points"),
    "z3_keys": _sql(f"SELECT pid, {_z3_sql('timestamp_sec')} AS z FROM points"),
    "dist_point": _sql(f"SELECT pid, {_D} AS d FROM points"),
    "dist_min": _sql(f"SELECT block_id, seg_id, CAST({_MIND} AS BIGINT) AS d FROM seg", _TIME, _SEG),
    "dist_minmax": _sql(f"SELECT block_id, seg_id, {_minmax_sql()} AS d FROM seg", _TIME, _SEG),
    "bloom_bits": _sql(f"SELECT DISTINCT oid, {_bit_sql(0)} AS bloom_lo, {_bit_sql(1)} AS bloom_hi FROM points"),
    "synthetic_sequential": "SELECT 12 AS oid, CAST(range AS INTEGER) AS timestamp_sec, CAST(range AS INTEGER) AS lon, CAST(range AS INTEGER) AS lat, range AS pid FROM range(100, 1100)",
    "synthetic_random": "SELECT 12 AS oid, v AS timestamp_sec, v AS lon, v AS lat, pid FROM (SELECT range AS pid, CAST(((range + 1 + 7 * 7919) % 2147483647 * 48271 % 2147483647 + 7) % 2147483647 * 69621 % 2147483647 % 1048576 AS INTEGER) AS v FROM range(1000))",
    "read_porto": _sql("SELECT oid, timestamp_sec, lon, lat FROM points"),
    "read_porto_window": "SELECT 50 AS n, 100 AS first, 149 AS last",
    "read_nyc": _sql("SELECT oid, timestamp_sec, lon, lat FROM points"),
    "read_osm": _sql("SELECT CAST(pid AS INTEGER) AS oid, timestamp_sec, lon, lat FROM points"),
    "read_geolife": _sql("SELECT timestamp_sec, lon, lat FROM points"),
    "read_id_queries": "SELECT * FROM " + _values([(i, *r) for i, r in enumerate(ID_FILE)]) + " q(qid, oid, time_min, time_max)",
    "read_st_queries": "SELECT qid, time_min, time_max, " + ", ".join(_NORM.format(d=c, h=h, w=2 * h) + f" AS {n}" for c, h, n in (("a", 180, "lon_min"), ("b", 180, "lon_max"), ("c", 90, "lat_min"), ("d", 90, "lat_max")))
        + " FROM (SELECT qid, time_min, time_max, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM " + _values([(i, *r) for i, r in enumerate(ST_FILE)]) + " q(qid, time_min, time_max, a, b, c, d))",
    "read_knn_queries": "SELECT qid, " + ", ".join(_NORM.format(d=c, h=h, w=2 * h) + f" AS {n}" for c, h, n in (("a", 180, "lon"), ("b", 90, "lat"))) + ", k FROM (SELECT qid, a::DOUBLE AS a, b::DOUBLE AS b, k FROM "
        + _values([(i, *r) for i, r in enumerate(KNN_FILE)]) + " q(qid, a, b, k))",
    "store_points": _sql("SELECT oid, timestamp_sec, lon, lat, pid, block_id, seg_id FROM laid", _TIME),
    "store_index": _sql("SELECT * FROM idx", _TIME, _IDX),
    "store_segments": _sql("SELECT * FROM seg", _TIME, _SEG),
    "store_range": _sql(f"SELECT block_id, seg_id, oid, timestamp_sec, lon, lat, pid FROM laid WHERE {_IN}", _TIME),
    "store_id_temporal": _sql(f"SELECT block_id, seg_id, oid, timestamp_sec, lon, lat, pid FROM laid WHERE {_ID}", _TIME),
    "id_temporal_indexed": _sql(f"SELECT block_id, seg_id, oid, timestamp_sec, lon, lat, pid FROM laid WHERE {_ID}", _TIME),
    "adaptive_id_route": _sql(
        "SELECT block_id, goodness, CASE WHEN goodness < 0.3 THEN 'device' ELSE 'host' END AS route FROM g JOIN b USING (block_id)", _TIME, _SEG,
        f"g AS (SELECT block_id, coalesce(sum(seg_size) FILTER (time_min <= {ID_T[1]} AND time_max >= {ID_T[0]} AND {_bloom_test_sql()}), 0)::DOUBLE / sum(seg_size)::DOUBLE AS goodness FROM seg GROUP BY block_id)",
        f"b AS (SELECT block_id FROM laid GROUP BY block_id HAVING bool_or(oid = {OID}) AND min(timestamp_sec) <= {ID_T[1]} AND max(timestamp_sec) >= {ID_T[0]})"),
    "layout_synthetic": f"SELECT range AS pid, range // {P} AS block_id, CAST(least((least((range // {P} + 1) * {P}, 5000) - 1 - range) // {P // S}, {S - 1}) AS INTEGER) AS seg_id FROM range(5000)",
    "layout_space_time": _sql(_LAID, _layout_sql(f"{_z3_sql('timestamp_sec')}, pid")),
    "layout_by_lon": _sql(_LAID, _layout_sql("lon, pid")),
    "layout_by_lat": _sql(_LAID, _layout_sql("lat, pid")),
    "layout_by_time": _sql(_LAID, _layout_sql("timestamp_sec, pid")),
    "split_by_size": _sql("SELECT pid, block_id, CAST((row_number() OVER (PARTITION BY block_id ORDER BY oid, timestamp_sec DESC, pid) - 1) // 50 AS INTEGER) AS seg_id FROM laid", _TIME),
    "st_range_points": _sql(f"SELECT * FROM points WHERE {_IN}"),
    "st_range_count": _sql(f"SELECT count(*) AS n FROM points WHERE {_IN}"),
    "st_range_pruned": _sql(f"SELECT block_id, seg_id, oid, timestamp_sec, lon, lat, pid FROM laid WHERE {_IN}", _TIME),
    "st_range_batch": _sql("SELECT q.qid, p.* FROM points p JOIN " + _values(ST_BATCH) + " q(qid, t0, t1, x0, x1, y0, y1) ON p.timestamp_sec BETWEEN t0 AND t1 AND p.lon BETWEEN x0 AND x1 AND p.lat BETWEEN y0 AND y1"),
    "id_temporal_points": _sql(f"SELECT * FROM points WHERE {_ID}"),
    "id_temporal_count": _sql(f"SELECT count(*) AS n FROM points WHERE {_ID}"),
    "id_temporal_pruned": _sql(f"SELECT block_id, seg_id, oid, timestamp_sec, lon, lat, pid FROM laid WHERE {_ID}", _TIME),
    "id_temporal_batch": _sql("SELECT q.qid, p.* FROM points p JOIN " + _values(ID_BATCH) + " q(qid, o, t0, t1) ON p.oid = q.o AND p.timestamp_sec BETWEEN t0 AND t1"),
    "block_scan": _sql("SELECT oid, timestamp_sec, lon, lat, pid, block_id, seg_id FROM laid WHERE block_id BETWEEN 3 AND 7", _TIME),
    "total_points": "SELECT count(*) AS n FROM events",
    "grid_count": _sql("SELECT x * 30 + y AS cell, count(*) AS n FROM cells WHERE x * 30 + y BETWEEN 0 AND 1023 GROUP BY 1", _grid_sql(LON0, LAT0)),
    "grid_cells": _sql("SELECT x, y, count(*) AS n FROM cells GROUP BY 1, 2", _grid_sql(LON0 + 3000, LAT0 + 3000)),
    "grid_total": _sql("SELECT count(*) AS total FROM cells WHERE x * 30 + y BETWEEN 0 AND 1023", _grid_sql(LON0, LAT0)),
    "distinct_oids": _sql("SELECT DISTINCT oid FROM points"),
    "knn_k50": _sql(f"SELECT {_KNN_COLS} FROM points ORDER BY distance, pid LIMIT 50"),
    "knn_k500": _sql(f"SELECT {_KNN_COLS} FROM points ORDER BY distance, pid LIMIT 500"),
    "knn_pruned": _sql(f"SELECT {_KNN_COLS} FROM points ORDER BY distance, pid LIMIT 50"),
    "knn_batch": _sql("SELECT qid, rank, oid, timestamp_sec, lon, lat, pid, distance FROM r WHERE rank <= k",
                      "s AS (SELECT qid, k, p.*, (p.lon - qx)::BIGINT * (p.lon - qx) + (p.lat - qy)::BIGINT * (p.lat - qy) AS distance FROM points p, " + _values(KNN_BATCH) + " q(qid, qx, qy, k))",
                      "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rank FROM s)"),
    "knn_mbr_contains": _sql(f"SELECT {_KNN_COLS} FROM laid WHERE block_id IN (SELECT block_id FROM zidx WHERE {_HOLDS}) ORDER BY distance, pid LIMIT 50", _ZL, _ZIDX),
    "knn_matching_blocks": _sql(f"SELECT count(*) AS blocks FROM zidx WHERE {_HOLDS}", _ZL, _ZIDX),
    "closest_pairs": _sql("SELECT (a.lon - b.lon)::BIGINT * (a.lon - b.lon) + (a.lat - b.lat)::BIGINT * (a.lat - b.lat) AS distance, a.pid AS pid_1, b.pid AS pid_2, a.oid AS oid_1, b.oid AS oid_2 "
                          "FROM points a JOIN points b ON a.pid < b.pid ORDER BY 1, 2, 3 LIMIT 90"),
    "knn_join_per_point": _pairs_sql("", 3),
    "knn_join_timegap": _pairs_sql("AND abs(a.timestamp_sec - b.timestamp_sec) > 3600", 2),
    "layout_time_oid": _sql(_LAID, _TIME),
    "layout_time_per_block": _sql(_LAID, _layout_sql("oid, timestamp_sec DESC, pid", 1, 1000)),
    "layout_z2": _sql(_LAID, _ZL),
    "layout_time_pref": _sql(_LAID, _layout_sql(f"timestamp_sec // 300, {_Z2}, pid")),
    "layout_space_pref": _sql(_LAID, _layout_sql(f"{_Z2} >> 11, timestamp_sec, pid")),
    "layout_no_pref": _sql(_LAID, _layout_sql(f"{_z3_sql('(timestamp_sec // 5)')}, pid")),
    "layout_str": _sql(f"SELECT pid, CAST(block_id AS BIGINT) AS block_id, CAST(least((rn - 1) // {P // S}, {S - 1}) AS INTEGER) AS seg_id FROM r4", _STR),
    "block_index": _sql("SELECT * FROM idx", _TIME, _IDX),
    "seg_meta": _sql("SELECT * FROM seg", _TIME, _SEG),
    "est_size_range": _sql(f"SELECT CAST(coalesce(sum(seg_size), 0) AS BIGINT) AS bytes FROM seg WHERE {_OVER}", _TIME, _SEG),
    "est_size_range_blocks": _sql(f"SELECT CAST(b + 16 * (b // 4096) AS BIGINT) AS bytes FROM (SELECT CAST(coalesce(sum(seg_size), 0) AS BIGINT) AS b FROM seg {_MATCH} AND {_OVER})", _TIME, _SEG, _IDX),
    "est_size_id": _sql(f"SELECT CAST(coalesce(sum(seg_size), 0) AS BIGINT) AS bytes FROM seg WHERE time_min <= {ID_T[1]} AND time_max >= {ID_T[0]}", _TIME, _SEG),
    "est_size_id_bloom": _sql(f"SELECT CAST(b + 16 * (b // 4096) AS BIGINT) AS bytes FROM (SELECT CAST(coalesce(sum(seg_size), 0) AS BIGINT) AS b FROM seg {_MATCH} AND time_min <= {ID_T[1]} AND time_max >= {ID_T[0]} AND {_bloom_test_sql()})", _TIME, _SEG, _IDX),
    "block_count": _sql(f"SELECT count(*) AS blocks FROM idx WHERE {_OVER}", _TIME, _IDX),
    "selectivity": _sql(f"SELECT *, found::DOUBLE / (blocks * {P}.0::DOUBLE) AS selectivity FROM (SELECT (SELECT count(*) FROM points WHERE {_IN}) AS found, (SELECT count(*) FROM idx WHERE {_OVER}) AS blocks)", _TIME, _IDX),
    "pruning_ratio": _sql(f"SELECT count(*) AS total_segments, count(*) FILTER ({_OVER}) AS checked_segments FROM seg {_MATCH}", _TIME, _SEG, _IDX),
    "adaptive_route": _sql(
        "SELECT *, CASE WHEN goodness <= 0.3 THEN 'device' ELSE 'host' END AS route_goodness, CASE WHEN overlap <= 0.35 THEN 'device' ELSE 'host' END AS route_overlap FROM sc", _TIME, _SEG, _IDX,
        f"g AS (SELECT block_id, coalesce(sum(seg_size) FILTER ({_OVER}), 0)::DOUBLE / sum(seg_size)::DOUBLE AS goodness FROM seg GROUP BY block_id)",
        f"sc AS (SELECT block_id, goodness, coalesce(({_COMMON})::DOUBLE / nullif((lon_max - lon_min)::BIGINT * (lat_max - lat_min), 0)::DOUBLE * ((least({Q.time_max}, time_max) - greatest({Q.time_min}, time_min)) // nullif(time_max - time_min, 0)), 0.0) AS overlap "
        f"FROM idx JOIN g USING (block_id) WHERE {_OVER})"),
    "block_runs": _sql("SELECT min(block_id)::BIGINT AS block_start, count(*) AS block_count FROM i GROUP BY g", _TIME, _IDX,
                       f"i AS (SELECT block_id, block_id - row_number() OVER (ORDER BY block_id) AS g FROM idx WHERE {_OVER})"),
    "mbr_shape": _sql("SELECT avg((time_max - time_min)::DOUBLE) AS mean_time, avg((lon_max - lon_min)::DOUBLE) AS mean_lon, avg((lat_max - lat_min)::DOUBLE) AS mean_lat FROM idx", _TIME, _IDX),
    "cost_model": _model_sql(),
}
