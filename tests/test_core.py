import random

import pytest
from pyspark.sql import functions as F

from trailmark import functions as fn
from trailmark import operators as op
from trailmark import schema
from trailmark.sources import (event_points, read_geolife, read_id_queries, read_knn_queries, read_nyc, read_osm, read_porto,
                               read_st_queries, row_window)
from trailmark.streaming import append_points, grid_stream

SF = "/root/testdata/sf0.001"
POINT = "oid int, timestamp_sec int, lon int, lat int, pid long"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_page_geometry():
    assert schema.POINTS_PER_BLOCK == 219 and schema.block_bytes_for(219) == 4096 and schema.block_bytes_for(220) == 8192


@pytest.mark.parametrize("point,box,want", [((1, 1), (3, 5, 3, 4), 8), ((2, 1), (3, 6, 2, 4), 2), ((2, 1), (0, 6, 0, 7), 0)])
def test_min_dist(spark, point, box, want):
    b = dict(zip(("lon_min", "lon_max", "lat_min", "lat_max"), map(F.lit, box)))
    assert one(spark, fn.min_dist2(F.lit(point[0]), F.lit(point[1]), b)) == want


@pytest.mark.parametrize("point,box,want", [((1, 1), (3, 5, 3, 4), 13), ((2, 1), (3, 6, 2, 4), 10)])
def test_minmax_dist(spark, point, box, want):
    b = dict(zip(("lon_min", "lon_max", "lat_min", "lat_max"), map(F.lit, box)))
    assert one(spark, fn.minmax_dist2(F.lit(point[0]), F.lit(point[1]), b)) == want


def test_normalise(spark):
    assert one(spark, fn.norm_lon(F.lit(-8.610291))) == 7987339
    assert one(spark, fn.norm_lat(F.lit(41.140746))) == 12223203
    assert [one(spark, fn.norm_lon(F.lit(x))) for x in (180.0, -180.0, 200.0)] == [schema.GRID - 1, 0, schema.GRID - 1]


def test_z_order_bits(spark):
    for x, y, t in [(0, 0, 0), (5, 3, 7), (16777215, 1, 2097151), (2**31 - 1, 2**31 - 1, 2**21 + 5)]:
        bit = lambda v, i: v >> i & 1
        assert one(spark, fn.z2(F.lit(x), F.lit(y))) == sum(bit(x, i) << 2 * i | bit(y, i) << 2 * i + 1 for i in range(31))
        assert one(spark, fn.z3(F.lit(x), F.lit(y), F.lit(t))) == sum(bit(t, i) << 3 * i | bit(y, i) << 3 * i + 1 | bit(x, i) << 3 * i + 2 for i in range(21))


def test_bloom_has_no_false_negative(spark):
    df = spark.range(2000).select(F.col("id").cast("int").alias("oid"))
    lo, hi = fn.bloom_bits("oid")
    seg = df.groupBy((F.col("oid") % 100).alias("g")).agg(F.bit_or(lo).alias("lo"), F.bit_or(hi).alias("hi"))
    bad = df.join(seg, F.col("oid") % 100 == F.col("g")).where(~fn.bloom_may_contain("lo", "hi", F.col("oid")))
    assert bad.count() == 0


def test_csv_readers(spark, tmp_path):
    (tmp_path / "p").write_text("1,A,20000,1372636800,A,0,-8.610291,41.140746\n2,A,7,12,A,0,180,90\n3,A,8,13,A,0,-180,41\n4,A,9,x,A,0,abc,1\n")
    assert [tuple(r)[:4] for r in read_porto(spark, str(tmp_path / "p")).orderBy("pid").collect()] == [
        (20000, 1372636800, 7987339, 12223203), (7, 12, 16777215, 16777215), (8, 13, 0, 12210084), (9, None, None, 8481814)]
    (tmp_path / "n").write_text("5,2013-01-01 00:00:10,-73.9,40.7\n6,bad,1,2\n")
    assert [r[1] for r in read_nyc(spark, str(tmp_path / "n")).orderBy("pid").collect()] == [1356998410, None]
    (tmp_path / "o").write_text("9,1.5,2.5,77\n")
    assert tuple(read_osm(spark, str(tmp_path / "o"), row_id=False).first())[:2] == (9, 77)
    (tmp_path / "g").write_text("77,1.5,2.5\n")
    assert read_geolife(spark, str(tmp_path / "g")).first()["oid"] is None
    (tmp_path / "q").write_text("1372670836,1375262836,-8.612973,-8.112973,41.150043,41.650043\n")
    assert read_st_queries(spark, str(tmp_path / "q")).first()["time_max"] == 1375262836
    (tmp_path / "i").write_text("20000076,1372659460,1375251460\n")
    assert read_id_queries(spark, str(tmp_path / "i")).first()["oid"] == 20000076
    (tmp_path / "k").write_text("-8.6,41.1,10\n")
    assert read_knn_queries(spark, str(tmp_path / "k")).first()["k"] == 10


def test_readers_number_rows_without_gaps(spark, tmp_path):
    spark.range(60).selectExpr("1 AS a", "'A' AS b", "id", "id * 10 AS t", "'A' AS c", "0 AS d", "1.5D AS x", "2.5D AS y").repartition(20).write.csv(str(tmp_path / "p"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        p = read_porto(spark, str(tmp_path / "p"))
        assert p.rdd.getNumPartitions() > 5 and sorted(r["pid"] for r in p.collect()) == list(range(60))
        assert row_window(p, 10, 5).count() == 5
        assert op.layout_time_oid(p, capacity=7, segments=3, chunk_blocks=2).agg(F.countDistinct("block_id")).first()[0] == 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sparse_row_numbers_lay_out(spark):
    p = spark.createDataFrame([(1, 5, 1, 1, i << 40) for i in range(5)], POINT)
    assert op.layout_time_oid(p).select("block_id").distinct().count() == 5


def test_times_are_utc(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [one(spark, fn.to_epoch(F.lit(t))) for t in ("2013-01-01 00:00:10", "2013-1-1 0:0:10", "bad", None)] == [1356998410, 1356998410, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_no_cartesian_products(spark):
    from trailmark.sources import knn_queries, st_queries

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = event_points(spark, SF)
        boxes = st_queries(spark, [(i, 0, 2**31 - 1, 7978498 + 900 * i, 7978498 + 900 * i + 4660, 12210074, 12219394) for i in range(9)])
        near = knn_queries(spark, [(i, 7978498 + 900 * i, 12210074, 3 + i) for i in range(9)])
        for df in (op.st_range_batch(p, boxes), op.knn_batch(p, near)):
            plan = plan_of(df)
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_knn_batch_with_few_points_and_far_queries(spark):
    from trailmark.sources import knn_queries

    pts = [(1, 1, 5 * i, 7 * i % 11, i) for i in range(6)]
    p = spark.createDataFrame(pts, POINT)
    at = [(0, 3, 3, 4), (1, 16777215, 16777215, 2), (2, 0, 0, 50), (3, 10, 10, 0)]
    want = {(q, n + 1, i) for q, x, y, k in at for n, (_, i) in enumerate(sorted(((r[2] - x) ** 2 + (r[3] - y) ** 2, r[4]) for r in pts)[:k])}
    assert {(r["qid"], r["rank"], r["pid"]) for r in op.knn_batch(p, knn_queries(spark, at)).collect()} == want
    assert op.knn_batch(p.limit(0), knn_queries(spark, at)).count() == 0


def test_store_reads_only_the_blocks_of_a_query(spark, tmp_path):
    op.TrailStore.of(op.layout_zorder(event_points(spark, SF), capacity=20, segments=4)).write(str(tmp_path / "s"))
    s = op.TrailStore.open(spark, str(tmp_path / "s"))
    q = op.Box(0, 2**31 - 1, 7979000, 7979900, 12211000, 12213000)
    assert {r["pid"] for r in s.range(q).collect()} == {r["pid"] for r in op.st_range(event_points(spark, SF), q).collect()}
    plan = plan_of(s.range(q))
    assert "Exchange" not in plan and "GreaterThanOrEqual(block_id" in plan


def test_joins_keep_plans_small(spark):
    df = op.knn_join(event_points(spark, SF), 3)
    assert plan_of(df).count("Join") == 0


def test_row_window(spark):
    assert row_window(event_points(spark, SF), 10, 5).count() == 5


def test_layout_changes_no_answer(spark):
    p = event_points(spark, SF)
    q = op.Box(1704067200, 1706000000, 7979000, 7987000, 12211000, 12224000)
    want = {r["pid"] for r in op.st_range(p, q).collect()}
    want_knn = [r["pid"] for r in op.knn(p, 7985000, 12224000, 20).collect()]
    for laid in (op.layout_time_oid(p, capacity=50, segments=5), op.layout_zorder(p, capacity=50, segments=5),
                 op.layout_zorder(p, "no_preference", capacity=50, segments=5), op.layout_str(p, capacity=50, segments=5)):
        s = op.TrailStore.of(laid)
        assert {r["pid"] for r in s.range(q).collect()} == want == {r["pid"] for r in s.range(q, prune=False).collect()}
        assert [r["pid"] for r in op.knn_pruned(s.points, s.segments, 7985000, 12224000, 20).collect()] == want_knn
        assert {r["pid"] for r in s.id_temporal(7, 0, 2**31 - 1).collect()} == {r["pid"] for r in p.where("oid = 7").collect()}


def test_store_round_trip(spark, tmp_path):
    s = op.TrailStore.of(op.layout_zorder(event_points(spark, SF)))
    s.write(str(tmp_path / "s"))
    t = op.TrailStore.open(spark, str(tmp_path / "s"))
    assert t.total_points() == 1000 and t.blocks(0, 2).count() == 438 and sorted(t.index.collect()) == sorted(s.index.collect())


def test_block_runs(spark):
    for ids, want in (([1, 3, 4, 8, 9], [(1, 1), (3, 2), (8, 2)]), ([1, 2, 5, 6, 8], [(1, 2), (5, 2), (8, 1)]), ([], [])):
        df = spark.createDataFrame([(i,) for i in ids], "block_id int")
        for span in (1 << 20, 2):
            assert sorted(tuple(r) for r in op.block_runs(df, span).collect()) == want


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_pairs_and_joins_against_brute_force(spark, spread):
    rnd = random.Random(spread)
    pts = [(i % 5, rnd.randrange(9000), 100 + rnd.randrange(spread), 200 + rnd.randrange(spread), i) for i in range(120)]
    df = spark.createDataFrame(pts, POINT)
    d = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    pairs = sorted((d(a, b), a[4], b[4]) for a in pts for b in pts if a[4] < b[4])
    assert [tuple(r)[:3] for r in op.closest_pairs(df, 15).collect()] == pairs[:15]
    for gap in (None, 3600):
        want = {(a[4], n + 1, b, dd) for a in pts for n, (dd, b) in enumerate(sorted((d(a, b), b[4]) for b in pts if b != a and (gap is None or abs(a[1] - b[1]) > gap))[:4])}
        assert {tuple(r) for r in op.knn_join(df, 4, gap).collect()} == want


def test_empty_points(spark):
    e = spark.createDataFrame([], POINT)
    assert op.closest_pairs(e, 3).count() == 0 and op.knn_join(e, 3).count() == 0 and op.layout_str(e).count() == 0
    assert op.grid_total(e, 0, 0, 1, 1).first()[0] == 0


def test_stream_append(spark, tmp_path):
    event_points(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINT).parquet(str(tmp_path / "in"))
    append_points(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    t = op.TrailStore.open(spark, str(tmp_path / "out"))
    assert t.total_points() == 1000 and t.blocks(0, 2).count() == 438
    event_points(spark, SF).withColumn("pid", F.col("pid") + 1000).write.mode("append").parquet(str(tmp_path / "in"))
    append_points(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    t = op.TrailStore.open(spark, str(tmp_path / "out"))
    assert t.total_points() == 2000 and t.index.count() == 10 and t.segments.select("block_id").distinct().count() == 10
    q = op.Box(0, 2**31 - 1, 7979000, 7985000, 12211000, 12219000)
    assert t.range(q).count() == 2 * op.st_range(event_points(spark, SF), q).count()


def test_grid_stream(spark, tmp_path):
    event_points(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = grid_stream(spark.readStream.schema(POINT).parquet(str(tmp_path / "in")), 7978498, 12210074, 4660, 9320, window="1 day")
    stream.writeStream.format("memory").queryName("grid").outputMode("complete").start().processAllAvailable()
    assert spark.table("grid").agg(F.sum("n")).first()[0] == 1000
    for q in spark.streams.active:
        q.stop()
