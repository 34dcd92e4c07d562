import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from strataframe.functions import vector as V
from strataframe.operators import meshes, metrics
from strataframe.sources import readers, writers
from strataframe.streaming import streams


def test_dem_grid_is_read_from_the_south(spark, tmp_path):
    (tmp_path / "dem.asc").write_text("ncols 2\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2\n3 -9999\n")
    got = {(r.ix, r.iy): (r.x, r.y, r.z) for r in readers.read_dem(spark, str(tmp_path / "dem.asc")).collect()}
    assert got == {(0, 0): (100, 200, 3), (1, 0): (110, 200, -9999), (0, 1): (100, 210, 1), (1, 1): (110, 210, 2)}


def _whole_dem(text):
    """Cells of a grid read as one text, by a plain loop."""
    lines = text.splitlines()
    number = lambda i: float(lines[i].split()[-1])
    skip = 7 if not lines[5].upper().startswith("NODATA") and lines[6].upper().startswith("NODATA") else 6
    rows = [line.split() for line in lines[skip:] if line.strip()]
    x0, y0, c = number(2), number(3), number(4)
    return sorted((ix, iy, x0 + ix * c, y0 + iy * c, float(z)) for iy, row in enumerate(reversed(rows)) for ix, z in enumerate(row))


def test_dem_of_many_byte_ranges(spark, tmp_path):
    draw, head = random.Random(5), "ncols 7\nnrows 90\nxllcorner 100\nyllcorner 200\ncellsize 2.5\n"
    texts = {}
    for name, extra in (("a", "NODATA_value -9999\n"), ("b", "more -1\nNODATA_value -9999\n"), ("c", "more -1\n")):
        rows = [" ".join(str(draw.randrange(1000)) for _ in range(7)) for _ in range(90)]
        rows.insert(40, "  ")
        texts[name] = head + extra + "\n".join(rows) + "\n\n"
        (tmp_path / f"{name}.asc").write_text(texts[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (64, 300, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            cells = readers.read_dem(spark, str(tmp_path))
            assert size > 1000 or cells.rdd.getNumPartitions() > 3
            got = sorted(tuple(r) for r in cells.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == sorted(c for t in texts.values() for c in _whole_dem(t))


def test_off_round_trip_and_rejects(spark, tmp_path):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.00049, 0.0, 0.0), ("m", 2, 0.0, 2.5, -1.0)], "mesh_id string, v int, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2)], "mesh_id string, f int, a int, b int, c int")
    text = writers.off_text(v, f).first().value
    assert text.splitlines()[:2] == ["OFF", "3 1 0"] and "3 0 1 2" in text
    (tmp_path / "m.off").write_text("# by hand\n".join(["OFF\n", text.removeprefix("OFF\n")]))
    (tmp_path / "bad.off").write_text("OFF\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    vertices, faces, bad = readers.read_off(spark, str(tmp_path), strict=False)
    assert [(r.x, r.y, r.z) for r in vertices.orderBy("v").collect()] == [(0, 0, 0), (1, 0, 0), (0, 2.5, -1)]
    assert [r.mesh_id for r in bad.collect()] == ["bad.off"]
    row = readers.triangles(vertices, faces).first()
    assert (row.ax, row.bx, row.cy) == (0, 1, 2.5)


def test_section_job(spark, tmp_path):
    b = {"xmin": 0, "ymin": 0, "zmin": 0, "xmax": 1, "ymax": 1, "zmax": 1}
    (tmp_path / "job.json").write_text(json.dumps({"toCompute": {"a": [b, b]}, "resolution": 5, "computeMap": True, "springs": {"s": {"x": 1, "y": 2, "z": 3}}}))
    job = readers.read_job(spark, str(tmp_path / "job.json"), "intersections")
    assert job["sections"].count() == 2 and job["springs"].first().id == "s" and job["drillholes"].count() == 0


def test_names_metadata_and_labels(spark):
    df = spark.createDataFrame([("mesh_12_a.off", "/box", '{"a": "1"}'), ("7_x", "box", "no json")], "n string, c string, j string")
    rows = df.select(V.gwb_id_from_name(F.col("n")).alias("g"), V.relabel_container(F.col("c")).alias("c"), V.parse_metadata(F.col("j")).alias("m")).collect()
    assert [(r.g, r.c) for r in rows] == [(12, "box"), (7, "box")] and rows[0].m == {"a": "1"}


def test_profile_store_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("voxels", 3, "2024-01-01 00:00:01", {"a": 0.001234567})], "computation string, version int, start_time string, steps map<string,double>").withColumn("start_time", F.col("start_time").cast("timestamp"))
    writers.append_profile_json(p, str(tmp_path / "j"))
    row = readers.read_profile_json(spark, str(tmp_path / "j")).first()
    assert row.steps == {"a": 1.23457} and str(row.start_time) == "2024-01-01 00:00:01"


def test_voxels_are_written_in_order(spark, tmp_path):
    rows = [(x, y, z, x + 10 * y + 100 * z, 0) for x in range(2) for y in range(2) for z in range(2)]
    writers.write_vox(spark.createDataFrame(rows, "ix int, iy int, iz int, rank int, gwb_id int"), str(tmp_path / "v"), (0, 0, 0, 1, 1, 1), (2, 2, 2))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).withColumn("f", F.col("_metadata.file_path")).orderBy("f").collect()]
    assert lines[:2] == [writers.vox_header((0, 0, 0, 1, 1, 1), (2, 2, 2)), "rank gwb_id"]
    assert lines[2:] == [f"{r[3]} 0" for r in sorted(rows, key=lambda r: r[2::-1])]


def test_manifest(spark):
    df = spark.createDataFrame([("mesh", "1", "p1"), ("mesh", "1", "p0"), ("fault", "F", "q")], "kind string, name string, path string")
    assert json.loads(writers.manifest(df).first().value) == {"fault": {"F": ["q"]}, "mesh": {"1": ["p0", "p1"]}}


def test_named_path_functions(spark):
    import numpy as np
    from strataframe.operators import tunnels

    d = spark.createDataFrame([("sin", "line", 0.5), ("line", "sin", 1.0)], "fx string, fy string, t double")
    rows = tunnels.named_path(d, {"sin": np.sin, "line": lambda t: 3 * t}, {"x": "fx", "y": "fy"}).orderBy("t").collect()
    assert rows[0].bx == pytest.approx(np.sin(0.5)) and rows[0].tx == pytest.approx(np.cos(0.5)) and rows[0].ty == pytest.approx(3)
    assert rows[1].bx == 3 and rows[1].by_ == pytest.approx(np.sin(1.0))
    with pytest.raises(Exception, match="no path function"):
        tunnels.named_path(d, {"sin": np.sin}, {"x": "fx"}).collect()


def test_overdue_stream_equals_the_batch(spark, tmp_path):
    draw, first = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = [(7, "STARTED", 0.0), (7, "SUCCESS", 1.0), (7, "STARTED", 3.0)]  # began again and did not end
    for task in range(20, 60):
        at = draw.uniform(0, 30)
        for _ in range(draw.randrange(4)):
            took = draw.uniform(0, 5)
            rows += [(task, "STARTED", at), (task, draw.choice(streams.ENDS), at + took)]
            at += took + draw.uniform(0, 9)
        rows += [(task, "STARTED", at)] * draw.randrange(2) + [(task, "RETRY", at + 0.1)]
    rows += [(99, "RETRY", 80.0), (None, "STARTED", 1.0)]
    rows = sorted(((t, s, first + datetime.timedelta(hours=h)) for t, s, h in rows), key=lambda r: r[2])
    schema = "task long, state string, ts timestamp"
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = streams.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got = streams.drained(streams.overdue_tasks(stream, late="0 seconds"), "late_ones", str(tmp_path / "c"), "append").collect()
    want = metrics.overdue(spark.createDataFrame(rows, schema).where("task IS NOT NULL")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 7 in {r.task for r in got} and len(got) > 5


def test_surfaces_are_welded_written_and_read_back(spark, sf_dir, tmp_path):
    from strataframe.plans.views import view

    tri = meshes.extract_surfaces(spark, view(spark, sf_dir, "rank_grid")).withColumn("mesh_id", F.concat(F.lit("rank_"), "rank"))
    vertices, faces = meshes.welded(tri)
    writers.write_off(vertices, faces, str(tmp_path / "off"))
    for folder in (tmp_path / "off").glob("mesh_id=*"):
        next(folder.glob("part-*")).rename(tmp_path / folder.name.removeprefix("mesh_id="))
    back = readers.triangles(*readers.read_off(spark, str(tmp_path / "rank_*"))[:2])
    told = lambda t: {r.mesh_id: (round(r.volume, 6), r.closed, r.faces, r.vertices) for r in meshes.mesh_volume(t, "mesh_id").join(meshes.mesh_closed(t), "mesh_id").join(meshes.mesh_sizes(t, "mesh_id"), "mesh_id").collect()}
    assert told(back) == told(tri) and len(told(tri)) > 1 and all(v[1] for v in told(tri).values())
    counted = {r.mesh_id: r.n for r in vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("n")).collect()}
    assert counted == {m: v[3] for m, v in told(tri).items()}


def test_profile_csv_comes_back(spark, tmp_path):
    start = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [("meshes", 3, start, {"a": 0.25, "b": 1.5}), ("voxels", 1, start, {"b": 2.0}), ("voxels", 1, start, {"b": 2.0})]
    profile = spark.createDataFrame(rows, "computation string, version int, start_time timestamp, steps map<string,double>")
    writers.write_profile_csv(profile, str(tmp_path / "csv"), ["a", "b"])
    got = readers.read_profile_csv(spark, str(tmp_path / "csv"), ["a", "b"]).collect()
    assert sorted((r.computation, r.version, r.start_time, tuple(sorted(r.steps.items()))) for r in got) == sorted((c, v, t, tuple(sorted(s.items()))) for c, v, t, s in rows)


def test_report_of_no_aquifer_is_an_error(spark):
    with pytest.raises(ValueError, match="no aquifer"):
        writers.aquifer_report(spark.createDataFrame([], "spring_id int, unit_id int, component int, volume double"))


def test_drained_rows_stay_in_files(spark, sf_dir):
    from strataframe import catalog

    assert catalog.QUERIES["stream_latest_state"](spark, sf_dir).inputFiles()


def test_ranks_run_on_over_partitions(spark):
    from strataframe.operators import spatial

    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"), (F.col("id") % 7).alias("z"))
    out = spatial.ranked(d, F.desc("z"), "id")
    assert out.select("pos", "id", "z").collect() == [(i + 1, *r) for i, r in enumerate(sorted((tuple(r) for r in d.collect()), key=lambda r: (-r[1], r[0])))]
    assert spatial.ranked(d.limit(0), "id").count() == 0


def test_jobs_of_meshes_tunnels_and_points(spark, tmp_path):
    box = {"xmin": 0, "ymin": 1, "zmin": 2, "xmax": 3, "ymax": 4, "zmax": 5}
    (tmp_path / "m.json").write_text(json.dumps({"resolution": {"x": 5, "y": 6, "z": 7}, "box": box}))
    params = readers.read_job(spark, str(tmp_path / "m.json"), "meshes")["params"].first()
    assert (params.resolution.y, params.box.zmax) == (6, 5.0)
    tunnel = {"name": "t", "shape": "Circle", "radius": 2, "functions": [{"x": [0, 1], "y": [2], "z": [3]}, {"x": [1, 1], "y": [2], "z": [3, 0, 1]}]}
    (tmp_path / "t.json").write_text(json.dumps({"tunnels": [tunnel], "step": 0.1, "nb_vertices": 8, "idxStart": -1, "idxEnd": -1, "tStart": 0, "tEnd": 1}))
    job = readers.read_job(spark, str(tmp_path / "t.json"), "tunnels")
    assert [(r.name, r.segment, r.fx, r.fz) for r in job["tunnels"].orderBy("segment").collect()] == [("t", 0, [0, 1], [3]), ("t", 1, [1, 1], [3, 0, 1])]
    assert job["params"].first().nb_vertices == 8
    (tmp_path / "p.json").write_text(json.dumps({"points": [{"x": 1, "y": 2, "z": 3}, {"x": 4}]}))
    assert [tuple(r) for r in readers.read_points(spark, str(tmp_path / "p.json")).collect()] == [(1, 2, 3), (4, None, None)]


def test_only_text_meshes_are_read(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "b.drc").write_bytes(b"DRACO\x02\x00")
    (tmp_path / "c.off").write_text("OFF\nno counts\n")
    vertices, _, bad = readers.read_off(spark, str(tmp_path), strict=False)
    assert {r.mesh_id for r in vertices.collect()} == {"a.off"} and [r.mesh_id for r in bad.collect()] == ["c.off"]
    with pytest.raises(Exception, match="not a triangle mesh"):
        readers.read_off(spark, str(tmp_path))[0].collect()


def test_results_as_lines_of_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, None]), (2, None)], "id int, v array<double>")
    writers.write_json(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"v":[0.5,null]}', '{"id":2}']
    found = spark.createDataFrame([(2, 7, 0, 1.5), (1, 7, 3, 2.5)], "spring_id int, unit_id int, component int, volume double")
    report = [json.loads(r.value) for r in writers.aquifer_report(found).collect()]
    assert report == [{"file": "mesh_0.off", "unitId": 7, "springId": 1, "volume": 2.5}, {"file": "mesh_1.off", "unitId": 7, "springId": 2, "volume": 1.5}]


def test_stream_keeps_recent_rows(spark, tmp_path):
    now = datetime.datetime.now(datetime.timezone.utc)
    rows = [(k, now - datetime.timedelta(hours=h)) for k, h in enumerate((0.5, 7, 9, 100))] + [(9, None)]
    spark.createDataFrame(rows, "task long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "task long, ts timestamp")
    kept = streams.drained(streams.retained_stream(stream), "recent", str(tmp_path / "c"), "append")
    assert {r.task for r in kept.collect()} == {0, 1}
