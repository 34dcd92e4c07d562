from pyspark.sql import functions as F

from strataframe.operators import assembly, metrics, sections


def test_part_names_lose_their_prefix_and_unknown_parts_go(spark):
    faces = spark.createDataFrame([(1, 0, [0, 1, 2]), (2, 0, [0, 1, 2, 3]), (9, 0, [0, 1, 2])], "part int, f int, face array<int>")
    names = spark.createDataFrame([(1, "base-A"), (2, "B")], "part int, name string")
    assert {(r.part, r.name) for r in assembly.named_faces(faces, names).collect()} == {(1, "A"), (2, "B")}
    assert assembly.triangulated(faces).count() == 4
    assert assembly.grouped_faces(faces).where("part = 2").first().faces == [[0, 1, 2, 3]]


def test_an_evaluator_can_be_plugged_in(spark):
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double")
    assert [r.v for r in assembly.with_field(points, lambda p: p.x * p.y, "v").collect()] == [2.0, 12.0]


def test_faults_in_a_circle_are_an_error(spark):
    import pytest

    faults = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "fault string, stops_on array<string>")
    with pytest.raises(ValueError, match="circle"):
        sections.fault_levels(faults)


def test_zero_of_a_limit_is_clipped_and_unknown_limits_are_ignored(spark):
    potential = spark.createDataFrame([(0, 0, "a", 5.0), (0, 1, "a", 5.0), (0, 0, "b", 0.0), (0, 1, "b", 2.0)], "i int, j int, fault string, value double")
    faults = spark.createDataFrame([("a", True, ["b", "nowhere"]), ("b", True, [])], "fault string, infinite boolean, stops_on array<string>")
    none = spark.createDataFrame([], "fault string, limit_fault string, value double")
    ell = spark.createDataFrame([], "i int, j int, fault string, e double")
    got = {(r.j, r.fault): r.value for r in sections.clipped_faults(potential, faults, none, ell).collect()}
    assert got == {(0, "a"): None, (1, "a"): 5.0, (0, "b"): 0.0, (1, "b"): 2.0}
    assert [r.fault for r in sections.unknown_limits(faults).collect()] == ["nowhere"]


def test_rates_without_outcomes_are_null(spark):
    events = spark.createDataFrame([("q", "STARTED")], "queue string, state string")
    assert metrics.success_rate(events, "queue").first().success_rate is None
    assert metrics.task_stats(events, "queue").select(F.col("started")).first().started == 1


def test_fields_are_clipped_by_section(spark):
    """A field of zeros, a limit and a crossing are judged in each section by its own points."""
    rows = [("s", 0, 0, "a", 5.0, -1.0), ("s", 0, 1, "a", -5.0, -1.0), ("s", 1, 0, "a", 3.0, 2.0), ("s", 0, 0, "b", 1.0, None), ("s", 0, 1, "b", 1.0, None), ("s", 1, 0, "b", -1.0, None)]
    rows += [("t", 0, 0, "a", 5.0, 1.0), ("t", 0, 1, "a", -5.0, -1.0), ("t", 0, 0, "b", 0.0, None), ("t", 0, 1, "b", 0.0, None)]
    potential = spark.createDataFrame(rows, "k string, i int, j int, fault string, value double, e double")
    faults = spark.createDataFrame([("a", False, ["b"]), ("b", True, [])], "fault string, infinite boolean, stops_on array<string>")
    none = spark.createDataFrame([], "fault string, limit_fault string, value double")
    told = lambda df: {(r.k, r.i, r.j, r.fault): r.value for r in df.collect()}
    clipped = told(sections.clipped_faults(potential, faults, none, keys=("k",)))
    assert {k: v for k, v in clipped.items() if k[3] == "a"} == {("s", 0, 0, "a"): 5.0, ("s", 0, 1, "a"): -5.0, ("s", 1, 0, "a"): None, ("t", 0, 0, "a"): None, ("t", 0, 1, "a"): -5.0}
    assert not any(k[0] == "t" and k[3] == "b" for k in clipped)  # its field is zero there, and no limit
    kept = told(sections.fault_section(potential, faults, none, keys=("k",)))
    assert {(k, f) for k, _, _, f in kept} == {("s", "a"), ("s", "b")}
    high = potential.withColumn("height", F.when(F.col("j") == 1, 1.0))
    assert told(sections.clipped_faults(high, faults, none, keys=("k",)))[("s", 0, 1, "a")] is None
    nested = sections.fault_matrices(sections.fault_section(potential, faults, none, keys=("k",)), ["k"]).first()
    assert nested.faults == {"a": [[5.0, None], [-5.0]], "b": [[1.0, -1.0], [1.0]]}


def test_fields_are_told_from_gathered_points(spark):
    """Matrices of all faults of a section at once equal those of fields told and clipped pair by pair, whose rows are shuffled."""
    rows = [(k, i, j, i * 7.5 - 11 + k, j * 3.25 - 4, None if (i, j) == (2, 1) else 5.0 - i * j, None if i == 0 else i - 4.5) for k in range(3) for i in range(6) for j in range(5 - k) if (i, j) != (4, 2)]
    points = spark.createDataFrame(rows, "k int, i int, j int, x double, y double, z double, height double")
    plane = [(1, 1.0, 0.5, -1.0, 0.3), (2, -0.5, 1.0, 0.0, 0.1), (3, 0.0, 0.0, 0.0, 0.0), (4, 0.0, 1.0, 1.0, -2.0), (5, 1.0, 0.0, 0.0, 4.0), (10, 0.3, -1.0, 0.7, 1.0)]
    fields = spark.createDataFrame([(*p, *((4.0, -1.0, 2.0) if p[0] in (2, 5) else (None,) * 3), 9.0, 6.0, 8.0) for p in plane], "fault int, a double, b double, c double, d double, mx double, my double, mz double, rx double, ry double, rz double")
    faults = spark.createDataFrame([(1, True, [2, 3, 99]), (2, False, []), (3, True, []), (4, False, [1, 10]), (5, True, [4]), (77, True, [1])], "fault int, infinite boolean, stops_on array<int>")
    sides = spark.createDataFrame([(1, 2, -3.0), (1, 2, 1.0), (4, 1, 2.0)], "fault int, limit_fault int, value double")
    want = sections.fault_matrices(sections.clipped_faults(sections.plane_fields(points, fields), faults, sides, keys=("k",)), ["k"])
    got = sections.field_matrices(points, fields, faults, sides, ["k"])
    told = lambda df: sorted((r.k, list(r.faults.items())) for r in df.collect())
    assert told(got) == told(want) and len(told(want)) == 3
    again = sections.field_matrices(points, fields, faults, sides, ["k"])
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert told(sections.field_matrices(points, fields.where("fault = 3"), faults, sides, ["k"])) == []


def test_features_are_gathered_where_their_sections_are(spark):
    """Maps of features near each section equal the projections, which are rows; a section with none has a row as well."""
    boxes = spark.createDataFrame([(n, 0, x, y, 0.0, x + 30.0, y + n, 10.0) for n, (x, y) in enumerate([(0.0, 0.0), (40.0, 5.0), (40.0, 5.0), (0.0, 900.0)])], "section_id int, seg int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")
    holes = spark.createDataFrame([(i, i * 7.0 % 50, i * 11.0 % 60, 9.0, i * 7.0 % 50 + i % 3, i * 11.0 % 60, None if i == 4 else -float(i)) for i in range(40)], "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = sections.gathered_drillholes(boxes, holes, 9.0)
    told = {(r.section_id, i): tuple(v for end in ends for v in end) for r in got.collect() for i, ends in (r.drillholes or {}).items()}
    assert told == {(r.section_id, r.id): (r.u0, r.v0, r.u1, r.v1) for r in sections.project_drillholes(boxes, holes, 9.0).collect()} != {}
    assert sorted((r.section_id, r.drillholes is None) for r in got.collect()) == [(0, False), (1, False), (2, False), (3, True)]
    springs = holes.selectExpr("id", "x0 AS x", "y0 AS y", "z1 AS z")
    listed = {(r.section_id, i): tuple(v) for r in sections.gathered_springs(boxes, springs, 9.0).collect() for i, v in (r.springs or {}).items()}
    assert listed == {(r.section_id, r.id): (r.u, r.z) for r in sections.project_springs(boxes, springs, 9.0).collect()} != {}
    met = sections.gathered_springs(boxes, springs, 9.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in met and "BroadcastNestedLoopJoin" in met


def test_lists_of_features_are_neither_dealt_anew_nor_sorted(spark):
    """Also where a key of the sections is a constant, which Spark drops from the keys of joins and groups."""
    boxes = spark.range(40).select(F.col("id").cast("int").alias("section_id"), F.lit(0).alias("seg"), *[(F.col("id") * 1.0 + n).alias(c) for n, c in enumerate(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))])
    holes = spark.range(90).selectExpr("id", "id % 9 * 5D AS x0", "id % 7 * 5D AS y0", "9D AS z0", "id % 9 * 5D AS x1", "id % 7 * 5D AS y1", "-double(id) AS z1")
    near = sections.near_drillholes(boxes, holes, 9.0)
    told = near.join(near.select("section_id", "seg", F.size("drillholes").alias("n")).hint("shuffle_hash"), ["section_id", "seg"])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("sort_array", "").replace("SortOrder", "") and "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    want = {r.section_id: r["count"] for r in sections.project_drillholes(boxes, holes, 9.0).groupBy("section_id").count().collect()}
    got = {r.section_id: len(r.drillholes) for r in sections.gathered_drillholes(boxes, holes, 9.0).collect() if r.drillholes is not None}
    assert got == want != {}


def test_rows_of_equal_values_share_what_is_made_of_one(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, None), (5, 7.0)], "id int, x double")
    first, members = sections.alike(rows, ["id"], ["x", F.col("id") % 2])
    assert sorted(r.id for r in first.collect()) == [1, 2, 5]
    made = first.select("id", F.explode(F.array("id", F.lit(0))).alias("v"))
    assert sorted(tuple(r) for r in sections.of_alike(made, members, ["id"]).collect()) == sorted((i, v) for i, n in ((1, 1), (2, 2), (3, 1), (4, 2), (5, 5)) for v in (n, 0))


def test_a_part_with_both_ends_is_wider(spark):
    from strataframe.operators import tunnels

    rows = [(1, "Circle", 2.0, 3.0, 4.0, s) for s in (0, 1)] + [(2, "Rectangle", 2.0, 3.0, 4.0, s) for s in (0, 1)] + [(3, "Elliptic", 2.0, 3.0, 4.0, s) for s in (0, 1)]
    t = spark.createDataFrame(rows, "tunnel int, shape string, radius double, width double, height double, segment int").withColumns({"c0": F.col("segment") * 10.0, "c1": F.lit(10.0), "z": F.lit(0.0)})
    way = {"x": ["c0", "c1"], "y": ["z", "c1"], "z": ["z"]}
    told = lambda df: [(r.tunnel, r.station, r.v, round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in df.orderBy("tunnel", "station", "v").collect()]
    wide = t.withColumns({c: F.col(c) * 1.1 for c in ("radius", "width", "height")})
    part = lambda df, **k: told(tunnels.tunnel_vertices(df, way, 0.25, 8, first=1, t_first=0.5, **k))
    assert part(t, last=1) == part(wide) != part(t)


def test_water_layer_and_outputs_of_jobs(spark):
    assert assembly.has_hydro_layer(0, 0, 1) and assembly.has_hydro_layer(0, 2, 0) and assembly.has_hydro_layer(1, 0, 0) and not assembly.has_hydro_layer(0, 0, 0)
    one = spark.createDataFrame([("mesh", "rank_1"), ("mesh", "rank_1")], "kind string, name string")
    assert [tuple(r) for r in assembly.job_meshes(one, one.limit(0)).collect()] == [("mesh", "rank_1", 2)]
