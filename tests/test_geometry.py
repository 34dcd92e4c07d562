import collections
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe import runtime
from strataframe.operators import graph, groundwater, meshes, metrics, spatial, tunnels
from strataframe.functions import vector as V
from strataframe.plans.views import view

CUBE = [
    (0, 0, 0, 0, 1, 0, 1, 1, 0), (0, 0, 0, 1, 1, 0, 1, 0, 0), (0, 0, 1, 1, 0, 1, 1, 1, 1), (0, 0, 1, 1, 1, 1, 0, 1, 1),
    (0, 0, 0, 1, 0, 0, 1, 0, 1), (0, 0, 0, 1, 0, 1, 0, 0, 1), (0, 1, 0, 0, 1, 1, 1, 1, 1), (0, 1, 0, 1, 1, 1, 1, 1, 0),
    (0, 0, 0, 0, 0, 1, 0, 1, 1), (0, 0, 0, 0, 1, 1, 0, 1, 0), (1, 0, 0, 1, 1, 0, 1, 1, 1), (1, 0, 0, 1, 1, 1, 1, 0, 1),
]
TRI = "unit_id int, f int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def box(unit, x=0.0, y=0.0, z=0.0, size=1.0):
    move = (float(x), float(y), float(z)) * 3
    return [(unit, f, *[float(size * c + m) for c, m in zip(t, move, strict=True)]) for f, t in enumerate(CUBE)]


def inside_out(rows, first):
    return [(u, first + f, *t[0:3], *t[6:9], *t[3:6]) for u, f, *t in rows]


@pytest.mark.parametrize(("h", "volume"), [(0.5, 0.5), (0.25, 0.25), (2.0, 1.0)])
def test_cut_box_keeps_volume_and_stays_closed(spark, h, volume):
    tri = spark.createDataFrame(box(1), TRI).withColumn("h", F.lit(h))
    cut = meshes.clip_below(tri, ["unit_id"]).cache()
    assert meshes.mesh_volume(cut, "unit_id").first().volume == pytest.approx(volume)
    assert meshes.mesh_closed(cut, "unit_id").first().closed


def test_cut_below_the_box_leaves_nothing(spark):
    assert meshes.clip_below(spark.createDataFrame(box(1), TRI).withColumn("h", F.lit(-1.0)), ["unit_id"]).count() == 0


def test_four_boxes_give_the_three_that_touch(spark):
    tri = spark.createDataFrame(box(42) + box(101, 1, 0, -0.3) + box(213, 2, 0, -0.6) + box(1337, 99), TRI)
    springs = spark.createDataFrame([(0, 1.0, 1.0, 0.5, 42)], "id int, x double, y double, z double, unit_id int")
    rows = groundwater.groundwater_bodies(tri, springs).collect()
    assert sorted(r.unit_id for r in rows) == [42, 101, 213]
    assert {r.unit_id: round(r.volume, 6) for r in rows} == {42: 0.5, 101: 0.8, 213: 1.0}


def test_lower_spring_of_the_same_body_gives_none(spark):
    tri = spark.createDataFrame(box(42), TRI)
    springs = spark.createDataFrame([(7, 1.0, 1.0, 0.5, 42), (8, 1.0, 1.0, 0.4, 42)], "id int, x double, y double, z double, unit_id int")
    assert {r.spring_id for r in groundwater.groundwater_bodies(tri, springs).collect()} == {7}


def test_cavity_belongs_to_the_body_and_an_island_does_not(spark):
    shell = box(1, size=10) + [(u, f + 12, *t) for u, f, *t in inside_out(box(1, 2, 2, 2, size=6), 0)]
    island = [(u, f + 24, *t) for u, f, *t in box(1, 4, 4, 4, size=2)]
    tri = spark.createDataFrame(shell + island, TRI).withColumn("h", F.lit(5.0))
    walls, caps = groundwater.cut_components(tri, ["unit_id"])
    whole = walls.unionByName(caps)
    volumes = sorted(round(r.volume, 6) for r in meshes.mesh_volume(whole, "unit_id", "component").collect())
    assert volumes == [4.0, 500.0 - 6 * 6 * 3]


def _square(loop, x, y, size, hole):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    turned = corners[::-1] if hole else corners
    return [(1, loop, -size * size if hole else size * size, a, b, loop) for a, b in zip(turned, turned[1:] + turned[:1], strict=True)]


SEGMENT = "k int, loop int, area double, s struct<x:double,y:double>, e struct<x:double,y:double>, outer int"
HOLE = "k int, inner int, apex struct<x:double,y:double>"


def test_loops_around_holes_by_a_plain_test(spark):
    draw = random.Random(8)
    segments, holes = [], []
    for loop in range(60):
        x, y, size = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice([0.5, 3.0, 20.0, 90.0])
        segments += _square(loop, x, y, size, loop % 2 == 0)
        if loop % 2 == 0:
            holes.append((1, loop, (x, y)))
    got = groundwater.loops_around(spark.createDataFrame(holes, HOLE), spark.createDataFrame(segments, SEGMENT), ["k"])
    want = set()
    for _, inner, (px, py) in holes:
        hits = collections.Counter(loop for _, loop, _, (sx, sy), (ex, ey), _ in segments if (sy > py) != (ey > py) and px < (ex - sx) * (py - sy) / (ey - sy) + sx)
        want |= {(inner, loop) for loop, n in hits.items() if n % 2}
    assert {(r.inner, r.loop) for r in got.collect()} == want and len(want) > 60


def test_very_many_loops_of_one_cut(spark):
    """Ten thousand cavities, each in a body of its own, in one cut: a hole meets the loops of its strip."""
    side = spark.range(10_000).select(F.col("id"), (F.col("id") % 100 * 10).alias("x"), (F.floor(F.col("id") / 100) * 10).alias("y"))
    ring = lambda lo, hi: F.array(*[F.struct((F.col("x") + (hi if i in (1, 2) else lo)).cast("double").alias("x"), (F.col("y") + (hi if i in (2, 3) else lo)).cast("double").alias("y")) for i in (0, 1, 2, 3, 0)])
    loops = side.withColumn("p", ring(0, 8)).withColumn("loop", F.col("id")).unionByName(side.withColumn("p", ring(2, 5)).withColumn("loop", F.col("id") + 10_000))
    segments = loops.select(F.lit(1).alias("k"), "loop", F.lit(1.0).alias("area"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get("p", i).alias("s"), F.get("p", i + 1).alias("e")))).alias("g"), F.col("loop").alias("outer"))
    segments = segments.select("k", "loop", "area", "g.s", "g.e", "outer")
    holes = side.select(F.lit(1).alias("k"), (F.col("id") + 10_000).alias("inner"), F.struct((F.col("x") + 2.0).alias("x"), (F.col("y") + 2.5).alias("y")).alias("apex"))
    found = groundwater.loops_around(holes, segments, ["k"]).where("inner <> outer")
    told = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outer") == F.col("inner") - 10_000).alias("own")).first()
    assert (told.n, told.own) == (10_000, 10_000)


def test_unknown_unit_and_open_mesh_are_errors(spark):
    tri = spark.createDataFrame(box(42), TRI)
    spring = lambda unit: spark.createDataFrame([(0, 1.0, 1.0, 0.5, unit)], "id int, x double, y double, z double, unit_id int")
    with pytest.raises(ValueError, match="without a mesh"):
        groundwater.groundwater_bodies(tri, spring(5))
    with pytest.raises(ValueError, match="not closed"):
        groundwater.groundwater_bodies(tri.where("f > 0"), spring(42))


def test_placed_ring_has_a_level_base(spark):
    draw = random.Random(4)
    rows = [(draw.uniform(-10, 10), draw.uniform(-10, 10), draw.uniform(0, 10)) for _ in range(100)]
    df = spark.createDataFrame(rows, "tx double, ty double, tz double")
    zero = (F.lit(0.0),) * 3
    at = lambda w: tunnels.place_ring((F.lit(0.0), F.lit(w), F.lit(0.0)), V.vec("tx", "ty", "tz"), zero)
    for row in df.select(at(10.0).alias("p"), at(-10.0).alias("q")).collect():
        assert abs(row.p.z - row.q.z) < 1.0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 40)] + [(3, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(7, 40)} == {7} and 3 not in got


def test_small_components_settle_in_few_rounds(spark, monkeypatch):
    """Links are contracted in a few tasks before a round's shuffles, so a long chain takes few rounds."""
    rounds, told = [], graph.Scratch.cut_told
    monkeypatch.setattr(graph.Scratch, "cut_told", lambda self, *a, **b: rounds.append(1) or told(self, *a, **b))
    nodes = [i * 7919 % 3001 for i in range(3001)]
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "u long, v long").repartition(16)
    assert {tuple(r) for r in graph.connected_components(edges).select("node", "component").collect()} == {(i, 0) for i in range(3001)}
    assert len(rounds) <= 6


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert graph.connected_components(spark.createDataFrame([(4, 4), (None, 2)], "u long, v long")).count() == 0


def _joined(edges):
    """Smallest reachable node by node, by repeated union."""
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for u, v in edges:
        if u != v and None not in (u, v):
            low, high = sorted((find(u), find(v)))
            top[high] = low
    return {n: find(n) for n in top}


@pytest.mark.parametrize("task_links", [None, 0])
def test_components_of_hubs_equal_unions(spark, monkeypatch, task_links):
    """A low hub, a high hub and a random graph, with repeats and nulls; in one plan and with the links of hubs dealt."""
    monkeypatch.setattr(runtime, "SPREAD_ROWS", 16)
    draw = random.Random(8)
    edges = [(0, i) for i in range(1, 300)] + [(i, 9_999) for i in range(1_000, 1_300)] + [(9_999, 1_000)] * 40
    edges += [(draw.randrange(2_000, 2_600), draw.randrange(2_000, 2_600)) for _ in range(400)] + [(5, 5), (None, 3), (7, None)]
    got = graph.connected_components(spark.createDataFrame(edges, "u long, v long"), task_links=task_links).collect()
    want = _joined(edges)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_tables_of_finished_rounds_are_dropped(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    work = runtime.Scratch(spark, "rounds")
    first, told = work.cut_told(links, n=F.count(F.lit(1)), top=F.max("v"))
    second = work.cut(first.where("u < 5"))
    assert told == {"n": 40, "top": 40}
    assert work.keep_only(second) is second and second.count() == 5
    third = work.cut(second)
    work.drop(second)
    work.drop(second)
    assert third.count() == 5


def test_case_table_covers_all_mixed_masks():
    table = dict(meshes.case_table())
    assert len(table) == 254 and all(table.values())


def test_views_hold_repeated_points_and_null_coordinates(spark, sf_dir):
    points = view(spark, sf_dir, "points")
    assert points.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert points.where("x IS NULL").count() > 0


def volume_of(spark, cells, step=1.0):
    """The closed surface of unit 1 over cells of a voxel grid; its bounds are half a step around the cells."""
    ranks = spark.createDataFrame([(*c, 1) for c in cells], "ix int, iy int, iz int, rank int")
    return meshes.extract_surfaces(spark, ranks, (step, step, step)).withColumnRenamed("rank", "unit_id")


def u_shape(up):
    """Two towers joined by a floor, or by a roof where ``up`` is false; 0.5 around cells 0..6, 0..2, 0..6."""
    cells = [(x, y, z) for x in range(7) for y in range(3) for z in range(7)]
    return [(x, y, z) for x, y, z in cells if x < 2 or x > 4 or (z < 2 if up else z > 4)]


def shell_and_core():
    """A block inside an open box, joined by the box's roof only."""
    cells = [(x, y, z) for x in range(11) for y in range(11) for z in range(9)]
    middle = lambda v, r: abs(v - 5) <= r
    return [(x, y, z) for x, y, z in cells if z > 6 or not (middle(x, 3) and middle(y, 3)) or middle(x, 1) and middle(y, 1)]


def bounds(lo, hi):
    return dict(zip(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), (*lo, *hi), strict=True))


SINGLE = [
    ([(0, 0, 0)], [((0.0, 0.0, 0.3), bounds((-0.5, -0.5, -0.5), (0.5, 0.5, 0.3)))]),
    (u_shape(True), [((0.0, 1.0, 4.0), bounds((-0.5, -0.5, -0.5), (6.5, 2.5, 4.0)))]),
    (u_shape(False), [((6.0, 1.0, 3.0), bounds((4.5, -0.5, -0.5), (6.5, 2.5, 3.0)))]),
    (shell_and_core(), [((5.0, 5.0, 3.2), bounds((3.5, 3.5, -0.5), (6.5, 6.5, 3.2)))]),
    (shell_and_core(), [((0.0, 0.0, 3.2), bounds((-0.5, -0.5, -0.5), (10.5, 10.5, 3.2)))]),
    (shell_and_core(), [((5.0, 5.0, 7.2), bounds((-0.5, -0.5, -0.5), (10.5, 10.5, 7.2)))]),
    (
        shell_and_core(),
        [
            ((0.0, 0.0, 3.2), bounds((-0.5, -0.5, -0.5), (10.5, 10.5, 3.2))),
            ((5.0, 5.0, 2.2), bounds((3.5, 3.5, -0.5), (6.5, 6.5, 2.2))),
        ],
    ),
    (shell_and_core(), [((0.0, 0.0, 3.2), bounds((-0.5, -0.5, -0.5), (10.5, 10.5, 3.2))), ((0.0, 0.0, 2.2), None)]),
    ([(0, 0, 0)], [((0.0, 0.0, -999.0), None)]),
]


def test_bodies_of_single_meshes(spark):
    """Nine cases of one mesh each; every mesh lies far from the others, so one run works on all of them."""
    tri, springs, wanted = None, [], []
    for unit, (cells, asked) in enumerate(SINGLE):
        mesh = meshes.translate_mesh(volume_of(spark, cells).withColumn("unit_id", F.lit(unit)), 500.0 * unit, 0.0, 0.0)
        tri = mesh if tri is None else tri.unionByName(mesh)
        for (x, y, z), box_of in asked:
            if box_of is not None:
                box_of = box_of | {"xmin": box_of["xmin"] + 500.0 * unit, "xmax": box_of["xmax"] + 500.0 * unit}
                wanted.append((len(springs), *box_of.values()))
            springs.append((len(springs), x + 500.0 * unit, y, z, unit))
    faces = groundwater.groundwater_faces(tri, spark.createDataFrame(springs, "id int, x double, y double, z double, unit_id int"))
    got = spatial.mesh_bbox(faces, "spring_id").cache()
    assert {r.spring_id for r in got.collect()} == {w[0] for w in wanted}
    names = "xmin ymin zmin xmax ymax zmax".split()
    want = spark.createDataFrame(wanted, "spring_id int, " + ", ".join(f"w_{n} double" for n in names))
    near = got.join(want, "spring_id").select("spring_id", meshes.bbox_close("w_", "").alias("near"))
    assert [r.spring_id for r in near.collect() if not r.near] == []


@pytest.mark.parametrize(
    ("at", "inside"),
    [((0.5, 0.5, 0.5), True), ((0.0, 0.5, 0.5), False), ((1.0, 0.25, 0.75), False), ((1.0, 1.0, 0.5), False), ((1e-6, 0.5, 0.5), False), ((1e-3, 0.5, 0.5), True), ((0.5, 0.5, 1.0001), False)],
)
def test_points_on_a_face_are_not_inside(spark, at, inside):
    points = spark.createDataFrame([at], "x double, y double, z double")
    tri = spark.createDataFrame(box(1), TRI).withColumnRenamed("unit_id", "mesh_id")
    assert (spatial.points_in_mesh(points, tri).count() == 1) == inside


def test_rank_sample_keeps_the_columns_of_its_points(spark):
    points = spark.createDataFrame([(7, 8, 9, 1.5, 0.5, 0.5)], "ix int, iy int, iz int, x double, y double, z double")
    ranks = spark.createDataFrame([(1, 0, 0, 4)], "ix int, iy int, iz int, rank int")
    assert spatial.rank_sample(points, ranks, (1.0, 1.0, 1.0)).collect()[0].asDict() == {"ix": 7, "iy": 8, "iz": 9, "x": 1.5, "y": 0.5, "z": 0.5, "rank": 4}


POINTS = "x double, y double, z double, _ix string, tag string"
ASKED = [(5.0, 5.0, 0.5, "u", "a"), (5.0, 5.0, 0.5, "u", "a"), (5.0, 5.0, 0.5, "u", "b"), (None, 5.0, 0.5, "u", "c"), (5.0, None, 0.5, "u", "c"), (0.0, 0.0, None, "u", "d"), (99.0, 99.0, 9.0, "u", "e")]


def test_every_point_gives_a_row_of_the_terrain(spark):
    points = spark.createDataFrame([r[:3] + r[4:] for r in ASKED] + [(10.0, 10.0, 1.0, "f"), (10.0, 10.5, 1.0, "g"), (10.5, 10.0, 1.0, "h")], "x double, y double, z double, tag string")
    dem = spark.createDataFrame([(0, 0, 10.0), (1, 0, 12.0), (0, 1, 14.0), (1, 1, 8.0), (1, 1, 8.0)], "ix int, iy int, z double")
    got = spatial.dem_sample(points, dem, 10.0).collect()
    assert sorted((r.tag, r.dem_z or 0) for r in got) == [("a", 11.0), ("a", 11.0), ("b", 11.0), ("c", 0), ("c", 0), ("d", 10.0), ("e", 0), ("f", 8.0), ("g", 0), ("h", 0)]
    assert spatial.dem_sample(points.limit(0), dem, 10.0).count() == 0 == spatial.dem_sample(points, dem.limit(0), 10.0).where("dem_z IS NOT NULL").count()


#: Nodes (0, 0), (1, 0), (0, 1), (1, 1) of a cell of 20 and a point in it as high as the terrain, but for the last bit.
LEVEL = [((100.01, 96.02000000000001, 104.51, 100.52000000000001), 25.0, 565.5), ((99.11, 95.12, 103.61, 99.62), 225.0, 169.5), ((100.88, 96.89, 105.38, 101.39), 775.0, 550.5)]


def _level_points(spark):
    """Points at 100.25, where the terrain is as high, with the terrain around them."""
    nodes = [(int(x // 20) + n % 2, int(y // 20) + n // 2, z) for zs, x, y in LEVEL for n, z in enumerate(zs)]
    points = spark.createDataFrame([(x, y, 100.25) for _, x, y in LEVEL], "x double, y double, z double")
    return spatial.dem_sample(points, spark.createDataFrame(nodes, "ix int, iy int, z double"), 20.0)


def test_heights_of_level_points_are_summed_as_in_sql(spark):
    """By column, then row, as the SQL lists the nodes: all three heights come out below 100.25, in the other order none."""
    assert [r.above for r in _level_points(spark).selectExpr("z - dem_z > 0 AS above").collect()] == [True] * 3


def test_ranks_of_level_points_are_those_of_sql(spark):
    ranks = spark.createDataFrame([(ix, iy, 2, 4) for ix in range(20) for iy in range(20)], "ix int, iy int, iz int, rank int")
    assert [r["rank"] for r in spatial.rank_sample(_level_points(spark), ranks, (40.0, 40.0, 40.0)).collect()] == [0] * 3


def test_repeated_and_null_points_in_meshes(spark):
    tri = spark.createDataFrame(box(1, size=10) + box(2, 4, 4, 0, size=2), TRI).withColumnRenamed("unit_id", "mesh_id")
    points = spark.createDataFrame([r[:3] + r[4:] for r in ASKED], "x double, y double, z double, tag string")
    got = spatial.points_in_mesh(points, tri)
    assert sorted((r.tag, r.mesh_id) for r in got.collect()) == sorted((t, m) for t in "aab" for m in (1, 2))
    bodies = tri.select("mesh_id").distinct().withColumn("gwb_id", F.col("mesh_id") * 10)
    tags = spatial.gwb_tags(points, got.join(bodies, "mesh_id")).collect()
    assert sorted((r.tag, r.gwb_first, r.gwb_max) for r in tags) == [("a", 10, 20), ("a", 10, 20), ("b", 10, 20), *[(t, 0, 0) for t in "ccde"]]
    assert spatial.points_in_mesh(points.limit(0), tri).count() == 0 == spatial.points_in_mesh(points, tri.limit(0)).count()


def test_repeated_and_null_points_by_nearest_face(spark):
    tri = spark.createDataFrame(box(1, size=10), TRI)
    asked = spark.createDataFrame([(1, *r[:3], r[4]) for r in ASKED] + [(2, 1.0, 1.0, 1.0, "z")], "unit_id int, x double, y double, z double, tag string")
    got = spatial.nearest_face(asked, tri, ["unit_id"], read="read").collect()
    assert sorted((r.tag, r.distance, r.read) for r in got)[:3] == [("a", 0.5, 12), ("a", 0.5, 12), ("b", 0.5, 12)] and sorted(r.tag for r in got) == ["a", "a", "b", "e"]


def sphere(mesh, rings, turns, radius=100.0, wobble=0.0):
    """A closed mesh of 2 turns (rings - 1) faces around (0, 0, 0), its sides outward."""
    draw = random.Random(mesh)
    at = [[(0.0, 0.0, -radius)]]
    for i in range(1, rings):
        low = math.pi * i / rings - math.pi / 2
        r = [radius * (1 + wobble * draw.random()) for _ in range(turns)]
        at.append([(r[j] * math.cos(low) * math.cos(2 * math.pi * j / turns), r[j] * math.cos(low) * math.sin(2 * math.pi * j / turns), r[j] * math.sin(low)) for j in range(turns)])
    at.append([(0.0, 0.0, radius)])
    faces = []
    for i in range(rings):
        for j in range(turns):
            a, b = at[i][j % len(at[i])], at[i][(j + 1) % len(at[i])]
            c, d = at[i + 1][j % len(at[i + 1])], at[i + 1][(j + 1) % len(at[i + 1])]
            faces += [(a, b, d)] * (i > 0) + [(a, d, c)] * (i < rings - 1)
    return [(mesh, f, *p, *q, *r) for f, (p, q, r) in enumerate(faces)]


def winding(points, faces):
    a, b, c = (np.array([f[k : k + 3] for f in faces])[None] - points[:, None] for k in (2, 5, 8))
    la, lb, lc = (np.linalg.norm(v, axis=2) for v in (a, b, c))
    top = (a * np.cross(b, c)).sum(axis=2)
    under = la * lb * lc + (a * b).sum(axis=2) * lc + (b * c).sum(axis=2) * la + (c * a).sum(axis=2) * lb
    return np.arctan2(top, under).sum(axis=1) / (2 * math.pi)


def test_points_in_rough_meshes_by_winding_numbers(spark):
    rows = [r for m in (1, 2) for r in sphere(m, 12, 17, wobble=0.8)]
    # the second mesh winds twice round its middle: an even number of faces above a point that it holds
    rows += [(2, 1000 + f, *[v * 0.4 for v in t]) for _, f, *t in sphere(2, 12, 17, wobble=0.8)]
    draw = random.Random(0)
    asked = [tuple(draw.uniform(-150, 150) for _ in range(3)) for _ in range(900)] + [(0.0, 0.0, 5.0), (0.0, 0.0, -500.0), *dict.fromkeys(r[2:5] for r in rows[17:57])]
    want = set()
    # the last of the points are corners of the first mesh, so they lie on it
    for mesh, count in ((1, 902), (2, len(asked))):
        w = winding(np.array(asked[:count]), [r for r in rows if r[0] == mesh])
        want |= {(asked[i], mesh) for i in range(count) if abs(w[i]) > 0.5}
    got = spatial.points_in_mesh(spark.createDataFrame(asked, "x double, y double, z double"), spark.createDataFrame(rows, TRI), "unit_id").collect()
    assert {((r.x, r.y, r.z), r.unit_id) for r in got} == want and len(got) == len(want)


def test_columns_hold_few_faces_of_a_mesh_of_very_many(spark):
    tri = spark.createDataFrame(sphere(1, 150, 300), TRI)
    boxes, faces = spatial.mesh_columns(tri, "unit_id")
    assert faces.count() <= 9 * tri.count()
    points = spark.range(3000).selectExpr("double(id % 60 - 30) AS x", "double(id / 60 - 25) AS y", "double(id % 7) AS z")
    near = spatial._boxed(points, boxes, "unit_id", None)
    read = near.join(faces, ["unit_id", "_cx", "_cy"]).groupBy("x", "y", "z").count().agg(F.max("count")).first()[0]
    assert read < tri.count() / 100
    assert spatial.points_in_mesh(points, tri, "unit_id").count() == 3000


def plain_distance(p, faces):
    """Distance from a point to the nearest of many triangles: the foot on the plane if inside, else on an edge."""
    best = np.inf
    a, b, c = (np.array([f[k : k + 3] for f in faces]) for k in (2, 5, 8))
    n = np.cross(b - a, c - a)
    inside = np.ones(len(a), bool)
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        t = np.clip(((p - s) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        best = min(best, np.linalg.norm(s + d * t[:, None] - p, axis=1).min())
        inside &= (np.cross(d, p - s) * n).sum(axis=1) >= 0
    height = np.abs(((p - a) * n).sum(axis=1)) / np.linalg.norm(n, axis=1)
    return min(best, height[inside].min()) if inside.any() else best


def test_nearest_of_very_many_faces_by_brute_force(spark):
    rows = sphere(1, 40, 60, wobble=0.3) + sphere(2, 3, 4)
    draw = random.Random(4)
    asked = [(draw.choice([1, 1, 2]), *[draw.choice([draw.uniform(-200, 200), draw.uniform(-1e4, 1e4), 0.0]) for _ in range(3)]) for _ in range(120)]
    got = spatial.nearest_face(spark.createDataFrame(asked, "unit_id int, x double, y double, z double"), spark.createDataFrame(rows, TRI), ["unit_id"], read="read").collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.distance == pytest.approx(plain_distance(np.array([r.x, r.y, r.z]), [f for f in rows if f[0] == r.unit_id]), rel=1e-9)
    outside = [r.read for r in got if r.unit_id == 1 and abs(r.x) + abs(r.y) + abs(r.z) > 200]
    assert sum(outside) / len(outside) < 4680 / 4


def test_counters_by_a_plain_scan(spark):
    draw = random.Random(6)
    rows = []
    for n in range(400):
        series = draw.choice(["hot", "hot", "hot", "cold", None, "one"]) if n else "single"
        rows.append((series, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=draw.randrange(300)), float(draw.randrange(50))))
    samples = spark.createDataFrame(rows, "series string, seq long, ts timestamp, value double").repartition(7)
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by.setdefault(r[0], []).append(r)
    rises = {s: [0.0] + [b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(v, v[1:])] for s, v in by.items()}
    assert {r.series: r.increase for r in metrics.counter_increase(samples).collect()} == {s: sum(d) for s, d in rises.items()}
    want = {}
    for s, v in by.items():
        for k, (_, n, t, _) in enumerate(v):
            span = [d for d, x in zip(rises[s], v) if t - datetime.timedelta(minutes=20) <= x[2] <= t]
            want[n] = sum(span) - span[0]
    got = metrics.trailing_increase(samples, 1200).collect()
    assert {r.seq: r.increase for r in got} == want and len(got) == len(rows)
    assert metrics.trailing_increase(samples.limit(0), 60).count() == 0 == metrics.counter_rate(samples.limit(0)).count()


def test_a_hot_counter_lies_in_several_tasks(spark):
    samples = spark.range(40_000).selectExpr("'hot' AS series", "id AS seq", "timestamp_millis(id * 10) AS ts", "double(id) AS value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        steps = metrics.counter_steps(samples)
        most = steps.groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most[1] > 1 and most[0] < 40_000 * 0.6
    assert metrics.counter_increase(samples).first().increase == 39_999.0


def test_copies_of_meshes_and_points_are_judged_once(spark):
    rows = box(1, size=10) + [(3, 11 - f, *t) for _, f, *t in box(3, size=10)] + box(2, 4, 4, 0, size=2) + box(5, size=10)[:11] + box(7, 4, 4, 0, size=2)
    tri = spark.createDataFrame(rows, TRI).withColumnRenamed("unit_id", "mesh_id")
    known = spatial.shapes(tri)
    assert {r.mesh_id: r.shape for r in known.collect()} == {1: 1, 3: 1, 2: 2, 7: 2, 5: 5}
    points = spark.createDataFrame([r[:3] + r[4:] for r in ASKED] * 50, "x double, y double, z double, tag string")
    closed = tri.where("mesh_id <> 5")
    assert spatial.mesh_hits(points, spatial.of_shapes(closed, known)).count() == 2  # one point, two shapes
    assert spatial.points_in_mesh(points, closed).count() == 150 * 4
    bodies = spark.createDataFrame([(1, 0), (3, 4), (2, 9), (7, 11)], "mesh_id int, gwb_id int")
    tags = spatial.mesh_tags(points, closed, bodies).collect()
    assert len(tags) == 350 and {(r.tag, r.gwb_first, r.gwb_max) for r in tags} == {("a", 9, 11), ("b", 9, 11), *[(t, 0, 0) for t in "cde"]}


def test_a_fuller_column_is_dealt_to_several_rows(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COLUMN_FACES", 2)
    test_points_in_rough_meshes_by_winding_numbers(spark)


def test_points_of_a_place_share_what_stands_above_it(spark, monkeypatch):
    """Pairs of points and faces are no rows, and a crowded bucket is dealt to several tasks."""
    monkeypatch.setattr(spatial, "BUCKET_POINTS", 20)
    rows = [r for m in (1, 2) for r in sphere(m, 12, 17, wobble=0.8)]
    asked = [(x, y, z * 1.7 - 170.35) for x, y in ((0.0, 0.0), (31.5, -12.25), (70.0, 55.0)) for z in range(200)]
    points = spark.createDataFrame(asked, "x double, y double, z double")
    got = spatial.points_in_mesh(points, spark.createDataFrame(rows, TRI), "unit_id")
    want = {(asked[i], m) for m in (1, 2) for i in np.flatnonzero(np.abs(winding(np.array(asked), [r for r in rows if r[0] == m])) > 0.5)}
    assert {((r.x, r.y, r.z), r.unit_id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "inline" not in plan and "_deal" in plan


def test_copies_of_meshes_touch_and_are_linked_once(spark):
    rows = box(1) + box(2) + box(3, 0.5, 0.5, 0.5) + box(4, 9) + box(5, 9) + box(6, 20)
    tri = spark.createDataFrame(rows, TRI).withColumnRenamed("unit_id", "mesh_id")
    assert sorted(tuple(r) for r in spatial.mesh_contacts(tri).select("m1", "m2").collect()) == [(1, 2), (1, 3), (2, 3), (4, 5)]
    links = sorted(tuple(r) for r in spatial.contact_links(tri).select("m1", "m2").collect())
    assert links == [(1, 2), (1, 3), (4, 5)]  # the copy is linked with its shape only


def test_strips_of_tunnels_keep_the_order_of_their_faces(spark):
    for n in (1, 2, 3, 7):
        got = tunnels.tunnel_faces(spark.createDataFrame([(1, 3)], "tunnel int, stations long"), n).orderBy("f").collect()
        want = []
        for s in range(2):
            strip = {}
            for i in range(n):
                if i != n - 1:
                    strip[0 if i == 0 else 2 * i - 1] = (s * n + i, (s + 1) * n + i, (s + 1) * n + i + 1)
                if i != 0:
                    strip[2 * i - 1 if i == n - 1 else 2 * i] = (s * n + i, s * n + i - 1, (s + 1) * n + i)
            strip[2 * n - 2], strip[2 * n - 1] = (s * n, (s + 1) * n - 1, (s + 1) * n), ((s + 1) * n - 1, (s + 2) * n - 1, (s + 1) * n)
            want += [(s * 2 * n + f, *strip[f]) for f in sorted(strip)]
        assert [(r.f, r.a, r.b, r.c) for r in got] == want
    plan = got and tunnels.tunnel_faces(spark.createDataFrame([(1, 3)], "tunnel int, stations long"), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_equal_parts_of_tunnels_are_laid_once(spark, sf_dir):
    from strataframe.plans.geometry import _COEF

    parts = view(spark, sf_dir, "tunnels").where("tunnel < 40")
    more = parts.unionByName(parts.withColumn("tunnel", F.col("tunnel") + 1000))
    plan = tunnels.tunnel_vertices(more, _COEF, 0.1, 24, digits=6)
    got = plan.groupBy("tunnel", "station").count()
    assert got.count() == more.count() * 10 and "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    moved = plan.where("tunnel >= 1000").withColumn("tunnel", F.col("tunnel") - 1000)
    assert moved.exceptAll(plan.where("tunnel < 1000")).isEmpty()


def test_equal_springs_are_cut_once(spark, monkeypatch):
    seen = []
    whole = groundwater.cut_components
    monkeypatch.setattr(groundwater, "cut_components", lambda tri, keys: seen.append(tri.select("spring_id").distinct().count()) or whole(tri, keys))
    springs = spark.createDataFrame([(i, 0.5, 0.5, 0.6, 1) for i in range(2, 22)] + [(1, 0.5, 0.5, 0.3, 1)], "id int, x double, y double, z double, unit_id int")
    got = groundwater.groundwater_bodies(spark.createDataFrame(box(1), TRI), springs).collect()
    assert seen == [2] and [(r.spring_id, round(r.volume, 6)) for r in got] == [(2, 0.6)]


def test_springs_of_one_height_share_a_cut(spark, monkeypatch):
    """One cut a height and group of units, also where springs differ in place or unit; apart units keep a spring each."""
    seen = []
    whole = groundwater.cut_components
    monkeypatch.setattr(groundwater, "cut_components", lambda tri, keys: seen.append(tri.select("spring_id").distinct().count()) or whole(tri, keys))
    units = box(1) + box(2, 1) + box(3, 50)
    springs = [(i, 0.1 + i / 40, 0.4, 0.6, 1 + i % 2) for i in range(5, 25)] + [(i, 50.5, i / 60, 0.6, 3) for i in range(30, 40)] + [(3, 50.5, 0.5, 0.5, 3)]
    got = groundwater.groundwater_bodies(spark.createDataFrame(units, TRI), spark.createDataFrame(springs, "id int, x double, y double, z double, unit_id int")).collect()
    assert seen == [3] and sorted((r.spring_id, r.unit_id, round(r.volume, 6)) for r in got) == [(5, 1, 0.6), (5, 2, 0.6), (30, 3, 0.6)]


def test_equal_planes_and_places_are_projected_once(spark):
    from strataframe.operators import sections as S

    draw = random.Random(9)
    corners = [(float(draw.randrange(50)), float(draw.randrange(50)), 0.0, float(draw.randrange(60, 90)), float(draw.randrange(50)), 10.0) for _ in range(3)]
    sections = spark.createDataFrame([(i, 0, *corners[i % 3]) for i in range(9)], "section_id int, seg int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")
    springs = spark.createDataFrame([(i, i % 4 * 20.0 if i else None, 30.0, i * 1.0) for i in range(40)], "id int, x double, y double, z double")
    got = S.project_springs(sections, springs, 25.0, 6)
    u, z, near = S._projected((F.col("x"), F.col("y"), F.col("z")), 25.0)
    want = S.planes(sections).crossJoin(springs).where(near).select("section_id", "seg", "id", V.tidy(u).alias("u"), V.tidy(z).alias("z"))
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert got.select("u").distinct().count() <= 12
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" in plan and plan.startswith("Project [section_id")  # nothing is rounded after the joins
