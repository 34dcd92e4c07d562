"""Groundwater bodies below springs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strataframe.operators.graph import connected_components
from strataframe.operators.meshes import cap_loops, caps, clip_walls, components, mesh_closed, mesh_volume
from strataframe.operators.spatial import face_contacts, nearest_face, triangles_touch
from strataframe.runtime import cut


def spring_units(springs: DataFrame, units: DataFrame) -> DataFrame:
    """Springs whose unit has a mesh."""
    return springs.join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def spring_units_missing(springs: DataFrame, units: DataFrame) -> DataFrame:
    """Springs that name a unit without a mesh; a strict caller treats any row as an error."""
    return springs.join(units.select("unit_id").distinct(), "unit_id", "left_anti")


def validate(springs: DataFrame, unit_tri: DataFrame) -> None:
    """Raise if a spring names an unknown unit, or the mesh of a spring's unit is not closed."""
    if not spring_units_missing(springs, unit_tri).isEmpty():
        raise ValueError("a spring names a unit without a mesh")
    used = unit_tri.join(springs.select("unit_id").distinct(), "unit_id", "left_semi")
    if not mesh_closed(used, "unit_id").where("NOT closed").isEmpty():
        raise ValueError("the mesh of a spring's unit is not closed")


def loops_around(holes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., inner, loop, area, outer)``: the loops that hold each hole's ``apex``, by cut.

    A loop holds a point where a ray from it along x crosses the loop's ``segments`` (``s`` to ``e``) an odd number of
    times.  Segments are dealt to strips of y as high as they are in the mean, two strips a segment on average, and a
    hole meets the segments of its own strip; a cut of very many loops therefore lies in many tasks.  Level
    segments cross no ray.
    """
    sx, sy, ex, ey = F.col("s.x"), F.col("s.y"), F.col("e.x"), F.col("e.y")
    px, py = F.col("apex.x"), F.col("apex.y")
    slanted = segments.where(sy != ey)
    heights = slanted.groupBy(*keys).agg(F.avg(F.abs(ey - sy)).alias("_high"))
    strip = lambda y: F.floor(y / F.col("_high"))
    strips = F.sequence(strip(F.least(sy, ey)), strip(F.greatest(sy, ey)))
    dealt = slanted.join(heights, keys).withColumn("_strip", F.explode(strips)).drop("_high")
    asked = holes.join(heights, keys).withColumn("_strip", strip(py)).drop("_high")
    crosses = ((sy > py) != (ey > py)) & (px < (ex - sx) * (py - sy) / F.nullif(ey - sy, F.lit(0.0)) + sx)
    met = asked.join(dealt, [*keys, "_strip"]).where(crosses)
    return met.groupBy(*keys, "inner", "loop", "area", "outer").agg(F.count(F.lit(1)).alias("hits")).where("hits % 2 = 1").drop("hits")


def cut_components(cut_tri: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Wall pieces and caps of meshes cut at height ``h``, each with its ``component``.

    Walls are joined by shared edges.  Two wall pieces that only the cap joins become one where a hole
    loop's smallest enclosing loop is an outer loop: a cavity then belongs to the body around it, an
    island inside a cavity does not.
    """
    walls, segments = clip_walls(cut_tri, keys)
    walls = cut(components(cut(walls), keys))
    loops = cut(cap_loops(segments, keys))
    of_face = walls.groupBy(*keys, "f").agg(F.min("component").alias("component"))
    loops = cut(loops.join(of_face, [*keys, "f"], "left"))
    rims = loops.groupBy(*keys, "loop", "area", "apex").agg(F.min("component").alias("component"))
    holes = rims.where("area < 0").select(*keys, F.col("component").alias("inner"), "apex")
    outer = loops.join(rims.select(*keys, "loop", F.col("component").alias("outer")), [*keys, "loop"]).select(*keys, "loop", "area", "s", "e", "outer")
    around = loops_around(holes, outer, keys).where("inner <> outer")
    smallest = around.groupBy(*keys, "inner").agg(F.min(F.struct(F.abs("area").alias("size"), "area", "outer")).alias("m")).where("m.area > 0").select(*keys, "inner", F.col("m.outer").alias("outer"))
    merged = cut(smallest)
    if merged.isEmpty():
        return walls, caps(loops, keys, "component")
    node = lambda c: F.xxhash64(*keys, c)
    labels = connected_components(merged.select(node("inner").alias("u"), node("outer").alias("v"))).withColumnRenamed("component", "label")
    known = walls.select(*keys, "component").distinct().withColumn("node", node("component")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    final = cut(known.withColumn("final", F.min("component").over(Window.partitionBy(*keys, "label"))).select(*keys, "component", "final"))
    rename = lambda df: df.join(final, [*keys, "component"]).drop("component").withColumnRenamed("final", "component")
    return rename(walls), rename(caps(loops, keys, "component"))


def closest_component(walls: DataFrame, springs: DataFrame) -> DataFrame:
    """``(spring_id, unit_id, id, component)``: the component of each spring's own unit that is nearest to it, in its cut ``spring_id``."""
    own = walls.join(springs.select("spring_id", "unit_id"), ["spring_id", "unit_id"], "left_semi").withColumn("face", F.struct("f", "part", "component"))
    asked = springs.select("spring_id", "unit_id", "id", "x", "y", "z")
    return nearest_face(asked, own, ["spring_id", "unit_id"], "face").select("spring_id", "unit_id", "id", F.col("f.component").alias("component"))


def _face_boxes(tri: DataFrame, *keys: str) -> DataFrame:
    return tri.select(*keys, "f", F.greatest("az", "bz", "cz").alias("top"))


def cut_contacts(touching: DataFrame, walls: DataFrame, tops: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between components of different units that touch below each spring.

    ``touching`` holds the pairs of faces ``(m1, f1, m2, f2)`` of the uncut units that share a point, found once
    for all springs.  Walls are parts of those faces, so no other faces can touch; where the cut leaves both faces
    whole they do, otherwise their pieces are tested.
    """
    pieces = walls.join(tops, ["unit_id", "f"]).withColumn("whole", F.col("top") <= F.col("h"))
    names = ["spring_id", "unit_id", "component"]
    faces = cut(pieces.select(*names, "f", "whole", "part", *[f"{p}{a}" for p in "abc" for a in "xyz"]))
    side = lambda n, p: faces.select("spring_id", *[F.col(c).alias(f"{p}_{c}") for c in faces.columns if c != "spring_id"]).withColumnsRenamed({f"{p}_unit_id": f"m{n}", f"{p}_f": f"f{n}"})
    pairs = touching.join(side(1, "p"), ["m1", "f1"]).join(side(2, "q"), ["spring_id", "m2", "f2"])
    met = pairs.where("p_whole AND q_whole").unionByName(pairs.where("NOT (p_whole AND q_whole)").where(triangles_touch("p_", "q_")))
    node = lambda n, p: F.xxhash64("spring_id", f"m{n}", f"{p}_component")
    return met.select(node(1, "p").alias("u"), node(2, "q").alias("v")).distinct()


def groundwater_bodies(unit_tri: DataFrame, springs: DataFrame, strict: bool = True) -> DataFrame:
    """``(spring_id, unit_id, component, volume)`` of every part of the body below each spring."""
    return mesh_volume(groundwater_faces(unit_tri, springs, strict), "spring_id", "unit_id", "component")


def groundwater_faces(unit_tri: DataFrame, springs: DataFrame, strict: bool = True) -> DataFrame:
    """``(spring_id, unit_id, component, f, part, ax..cz)``: the closed meshes of the body below each spring.

    Units are cut at the spring's height; the body is every component that the spring's nearest component
    reaches by touching.  From the highest spring down (ties by id), a spring whose nearest component
    touches a body that is already kept gives none.

    Only units that the uncut unit of a spring reaches by touching are cut for it.  A body at a height holds
    whatever touches it there, so a lower spring touches it just where a face of its nearest component belongs
    to it; and what it would suppress lies in the higher body as well.  A spring is kept, therefore, if no
    higher body holds that face: one maximum per face, no pairs of springs.  Units are expected not to hold
    each other, as rock volumes do not.

    Springs of one group of units and one height share their cut, named by the first of them, and of those of one
    body in it the first alone can be kept; so work is in proportion to heights and not to springs.
    """
    if strict:
        validate(springs, unit_tri)
    # of equal springs the first alone can be kept, and it stands for all of them
    known = spring_units(springs, unit_tri).groupBy("unit_id", "x", "y", "z").agg(F.min("id").alias("id"))
    touching = cut(face_contacts(unit_tri, "unit_id"))
    lows = unit_tri.groupBy("unit_id").agg(F.min(F.least("az", "bz", "cz")).alias("low"))
    groups = connected_components(touching, "m1", "m2").withColumnRenamed("node", "unit_id")
    lows = cut(lows.join(groups, "unit_id", "left").select("unit_id", "low", F.coalesce("component", "unit_id").alias("grp")))
    keys = ["spring_id", "unit_id"]
    known = cut(known.join(lows.select("unit_id", "grp"), "unit_id"))
    cuts = cut(known.groupBy("grp", F.col("z").alias("h")).agg(F.min("id").alias("spring_id")))
    known = known.join(cuts.withColumnRenamed("h", "z"), ["grp", "z"])
    chosen = cut(cuts.join(lows, "grp").where("low < h").select(*keys, "h"))
    walls, lids = cut_components(chosen.join(unit_tri, "unit_id"), keys)
    walls, lids = cut(walls), cut(lids)
    nearest = cut(closest_component(walls, known))

    node = F.xxhash64("spring_id", "unit_id", "component").alias("node")
    heights = cuts.select("spring_id", "h")
    links = cut_contacts(touching, walls.join(heights, "spring_id"), _face_boxes(unit_tri, "unit_id"))
    labels = connected_components(links).withColumnRenamed("component", "label")
    parts = walls.select(*keys, "component").distinct().withColumn("node", node).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    seeds = nearest.withColumn("node", node).join(parts.select("node", "label"), "node")
    first_of = seeds.groupBy("spring_id", "label").agg(F.min(F.struct("id", "unit_id", "component")).alias("s"))
    init = cut(first_of.select("spring_id", "label", "s.*"))
    bodies = cut(parts.join(init.select("spring_id", "label", "id"), ["spring_id", "label"]).select(*keys, "component", "id"))

    # one face of each spring's nearest component, and the highest spring whose body holds it
    mine = walls.join(init.drop("label"), [*keys, "component"]).groupBy("id", "unit_id").agg(F.min("f").alias("f"))
    of_bodies = walls.select(*keys, "component", "f").distinct().join(bodies, [*keys, "component"])
    asked_faces = mine.select("unit_id", "f").distinct()
    holders = of_bodies.join(asked_faces, ["unit_id", "f"]).join(heights, "spring_id")
    first = holders.groupBy("unit_id", "f").agg(F.max(F.struct("h", (-F.col("id")).alias("low"))).alias("m"))
    kept = cut(mine.join(first, ["unit_id", "f"]).where("id = -m.low").select("id"))

    of_body = bodies.join(kept, "id", "left_semi")
    shown = walls.unionByName(lids)
    return shown.join(of_body, [*keys, "component"]).withColumn("spring_id", F.col("id")).select(*shown.columns)
