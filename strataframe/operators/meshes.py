"""Triangle meshes as rows: measures, closedness, cuts, components and extracted surfaces."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.functions.vector import cross, dot, let, vec
from strataframe.operators.graph import connected_components
from strataframe.operators.spatial import ranked
from strataframe.runtime import cut, join_by_key

_CORNERS = [f"{p}{a}" for p in "abc" for a in "xyz"]


def mesh_volume(tri: DataFrame, *keys: str) -> DataFrame:
    """Signed volume: a sixth of the sum of the corner determinants; positive where normals point outward."""
    return tri.groupBy(*keys).agg((F.sum(dot(vec("ax", "ay", "az"), cross(vec("bx", "by", "bz"), vec("cx", "cy", "cz")))) / 6).alias("volume"))


def _edges(tri: DataFrame, *keep: str) -> DataFrame:
    point = {p: F.struct(*[F.col(f"{p}{a}").alias(a) for a in "xyz"]) for p in "abc"}
    pair = lambda p, q: F.struct(F.least(point[p], point[q]).alias("s"), F.greatest(point[p], point[q]).alias("e"))
    return tri.select(*keep, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("edge"))


def mesh_closed(tri: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Whether every edge of a mesh has exactly two faces."""
    counted = _edges(tri, key).groupBy(key, "edge").count()
    return counted.groupBy(key).agg(F.bool_and(F.col("count") == 2).alias("closed"))


def mesh_validity(faces: DataFrame, key: str = "mesh_id", face: str = "face") -> DataFrame:
    """Per mesh: face count and whether it is a non-empty triangle mesh."""
    return faces.groupBy(key).agg(F.count(face).alias("faces"), (F.bool_and(F.size(face) == 3) & (F.count(face) > 0)).alias("valid"))


def mesh_sizes(tri: DataFrame, *keys: str) -> DataFrame:
    """Faces and distinct vertices, as in a mesh file's header."""
    corners = tri.select(*keys, F.explode(F.array(*[F.struct(*[F.col(f"{p}{a}").alias(a) for a in "xyz"]) for p in "abc"])).alias("v"))
    faces = tri.groupBy(*keys).agg(F.count(F.lit(1)).alias("faces"))
    return faces.join(corners.groupBy(*keys).agg(F.count_distinct("v").alias("vertices")), list(keys))


def welded(tri: DataFrame, key: str = "mesh_id") -> tuple[DataFrame, DataFrame]:
    """Vertices ``(key, v, x, y, z)`` and faces ``(key, f, a, b, c)`` of bare triangles, as ``write_off`` takes them.

    Equal corners of a mesh are one vertex.  Vertices and faces are numbered from 0 in the order of their coordinates,
    by the counts of range partitions, so a mesh may lie in many tasks; equal faces stay faces of their own.
    """

    def dense(rows: DataFrame, number: str, *order: str) -> DataFrame:
        placed = ranked(rows, key, *order)
        first = placed.groupBy(key).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        met = join_by_key(placed, cut(first), key, "_n", "pos")
        return met.select(*rows.columns, (F.col("pos") - F.col("_first")).cast("int").alias(number))

    faces = cut(dense(tri.select(key, *_CORNERS), "f", *_CORNERS))
    corners = faces.select(key, "f", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), *[F.col(f"{p}{a}").alias(a) for a in "xyz"]) for p in "abc"])).alias("c")).select(key, "f", "c.*")
    vertices = cut(dense(corners.select(key, *"xyz").distinct(), "v", *"xyz"))
    named = corners.join(vertices, [key, *"xyz"]).groupBy(key, "f").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(p) for p in "abc"])
    return vertices.select(key, "v", *"xyz"), named


def translate_mesh(tri: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    move = dict(zip("xyz", (dx, dy, dz), strict=True))
    return tri.withColumns({c: F.col(c) + move[c[1]] for c in _CORNERS})


def bbox_close(a: str, b: str, tolerance: float = 0.02) -> Column:
    """All six bounds of two boxes (columns prefixed) within a share of the first box's bounds."""
    out = F.lit(True)
    for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"):
        out = out & (F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= F.abs(F.col(f"{a}{c}")) * tolerance)
    return out


def _point(p: str) -> Column:
    return F.struct(*[F.col(f"{p}{a}").cast("double").alias(a) for a in "xyz"])


def _crossing(p: Column, q: Column, h: Column) -> Column:
    """Where edge p-q meets the plane; the ends are put in one order first, so both faces get the same bits."""

    def between(g: Column) -> Column:
        s, e = g["s"], g["e"]
        t = (h - s["z"]) / F.nullif(e["z"] - s["z"], F.lit(0.0))
        return let(t, lambda r: F.struct((s["x"] + r * (e["x"] - s["x"])).alias("x"), (s["y"] + r * (e["y"] - s["y"])).alias("y"), h.alias("z")))

    made = let(F.struct(F.least(p, q).alias("s"), F.greatest(p, q).alias("e")), between)
    return F.when(p["z"] == h, p).when(q["z"] == h, q).otherwise(made)


def clip_walls(tri: DataFrame, keys: list[str], height: str = "h") -> tuple[DataFrame, DataFrame]:
    """Cut every triangle of ``tri (keys..., f, ax..cz, h)`` at its mesh's height.

    Returns wall pieces ``(keys..., f, part, ax..cz)`` at or below it and the cut segments ``(keys..., f,
    s, e)``, directed as a cap over the walls needs them.  Meshes that do not begin below the height are
    left out whole.
    """
    low = tri.groupBy(*keys).agg(F.min(F.least("az", "bz", "cz")).alias("_low"), F.first(height).alias("_h")).where("_low < _h").select(*keys)
    work = tri.join(low, keys, "left_semi").select(*keys, "f", F.struct(_point("a").alias("a"), _point("b").alias("b"), _point("c").alias("c"), F.col(height).cast("double").alias("h")).alias("t"))

    def sided(t: Column) -> Column:
        """The number of corners above, and the corners turned so that the odd one out comes first."""
        up = [(t[p]["z"] > t["h"]).cast("int") for p in "abc"]

        def turned(n: Column) -> Column:
            odd = [u == F.when(n == 1, 1).otherwise(0) for u in up]
            pick = lambda i: F.when(odd[0], t["abc"[i]]).when(odd[1], t["bca"[i]]).otherwise(t["cab"[i]])
            return let(F.struct(n.alias("n"), t.alias("t"), pick(0).alias("p"), pick(1).alias("q"), pick(2).alias("r")), crossed)

        return let(up[0] + up[1] + up[2], turned)

    tri3 = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    seg = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def crossed(g: Column) -> Column:
        """Pieces at or below the plane and, where it is crossed, the cap's segment."""
        n, p, q, r, t = g["n"], g["p"], g["q"], g["r"], g["t"]

        def cut_up(x: Column) -> Column:
            pieces = F.when(n == 0, F.array(tri3(t["a"], t["b"], t["c"]))).when(n == 1, F.array(tri3(x["pq"], q, r), tri3(x["pq"], r, x["pr"]))).when(n == 2, F.array(tri3(p, x["pq"], x["pr"])))
            side = F.when(n == 1, seg(x["pq"], x["pr"])).when(n == 2, seg(x["pr"], x["pq"]))
            return F.struct(pieces.alias("pieces"), side.alias("side"))

        return let(F.struct(F.when(n.isin(1, 2), _crossing(p, q, t["h"])).alias("pq"), F.when(n.isin(1, 2), _crossing(p, r, t["h"])).alias("pr")), cut_up)

    work = cut(work.select(*keys, "f", let(F.col("t"), sided).alias("g")))
    flat = [F.col(f"t.{p}.{a}").alias(f"{p}{a}") for p in "abc" for a in "xyz"]
    walls = work.select(*keys, "f", F.posexplode("g.pieces").alias("part", "t")).where("t.a <> t.b AND t.b <> t.c AND t.c <> t.a").select(*keys, "f", "part", *flat)
    segments = work.where("g.side IS NOT NULL").select(*keys, "f", "g.side.s", "g.side.e").where("s <> e")
    return walls, segments


def _id(keys: list[str], *more) -> Column:
    return F.xxhash64(*keys, *more)


def _point_id(keys: list[str], p: str) -> Column:
    return _id(keys, f"{p}.x", f"{p}.y", F.lit("point"))


def face_links(tri: DataFrame, keys: list[str]) -> DataFrame:
    """Links ``(u, v)`` between faces that share an edge, each to the smallest face of the edge; faces are 64-bit names."""
    named = tri.withColumn("node", _id(keys, "f", "part") if "part" in tri.columns else _id(keys, "f"))
    edges = _edges(named, *keys, "node")
    low = edges.groupBy(*keys, "edge").agg(F.min("node").alias("low"), F.collect_set("node").alias("nodes"))
    return low.select(F.col("low").alias("v"), F.explode("nodes").alias("u"))


def components(tri: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``component``: the smallest face number among the faces joined by shared edges."""
    node = _id(keys, "f", "part") if "part" in tri.columns else _id(keys, "f")
    labels = connected_components(face_links(tri, keys))
    named = tri.withColumn("node", node).join(labels, "node", "left").withColumn("_l", F.coalesce("component", "node")).drop("component", "node")
    first = named.groupBy(*keys, "_l").agg(F.min("f").alias("component"))
    return named.join(first, [*keys, "_l"]).drop("_l")


def cap_loops(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with ``loop``, the label of the closed line that they belong to, and its signed ``area`` in x, y."""
    labels = connected_components(segments.select(_point_id(keys, "s").alias("u"), _point_id(keys, "e").alias("v")))
    named = segments.withColumn("node", _point_id(keys, "s")).join(labels, "node").withColumnRenamed("component", "loop").drop("node")
    area = named.groupBy(*keys, "loop").agg((F.sum(F.col("s.x") * F.col("e.y") - F.col("e.x") * F.col("s.y")) / 2).alias("area"), F.min("s").alias("apex"))
    return named.join(area, [*keys, "loop"])


def caps(loops: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Cap triangles: a fan over each loop from one of its own points; folds cancel by sign.

    Flat triangles stay where the loop runs straight through the apex, so that every edge keeps its pair.
    """
    t = {"a": "apex", "b": "s", "c": "e"}
    flat = [F.col(f"{v}.{a}").alias(f"{p}{a}") for p, v in t.items() for a in "xyz"]
    return loops.where("apex <> s AND apex <> e").select(*keys, *more, "f", F.lit(-1).alias("part"), *flat)


def clip_below(tri: DataFrame, keys: list[str], height: str = "h") -> DataFrame:
    """Closed meshes ``(keys..., f, part, ax..cz)`` cut at their height; cap triangles have part -1."""
    walls, segments = clip_walls(tri, keys, height)
    return walls.unionByName(caps(cap_loops(segments, keys), keys))


# --- surfaces of rank volumes -------------------------------------------------------------------

def _tetrahedra() -> list[tuple[int, int, int, int]]:
    """Six tetrahedra about the diagonal 0-7 of a cell whose corner k has bits x, y, z."""
    out = []
    for first in (1, 2, 4):
        for second in (1, 2, 4):
            if first != second:
                out.append((0, first, first | second, 7))
    return out


def _halves(k: int) -> tuple[int, int, int]:
    return (2 * (k & 1), 2 * (k >> 1 & 1), 2 * (k >> 2 & 1))


def case_table() -> list[tuple[int, list[list[int]]]]:
    """For each of the 254 mixed corner masks its triangles, in half steps from the cell's low corner.

    Every tetrahedron with corners on both sides adds one or two triangles through its edge middles,
    turned so that the normal points from the inside to the outside.
    """

    def middle(a: int, b: int) -> tuple[int, ...]:
        return tuple((p + q) // 2 for p, q in zip(_halves(a), _halves(b), strict=True))

    def facing(t: list[tuple], inside: list[int], outside: list[int]) -> list[tuple]:
        u, v = [[t[i][k] - t[0][k] for k in range(3)] for i in (1, 2)]
        n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        way = [sum(_halves(c)[k] for c in outside) * len(inside) - sum(_halves(c)[k] for c in inside) * len(outside) for k in range(3)]
        return t if sum(p * q for p, q in zip(n, way, strict=True)) > 0 else [t[0], t[2], t[1]]

    table = []
    for mask in range(1, 255):
        rows: list[list[int]] = []
        for tet in _tetrahedra():
            inside, outside = [c for c in tet if mask >> c & 1], [c for c in tet if not mask >> c & 1]
            if not inside or not outside:
                continue
            if len(inside) == 2:
                a, b = inside
                c, d = outside
                quad = [middle(a, c), middle(a, d), middle(b, d), middle(b, c)]
                faces = [[quad[0], quad[1], quad[2]], [quad[0], quad[2], quad[3]]]
            else:
                one, three = (inside, outside) if len(inside) == 1 else (outside, inside)
                faces = [[middle(one[0], c) for c in three]]
            rows += [[x for p in facing(t, inside, outside) for x in p] for t in faces]
        table.append((mask, rows))
    return table


def surface_cells(ranks: DataFrame) -> DataFrame:
    """Cells ``(rank, cx, cy, cz, mask)`` with corners both inside and outside each rank; rank 0 is sky.

    Every voxel tells its eight cells which corner it fills; the margin around the grid needs no rows.
    """
    corner = lambda k: F.struct((F.col("ix") - (k & 1)).alias("cx"), (F.col("iy") - (k >> 1 & 1)).alias("cy"), (F.col("iz") - (k >> 2 & 1)).alias("cz"), F.lit(1 << k).alias("bit"))
    told = ranks.where("rank <> 0").select("rank", F.explode(F.array(*[corner(k) for k in range(8)])).alias("c"))
    return told.groupBy("rank", "c.cx", "c.cy", "c.cz").agg(F.bit_or("c.bit").alias("mask")).where("mask <> 255")


def extract_surfaces(spark: SparkSession, ranks: DataFrame, steps: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """One closed, outward surface per rank as ``(rank, f, ax..cz)``; the case table (254 rows) is broadcast."""
    table = spark.createDataFrame(case_table(), "mask int, tris array<array<int>>")
    cells = surface_cells(ranks).join(F.broadcast(table), "mask")
    base = dict(zip("xyz", (F.col("cx"), F.col("cy"), F.col("cz")), strict=True))
    cut = cells.select("rank", "cx", "cy", "cz", F.posexplode("tris").alias("k", "t"))
    flat = [((base[a] + F.get("t", F.lit(3 * p + i)) / 2) * steps[i] + origin[i]).alias(f"{'abc'[p]}{a}") for p in range(3) for i, a in enumerate("xyz")]
    return cut.select("rank", _id(["rank", "cx", "cy", "cz"], "k").alias("f"), *flat)


