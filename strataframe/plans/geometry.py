"""Registered queries over grids, sections, faults, tunnels and meshes, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.functions import vector as V
from strataframe.operators import assembly, graph, grids, groundwater, meshes, sections as S, spatial, tunnels as T
from strataframe.plans.views import oracle, view
from strataframe.runtime import cut
from strataframe.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its oracle if SQL has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _r(*names: str) -> list:
    return [V.tidy(F.col(n)).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 AS {n}" for n in names)


_EXT = """x AS (SELECT *, round_even(xmax, 0) - round_even(xmin, 0) AS x_extent, round_even(ymax, 0) - round_even(ymin, 0) AS y_extent,
  round_even(zmax, 0) - round_even(zmin, 0) AS height FROM sections),
w AS (SELECT *, sqrt(x_extent * x_extent + y_extent * y_extent) AS width FROM x),
g AS (SELECT *, CASE WHEN width = 0 OR height = 0 THEN resolution WHEN width > height THEN resolution ELSE CAST(round_even(width * (resolution / height), 0) AS INT) END AS n,
  CASE WHEN width = 0 OR height = 0 THEN resolution WHEN width > height THEN CAST(round_even(height * (resolution / width), 0) AS INT) ELSE resolution END AS m FROM w)"""
_LIN = "CASE WHEN {i} = {n} - 1 AND {n} > 1 THEN {b} ELSE {a} + {i} * (({b} - {a}) / greatest({n} - 1, 1)) END"
_GRID = f"""{_EXT},
s AS (SELECT *, CASE WHEN xmin <> xmax THEN {_LIN.format(i='i', n='n', a='xmin', b='xmax')} ELSE xmin END AS px
      FROM g, LATERAL (SELECT unnest(range(n)) AS i) AS a, LATERAL (SELECT unnest(range(m)) AS j) AS b),
grid AS (SELECT section_id, seg, CAST(i AS INT) AS i, CAST(j AS INT) AS j, px AS x,
      CASE WHEN xmin <> xmax THEN (ymax - ymin) / nullif(xmax - xmin, 0e0) * (px - xmin) + ymin ELSE {_LIN.format(i='i', n='n', a='ymin', b='ymax')} END AS y,
      {_LIN.format(i='j', n='m', a='zmin', b='zmax')} AS z FROM s)"""


@query(f"WITH {_EXT} SELECT section_id, seg, x_extent, y_extent, height, {_rs('width')} FROM w")
def section_extents(spark, sf):
    return grids.section_extents(view(spark, sf, "sections")).select("section_id", "seg", "x_extent", "y_extent", "height", *_r("width"))


@query(f"WITH {_EXT} SELECT section_id, seg, CAST(n AS INT) AS n, CAST(m AS INT) AS m FROM g")
def grid_resolution(spark, sf):
    return grids.grid_resolutions(view(spark, sf, "sections")).select("section_id", "seg", "n", "m")


@query(f"WITH {_GRID} SELECT section_id, seg, i, j, {_rs('x', 'y', 'z')} FROM grid")
def slice_grid(spark, sf):
    return grids.vertical_slice_grid(view(spark, sf, "sections")).select("section_id", "seg", "i", "j", *_r("x", "y", "z"))


def _bilinear(points: str, keys: str, cell: str = "20e0") -> str:
    named = ", ".join(f"p2.{k.strip()}" for k in keys.split(","))
    return f"""p0 AS (SELECT *, floor(x / {cell}) AS fx, floor(y / {cell}) AS fy FROM {points}),
p1 AS (SELECT *, x / {cell} - fx AS tx, y / {cell} - fy AS ty FROM p0),
p2 AS (SELECT p1.*, CAST(fx + a AS INT) AS nx, CAST(fy + b AS INT) AS ny, (CASE WHEN a = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN b = 1 THEN ty ELSE 1 - ty END) AS part
  FROM p1 CROSS JOIN (VALUES (0), (1)) AS q(a) CROSS JOIN (VALUES (0), (1)) AS r(b)),
sampled AS (SELECT {named}, CASE WHEN count(d.z) = count(*) THEN sum(part * d.z) END AS dem_z
  FROM (SELECT * FROM p2 WHERE part <> 0 OR part IS NULL) AS p2 LEFT JOIN dem d ON d.ix = nx AND d.iy = ny GROUP BY {named})"""


_MAP = """m AS (SELECT k AS grid_id, (k * 41) % 300 * 1e0 AS xmin, 5e0 AS ymin, (k * 41) % 300 + 400.5e0 AS xmax, 5e0 + k % 25 * 2 AS ymax, 20 AS n, 10 AS m FROM site)"""


def _map_boxes(spark, sf):
    k = F.col("k")
    x = (k * 41) % 300
    corners = {"xmin": x.cast("double"), "ymin": F.lit(5.0), "xmax": x + 400.5, "ymax": k % 25 * 2 + 5.0, "n": F.lit(20), "m": F.lit(10)}
    return view(spark, sf, "site").select(k.alias("grid_id"), *[c.alias(a) for a, c in corners.items()])


@query(f"""WITH {_MAP}, mp AS (SELECT grid_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_LIN.format(i='i', n='n', a='xmin', b='xmax')} AS x, {_LIN.format(i='j', n='m', a='ymin', b='ymax')} AS y
  FROM m, LATERAL (SELECT unnest(range(n)) AS i) AS a, LATERAL (SELECT unnest(range(m)) AS j) AS b), {_bilinear('mp', 'grid_id, i, j, x, y')}
  SELECT grid_id, i, j, {_rs('x', 'y', 'dem_z')} FROM sampled""")
def map_grid(spark, sf):
    return spatial.dem_sample(grids.map_grid(_map_boxes(spark, sf)), view(spark, sf, "dem"), 20.0).select("grid_id", "i", "j", *_r("x", "y", "dem_z"))


def _voxel_boxes(spark, sf):
    k = F.col("k")
    box = {f"{a}min": F.lit(0.0) for a in "xyz"} | {"xmax": F.lit(1000.0), "ymax": F.lit(1000.0), "zmax": F.lit(960.0)}
    return view(spark, sf, "site").select(k.alias("grid_id"), *[c.alias(a) for a, c in box.items()], (k % 5 + 8).alias("nx"), (k % 3 + 7).alias("ny"), (k % 4 + 5).alias("nz"))


_VOX = """v AS (SELECT k AS grid_id, k % 5 + 8 AS nx, k % 3 + 7 AS ny, k % 4 + 5 AS nz FROM site),
voxels AS (SELECT grid_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, (ix + 0.5e0) * (1000e0 / nx) AS x, (iy + 0.5e0) * (1000e0 / ny) AS y, (iz + 0.5e0) * (960e0 / nz) AS z
 FROM v, LATERAL (SELECT unnest(range(nx)) AS ix) AS a, LATERAL (SELECT unnest(range(ny)) AS iy) AS b, LATERAL (SELECT unnest(range(nz)) AS iz) AS c)"""


@query(f"WITH {_VOX} SELECT grid_id, ix, iy, iz, {_rs('x', 'y', 'z')} FROM voxels")
def voxel_grid(spark, sf):
    return grids.voxel_center_grid(_voxel_boxes(spark, sf)).select("grid_id", "ix", "iy", "iz", *_r("x", "y", "z"))


@query(f"WITH {_VOX} SELECT grid_id, CAST(nx * ny * nz AS BIGINT) AS cells FROM v")
def grid_cells(spark, sf):
    boxes = _voxel_boxes(spark, sf)
    return boxes.select("grid_id", grids.grid_cells(*[F.col(f"n{a}") for a in "xyz"]).alias("cells"))


@query(f"""WITH {_VOX} SELECT grid_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, round(ix * (1000e0 / (nx - 1)), 6) + 0e0 AS x, round(iy * (1000e0 / (ny - 1)), 6) + 0e0 AS y, round(iz * (960e0 / (nz - 1)), 6) + 0e0 AS z
 FROM v, LATERAL (SELECT unnest(range(nx)) AS ix) AS a, LATERAL (SELECT unnest(range(ny)) AS iy) AS b, LATERAL (SELECT unnest(range(nz)) AS iz) AS c""")
def lattice_grid(spark, sf):
    return grids.lattice_grid(_voxel_boxes(spark, sf)).select("grid_id", "ix", "iy", "iz", *_r("x", "y", "z"))


@query("""WITH m AS (SELECT mesh_id, xmin + mesh_id % 9 AS x2, ymin AS y2, zmin - mesh_id % 5 AS z2, xmax + mesh_id % 9 AS x3, ymax AS y3, zmax - mesh_id % 5 AS z3 FROM boxes)
SELECT mesh_id, abs(xmin - x2) <= abs(xmin) * 0.02e0 AND abs(ymin - y2) <= abs(ymin) * 0.02e0 AND abs(zmin - z2) <= abs(zmin) * 0.02e0 AND abs(xmax - x3) <= abs(xmax) * 0.02e0
 AND abs(ymax - y3) <= abs(ymax) * 0.02e0 AND abs(zmax - z3) <= abs(zmax) * 0.02e0 AS near FROM boxes JOIN m USING (mesh_id)""")
def bbox_close(spark, sf):
    """Whether each body's bounds stay within the tolerance when the body is moved."""
    tri = view(spark, sf, "tri")
    moved = tri.withColumns({f"{p}x": F.col(f"{p}x") + F.col("mesh_id") % 9 for p in "abc"} | {f"{p}z": F.col(f"{p}z") - F.col("mesh_id") % 5 for p in "abc"})
    named = lambda t, s: spatial.mesh_bbox(t).select("mesh_id", *[F.col(f"{a}{e}").alias(f"{s}{a}{e}") for a in "xyz" for e in ("min", "max")])
    return named(tri, "p_").join(named(moved, "q_"), "mesh_id").select("mesh_id", meshes.bbox_close("p_", "q_").alias("near"))


@query("SELECT s_suppkey AS id, regexp_replace('/' || s_name, '^/(.*)$', '\\1') AS container, regexp_full_match(s_name, 'Supplier#0+[1-4].*') AS matched, CAST(regexp_extract('mesh_' || s_suppkey || '_a.off', '([0-9]+)', 1) AS INT) AS gwb_id FROM supplier")
def labels_and_names(spark, sf):
    """Container names without their slash, labels that match a whole pattern, bodies named by their files."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    file = F.concat(F.lit("mesh_"), F.col("s_suppkey").cast("string"), F.lit("_a.off"))
    return s.select(F.col("s_suppkey").alias("id"), V.relabel_container(F.concat(F.lit("/"), "s_name")).alias("container"), V.label_match(F.col("s_name"), "Supplier#0+[1-4].*").alias("matched"), V.gwb_id_from_name(file).alias("gwb_id"))


@query("""WITH v AS (SELECT k AS grid_id, k * 10 + 30 AS nx, k % 5 + 8 AS ny FROM site)
SELECT grid_id, CAST(floor(greatest(10e0, nx / 10)) AS INT) AS nx, CAST(floor(greatest(10e0, ny / 10)) AS INT) AS ny FROM v""")
def coarse_shape(spark, sf):
    n = view(spark, sf, "site").select(F.col("k").alias("grid_id"))
    return n.select("grid_id", grids.coarse_shape(F.col("grid_id") * 10 + 30).alias("nx"), grids.coarse_shape(F.col("grid_id") % 5 + 8).alias("ny"))


@query("""SELECT tunnel, segment, CAST(k AS INT) AS k, round(t0 + k * 0.1e0, 6) + 0e0 AS t FROM (SELECT *, CASE WHEN segment = 0 THEN 0.25e0 ELSE 0e0 END AS t0 FROM tunnels) AS q,
  LATERAL (SELECT unnest(range(CAST(ceil((1e0 - t0) / 0.1e0) AS INT))) AS k) AS g""")
def tunnel_stations(spark, sf):
    return grids.tunnel_stations(view(spark, sf, "tunnels"), 0.1, first=0, t_first=0.25).select("tunnel", "segment", "k", *_r("t"))


_COEF = {"x": ["fx0", "fx1"], "y": ["fy0", "fy1", "fy2"], "z": ["fz0", "fz1"]}
_PATH = """st AS (SELECT tunnel, segment, shape, radius, width, height, CAST(k AS INT) AS k, k * 0.1e0 AS t, fx0, fx1, fy0, fy1, fy2, fz0, fz1 FROM tunnels, LATERAL (SELECT unnest(range(10)) AS k) AS g),
path AS (SELECT *, fx1 * t + fx0 AS bx, fx1 AS tx, (fy2 * t + fy1) * t + fy0 AS by_, fy2 * 2 * t + fy1 AS ty, fz1 * t + fz0 AS bz, fz1 AS tz FROM st)"""


@query(f"WITH {_PATH} SELECT tunnel, segment, k, {_rs('bx', 'by_', 'bz', 'tx', 'ty', 'tz')} FROM path")
def tunnel_path(spark, sf):
    stations = grids.tunnel_stations(view(spark, sf, "tunnels"), 0.1)
    return T.tunnel_path(stations, _COEF).select("tunnel", "segment", "k", *_r("bx", "by_", "bz", "tx", "ty", "tz"))


_N = 24
_PI2 = "1.5707963267948966e0"
_CIRCLE = f"""circle AS (SELECT tunnel, CAST(v AS INT) AS v, -(sin(({_N} - 1 - v) * (2 * 3.141592653589793e0) / {_N}) * radius + radius) AS u, -(cos(({_N} - 1 - v) * (2 * 3.141592653589793e0) / {_N}) * radius) AS w
  FROM (SELECT DISTINCT tunnel, radius FROM tunnels WHERE shape = 'Circle') AS q, range({_N}) AS g(v))"""
_RECT = f"""r0 AS (SELECT tunnel, v, width AS w, height AS h, (2 * width + 2 * height) * v / {_N} AS d FROM (SELECT DISTINCT tunnel, width, height FROM tunnels WHERE shape = 'Rectangle') AS q, range({_N}) AS g(v)),
r1 AS (SELECT *, CASE WHEN d < h THEN 0 WHEN d < h + w THEN 1 WHEN d < 2 * h + w THEN 2 ELSE 3 END AS side FROM r0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY tunnel, side ORDER BY v) = 1 AND len(list(side) OVER (PARTITION BY tunnel ORDER BY v)) >= 0
  AND (SELECT count(DISTINCT x.side) FROM r1 x WHERE x.tunnel = r1.tunnel AND x.side <= r1.side) = side + 1 AS opens FROM r1),
rectangle AS (SELECT tunnel, CAST(v AS INT) AS v, CASE side WHEN 0 THEN CASE WHEN opens THEN 0e0 ELSE -d END WHEN 1 THEN -h WHEN 2 THEN CASE WHEN opens THEN -h ELSE -(2 * h + w - d) END ELSE 0e0 END AS u,
  CASE side WHEN 0 THEN w / 2 WHEN 1 THEN CASE WHEN opens THEN w / 2 ELSE -(d - h - w / 2) END WHEN 2 THEN -w / 2 ELSE CASE WHEN opens THEN -w / 2 ELSE -(2 * h + 1.5e0 * w - d) END END AS w FROM r2)"""
_ELL = f"""e0 AS (SELECT DISTINCT tunnel, width AS w, height AS h FROM tunnels WHERE shape = 'Elliptic'),
e1 AS (SELECT tunnel, w, h, 2 * sum(sqrt(w / 2 * w / 2 * cos(i * ({_PI2} / 400)) * cos(i * ({_PI2} / 400)) + h * h * sin(i * ({_PI2} / 400)) * sin(i * ({_PI2} / 400))) * CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({_PI2} / 400 / 3) AS arc
  FROM e0, range(401) AS g(i) GROUP BY tunnel, w, h),
e2 AS (SELECT *, CAST(floor(arc * {_N} / (w + arc)) AS INT) AS nc, {_N} - CAST(floor(arc * {_N} / (w + arc)) AS INT) AS ns FROM e1),
e3 AS (SELECT *, {_LIN.format(i='(v - ns)', n='nc', a='-' + _PI2, b=_PI2)} AS t FROM e2, range({_N}) AS g(v)),
elliptic AS (SELECT tunnel, CAST(v AS INT) AS v, CASE WHEN v < ns THEN 0e0 ELSE -h * cos(t) END AS u, CASE WHEN v < ns THEN w / 2 - w * v / ns ELSE -(w / 2) * sin(t) END AS w FROM e3)"""


def _ring(spark, sf, shape):
    one = view(spark, sf, "tunnels").where(F.col("shape") == shape).select("tunnel", "shape", "radius", "width", "height").distinct()
    return T.ring_rows(one, _N).select("tunnel", "v", *_r("u", "w"))


@query(f"WITH {_CIRCLE} SELECT tunnel, v, {_rs('u', 'w')} FROM circle")
def ring_circle(spark, sf):
    return _ring(spark, sf, "Circle")


@query(f"WITH {_RECT} SELECT tunnel, v, {_rs('u', 'w')} FROM rectangle")
def ring_rectangle(spark, sf):
    return _ring(spark, sf, "Rectangle")


@query(f"WITH {_ELL} SELECT tunnel, v, {_rs('u', 'w')} FROM elliptic")
def ring_elliptic(spark, sf):
    return _ring(spark, sf, "Elliptic")


@query(f"""WITH {_PATH}, {_CIRCLE}, {_RECT}, {_ELL}, ring AS (FROM circle UNION ALL FROM rectangle UNION ALL FROM elliptic),
n AS (SELECT *, row_number() OVER (PARTITION BY tunnel ORDER BY segment, k) - 1 AS station, sqrt(tx * tx + ty * ty + tz * tz) AS l FROM path),
a AS (SELECT *, tx / l AS ux, ty / l AS uy, tz / l AS uz, acos(-(tz / l)) AS angle, sqrt(ty / l * (ty / l) + tx / l * (tx / l)) AS al FROM n),
b AS (SELECT *, coalesce(uy / nullif(al, 0e0), 0e0) AS ax, coalesce(-ux / nullif(al, 0e0), 0e0) AS ay, cos(angle) AS c, sin(angle) AS s FROM a),
-- the level direction is the turned z axis without its height
d AS (SELECT *, ay * s AS dx, -ax * s AS dy FROM b),
e AS (SELECT *, CASE WHEN ty < 0 THEN -1 ELSE 1 END * acos(greatest(-1e0, least(1e0, dx / sqrt(dx * dx + dy * dy)))) AS turn FROM d),
f AS (SELECT e.*, v, u AS pu, w AS pw, u * c + ax * (ax * u + ay * w) * (1 - c) AS qx, w * c + ay * (ax * u + ay * w) * (1 - c) AS qy, (ax * w - ay * u) * s AS qz FROM e JOIN ring USING (tunnel)),
g AS (SELECT *, cos(turn) AS c2, sin(turn) AS s2, ux * qx + uy * qy + uz * qz AS along FROM f),
h AS (SELECT tunnel, station, v, bx + CASE WHEN abs(turn) > 0.01 THEN qx * c2 + (uy * qz - uz * qy) * s2 + ux * along * (1 - c2) ELSE qx END AS x,
  by_ + CASE WHEN abs(turn) > 0.01 THEN qy * c2 + (uz * qx - ux * qz) * s2 + uy * along * (1 - c2) ELSE qy END AS y,
  bz + CASE WHEN abs(turn) > 0.01 THEN qz * c2 + (ux * qy - uy * qx) * s2 + uz * along * (1 - c2) ELSE qz END AS z FROM g)
SELECT tunnel, CAST(station AS INT) AS station, v, {_rs('x', 'y', 'z')} FROM h""")
def tunnel_vertices(spark, sf):
    return T.tunnel_vertices(view(spark, sf, "tunnels"), _COEF, 0.1, _N, digits=6).select("tunnel", "station", "v", "x", "y", "z")


@query(f"""WITH s AS (SELECT DISTINCT tunnel FROM tunnels), c AS (SELECT tunnel, s AS st, i FROM s, range(19) AS a(s), range({_N}) AS b(i)),
t AS (SELECT tunnel, st * {_N} + i AS a, (st + 1) * {_N} + i AS b, (st + 1) * {_N} + i + 1 AS c FROM c WHERE i <> {_N} - 1
 UNION ALL SELECT tunnel, st * {_N} + i, st * {_N} + i - 1, (st + 1) * {_N} + i FROM c WHERE i <> 0
 UNION ALL SELECT tunnel, st * {_N}, (st + 1) * {_N} - 1, (st + 1) * {_N} FROM c WHERE i = 0
 UNION ALL SELECT tunnel, (st + 1) * {_N} - 1, (st + 2) * {_N} - 1, (st + 1) * {_N} FROM c WHERE i = 0)
SELECT tunnel, a, b, c FROM t""")
def tunnel_faces(spark, sf):
    stations = grids.tunnel_stations(view(spark, sf, "tunnels"), 0.1).groupBy("tunnel").agg(F.count(F.lit(1)).alias("stations"))
    return T.tunnel_faces(stations, _N).select("tunnel", "a", "b", "c")


_WIDE = """o AS (SELECT *, CASE WHEN round_even(xmax, 0) = round_even(xmin, 0) AND round_even(ymax, 0) = round_even(ymin, 0) THEN 1 ELSE 0 END AS v FROM sections),
pl0 AS (SELECT section_id, seg, xmin - v AS px, ymin - v AS py, zmin AS pz, (ymax + v - (ymin - v)) * (zmax - zmin) AS nx, -((xmax + v - (xmin - v)) * (zmax - zmin)) AS ny FROM o),
pl AS (SELECT section_id, seg, px, py, pz, nx / sqrt(nx * nx + ny * ny) AS nx, ny / sqrt(nx * nx + ny * ny) AS ny FROM pl0)"""
_LIMIT = 60.0
_FOOT = "sqrt(({x} - d * nx - px) * ({x} - d * nx - px) + ({y} - d * ny - py) * ({y} - d * ny - py))"


@query(f"WITH {_WIDE} SELECT section_id, seg, {_rs('px', 'py', 'pz', 'nx', 'ny')}, 0e0 AS nz FROM pl")
def section_plane(spark, sf):
    return S.planes(view(spark, sf, "sections")).select("section_id", "seg", *_r("px", "py", "pz", "nx", "ny", "nz"))


@query(f"""WITH {_WIDE}, d AS (SELECT *, (x - px) * nx + (y - py) * ny AS d FROM springs CROSS JOIN pl)
SELECT section_id, seg, id, round({_FOOT.format(x='x', y='y')}, 6) + 0e0 AS u, {_rs('z')} FROM d WHERE abs(d) < {_LIMIT}e0""")
def project_springs(spark, sf):
    return S.project_springs(view(spark, sf, "sections"), view(spark, sf, "springs"), _LIMIT, 6).select("section_id", "seg", "id", "u", "z")


@query(f"""WITH {_WIDE}, a AS (SELECT *, (x0 - px) * nx + (y0 - py) * ny AS d0, (x1 - px) * nx + (y1 - py) * ny AS d1 FROM drillholes CROSS JOIN pl)
SELECT section_id, seg, id, round({_FOOT.format(x='x0', y='y0').replace(' d ', ' d0 ')}, 6) + 0e0 AS u0, round(z0, 6) AS v0, round({_FOOT.format(x='x1', y='y1').replace(' d ', ' d1 ')}, 6) + 0e0 AS u1, round(z1, 6) AS v1
FROM a WHERE abs(d0) < {_LIMIT}e0 OR abs(d1) < {_LIMIT}e0""")
def project_drillholes(spark, sf):
    return S.project_drillholes(view(spark, sf, "sections"), view(spark, sf, "drillholes"), _LIMIT, 6).select("section_id", "seg", "id", "u0", "v0", "u1", "v1")


def _dem_points(spark, sf):
    return spatial.dem_sample(view(spark, sf, "points").select("x", "y", "z"), view(spark, sf, "dem"), 20.0)


#: Points as rows of their own: equal ones and those of null coordinates count one by one.
_ROWS = "pts AS (SELECT row_number() OVER () AS r, * FROM points)"
_ABOVE = f"{_ROWS}, {_bilinear('pts', 'r, x, y, z')}"


@query(f"WITH {_ABOVE} SELECT x, y, z, {_rs('dem_z')} FROM sampled")
def dem_sample(spark, sf):
    return _dem_points(spark, sf).select("x", "y", "z", *_r("dem_z"))


@query(f"WITH {_ABOVE} SELECT x, y, z, round(z - dem_z, 6) + 0e0 AS height, coalesce(z - dem_z > 0, false) AS above FROM sampled")
def above_ground(spark, sf):
    height = F.col("z") - F.col("dem_z")
    return _dem_points(spark, sf).select("x", "y", "z", V.tidy(height).alias("height"), F.coalesce(height > 0, F.lit(False)).alias("above"))


@query(f"""WITH {_ABOVE} SELECT s.x, s.y, s.z, CAST(CASE WHEN s.z > s.dem_z THEN 0 ELSE coalesce(r.rank, 0) END AS INT) AS rank
FROM sampled s LEFT JOIN rank_grid r ON r.ix = floor(s.x / 40e0) AND r.iy = floor(s.y / 40e0) AND r.iz = floor(s.z / 40e0)""")
def rank_sample(spark, sf):
    return spatial.rank_sample(_dem_points(spark, sf), view(spark, sf, "rank_grid"), (40.0, 40.0, 40.0)).select("x", "y", "z", F.col("rank").cast("int").alias("rank"))


@query("SELECT rank, count(*) AS cells FROM rank_grid GROUP BY rank")
def distinct_ranks(spark, sf):
    return view(spark, sf, "rank_grid").groupBy("rank").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT g.rank, count(*) AS cells, CAST(max(g.rank - CASE WHEN s.reference = 'base' THEN 1 ELSE 0 END) AS INT) AS section_rank FROM rank_grid g JOIN series s ON s.unit = g.rank GROUP BY g.rank")
def rank_offset(spark, sf):
    ranks, series = view(spark, sf, "rank_grid"), view(spark, sf, "series").select(F.col("unit").alias("rank"), "reference")
    return ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("cells")).join(series, "rank").select("rank", "cells", (F.col("rank") - F.when(F.col("reference") == "base", 1).otherwise(0)).alias("section_rank"))


@query("SELECT DISTINCT g.rank, CAST(CASE WHEN s.reference = 'base' THEN g.rank - 1 ELSE g.rank END AS INT) AS unit_id FROM rank_grid g JOIN series s ON s.unit = g.rank WHERE g.rank <> 0")
def unit_ids(spark, sf):
    ranks, series = view(spark, sf, "rank_grid"), view(spark, sf, "series").select(F.col("unit").alias("rank"), "reference")
    return ranks.where("rank <> 0").select("rank").distinct().join(series, "rank").select("rank", F.when(F.col("reference") == "base", F.col("rank") - 1).otherwise(F.col("rank")).alias("unit_id"))


def _polygons(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(F.col("p_partkey").alias("face_id"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 6 + 2), lambda i: (F.col("p_partkey") * 3 + i * i).cast("int")).alias("face"))


@query("""WITH f AS (SELECT p_partkey AS face_id, list_transform(range(p_size % 6 + 3), lambda i: p_partkey * 3 + i * i) AS face FROM part)
SELECT face_id, CAST(face[1] AS INT) AS a, CAST(face[k + 1] AS INT) AS b, CAST(face[k + 2] AS INT) AS c FROM f, LATERAL (SELECT unnest(range(1, len(face) - 1)) AS k) AS g""")
def fan_triangles(spark, sf):
    t = _polygons(spark, sf).select("face_id", F.explode(V.fan(F.col("face"))).alias("t"))
    return t.select("face_id", *[F.get("t", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query(f"SELECT mesh_id, {_rs('xmin', 'ymin', 'zmin', 'xmax', 'ymax', 'zmax')} FROM boxes")
def mesh_bbox(spark, sf):
    return spatial.mesh_bbox(view(spark, sf, "tri")).select("mesh_id", *_r("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))


@query("SELECT mesh_id, round((xmax - xmin) * (ymax - ymin) * (zmax - zmin), 3) AS volume FROM boxes")
def mesh_volume(spark, sf):
    return meshes.mesh_volume(view(spark, sf, "tri"), "mesh_id").select("mesh_id", V.tidy(F.col("volume"), 3).alias("volume"))


@query("SELECT mesh_id, mesh_id % 10 <> 3 AS closed FROM boxes")
def mesh_closed(spark, sf):
    holed = view(spark, sf, "tri").where("NOT (mesh_id % 10 = 3 AND f = 5)")
    return meshes.mesh_closed(holed)


@query("SELECT mesh_id, CAST(12 AS BIGINT) AS faces, CAST(8 AS BIGINT) AS vertices FROM boxes")
def mesh_sizes(spark, sf):
    return meshes.mesh_sizes(view(spark, sf, "tri"), "mesh_id")


_IN = "p.x > xmin AND p.x < xmax AND p.y > ymin AND p.y < ymax AND p.z > zmin AND p.z < zmax"


@query(f"SELECT {_rs('x')}, p.y, p.z, mesh_id FROM points p JOIN boxes ON {_IN}")
def points_in_mesh(spark, sf):
    return spatial.points_in_mesh(view(spark, sf, "points"), view(spark, sf, "tri")).select(*_r("x"), "y", "z", "mesh_id")


def _tags(spark, sf, points):
    return spatial.mesh_tags(points, view(spark, sf, "tri"), view(spark, sf, "boxes").select("mesh_id", "gwb_id"))


@query(f"WITH {_ROWS} SELECT {_rs('x')}, p.y, p.z, CAST(coalesce(min_by(gwb_id, mesh_id), 0) AS INT) AS gwb_first FROM pts p LEFT JOIN boxes ON {_IN} GROUP BY p.r, p.x, p.y, p.z")
def gwb_first(spark, sf):
    return _tags(spark, sf, view(spark, sf, "points")).select(*_r("x"), "y", "z", F.col("gwb_first").cast("int").alias("gwb_first"))


@query(f"WITH {_ROWS} SELECT {_rs('x')}, p.y, p.z, CAST(coalesce(max(gwb_id), 0) AS INT) AS gwb_max FROM pts p LEFT JOIN boxes ON {_IN} GROUP BY p.r, p.x, p.y, p.z")
def gwb_max(spark, sf):
    return _tags(spark, sf, view(spark, sf, "points")).select(*_r("x"), "y", "z", F.col("gwb_max").cast("int").alias("gwb_max"))


_OVER = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND a.zmin <= b.zmax AND b.zmin <= a.zmax"
_WITHIN = "{a}.xmin > {b}.xmin AND {a}.xmax < {b}.xmax AND {a}.ymin > {b}.ymin AND {a}.ymax < {b}.ymax AND {a}.zmin > {b}.zmin AND {a}.zmax < {b}.zmax"
_TOUCH = f"{_OVER} AND NOT ({_WITHIN.format(a='a', b='b')}) AND NOT ({_WITHIN.format(a='b', b='a')})"


@query(f"SELECT a.mesh_id AS m1, b.mesh_id AS m2 FROM boxes a JOIN boxes b ON a.mesh_id < b.mesh_id AND {_TOUCH}")
def mesh_contacts(spark, sf):
    return spatial.mesh_contacts(view(spark, sf, "tri"))


@query(f"""WITH RECURSIVE e AS (SELECT a.mesh_id AS m1, b.mesh_id AS m2 FROM boxes a JOIN boxes b ON a.mesh_id <> b.mesh_id AND {_TOUCH}),
r AS (SELECT mesh_id AS m, mesh_id AS c FROM boxes UNION SELECT e.m2, r.c FROM r JOIN e ON e.m1 = r.m)
SELECT m AS mesh_id, min(c) AS body FROM r GROUP BY m""")
def contact_bodies(spark, sf):
    """Meshes joined by touching, named by the smallest mesh that they reach."""
    ids = view(spark, sf, "boxes").select("mesh_id")
    labels = graph.connected_components(spatial.contact_links(view(spark, sf, "tri")), "m1", "m2")
    return ids.join(labels.withColumnRenamed("node", "mesh_id"), "mesh_id", "left").select("mesh_id", F.coalesce("component", "mesh_id").alias("body"))


def _pair_meshes(spark, sf):
    """Two boxes far apart in one mesh: faces 0-11 and 12-23."""
    tri = view(spark, sf, "tri")
    far = meshes.translate_mesh(tri, 5000.0, 0.0, 0.0).withColumn("f", F.col("f") + 12)
    return tri.unionByName(far)


@query("SELECT mesh_id, f, CASE WHEN f < 12 THEN 0 ELSE 12 END AS component FROM boxes, range(24) AS q(f)".replace("SELECT mesh_id, f,", "SELECT mesh_id, CAST(f AS INT) AS f,"))
def mesh_components(spark, sf):
    return meshes.components(_pair_meshes(spark, sf), ["mesh_id"]).select("mesh_id", F.col("f").cast("int").alias("f"), F.col("component").cast("int").alias("component"))


@query("SELECT mesh_id, round((xmax - xmin) * (ymax - ymin) * (least(zmax, 400.5e0) - zmin), 3) AS volume FROM boxes WHERE zmin < 400.5e0")
def clip_volume(spark, sf):
    cut = meshes.clip_below(view(spark, sf, "tri").withColumn("h", F.lit(400.5)), ["mesh_id"])
    return meshes.mesh_volume(cut, "mesh_id").select("mesh_id", V.tidy(F.col("volume"), 3).alias("volume"))


@query("SELECT mesh_id, true AS closed FROM boxes WHERE zmin < 400.5e0")
def clip_closed(spark, sf):
    return meshes.mesh_closed(meshes.clip_below(view(spark, sf, "tri").withColumn("h", F.lit(400.5)), ["mesh_id"]))


@query("""WITH d AS (SELECT mesh_id, s.id, greatest(xmin - s.x, 0, s.x - xmax) AS dx, greatest(ymin - s.y, 0, s.y - ymax) AS dy, greatest(zmin - s.z, 0, s.z - zmax) AS dz,
 least(s.x - xmin, xmax - s.x, s.y - ymin, ymax - s.y, s.z - zmin, zmax - s.z) AS deep FROM boxes JOIN springs s ON s.id = mesh_id)
SELECT id, round(CASE WHEN deep > 0 THEN deep ELSE sqrt(dx * dx + dy * dy + dz * dz) END, 6) + 0e0 AS distance FROM d""")
def nearest_face(spark, sf):
    asked = view(spark, sf, "springs").select(F.col("id").alias("mesh_id"), "x", "y", "z")
    return spatial.nearest_face(asked, view(spark, sf, "tri"), ["mesh_id"]).select(F.col("mesh_id").alias("id"), *_r("distance"))


@query("""WITH d AS (SELECT b.mesh_id, s.id, CASE WHEN abs(s.x - (xmin + xmax) / 2) <= abs(s.x - 5000 - (xmin + xmax) / 2) THEN 0 ELSE 12 END AS component FROM boxes b JOIN springs s ON s.id = b.mesh_id)
SELECT id, CAST(component AS INT) AS component FROM d""")
def closest_component(spark, sf):
    tri = meshes.components(_pair_meshes(spark, sf), ["mesh_id"]).withColumn("face", F.struct("f", "component"))
    asked = view(spark, sf, "springs").select(F.col("id").alias("mesh_id"), "x", "y", "z")
    return spatial.nearest_face(asked, tri, ["mesh_id"], "face").select(F.col("mesh_id").alias("id"), F.col("f.component").cast("int").alias("component"))


@query("SELECT id, unit_id FROM springs WHERE unit_id IN (SELECT unit_id FROM units WHERE unit_id % 6 <> 5)")
def spring_units(spark, sf):
    return groundwater.spring_units(view(spark, sf, "springs"), view(spark, sf, "units").where("unit_id % 6 <> 5")).select("id", "unit_id")


@query("SELECT id, unit_id FROM springs WHERE unit_id NOT IN (SELECT unit_id FROM units WHERE unit_id % 6 <> 5)")
def spring_units_missing(spark, sf):
    return groundwater.spring_units_missing(view(spark, sf, "springs"), view(spark, sf, "units").where("unit_id % 6 <> 5")).select("id", "unit_id")


@query("SELECT CAST(row_number() OVER (ORDER BY z DESC, id) AS INT) AS pos, id, z FROM springs ORDER BY z DESC, id")
def springs_by_z(spark, sf):
    return spatial.ranked(view(spark, sf, "springs").select("id", "z"), F.desc("z"), "id").select(F.col("pos").cast("int").alias("pos"), "id", "z")


_GWB = f"""s AS (SELECT id, x, y, (z + 20) * 0.6e0 AS z, unit_id FROM springs),
cutb AS (SELECT s.id AS spring_id, u.unit_id, xmin, ymin, zmin, xmax, ymax, least(zmax, s.z) AS zmax FROM s JOIN units u ON u.zmin < s.z),
e AS (SELECT a.spring_id, a.unit_id AS p, b.unit_id AS q FROM cutb a JOIN cutb b ON a.spring_id = b.spring_id AND a.unit_id <> b.unit_id AND {_TOUCH}),
i AS (SELECT s.id AS spring_id, s.unit_id, s.z FROM s JOIN cutb c ON c.spring_id = s.id AND c.unit_id = s.unit_id),
r AS (SELECT spring_id, unit_id FROM i UNION SELECT e.spring_id, e.q FROM r JOIN e ON e.spring_id = r.spring_id AND e.p = r.unit_id),
o AS (SELECT *, row_number() OVER (ORDER BY z DESC, spring_id) AS pos FROM i),
cf AS (SELECT low.pos, list(DISTINCT high.pos) AS hits FROM o low JOIN cutb a ON a.spring_id = low.spring_id AND a.unit_id = low.unit_id
  JOIN o high ON high.pos < low.pos JOIN r ON r.spring_id = high.spring_id JOIN cutb b ON b.spring_id = r.spring_id AND b.unit_id = r.unit_id AND {_TOUCH} GROUP BY low.pos),
c0 AS (SELECT o.pos, coalesce(cf.hits, []) AS hits FROM o LEFT JOIN cf USING (pos)),
k AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT c0.pos, CASE WHEN list_has_any(k.kept, c0.hits) THEN k.kept ELSE list_append(k.kept, c0.pos) END FROM k JOIN c0 ON c0.pos = k.pos + 1),
kept AS (SELECT unnest(kept) AS pos FROM k WHERE pos = (SELECT max(pos) FROM k))"""


@query(f"""WITH RECURSIVE {_GWB}
SELECT b.spring_id, b.unit_id, round((xmax - xmin) * (ymax - ymin) * (zmax - zmin), 3) AS volume
FROM kept JOIN o USING (pos) JOIN r ON r.spring_id = o.spring_id JOIN cutb b ON b.spring_id = r.spring_id AND b.unit_id = r.unit_id""")
def gwb_metadata(spark, sf):
    """Groundwater bodies below all springs."""
    springs = view(spark, sf, "springs").withColumn("z", (F.col("z") + 20) * 0.6)
    out = groundwater.groundwater_bodies(view(spark, sf, "unit_tri"), springs)
    return out.select("spring_id", "unit_id", V.tidy(F.col("volume"), 3).alias("volume"))


@query("""WITH c AS (SELECT rank, ix - dx AS cx, iy - dy AS cy, iz - dz AS cz, CAST(1 << (dx + 2 * dy + 4 * dz) AS INT) AS b FROM rank_grid, (VALUES (0), (1)) AS p(dx), (VALUES (0), (1)) AS q(dy), (VALUES (0), (1)) AS r(dz) WHERE rank <> 0)
SELECT rank, mask, count(*) AS cells FROM (SELECT rank, CAST(bit_or(b) AS INT) AS mask FROM c GROUP BY rank, cx, cy, cz) WHERE mask <> 255 GROUP BY rank, mask""")
def surface_cell_cases(spark, sf):
    return meshes.surface_cells(view(spark, sf, "rank_grid")).groupBy("rank", "mask").agg(F.count(F.lit(1)).alias("cells"))


# Faces and volume by rule, without a case table: six tetrahedra fill a cell and are cut at the middles of their edges.
_SURF = """c AS (SELECT rank, ix - dx AS cx, iy - dy AS cy, iz - dz AS cz, CAST(1 << (dx + 2 * dy + 4 * dz) AS INT) AS b FROM rank_grid, (VALUES (0), (1)) AS p(dx), (VALUES (0), (1)) AS q(dy), (VALUES (0), (1)) AS r(dz) WHERE rank <> 0),
m AS (SELECT rank, cx, cy, cz, CAST(bit_or(b) AS INT) AS mask FROM c GROUP BY rank, cx, cy, cz),
t AS (SELECT CAST(1 + (1 << p1) + (1 << (p1 | p2)) + 128 AS INT) AS corners FROM (VALUES (1), (2), (4)) AS p(p1), (VALUES (1), (2), (4)) AS q(p2) WHERE p1 <> p2),
h AS (SELECT rank, bit_count(mask & corners) AS inside FROM m, t),
surf AS (SELECT rank, CAST(sum(CASE WHEN inside IN (1, 3) THEN 1 WHEN inside = 2 THEN 2 ELSE 0 END) AS BIGINT) AS faces,
  sum(CASE inside WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 8 ELSE 0 END) / 48e0 AS volume FROM h GROUP BY rank)"""


@query(f"WITH {_SURF} SELECT rank, round(volume, 3) + 0e0 AS volume, true AS closed, faces FROM surf WHERE faces > 0")
def surfaces(spark, sf):
    """Closed surfaces of all ranks; ``closed`` and a positive ``volume`` are the test."""
    tri = meshes.extract_surfaces(spark, view(spark, sf, "rank_grid"))
    closed = meshes.mesh_closed(tri, "rank")
    made = meshes.mesh_volume(tri, "rank").join(closed, "rank").join(tri.groupBy("rank").agg(F.count(F.lit(1)).alias("faces")), "rank")
    return made.select("rank", V.tidy(F.col("volume"), 3).alias("volume"), "closed", "faces")


@query(f"""WITH {_VOX}, t AS (SELECT *, 0.00001e0 * sqrt((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin) + (zmax - zmin) * (zmax - zmin)) AS tol FROM boxes),
r AS (SELECT v.*, coalesce(g.rank, 0) AS rank FROM voxels v LEFT JOIN rank_grid g ON g.ix = floor(v.x / 40e0) AND g.iy = floor(v.y / 40e0) AND g.iz = floor(v.z / 40e0)),
b AS (SELECT r.grid_id, r.ix, r.iy, r.iz, r.rank, CAST(coalesce(max(gwb_id), 0) AS INT) AS gwb_id FROM r LEFT JOIN t ON r.x > xmin + tol AND r.x < xmax - tol AND r.y > ymin + tol AND r.y < ymax - tol AND r.z > zmin + tol AND r.z < zmax - tol GROUP BY ALL)
SELECT grid_id, ix, iy, iz, CAST(rank AS INT) AS rank, gwb_id FROM b""")
def voxel_table(spark, sf):
    """Rank and highest body of every voxel of all grids; ranks keep their raw number, a point on a face is not inside."""
    voxels = grids.voxel_center_grid(_voxel_boxes(spark, sf))
    ranked = spatial.rank_sample(_tags(spark, sf, voxels), view(spark, sf, "rank_grid"), (40.0, 40.0, 40.0))
    return ranked.select("grid_id", "ix", "iy", "iz", F.col("rank").cast("int").alias("rank"), F.col("gwb_max").cast("int").alias("gwb_id"))


@query(f"WITH {_VOX} SELECT grid_id, CAST(row_number() OVER (PARTITION BY grid_id ORDER BY iz, iy, ix) AS INT) AS line, ix, iy, iz FROM voxels")
def voxel_order(spark, sf):
    from pyspark.sql import Window

    rows = grids.voxel_center_grid(_voxel_boxes(spark, sf))
    return rows.select("grid_id", F.row_number().over(Window.partitionBy("grid_id").orderBy("iz", "iy", "ix")).alias("line"), "ix", "iy", "iz")


def _faults(spark, sf):
    f = view(spark, sf, "faults")
    return f.withColumn("stops_on", F.when(F.col("stops_on").isNotNull(), F.array("stops_on")).otherwise(F.expr("cast(array() as array<int>)")))


@query("SELECT fault FROM fault_potential GROUP BY fault HAVING bool_or(value <> 0)")
def fault_nonempty(spark, sf):
    return S.fault_nonempty(view(spark, sf, "fault_potential"))


@query("""SELECT f.fault, f.stops_on AS limit_fault, round(coalesce(avg(v.value), 1e0), 6) + 0e0 AS side FROM faults f LEFT JOIN fault_interface_value v ON v.fault = f.fault AND v.limit_fault = f.stops_on
WHERE f.stops_on IS NOT NULL GROUP BY f.fault, f.stops_on""")
def fault_valid_side(spark, sf):
    return S.fault_valid_side(_faults(spark, sf), view(spark, sf, "fault_interface_value")).select("fault", "limit_fault", *_r("side"))


_CLIP = """ne AS (SELECT fault FROM fault_potential GROUP BY fault HAVING bool_or(value <> 0)),
sd AS (SELECT f.fault, f.stops_on AS limit_fault, coalesce(avg(v.value), 1e0) AS side FROM faults f LEFT JOIN fault_interface_value v ON v.fault = f.fault AND v.limit_fault = f.stops_on
  WHERE f.stops_on IN (SELECT fault FROM ne) GROUP BY f.fault, f.stops_on),
ht AS (SELECT DISTINCT l.i, l.j, sd.fault FROM sd JOIN fault_potential l ON l.fault = sd.limit_fault WHERE NOT (sd.side * l.value > 0)),
ot AS (SELECT e.i, e.j, e.fault FROM fault_ellipsoid e JOIN faults f ON f.fault = e.fault AND NOT f.infinite WHERE e.e > 0),
cl AS (SELECT p.i, p.j, p.fault, CASE WHEN ht.fault IS NULL AND ot.fault IS NULL THEN p.value END AS value FROM fault_potential p JOIN ne ON ne.fault = p.fault
  LEFT JOIN ht ON ht.i = p.i AND ht.j = p.j AND ht.fault = p.fault LEFT JOIN ot ON ot.i = p.i AND ot.j = p.j AND ot.fault = p.fault),
cr AS (SELECT fault FROM cl GROUP BY fault HAVING coalesce(bool_or(value < 0), false) AND coalesce(bool_or(value > 0), false))"""


def _clip_args(spark, sf):
    return view(spark, sf, "fault_potential"), _faults(spark, sf), view(spark, sf, "fault_interface_value"), view(spark, sf, "fault_ellipsoid")


@query(f"WITH {_CLIP} SELECT i, j, fault, {_rs('value')} FROM cl")
def fault_clip_limits(spark, sf):
    return S.clipped_faults(*_clip_args(spark, sf)).select("i", "j", "fault", *_r("value"))


@query(f"WITH {_CLIP} SELECT fault FROM cr")
def fault_crossing(spark, sf):
    return S.crossing_faults(S.clipped_faults(*_clip_args(spark, sf)))


@query(f"WITH {_CLIP} SELECT i, j, cl.fault, {_rs('value')} FROM cl JOIN cr ON cr.fault = cl.fault")
def fault_section(spark, sf):
    return S.fault_section(*_clip_args(spark, sf)).select("i", "j", "fault", *_r("value"))


@query("SELECT fault FROM faults WHERE fault NOT IN (SELECT stops_on FROM faults WHERE stops_on IS NOT NULL)")
def fault_roots(spark, sf):
    f = _faults(spark, sf)
    return f.select("fault").join(f.select(F.explode("stops_on").alias("fault")), "fault", "left_anti")


@query("""WITH RECURSIVE r AS (SELECT fault, 0 AS level FROM faults WHERE fault NOT IN (SELECT stops_on FROM faults WHERE stops_on IS NOT NULL)
UNION ALL SELECT f.stops_on, r.level + 1 FROM r JOIN faults f ON f.fault = r.fault WHERE f.stops_on IS NOT NULL) SELECT fault, CAST(max(level) AS INT) AS level FROM r GROUP BY fault""")
def fault_levels(spark, sf):
    return S.fault_levels(_faults(spark, sf))


_LINES = """l AS (SELECT section_id, seg, i, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY j) AS line FROM r GROUP BY ALL)
SELECT section_id, seg, string_agg(line, ';' ORDER BY i) AS matrix FROM l GROUP BY ALL"""


def _lines(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda line: F.array_join(F.transform(line, lambda v: v.cast("string")), " ")), ";")


@query(f"""WITH {_GRID}, {_bilinear('grid', 'section_id, seg, i, j, x, y, z')},
r AS (SELECT section_id, seg, i, j, CASE WHEN z > dem_z THEN 0 ELSE coalesce(k.rank, 0) END - CASE WHEN section_id % 2 = 0 THEN 1 ELSE 0 END AS v
  FROM sampled LEFT JOIN rank_grid k ON k.ix = floor(x / 40e0) AND k.iy = floor(y / 40e0) AND k.iz = floor((z + 200) / 40e0)), {_LINES}""")
def rank_matrix(spark, sf):
    """Ranks of every section, a line for each step along it: sky above ground, one less where the pile is told by bases."""
    return _rank_matrix(spark, sf).select("section_id", "seg", _lines(F.col("matrix")).alias("matrix"))


def _section_points(spark, sf, sections=None):
    laid = grids.vertical_slice_grid(view(spark, sf, "sections") if sections is None else sections)
    return laid.select("section_id", "seg", "i", "j", "x", "y", "z")


def _rank_matrix(spark, sf, sections=None):
    """Nested rank arrays [along][up] of every section; sections of even number belong to piles told by bases."""
    ground = spatial.dem_sample(_section_points(spark, sf, sections), view(spark, sf, "dem"), 20.0)
    ranked = spatial.rank_sample(ground, view(spark, sf, "rank_grid"), (40.0, 40.0, 40.0), (0.0, 0.0, -200.0))
    reference = F.when(F.col("section_id") % 2 == 0, "base").otherwise("top")
    return S.matrix(ranked.withColumn("rank", S.section_rank(F.col("rank"), reference)), ["section_id", "seg"], "rank")


@query(f"""WITH {_GRID}, t AS (SELECT *, 0.00001e0 * sqrt((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin) + (zmax - zmin) * (zmax - zmin)) AS tol FROM boxes),
r AS (SELECT section_id, seg, i, j, coalesce(min_by(gwb_id, mesh_id), 0) AS v
  FROM grid p LEFT JOIN t ON p.x > t.xmin + tol AND p.x < t.xmax - tol AND p.y > t.ymin + tol AND p.y < t.ymax - tol AND p.z > t.zmin + tol AND p.z < t.zmax - tol GROUP BY section_id, seg, i, j), {_LINES}""")
def section_bodies(spark, sf):
    """The first groundwater body that holds each point of every section, a line for each step along it."""
    return _body_matrix(spark, sf).select("section_id", "seg", _lines(F.col("matrix")).alias("matrix"))


def _body_matrix(spark, sf, sections=None):
    return S.matrix(_tags(spark, sf, _section_points(spark, sf, sections)), ["section_id", "seg"], "gwb_first")


def _field_clip(points: str, keys: str) -> str:
    """SQL of ``kept``: the clipped fields of all faults that cross a section, from ``points (keys, i, j, x, y, z, height)``."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in f"{keys}, i, j".split(","))
    return f"""pv AS (SELECT {keys}, i, j, fault, height, a * x + b * y + c * z + d AS value,
  (x - mx) / rx * ((x - mx) / rx) + (y - my) / ry * ((y - my) / ry) + (z - mz) / rz * ((z - mz) / rz) - 1 AS e FROM {points} CROSS JOIN fault_fields),
own AS (SELECT * FROM pv WHERE ({keys}, fault) IN (SELECT ({keys}, fault) FROM pv WHERE value <> 0)),
sd AS (SELECT f.fault, f.stops_on AS limit_fault, coalesce(avg(v.value), 1e0) AS side FROM faults f LEFT JOIN fault_interface_value v ON v.fault = f.fault AND v.limit_fault = f.stops_on GROUP BY ALL),
cl AS (SELECT own.*, CASE WHEN coalesce(own.height > 0, false) OR coalesce(NOT f.infinite AND own.e > 0, false) OR coalesce(NOT (sd.side * l.value > 0), false) THEN NULL ELSE own.value END AS kept
  FROM own LEFT JOIN faults f ON f.fault = own.fault LEFT JOIN sd ON sd.fault = own.fault LEFT JOIN own l ON {same('l', 'own')} AND l.fault = sd.limit_fault),
kept AS (SELECT {keys}, i, j, fault, kept AS value FROM cl WHERE ({keys}, fault) IN (SELECT ({keys}, fault) FROM cl GROUP BY {keys}, fault HAVING bool_or(kept < 0) AND bool_or(kept > 0))),
fl AS (SELECT {keys}, fault, j, string_agg(coalesce(CAST(CAST(round((round(value, 6) + 0e0) * 1000) AS BIGINT) AS VARCHAR), 'null'), ' ' ORDER BY i) AS line FROM kept GROUP BY ALL),
fm AS (SELECT {keys}, CAST(fault AS VARCHAR) AS name, string_agg(line, ';' ORDER BY j) AS value FROM fl GROUP BY ALL)"""


def _millis(v: Column) -> Column:
    """A length in thousandths as text, so that values read back from a report compare as whole numbers."""
    return F.coalesce(F.round(V.tidy(v) * 1000).cast("long").cast("string"), F.lit("null"))


def _fault_matrices(spark, sf, points, keys: tuple[str, ...]):
    """By fault, what crosses each section or map, from its points with their ``height`` above ground."""
    return S.field_matrices(points, view(spark, sf, "fault_fields"), _faults(spark, sf), view(spark, sf, "fault_interface_value"), list(keys))


def _section_reports(spark, sf):
    """Reports of the sections that stand for all of their place, resolution and pile, and the sections that each stands for."""
    keys = ["section_id", "seg"]
    known = view(spark, sf, "sections")
    alike = [*[f"{a}{end}" for a in "xyz" for end in ("min", "max")], "resolution", F.col("section_id") % 2]
    sections, members = S.alike(known, keys, alike)
    ranks, bodies = _rank_matrix(spark, sf, sections), _body_matrix(spark, sf, sections).withColumnRenamed("matrix", "bodies")
    springs = S.near_springs(sections, view(spark, sf, "springs"), _LIMIT)
    holes = S.near_drillholes(sections, view(spark, sf, "drillholes"), _LIMIT)
    ground = spatial.dem_sample(_section_points(spark, sf, sections), view(spark, sf, "dem"), 20.0).withColumn("height", F.col("z") - F.col("dem_z")).drop("dem_z")
    faults = _fault_matrices(spark, sf, ground, ("section_id", "seg"))
    # parts are made one after the other, so no plan holds them all; features, the largest, stay where they are gathered
    ranks, bodies, faults = (cut(part) for part in (ranks, bodies, faults))
    joined = holes
    for part, how in ((springs, "inner"), (ranks, "inner"), (bodies, "inner"), (faults, "left")):
        joined = joined.join(part.hint("shuffle_hash"), keys, how)  # a merge would sort the lists of features
    told = {"springs": S.spring_map(F.col("springs")), "drillholes": S.drillhole_map(F.col("drillholes"))}
    parts = [told.get(c, F.col(c)).alias(c) for c in ("matrix", "bodies", "springs", "drillholes", "faults")]
    return joined.select(*keys, F.to_json(F.struct(*parts)).alias("report")), members


@query()
def section_report(spark, sf):
    """Ranks, groundwater bodies, springs, drillholes and faults of every section as nested values, one row per section."""
    reports, members = _section_reports(spark, sf)
    return S.of_alike(reports, members, ["section_id", "seg"])


_REPORT = "matrix array<array<int>>, bodies array<array<int>>, springs map<string,array<double>>, drillholes map<string,array<array<double>>>, faults map<string,array<array<double>>>"


def _report_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., part, name, value)``: what the reports' texts say, a row for each matrix and each feature."""
    read = reports.select(*keys, F.from_json("report", _REPORT).alias("r"))
    whole = lambda m: F.map_from_entries(F.array(F.struct(F.lit("").alias("k"), _lines(m).alias("v"))))
    told = lambda values: F.array_join(F.transform(values, _millis), " ")
    parts = {
        "ranks": whole(F.col("r.matrix")),
        "bodies": whole(F.col("r.bodies")),
        "springs": F.transform_values("r.springs", lambda _, v: told(v)),
        "drillholes": F.transform_values("r.drillholes", lambda _, v: told(F.flatten(v))),
        "faults": F.transform_values("r.faults", lambda _, m: F.array_join(F.transform(m, told), ";")),
    }

    def named(part: str, values: Column) -> Column:
        row = lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("name"), e["value"].alias("value"))
        return F.transform(F.coalesce(F.map_entries(values), F.array()), row)

    listed = F.flatten(F.array(*[named(part, values) for part, values in parts.items()]))
    return read.select(*keys, F.inline(listed)).where("value IS NOT NULL")


_M = "CAST(CAST(round({} * 1000) AS BIGINT) AS VARCHAR)"
_SECTION_ROWS = f"""SELECT section_id, seg, 'ranks' AS part, '' AS name, matrix AS value FROM ({ORACLES["rank_matrix"]})
UNION ALL SELECT section_id, seg, 'bodies', '', matrix FROM ({ORACLES["section_bodies"]})
UNION ALL SELECT section_id, seg, 'springs', CAST(id AS VARCHAR), concat_ws(' ', {", ".join(_M.format(c) for c in ("u", "z"))}) FROM ({ORACLES["project_springs"]})
UNION ALL SELECT section_id, seg, 'drillholes', CAST(id AS VARCHAR), concat_ws(' ', {", ".join(_M.format(c) for c in ("u0", "v0", "u1", "v1"))}) FROM ({ORACLES["project_drillholes"]})
UNION ALL SELECT section_id, seg, 'faults', name, value FROM fm"""


@query(f"""WITH {_GRID}, {_bilinear('grid', 'section_id, seg, i, j, x, y, z')}, hp AS (SELECT *, z - dem_z AS height FROM sampled), {_field_clip('hp', 'section_id, seg')}
{_SECTION_ROWS}""")
def section_report_rows(spark, sf):
    """The reports of all sections read back from their text: ranks, bodies, springs, drillholes and faults."""
    reports, members = _section_reports(spark, sf)
    return S.of_alike(_report_rows(reports, ["section_id", "seg"]), members, ["section_id", "seg"])


@query(f"""WITH {_MAP}, mp AS (SELECT grid_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_LIN.format(i='i', n='n', a='xmin', b='xmax')} AS x, {_LIN.format(i='j', n='m', a='ymin', b='ymax')} AS y
  FROM m, LATERAL (SELECT unnest(range(n)) AS i) AS a, LATERAL (SELECT unnest(range(m)) AS j) AS b), {_bilinear('mp', 'grid_id, i, j, x, y')},
hp AS (SELECT *, dem_z AS z, 0e0 AS height FROM sampled), {_field_clip('hp', 'grid_id')},
r AS (SELECT grid_id, i, j, coalesce(k.rank, 0) - CASE WHEN grid_id % 2 = 0 THEN 1 ELSE 0 END AS v
  FROM hp LEFT JOIN rank_grid k ON k.ix = floor(x / 40e0) AND k.iy = floor(y / 40e0) AND k.iz = floor((z + 200) / 40e0)),
l AS (SELECT grid_id, i, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY j) AS line FROM r GROUP BY ALL)
SELECT grid_id, 'ranks' AS part, '' AS name, string_agg(line, ';' ORDER BY i) AS value FROM l GROUP BY grid_id
UNION ALL SELECT grid_id, 'faults', name, value FROM fm""")
def map_report_rows(spark, sf):
    """Ranks and faults of every map, whose points lie on the terrain, read back from the reports' text."""
    boxes, members = S.alike(_map_boxes(spark, sf), ["grid_id"], ["xmin", "ymin", "xmax", "ymax", "n", "m", F.col("grid_id") % 2])
    on = spatial.dem_sample(grids.map_grid(boxes), view(spark, sf, "dem"), 20.0).withColumnsRenamed({"dem_z": "z"})
    ranked = spatial.rank_sample(on, view(spark, sf, "rank_grid"), (40.0, 40.0, 40.0), (0.0, 0.0, -200.0))
    reference = F.when(F.col("grid_id") % 2 == 0, "base").otherwise("top")
    ranks = S.matrix(ranked.withColumn("rank", S.section_rank(F.col("rank"), reference)), ["grid_id"], "rank")
    faults = _fault_matrices(spark, sf, on.withColumn("height", F.lit(0.0)), ("grid_id",))
    reports = ranks.join(faults, "grid_id", "left").select("grid_id", F.to_json(F.struct("matrix", "faults")).alias("report"))
    return S.of_alike(_report_rows(reports, ["grid_id"]), members, ["grid_id"])


@query("SELECT DISTINCT fault FROM (SELECT fault FROM faults UNION ALL SELECT stops_on FROM faults WHERE stops_on IS NOT NULL)")
def fault_names(spark, sf):
    return assembly.fault_names(_faults(spark, sf))


@query("SELECT gwb_id, array_to_string(list_sort(list(mesh_id)), ',') AS meshes FROM boxes GROUP BY gwb_id")
def gwb_groups(spark, sf):
    grouped = assembly.gwb_groups(view(spark, sf, "boxes"))
    return grouped.select("gwb_id", F.array_join(F.transform("meshes", lambda m: m.cast("string")), ",").alias("meshes"))


@query("SELECT 'fault' AS kind, 'fault_' || fault AS name, sum(p_size % 6 + 1) AS triangles FROM part JOIN faults ON fault = p_partkey % 40 GROUP BY fault".replace("sum(p_size % 6 + 1)", "CAST(sum(p_size % 6 + 1) AS BIGINT)"))
def fault_mesh_outputs(spark, sf):
    """Triangles by fault from polygon faces; faces of unknown faults are dropped."""
    faces = _polygons(spark, sf).select((F.col("face_id") % 40).cast("string").alias("part"), F.col("face_id").alias("f"), "face")
    tris = assembly.fault_meshes(faces, view(spark, sf, "faults"))
    return tris.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("triangles"))


@query(f"""WITH {_SURF} SELECT 'mesh' AS kind, 'rank_' || CASE WHEN reference = 'base' THEN unit - 1 ELSE unit END AS name, CAST(sum(faces) AS BIGINT) AS triangles
FROM surf JOIN series ON unit = rank WHERE faces > 0 GROUP BY ALL""")
def unit_mesh_outputs(spark, sf):
    """Triangles by rock unit from the surfaces of the rank grid."""
    tris = assembly.unit_meshes(spark, view(spark, sf, "rank_grid"), view(spark, sf, "series"))
    return tris.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("triangles"))


@query(f"""WITH {_SURF}, e AS (SELECT rank, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, min(iz) AS z0, max(iz) AS z1 FROM rank_grid WHERE rank <> 0 GROUP BY rank)
SELECT rank, faces, round(volume * 3e0, 3) + 0e0 AS volume, (x0 - 0.5e0) * 2e0 + 100e0 AS xmin, (x1 + 0.5e0) * 2e0 + 100e0 AS xmax, (y0 - 0.5e0) * 3e0 - 50e0 AS ymin, (y1 + 0.5e0) * 3e0 - 50e0 AS ymax,
  (z0 - 0.5e0) * 0.5e0 + 7e0 AS zmin, (z1 + 0.5e0) * 0.5e0 + 7e0 AS zmax FROM surf JOIN e USING (rank) WHERE faces > 0""")
def surfaces_to_scale(spark, sf):
    """Surfaces brought from grid steps to a box whose cells are 2 by 3 by 0.5."""
    tri = meshes.extract_surfaces(spark, view(spark, sf, "rank_grid"), steps=(2.0, 3.0, 0.5), origin=(100.0, -50.0, 7.0))
    made = meshes.mesh_volume(tri, "rank").join(tri.groupBy("rank").agg(F.count(F.lit(1)).alias("faces")), "rank").join(spatial.mesh_bbox(tri, "rank"), "rank")
    return made.select("rank", "faces", V.tidy(F.col("volume"), 3).alias("volume"), *[f"{a}{e}" for a in "xyz" for e in ("min", "max")])


_PARTS = "f AS (SELECT p_partkey % 40 AS part, p_size % 6 AS more, p_partkey AS f, list_transform(range(p_size % 6 + 3), lambda i: p_partkey * 3 + i * i) AS face FROM part)"


def _part_faces(spark, sf):
    return _polygons(spark, sf).select((F.col("face_id") % 40).alias("part"), (F.size("face") - 3).alias("more"), F.col("face_id").alias("f"), "face")


@query(f"WITH {_PARTS} SELECT part * 2 + CASE WHEN more > 0 THEN 1 ELSE 0 END AS mesh_id, count(*) AS faces, bool_and(len(face) = 3) AS valid FROM f GROUP BY ALL")
def mesh_validity(spark, sf):
    """Meshes of polygon faces that are triangle meshes, and those that are not."""
    kind = F.when(F.col("more") > 0, 1).otherwise(0)
    return meshes.mesh_validity(_part_faces(spark, sf).withColumn("mesh_id", F.col("part") * 2 + kind)).select("mesh_id", "faces", "valid")


@query(f"WITH {_PARTS} SELECT part, string_agg(array_to_string(face, ' '), ';' ORDER BY f) AS faces FROM f GROUP BY part")
def grouped_faces(spark, sf):
    grouped = assembly.grouped_faces(_part_faces(spark, sf))
    return grouped.select("part", _lines(F.col("faces")).alias("faces"))


@query(f"WITH {_PARTS} SELECT part, f, CAST(k - 1 AS INT) AS part_of_face, concat_ws(' ', face[1], face[k + 1], face[k + 2]) AS tri FROM f, LATERAL (SELECT unnest(range(1, len(face) - 1)) AS k) AS g")
def triangulated_faces(spark, sf):
    """Faces as triangles, those that are triangles already as they are."""
    told = assembly.triangulated(_part_faces(spark, sf))
    return told.select("part", "f", "part_of_face", F.array_join(F.transform("tri", lambda v: v.cast("string")), " ").alias("tri"))


@query("SELECT mesh_id, CAST(CASE WHEN zmin > 200 THEN gwb_id ELSE 0 END AS INT) AS gwb_id FROM boxes")
def tag_gwb(spark, sf):
    """The body's number on what was selected, 0 elsewhere."""
    return view(spark, sf, "boxes").select("mesh_id", assembly.tag_gwb(F.col("zmin") > 200, F.col("gwb_id")).cast("int").alias("gwb_id"))


_JOB = f"{ORACLES['unit_mesh_outputs']} UNION ALL SELECT * FROM ({ORACLES['fault_mesh_outputs']})"


def _job(spark, sf):
    faces = _polygons(spark, sf).select((F.col("face_id") % 40).cast("string").alias("part"), F.col("face_id").alias("f"), "face")
    units = assembly.unit_meshes(spark, view(spark, sf, "rank_grid"), view(spark, sf, "series"))
    return assembly.job_meshes(units, assembly.fault_meshes(faces, view(spark, sf, "faults")))


@query(f"SELECT * FROM ({_JOB})")
def job_meshes(spark, sf):
    """All outputs of a mesh job, units and faults, with their triangles."""
    return _job(spark, sf)


@query(f"""SELECT kind, name, CAST(row_number() OVER (ORDER BY kind, name) - 1 AS INT) AS n,
  CASE WHEN kind = 'mesh' THEN 'mesh_' || (row_number() OVER (ORDER BY kind, name) - 1) ELSE kind || '_' || name END AS file FROM ({_JOB})""")
def output_names(spark, sf):
    """Outputs of a mesh job numbered in the order of their names, and the files that they go to."""
    rows = writers.numbered(_job(spark, sf).select("kind", "name"), "kind", "name")
    return rows.select("kind", "name", F.col("n").cast("int").alias("n"), writers.output_name(F.col("kind"), F.col("name"), F.col("n")).alias("file"))
