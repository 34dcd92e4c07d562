"""Derived input tables: one SQL text per table, read alike by Spark and by the oracle engine.

The driver's relational tables stand in for the geological inputs: suppliers are springs, small bodies,
sections, faults, grids and tunnels, nations are rock units and the faults that have a field, parts a
terrain, orders a rank grid, line items points, and events job timings and task events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CUBE = """(VALUES (0, 0,0,0, 0,1,0, 1,1,0), (1, 0,0,0, 1,1,0, 1,0,0), (2, 0,0,1, 1,0,1, 1,1,1), (3, 0,0,1, 1,1,1, 0,1,1),
  (4, 0,0,0, 1,0,0, 1,0,1), (5, 0,0,0, 1,0,1, 0,0,1), (6, 0,1,0, 0,1,1, 1,1,1), (7, 0,1,0, 1,1,1, 1,1,0),
  (8, 0,0,0, 0,0,1, 0,1,1), (9, 0,0,0, 0,1,1, 0,1,0), (10, 1,0,0, 1,1,0, 1,1,1), (11, 1,0,0, 1,1,1, 1,0,1))
  AS q(f, ai, aj, ak, bi, bj, bk, ci, cj, ck)"""


def _corners(boxes: str, key: str) -> str:
    axes = ", ".join(f"{axis}min + {p}{index} * ({axis}max - {axis}min) AS {p}{axis}" for p in "abc" for axis, index in zip("xyz", "ijk", strict=True))
    return f"SELECT {key}, f, {axes} FROM ({boxes}) CROSS JOIN {_CUBE}"


_BOXES = """SELECT s_suppkey AS mesh_id, s_nationkey % 7 + 1 AS gwb_id,
  x AS xmin, y AS ymin, z AS zmin, x + 60e0 + s_suppkey % 5 * 10e0 AS xmax, y + 80e0 + s_suppkey % 3 * 20e0 AS ymax, z + 200e0 + s_suppkey % 4 * 50e0 AS zmax
  FROM (SELECT s_suppkey, s_nationkey, (s_suppkey * 173) % 1000 * 1e0 AS x, (s_suppkey * 311) % 1000 * 1e0 AS y, (s_suppkey * 57) % 700 * 1e0 AS z FROM {supplier})"""
_UNITS = """SELECT n_nationkey AS unit_id, x AS xmin, y AS ymin, z AS zmin, x + 220e0 AS xmax, y + 230e0 AS ymax, z + 60e0 AS zmax
  FROM (SELECT n_nationkey, n_nationkey % 5 * 200e0 AS x, floor(n_nationkey / 5) * 215e0 + CASE WHEN n_nationkey % 5 = 3 THEN 60e0 ELSE 0e0 END AS y,
               -20e0 + (n_nationkey * 7) % 11 * 5e0 AS z FROM {nation})"""

#: One site per supplier: each has a section, a fault, grids and tunnels, so these grow with the table.
SITES = "(SELECT CAST(s_suppkey AS INT) AS k FROM {supplier}) AS sites"

VIEWS: dict[str, str] = {
    "site": "SELECT CAST(s_suppkey AS INT) AS k FROM {supplier}",
    "springs": """SELECT s_suppkey AS id, (s_suppkey * 37) % 1000 * 1e0 AS x, (s_suppkey * 91) % 1000 * 1e0 AS y, s_acctbal / 100 AS z, s_nationkey AS unit_id FROM {supplier}""",
    "drillholes": """SELECT c_custkey AS id, (c_custkey * 37) % 1000 * 1e0 AS x0, (c_custkey * 91) % 1000 * 1e0 AS y0, 100e0 AS z0,
  (c_custkey * 37) % 1000 * 1e0 + c_custkey % 7 AS x1, (c_custkey * 91) % 1000 * 1e0 - c_custkey % 5 AS y1, 100e0 - abs(c_acctbal) / 50 AS z1 FROM {customer}""",
    "sections": f"""SELECT k AS section_id, 0 AS seg, x AS xmin, y AS ymin, -200.4e0 AS zmin,
  CASE WHEN k % 5 = 0 THEN x WHEN k % 25 = 24 THEN x ELSE x + 300.5e0 END AS xmax,
  CASE WHEN k % 25 = 24 THEN y ELSE y + 150.25e0 END AS ymax, 100.5e0 AS zmax, 20 + k % 25 AS resolution
  FROM (SELECT k, (k * 41) % 700 * 1e0 AS x, (k * 83) % 800 * 1e0 AS y FROM {SITES})""",
    "points": """SELECT CASE WHEN l_orderkey % 97 <> 5 THEN l_partkey % 1000 * 1e0 END AS x, l_suppkey * 7 % 1000 * 1e0 + 0.5e0 AS y, l_quantity * 20 + 0.25e0 AS z FROM {lineitem}""",
    "dem": """SELECT CAST(p_partkey % 50 AS INT) AS ix, CAST(floor(p_partkey / 50) AS INT) AS iy, p_partkey % 50 * 20e0 AS x, floor(p_partkey / 50) * 20e0 AS y, p_retailprice / 10 + (p_partkey * 13) % 17 AS z FROM {part}""",
    "rank_grid": """SELECT CAST(k % 25 AS INT) AS ix, CAST(floor(k / 25) % 25 AS INT) AS iy, CAST(floor(k / 625) AS INT) AS iz,
  CAST(floor((floor(k / 625) + k % 25 * 0.3e0 + floor(k / 25) % 25 * 0.2e0) / 4e0) % 6 AS INT) AS rank FROM (SELECT o_orderkey AS k FROM {orders})""",
    "boxes": _BOXES,
    "tri": _corners(_BOXES, "mesh_id"),
    "units": _UNITS,
    "unit_tri": _corners(_UNITS, "unit_id"),
    "series": """SELECT n_nationkey AS unit, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'erode' ELSE 'onlap' END AS relation, CASE WHEN n_regionkey % 2 = 0 THEN 'base' ELSE 'top' END AS reference FROM {nation}""",
    "faults": f"""SELECT k AS fault, k % 4 <> 0 AS infinite, k % 5 AS grp, CASE WHEN k % 25 >= 5 THEN k - 5 END AS stops_on FROM {SITES}""",
    "contact_points": """SELECT p_partkey % 25 AS owner, p_size % 3 = 0 AS is_fault FROM {part}""",
    "dips": """SELECT c_custkey % 25 AS owner, c_custkey % 4 = 0 AS is_fault FROM {customer}""",
    "fault_grid": """SELECT CAST(k % 30 AS INT) AS i, CAST(floor(k / 30) AS INT) AS j, k % 30 * 30e0 AS x, floor(k / 30) * 25e0 AS z FROM (SELECT p_partkey AS k FROM {part})""",
    "fault_potential": """SELECT i, j, n_nationkey AS fault,
  CASE WHEN n_nationkey = 7 THEN 0e0 ELSE (x - n_nationkey * 45e0) * (1 + n_nationkey % 3) + (z - 300e0) * (n_nationkey % 5 - 2) * 0.5e0 END AS value
  FROM (SELECT CAST(k % 30 AS INT) AS i, CAST(floor(k / 30) AS INT) AS j, k % 30 * 30e0 AS x, floor(k / 30) * 25e0 AS z FROM (SELECT p_partkey AS k FROM {part})) CROSS JOIN {nation}""",
    "fault_ellipsoid": """SELECT i, j, n_nationkey AS fault, (x - n_nationkey * 45e0) * (x - n_nationkey * 45e0) / 90000e0 + (z - 400e0) * (z - 400e0) / 160000e0 - 1 AS e
  FROM (SELECT CAST(k % 30 AS INT) AS i, CAST(floor(k / 30) AS INT) AS j, k % 30 * 30e0 AS x, floor(k / 30) * 25e0 AS z FROM (SELECT p_partkey AS k FROM {part})) CROSS JOIN {nation}
  WHERE n_nationkey % 4 = 0""",
    "fault_fields": """SELECT CAST(n_nationkey AS INT) AS fault, f * (1 + n_nationkey % 3) AS a, f * (n_nationkey % 4 - 1) * 0.25e0 AS b, f * (n_nationkey % 5 - 2) * 0.5e0 AS c, f * (-37.3e0 * n_nationkey - 11.7e0) AS d,
  CASE WHEN e THEN n_nationkey * 45e0 END AS mx, CASE WHEN e THEN 480.3e0 END AS my, CASE WHEN e THEN -50.2e0 END AS mz, 300e0 AS rx, 400e0 AS ry, 250e0 AS rz
  FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 0e0 ELSE 1e0 END AS f, n_nationkey % 4 = 0 AND n_nationkey <> 8 AS e FROM {nation})""",
    "fault_interface_value": f"""SELECT k AS fault, k - 5 AS limit_fault, ((k % 25 * 29) % 13 - 6) * 1e0 + n AS value
  FROM {SITES} CROSS JOIN (VALUES (0), (1), (2)) AS q(n) WHERE k % 25 >= 10""",
    "tunnels": f"""SELECT k * 10 + s AS tunnel, shape, 10e0 AS radius, 20e0 AS width, 10e0 AS height, j AS segment,
  10e0 * j AS fx0, 10e0 + k % 25 AS fx1, 0.25e0 + j AS fy0, 119e0 - k % 25 * 9 AS fy1, 1e0 AS fy2, 40e0 AS fz0, k % 25 * 0.5e0 AS fz1
  FROM {SITES} CROSS JOIN (VALUES (0, 'Circle'), (1, 'Rectangle'), (2, 'Elliptic')) AS q(s, shape) CROSS JOIN (VALUES (0), (1)) AS g(j)""",
    "task_events": """SELECT ts, event_id AS id, event_type AS name, user_id % 2 AS queue, CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_id % 11 = 0 THEN 'RETRY' WHEN event_id % 13 = 0 THEN 'REVOKED'
  WHEN event_id % 7 = 0 THEN 'STARTED' ELSE 'SUCCESS' END AS state, user_id AS task, value AS runtime, props AS exception FROM {events}""",
    "profile_events": """SELECT user_id * 100 + dayofmonth(CAST(ts AS DATE)) AS run, CASE WHEN user_id % 3 = 0 THEN 'meshes' WHEN user_id % 3 = 1 THEN 'voxels' ELSE 'faults' END AS computation,
  CAST(1 + user_id % 4 AS INT) AS version, event_type AS step, ts, event_id AS seq, value FROM {events}""",
    "counters": """SELECT user_id % 10 AS series, event_id AS seq, ts, value * (event_id % 97) AS value FROM {events}""",
}

_TABLES = "region nation customer supplier part orders lineitem events".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables of ``sf_dir``."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The oracle text for ``sql``: the derived tables that it names go before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({re.sub(r'{(' + '|'.join(_TABLES) + r')}', r'\1', VIEWS[n])})" for n in names]
    body = sql.strip()
    head = re.match(r"WITH( RECURSIVE)?\s", body)
    recursive = " RECURSIVE" if head and head[1] else ""
    rest = f", {body[head.end():]}" if head else f" {body}"
    return (f"WITH{recursive} " + ",\n".join(ctes) + rest) if ctes else body
