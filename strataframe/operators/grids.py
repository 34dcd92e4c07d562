"""Grid generators: sections, maps, voxels, tunnel stations and rings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.vector import half_even, let, linspace


def proportional_resolution(width: Column, height: Column, resolution: Column) -> tuple[Column, Column]:
    """The larger side gets ``resolution`` steps, the other its share, rounded half to even.

    Either side 0: both get all steps.  Both 0 or below: an error.
    """
    bad = F.raise_error(F.lit("a section needs an extent")).cast("int")
    share = lambda small, large: half_even(small * (resolution / large)).cast("int")
    none, flat = (width <= 0) & (height <= 0), (width == 0) | (height == 0)
    full = resolution.cast("int")
    n = F.when(none, bad).when(flat, full).when(width > height, full).otherwise(share(width, height))
    m = F.when(none, bad).when(flat, full).when(width > height, share(height, width)).otherwise(full)
    return n, m


def section_extents(sections: DataFrame) -> DataFrame:
    """Add rounded extents, height and width of each section."""
    dx, dy = half_even(F.col("xmax")) - half_even(F.col("xmin")), half_even(F.col("ymax")) - half_even(F.col("ymin"))
    return sections.withColumns({"x_extent": dx, "y_extent": dy, "height": half_even(F.col("zmax")) - half_even(F.col("zmin")), "width": F.sqrt(dx * dx + dy * dy)})


def grid_resolutions(sections: DataFrame) -> DataFrame:
    n, m = proportional_resolution(F.col("width"), F.col("height"), F.col("resolution"))
    return section_extents(sections).withColumns({"n": n, "m": m})


def _steps(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def vertical_slice_grid(sections: DataFrame) -> DataFrame:
    """Points ``(section_id, seg, i, j, x, y, z)`` of every section; i runs along it, j up."""
    sized = grid_resolutions(sections).select("section_id", "seg", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax", "n", "m")
    laid = sized.withColumn("i", _steps(F.col("n"))).withColumn("j", _steps(F.col("m")))
    along_x = F.col("xmin") != F.col("xmax")
    x = F.when(along_x, linspace(F.col("xmin"), F.col("xmax"), F.col("n"), F.col("i"))).otherwise(F.col("xmin"))
    slope = (F.col("ymax") - F.col("ymin")) / F.nullif(F.col("xmax") - F.col("xmin"), F.lit(0.0))
    y = F.when(along_x, slope * (F.col("x") - F.col("xmin")) + F.col("ymin")).otherwise(linspace(F.col("ymin"), F.col("ymax"), F.col("n"), F.col("i")))
    return laid.withColumn("x", x).withColumn("y", y).withColumn("z", linspace(F.col("zmin"), F.col("zmax"), F.col("m"), F.col("j"))).select("section_id", "seg", "i", "j", "x", "y", "z")


def map_grid(boxes: DataFrame) -> DataFrame:
    """Points ``(grid_id, i, j, x, y)`` of ``boxes (grid_id, xmin, ymin, xmax, ymax, n, m)``, x outer."""
    laid = boxes.withColumn("i", _steps(F.col("n"))).withColumn("j", _steps(F.col("m")))
    return laid.select("grid_id", "i", "j", linspace(F.col("xmin"), F.col("xmax"), F.col("n"), F.col("i")).alias("x"), linspace(F.col("ymin"), F.col("ymax"), F.col("m"), F.col("j")).alias("y"))


def _cells(boxes: DataFrame, divisor, offset: float) -> DataFrame:
    out = boxes.withColumn("ix", _steps(F.col("nx"))).withColumn("iy", _steps(F.col("ny"))).withColumn("iz", _steps(F.col("nz")))
    at = {a: F.col(f"{a}min") + (F.col(f"i{a}") + offset) * ((F.col(f"{a}max") - F.col(f"{a}min")) / divisor(F.col(f"n{a}"))) for a in "xyz"}
    return out.select("grid_id", "ix", "iy", "iz", *[c.alias(a) for a, c in at.items()])


def voxel_center_grid(boxes: DataFrame) -> DataFrame:
    """Cell centres of ``boxes (grid_id, xmin..zmax, nx, ny, nz)``."""
    return _cells(boxes, lambda n: n, 0.5)


def lattice_grid(boxes: DataFrame) -> DataFrame:
    """Nodes on the faces included: steps of extent / (n - 1)."""
    return _cells(boxes, lambda n: F.greatest(n - 1, F.lit(1)), 0.0)


def grid_cells(nx: Column, ny: Column, nz: Column) -> Column:
    """Cells of a grid, the measure of a job's cost."""
    return (nx.cast("long") * ny * nz).cast("long")


def coarse_shape(n: Column) -> Column:
    """A fault grid's cells per axis: a tenth, ten at least."""
    return F.greatest(F.lit(10.0), n / 10).cast("int")


def tunnel_stations(tunnels: DataFrame, step: float, first: int = -1, t_first: float = 0.0, last: int = -1, t_last: float = 1.0) -> DataFrame:
    """Add ``t`` and ``k`` to each segment of ``tunnels (tunnel, segment, ...)``, its end excluded.

    ``first`` and ``last`` choose a part of the tunnel (-1: all); the first segment then begins at
    ``t_first`` and the last ends at ``t_last``.
    """
    part = tunnels.where((F.col("segment") >= max(first, 0)) & (F.col("segment") <= last if last != -1 else F.lit(True)))
    start = F.when(F.col("segment") == first, F.lit(float(t_first))).otherwise(F.lit(0.0))
    stop = F.when(F.col("segment") == last, F.lit(float(t_last))).otherwise(F.lit(1.0))
    count = F.ceil((stop - start) / F.lit(float(step))).cast("int")
    return part.withColumn("k", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)))).withColumn("t", start + F.col("k") * F.lit(float(step)))


def rings(n: int, scale: float = 1.0):
    """Ring points of each shape as one array expression of structs ``(v, u, w)``: v numbers a ring's vertices.

    ``u`` points down from the ring's base and ``w`` sideways, in the ring's own plane.
    """
    r, w, h = F.col("radius") * scale, F.col("width") * scale, F.col("height") * scale
    whole = F.sequence(F.lit(0), F.lit(n - 1))
    point = lambda v, a, b: F.struct(v.alias("v"), a.cast("double").alias("u"), b.cast("double").alias("w"))

    def on_circle(v: Column) -> Column:
        angle = (n - 1 - v) * (2 * 3.141592653589793) / n
        return point(v, -(F.sin(angle) * r + r), -(F.cos(angle) * r))

    around = 2 * w + 2 * h
    walked = lambda v: around * v / n
    side = lambda v: F.when(walked(v) < h, 0).when(walked(v) < h + w, 1).when(walked(v) < 2 * h + w, 2).otherwise(3)

    def on_rectangle(sides: Column, v: Column) -> Column:
        d, s = walked(v), side(v)
        opens = (F.array_position(sides, s) == v + 1) & (F.forall(F.sequence(F.lit(0), s), lambda q: F.array_contains(sides, q)))
        u = F.when(s == 0, F.when(opens, F.lit(0.0)).otherwise(-d)).when(s == 1, -h).when(s == 2, F.when(opens, -h).otherwise(-(2 * h + w - d))).otherwise(F.lit(0.0))
        x = F.when(s == 0, w / 2).when(s == 1, F.when(opens, w / 2).otherwise(-(d - h - w / 2))).when(s == 2, -w / 2).otherwise(F.when(opens, -w / 2).otherwise(-(2 * h + 1.5 * w - d)))
        return point(v, u, x)

    a, b, pieces = w / 2, h, 400
    speed = lambda t: F.sqrt(a * a * F.cos(t) * F.cos(t) + b * b * F.sin(t) * F.sin(t))
    width = 1.5707963267948966 / pieces
    weight = lambda i: F.when((i == 0) | (i == pieces), 1).when(i % 2 == 1, 4).otherwise(2)
    arc = 2 * F.aggregate(F.sequence(F.lit(0), F.lit(pieces)), F.lit(0.0), lambda acc, i: acc + speed(i * width) * weight(i)) * (width / 3)
    counted = let(arc, lambda length: F.floor(length * n / (w + length)).cast("int"))

    def on_ellipse(curved: Column, v: Column) -> Column:
        straight = F.lit(n) - curved
        at = v - straight
        t = linspace(F.lit(-1.5707963267948966), F.lit(1.5707963267948966), curved, at)
        chord = v < straight
        return point(v, F.when(chord, F.lit(0.0)).otherwise(-b * F.cos(t)), F.when(chord, w / 2 - w * v / straight).otherwise(-a * F.sin(t)))

    return {"Circle": F.transform(whole, on_circle), "Rectangle": let(F.transform(whole, side), lambda s: F.transform(whole, lambda v: on_rectangle(s, v))), "Elliptic": let(counted, lambda c: F.transform(whole, lambda v: on_ellipse(c, v)))}
