"""Column expressions: vectors, projections, rounding, half-even counts, polynomial paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; keeps long expressions from being repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(v: Vec) -> Column:
    return F.struct(*[c.cast("double").alias(a) for a, c in zip("xyz", v, strict=True)])


def unpack(c: Column) -> Vec:
    return (c["x"], c["y"], c["z"])


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """A vector of length one; null for the null vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return scale(a, 1 / n)


def rotate(axis: Vec, angle: Column, p: Vec) -> Vec:
    """Turn ``p`` about a unit axis (Rodrigues): p cos a + (axis x p) sin a + axis (axis . p)(1 - cos a)."""
    c, s = F.cos(angle), F.sin(angle)
    side, along = cross(axis, p), dot(axis, p)
    return tuple(p[i] * c + side[i] * s + axis[i] * along * (1 - c) for i in range(3))


def half_even(value: Column) -> Column:
    return F.bround(value, 0)


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def section_plane(prefix: str = "") -> tuple[Vec, Vec]:
    """Lower-left corner and unit normal of the plane through a section's box corners."""
    low = vec(f"{prefix}xmin", f"{prefix}ymin", f"{prefix}zmin")
    high = vec(f"{prefix}xmax", f"{prefix}ymax", f"{prefix}zmax")
    up = (low[0], low[1], high[2])
    return low, unit(cross(sub(high, low), sub(up, low)))


def widen_vertical(name: str, sign: int) -> Column:
    """A corner in x or y, moved by one outwards where the section's rounded extent is 0 both ways."""
    flat = (half_even(F.col("xmax")) == half_even(F.col("xmin"))) & (half_even(F.col("ymax")) == half_even(F.col("ymin")))
    return F.when(flat, F.col(name) + sign).otherwise(F.col(name))


def polynomial(coefficients: list[Column], t: Column) -> Column:
    """Horner's scheme, lowest power first."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def derivative(coefficients: list[Column]) -> list[Column]:
    return [c * k for k, c in enumerate(coefficients)][1:] or [F.lit(0.0)]


def clip_null(value: Column, clipped: Column) -> Column:
    """Null where the condition holds; a null condition clips nothing."""
    return F.when(~F.coalesce(clipped, F.lit(False)), value)


def linspace(start: Column, stop: Column, n: Column, i: Column) -> Column:
    """The i-th of n even steps; the last is the stop itself and a single one the start."""
    step = start + i * ((stop - start) / F.greatest(n - 1, F.lit(1)))
    return F.when((i == n - 1) & (n > 1), stop).otherwise(step)


def fan(face: Column) -> Column:
    """Triangles of a polygon's vertex list, fanned from its first vertex; fewer than three is an error."""
    cut = F.transform(F.sequence(F.lit(1), F.size(face) - 2), lambda i: F.array(F.get(face, F.lit(0)), F.get(face, i), F.get(face, i + 1)))
    return F.when(F.size(face) == 3, F.array(face)).when(F.size(face) > 3, cut).otherwise(F.raise_error(F.lit("a face needs three vertices or more")))


def parse_metadata(text: Column) -> Column:
    """A JSON object of strings; anything else is null."""
    return F.from_json(text, "map<string,string>")


def merge_metadata(base: Column, extra: Column) -> Column:
    """Both maps, the keys of ``extra`` first in line."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.when(extra.isNull(), base).when(base.isNull(), extra).otherwise(F.map_concat(kept, extra))


def relabel_container(name: Column) -> Column:
    return F.regexp_replace(name, "^/(.*)$", "$1")


def label_match(label: Column, pattern: str) -> Column:
    return label.rlike(f"^(?:{pattern})$")


def gwb_id_from_name(name: Column) -> Column:
    """``12_a``, ``mesh_12_a.off`` and ``12.off`` all belong to body 12."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^(?:mesh_)?([0-9]+)(?:_.*)?(?:\.off)?$", 1).try_cast("int")
