"""Results of mesh jobs put together: named surfaces, grouped meshes, evaluator hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strataframe.functions.vector import fan
from strataframe.operators.meshes import extract_surfaces


def named_faces(faces: DataFrame, names: DataFrame, prefixes: tuple[str, ...] = ("base-", "top-")) -> DataFrame:
    """Faces ``(part, face)`` with the ``name`` of their surface, its prefix taken off; unknown parts are dropped."""
    bare: Column = F.col("name")
    for p in prefixes:
        bare = F.when(F.col("name").startswith(p), F.substring(F.col("name"), len(p) + 1, 1 << 20)).otherwise(bare)
    return faces.join(names, "part").withColumn("name", bare)


def grouped_faces(faces: DataFrame, key: str = "part", f: str = "f") -> DataFrame:
    """Faces of a part gathered in face order."""
    return faces.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(f, "face"))), lambda s: s["face"]).alias("faces"))


def triangulated(faces: DataFrame) -> DataFrame:
    """Polygon faces as triangles; a list that is one already stays as it is."""
    return faces.select("*", F.posexplode(fan(F.col("face"))).alias("part_of_face", "tri")).drop("face")


def gwb_groups(meshes: DataFrame) -> DataFrame:
    """Meshes of each groundwater body, in mesh order."""
    return meshes.groupBy("gwb_id").agg(F.sort_array(F.collect_list("mesh_id")).alias("meshes"))


def unit_meshes(spark: SparkSession, ranks: DataFrame, series: DataFrame) -> DataFrame:
    """Closed surfaces as ``(kind, name, f, ax..cz)``: one per rank, named after the unit that it bounds."""
    named = series.select(F.col("unit").alias("rank"), F.when(F.col("reference") == "base", F.col("unit") - 1).otherwise(F.col("unit")).alias("unit_id"))
    return extract_surfaces(spark, ranks).join(named, "rank").withColumn("kind", F.lit("mesh")).withColumn("name", F.concat(F.lit("rank_"), F.col("unit_id").cast("string"))).drop("rank", "unit_id")


def fault_meshes(faces: DataFrame, faults: DataFrame) -> DataFrame:
    """Triangles of the polygon faces of known faults as ``(kind, name, f, part_of_face, tri)``."""
    known = faces.join(faults.select(F.col("fault").cast("string").alias("part")), "part", "left_semi")
    return triangulated(known).select(F.lit("fault").alias("kind"), F.concat(F.lit("fault_"), "part").alias("name"), "f", "part_of_face", "tri")


def job_meshes(units: DataFrame, fault_tris: DataFrame) -> DataFrame:
    """Outputs of a mesh job: units and, where there are any, faults, by kind and name."""
    counted = lambda df: df.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("triangles"))
    return counted(units).unionByName(counted(fault_tris))


def fault_names(faults: DataFrame) -> DataFrame:
    """Names from the fault data and from the lists of faults that they stop on."""
    return faults.select("fault").union(faults.select(F.explode("stops_on"))).distinct()


def has_hydro_layer(springs: int, drillholes: int, gwb_meshes: int) -> bool:
    """Whether a section job has anything to put on its water layer."""
    return springs > 0 or drillholes > 0 or gwb_meshes > 0


def tag_gwb(inside: Column, gwb_id: Column) -> Column:
    return F.when(inside, gwb_id).otherwise(F.lit(0))


def with_field(points: DataFrame, evaluate: Callable[[pd.DataFrame], pd.Series], name: str) -> DataFrame:
    """Add a field that a caller's vectorised evaluator computes from batches of points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: evaluate(frame)})

    return points.mapInPandas(run, StructType([*points.schema.fields, StructField(name, DoubleType())]))
