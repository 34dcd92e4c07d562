"""Writers: meshes, voxels, section results, manifests, timing stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def output_name(kind: Column, name: Column, n: Column | None = None) -> Column:
    """``rank_3``, ``fault_F1``, and ``mesh_0`` by number."""
    return F.when(kind == "mesh", F.concat(F.lit("mesh_"), (n if n is not None else name).cast("string"))).otherwise(F.concat(kind, F.lit("_"), name.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``n`` from 0 in the given order; for a job's outputs, which are few, so one task may order them."""
    return rows.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1)


def off_text(vertices: DataFrame, faces: DataFrame, key: str = "mesh_id", digits: int = 3) -> DataFrame:
    """``(mesh_id, value)``: one mesh file's text per row, vertices rounded half to even."""
    number = lambda c: F.regexp_replace(F.format_string(f"%.{digits}f", F.bround(F.col(c), digits) + F.lit(0.0)), r"(\.[0-9]*?)0+$", "$1")
    v = vertices.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("v", F.concat_ws(" ", *[F.regexp_replace(number(c), r"\.$", ".0") for c in "xyz"]).alias("s")))).alias("vs"))
    f = faces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("f", F.concat_ws(" ", F.lit("3"), "a", "b", "c").alias("s")))).alias("fs"))
    head = F.format_string("%d %d 0", F.size("vs"), F.size("fs"))
    lines = F.concat(F.array(F.lit("OFF"), head), F.transform("vs", lambda x: x["s"]), F.transform("fs", lambda x: x["s"]))
    return v.join(f, key).select(key, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def write_off(vertices: DataFrame, faces: DataFrame, path: str, key: str = "mesh_id") -> None:
    """One folder per mesh name; every mesh is a row of its own, so files are written where meshes lie."""
    # the writer ends each row by a line feed of its own
    rows = off_text(vertices, faces, key).select(key, F.regexp_replace("value", "\n$", "").alias("value"))
    rows.write.mode("overwrite").partitionBy(key).text(path)


def vox_lines(voxels: DataFrame) -> DataFrame:
    """Lines ``rank gwb_id`` in z, y, x order, ranges of it in order across partitions."""
    return voxels.orderBy("iz", "iy", "ix").select(F.concat_ws(" ", F.col("rank").cast("string"), F.col("gwb_id").cast("string")).alias("value"))


def vox_header(box: tuple, shape: tuple) -> str:
    low = " ".join(f"{a.upper()}MIN={v}" for a, v in zip("xyz", box[:3], strict=True))
    high = " ".join(f"{a.upper()}MAX={v}" for a, v in zip("xyz", box[3:], strict=True))
    return f"{low} {high} " + " ".join(f"NUMBER{a.upper()}={n}" for a, n in zip("xyz", shape, strict=True)) + " NOVALUE=0"


def write_vox(voxels: DataFrame, path: str, box: tuple, shape: tuple) -> None:
    """Part files in order, the header and the column line first in the first one."""
    spark = voxels.sparkSession
    head = spark.createDataFrame([(0, vox_header(box, shape)), (1, "rank gwb_id")], "k int, value string").select(F.lit(-1).alias("iz"), F.col("k").alias("iy"), F.lit(0).alias("ix"), "value")
    lines = voxels.select("iz", "iy", "ix", F.concat_ws(" ", F.col("rank").cast("string"), F.col("gwb_id").cast("string")).alias("value"))
    head.unionByName(lines).orderBy("iz", "iy", "ix").select("value").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Compact JSON, a line per row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def manifest(outputs: DataFrame) -> DataFrame:
    """One JSON text: kind to name to paths, from ``(kind, name, path)`` rows of a job's outputs."""
    named = outputs.groupBy("kind", "name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    kinds = named.groupBy("kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "paths")))).alias("names"))
    by_kind = F.transform(F.array_sort(F.collect_list(F.struct("kind", F.map_entries("names").alias("names")))), lambda k: F.struct(k["kind"].alias("kind"), F.map_from_entries(k["names"]).alias("names")))
    return kinds.agg(F.to_json(F.map_from_entries(by_kind)).alias("value"))


def aquifer_report(aquifers: DataFrame) -> DataFrame:
    """``(value)``: a JSON object per aquifer with its file, unit, spring and volume; an error when there is none."""
    if aquifers.isEmpty():
        raise ValueError("no aquifer was found")
    rows = numbered(aquifers, "spring_id", "unit_id", "component")
    return rows.select(F.to_json(F.struct(F.concat(F.lit("mesh_"), "n", F.lit(".off")).alias("file"), F.col("unit_id").alias("unitId"), F.col("spring_id").alias("springId"), "volume")).alias("value"))


def write_profile_csv(profile: DataFrame, path: str, steps: list[str]) -> None:
    """Append timings in ms with five decimals, ``;``-separated, by computation and version."""
    took = lambda s: F.try_element_at("steps", F.lit(s))
    cells = [F.when(took(s).isNotNull(), F.format_string("%.5f", took(s) * 1000)).alias(s) for s in steps]
    profile.select("computation", "version", "start_time", *cells).write.mode("append").partitionBy("computation", "version").option("sep", ";").option("header", True).csv(path)


def append_profile_json(profile: DataFrame, path: str, mode: str = "append") -> None:
    """Append entries ``{metadata, steps}`` in ms rounded to five decimals, by computation and version."""
    steps = F.transform_values("steps", lambda _, s: F.round(s * 1000, 5))
    metadata = F.map_concat(F.map_filter("metadata", lambda k, _: k != "start_time"), F.create_map(F.lit("start_time"), F.col("start_time").cast("string"))) if "metadata" in profile.columns else F.create_map(F.lit("start_time"), F.col("start_time").cast("string"))
    profile.select("computation", "version", metadata.alias("metadata"), steps.alias("steps")).write.mode(mode).partitionBy("computation", "version").json(path)
