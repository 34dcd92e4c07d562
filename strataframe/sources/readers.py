"""Readers: terrain grids, meshes, job descriptions, points, timing stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataframe.operators.spatial import small
from strataframe.runtime import cut

_BOX = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
_POINT = "struct<x:double,y:double,z:double>"
SECTIONS_JOB = f"toCompute map<string,array<{_BOX}>>, resolution int, computeMap boolean, springs map<string,{_POINT}>, drillholes map<string,{_BOX}>"
MESH_JOB = f"resolution struct<x:int,y:int,z:int>, box {_BOX}"
TUNNEL_JOB = "tunnels array<struct<name:string,shape:string,radius:double,width:double,height:double,functions:array<struct<x:array<double>,y:array<double>,z:array<double>>>>>, step double, nb_vertices int, idxStart int, idxEnd int, tStart double, tEnd double"


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """Add each line's number within its ``file``, from 0, as ``name``.

    Lines are read by byte ranges (``block``), in order within each; one row a range tells how many lines lie in
    those before it.  That table is stored, so it is counted before it is broadcast.
    """
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = cut(placed.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")
    return placed.join(small(blocks.select("file", "block", start)), ["file", "block"]).withColumn(name, F.col("_id") + F.col("_start")).drop("_id", "_start")


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """Cells ``(ix, iy, x, y, z)`` of ASCII grids, read by byte ranges, so that a grid of any size lies in many tasks.

    The header is read by place: corner x, corner y and cell size on lines 3 to 5; a seventh line that
    names the no-data value is skipped, its value is not masked.  Blank lines among the rows are passed over, row 0
    of the result is the south, and a word that is no number gives null.  Lines are counted once and read twice.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("line"))
    head = _numbered(text, "no").where("no < 8").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("no", "line"))).alias("l"))
    named = lambda i: F.coalesce(F.upper(F.try_element_at("l", F.lit(i).cast("long"))).startswith("NODATA"), F.lit(False))
    number = lambda i: F.element_at(_words(F.try_element_at("l", F.lit(i).cast("long"))), -1).try_cast("double")
    skipped = F.when(~named(5) & named(6), 7).otherwise(6)
    above = F.size(F.filter(F.map_entries("l"), lambda e: (e["key"] < F.col("skipped")) & (e["value"] != "")))
    laid = cut(head.withColumn("skipped", skipped).select("file", number(2).alias("x0"), number(3).alias("y0"), number(4).alias("c"), above.alias("above")))
    full = _numbered(text.where("line <> ''"), "at")
    ends = cut(full.groupBy("file").agg((F.max("at") + 1).alias("n")))
    rows = full.drop("block").join(small(laid.join(ends, "file")), "file").where("at >= above")
    cells = rows.select("x0", "y0", "c", (F.col("n") - 1 - F.col("at")).cast("int").alias("iy"), F.posexplode(_words(F.col("line"))).alias("ix", "z"))
    return cells.select("ix", "iy", (F.col("x0") + F.col("ix") * F.col("c")).alias("x"), (F.col("y0") + F.col("iy") * F.col("c")).alias("y"), F.col("z").try_cast("double").alias("z"))


def _off(spark: SparkSession, path: str) -> DataFrame:
    """Mesh files whose first bytes say that they are text meshes, as lines without blanks and comments."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).where(F.substring("content", 1, 3) == F.lit(b"OFF"))
    lines = F.filter(F.transform(_lines(F.decode("content", "UTF-8")), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    parsed = files.select(F.element_at(F.split("path", "/"), -1).alias("mesh_id"), lines.alias("l"))
    counts = F.transform(_words(F.get("l", F.lit(1))), lambda w: w.try_cast("int"))
    return parsed.withColumn("nv", F.get(counts, F.lit(0))).withColumn("nf", F.get(counts, F.lit(1)))


def read_off(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices ``(mesh_id, v, x, y, z)``, faces ``(mesh_id, f, a, b, c)`` and rejected files of ``path``.

    A file is rejected if its first line is not OFF, a count is missing or a face has not three vertices;
    strict reading fails on the first such file instead.
    """
    files = _off(spark, path)
    faces = F.slice("l", F.col("nv") + 3, F.col("nf"))
    good = (F.get("l", F.lit(0)) == "OFF") & F.col("nv").isNotNull() & F.col("nf").isNotNull() & (F.size("l") >= F.col("nv") + F.col("nf") + 2) & F.forall(faces, lambda f: F.get(_words(f), F.lit(0)) == "3")
    judged = files.withColumn("ok", F.coalesce(good, F.lit(False)))
    if strict:
        judged = judged.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(F.concat(F.lit("not a triangle mesh: "), "mesh_id")).cast("boolean")))
    kept = judged.where("ok")
    v = kept.select("mesh_id", F.posexplode(F.slice("l", F.lit(3), F.col("nv"))).alias("v", "s")).select("mesh_id", "v", *[F.get(_words(F.col("s")), F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])
    f = kept.select("mesh_id", F.posexplode(faces).alias("f", "s")).select("mesh_id", "f", *[F.get(_words(F.col("s")), F.lit(i + 1)).cast("int").alias(a) for i, a in enumerate("abc")])
    return v, f, judged.where("NOT ok").select("mesh_id")


def triangles(vertices: DataFrame, faces: DataFrame, key: str = "mesh_id") -> DataFrame:
    """The work form ``(mesh_id, f, ax..cz)``: each face corner asks for its vertex once."""
    corners = faces.select(key, "f", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("v")) for p in "abc"])).alias("c")).select(key, "f", "c.p", "c.v")
    met = corners.join(vertices, [key, "v"])
    pick = [F.max(F.when(F.col("p") == p, F.col(a))).alias(f"{p}{a}") for p in "abc" for a in "xyz"]
    return met.groupBy(key, "f").agg(*pick)


def read_job(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """A job file as tables: ``sections``, ``springs``, ``drillholes``, ``params``; or ``tunnels``; or ``params``."""
    if kind == "meshes":
        return {"params": spark.read.schema(MESH_JOB).json(path, multiLine=True)}
    if kind == "tunnels":
        job = spark.read.schema(TUNNEL_JOB).json(path, multiLine=True)
        t = job.select(F.posexplode("tunnels").alias("tunnel", "t")).select("tunnel", "t.name", "t.shape", "t.radius", "t.width", "t.height", F.posexplode("t.functions").alias("segment", "fn"))
        return {"tunnels": t.select("*", F.col("fn.x").alias("fx"), F.col("fn.y").alias("fy"), F.col("fn.z").alias("fz")).drop("fn"), "params": job.drop("tunnels")}
    job = spark.read.schema(SECTIONS_JOB).json(path, multiLine=True)
    sections = job.select("resolution", F.explode("toCompute").alias("section_id", "boxes")).select("section_id", "resolution", F.posexplode("boxes").alias("seg", "b")).select("section_id", "seg", "resolution", "b.*")
    springs = job.select(F.explode("springs").alias("id", "p")).select("id", "p.*")
    holes = job.select(F.explode("drillholes").alias("id", "b")).select("id", F.col("b.xmin").alias("x0"), F.col("b.ymin").alias("y0"), F.col("b.zmin").alias("z0"), F.col("b.xmax").alias("x1"), F.col("b.ymax").alias("y1"), F.col("b.zmax").alias("z1"))
    return {"sections": sections, "springs": springs, "drillholes": holes, "params": job.select("resolution", "computeMap")}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"points array<{_POINT}>").json(path, multiLine=True).select(F.explode("points").alias("p")).select("p.*")


def read_profile_csv(spark: SparkSession, path: str, steps: list[str]) -> DataFrame:
    """Timings in ms, ``;``-separated: start time, then steps; from ``<computation>_v<version>.csv`` files, or from the
    folders by computation and version that ``write_profile_csv`` makes."""
    schema = ", ".join(["start_time timestamp", *[f"`{s}` double" for s in steps]])
    rows = spark.read.schema(schema).option("sep", ";").option("header", True).csv(path).withColumn("_f", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    if "computation" in rows.columns:
        named = rows.withColumns({"computation": F.col("computation").cast("string"), "version": F.col("version").cast("int")})
    else:
        named = rows.withColumns({"computation": F.regexp_extract("_f", r"^(.*)_v[0-9]+", 1), "version": F.regexp_extract("_f", r"_v([0-9]+)", 1).cast("int")})
    entries = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), (F.col(f"`{s}`") / 1000).alias("value")) for s in steps]), lambda e: e["value"].isNotNull())
    return named.select("computation", "version", "start_time", F.map_from_entries(entries).alias("steps"))


def read_profile_json(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """Entries of the profile store, partitioned by computation and version; steps in ms.

    ``path`` may name several folders of the store ``base``, none included.
    """
    schema = "computation string, version int, metadata map<string,string>, steps map<string,double>"
    read = spark.read.schema(schema) if base is None else spark.read.schema(schema).option("basePath", base)
    rows = read.json(path) if path else spark.createDataFrame([], schema)
    rows = rows.select("computation", "version", "metadata", "steps")
    return rows.withColumn("start_time", F.to_timestamp(F.try_element_at("metadata", F.lit("start_time"))))


def list_profile_versions(keys: DataFrame, computation: str, key: str = "key") -> DataFrame:
    """Versions named by store keys ``profiling:<computation>:v<n>``."""
    mine = keys.where(F.col(key).startswith(f"profiling:{computation}:"))
    return mine.select(F.regexp_extract(key, r"(v[0-9]+)$", 1).alias("version")).where("version <> ''").distinct()
